"""SimHash near-duplicates: fingerprints joined on a grid of per-segment bit counts.

A fingerprint is cut into segments, and the count of set bits in each segment
embeds it in a small integer space.  One differing bit moves one coordinate by
one, so the Manhattan distance of two embeddings is a lower bound of their
Hamming distance.  Two points at Manhattan distance 2 or less have a grid cell
that is at most one step from both, so each point visits its own cell and the
cells one step away, and points that share a cell are the candidates; the exact
Hamming distance then decides.

Sizes: only distinct fingerprints are joined, and of those only distinct points
meet in cells, so no cell has more than 2 * segments + 1 members, whatever the
data.  Points that hold so many fingerprints that their pairs would not be
bounded go through the finest grid instead (segments of one bit, where the
embedding is the fingerprint and the bound is exact): there a cell has at most
65 members, all linked, and a star replaces their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinforge.llm.components import connected_components, spread_join
from basinforge.llm.textcols import checkpointed, release, slices, text_bytes, tidied

#: The grid join needs a cell one step from both points.
MAX_BITS = 2
#: Pairs of fingerprints that two points may make before the finest grid takes over.
MAX_PAIRS = 1024
_STEP = 1 << 17


def simhash(text: bytes, shingle: int, seed: int = 42) -> int:
    """Fingerprint of a text's word shingles, as a signed 64-bit integer; 0 without words."""
    words = text.lower().split()
    n = max(len(words) - shingle + 1, 1)
    if not words:
        return 0
    if n == 1:
        return int(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64).view(np.int64)[0])
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts, stops)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, fp) of every row; A-Z are lower-cased, words are what ASCII white space separates."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, 1):
            known: dict[bytes, int] = {}  # copies often stand together
            fps = []
            for text in batch.column(1).to_pylist():
                fp = known.get(text)
                if fp is None:
                    fp = known[text] = simhash(text, shingle, seed)
                fps.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=schema.names)

    return docs.select(docs[id_col].alias(id_col), text_bytes(docs, text_col).alias("__text")).mapInArrow(tidied(run), schema)


def segment_counts(fp: Column, segment_bits: int = 4) -> Column:
    """Set bits of each segment, in lanes of ``segment_bits`` bits of one long (1, 4 or 8)."""
    if segment_bits == 1:
        return fp
    ones = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(ones), F.shiftrightunsigned(fp, 1).bitwiseAND(ones)
    x = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))  # a sum could overflow
    low = F.lit(0x3333333333333333)
    x = x.bitwiseAND(low) + F.shiftrightunsigned(x, 2).bitwiseAND(low)
    if segment_bits == 8:
        x = (x + F.shiftrightunsigned(x, 4)).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))
    return x


def grid_cells(point: Column, segment_bits: int = 4) -> Column:
    """The point's own cell and those one step away; steps off the grid are null."""
    cells = [point]
    for shift in range(0, 64, segment_bits):
        if segment_bits == 1:
            cells.append(point.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), shift)))
            continue
        lane = F.shiftrightunsigned(point, shift).bitwiseAND(F.lit((1 << segment_bits) - 1))
        step = F.lit(1 << shift)
        cells += [F.when(lane < segment_bits, point + step), F.when(lane > 0, point - step)]
    return F.array(*cells)


def bit_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, segment_bits: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect just what differs in ``max_bits`` bits or fewer.

    ``fps`` has one row per fingerprint in its column ``fp``.  Pairs in the
    finest grid come as stars: every link is real, and what is linked is
    connected, but not each pair has its own row.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    at = fps.select("fp", segment_counts(F.col("fp"), segment_bits).alias("point"))
    points = at.groupBy("point").agg(F.count(F.lit(1)).alias("n"))
    # few bytes come before the explosion into cells and many behind it, so the partitions must not be merged
    points = points.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "point")
    met = (
        points.select(F.struct("point", "n").alias("p"), F.explode(grid_cells(F.col("point"), segment_bits)).alias("cell"))
        .where(F.col("cell").isNotNull())
        .groupBy("cell")
        .agg(F.collect_list("p").alias("ps"))
        .where(F.size("ps") > 1)
    )
    p, q = F.col("p"), F.col("q")
    pairs = (
        met.select("ps", F.explode("ps").alias("p"))
        .select("p", F.explode("ps").alias("q"))
        .where(p["point"] < q["point"])
        .select(p["point"].alias("p"), q["point"].alias("q"), p["n"].alias("pn"), q["n"].alias("qn"))
        .distinct()
        .unionByName(points.where("n > 1").select(F.col("point").alias("p"), F.col("point").alias("q"), F.col("n").alias("pn"), F.col("n").alias("qn")))
    )
    pairs = checkpointed(pairs)
    left, right = (at.select(F.col("point").alias(k), F.col("fp").alias(v)) for k, v in (("p", "a"), ("q", "b")))
    links = (
        pairs.where(F.col("pn") * F.col("qn") <= MAX_PAIRS)
        .join(left, "p")
        .join(right, "q")
        .where((F.col("p") != F.col("q")) | (F.col("a") < F.col("b")))
        .where(bit_distance(F.col("a"), F.col("b")) <= max_bits)
        .select("a", "b")
    )
    crowded = pairs.where(F.col("pn") * F.col("qn") > MAX_PAIRS)
    crowded = crowded.select(F.explode(F.array("p", "q")).alias("point")).distinct()
    fine = (
        at.join(crowded, "point", "left_semi")
        .select("fp", F.explode(grid_cells(F.col("fp"), 1)).alias("cell"))
        .groupBy("cell")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        # the members are one bit from the cell: two bits join them all, one bit only with the cell's own fingerprint
        .where(F.lit(max_bits == 2) | F.array_contains("fps", F.col("cell")))
        .select((F.array_min("fps") if max_bits == 2 else F.col("cell")).alias("a"), F.explode("fps").alias("b"))
        .where((F.col("a") != F.col("b")) & (bit_distance(F.col("a"), F.col("b")) <= max_bits))
        .select("a", "b")
    )
    return links.unionByName(fine)


def near_duplicates(
    docs: DataFrame, shingle: int = 5, max_bits: int = MAX_BITS, segment_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id) of every row; the component is the least id reachable over linked fingerprints.

    A null or wordless text has fingerprint zero and is linked like any other.
    Rows with a null id have their fingerprint's component, which is null if all its
    ids are.  Repeated rows give repeated results.  An empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    fps = checkpointed(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    groups = connected_components(near_links(fps, max_bits, segment_bits), "a", "b").withColumnRenamed("node", "fp")
    grouped = fps.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    firsts = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = spread_join(grouped, firsts, "component").select("fp", "component_id")
    return rows.join(ids, "fp").select(id_col, "fp", "component_id")
