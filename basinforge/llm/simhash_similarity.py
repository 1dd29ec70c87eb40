"""Near-duplicates by SimHash fingerprints, and beyond their reach at a stated Jaccard similarity of word shingles by an exact prefix filter.

Two bits of 64, as far as the grid of ``simhash`` reaches, is a similarity of
about 0.97: with ``bits`` what that grid links is linked, and its groups need no more pairs.  Beyond that, cells of longer fingerprints must grow with the table, so that
near copies found in a small one are lost in a large one.  Here candidates do not
depend on the number of documents: with the shingles of each text in one order,
the rarest first, two texts that are ``t`` alike share one of the first
``n - ceil(t n) + 1`` of their ``n`` shingles.  A link is a pair whose sets of
shingles are ``t`` alike, counted exactly.

Shingles are known by 64-bit hashes.  Those of one text only can neither be shared
nor lead to a candidate, and are dropped as soon as they are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinforge.llm import simhash
from basinforge.llm.components import connected_components, spread_join
from basinforge.llm.textcols import checkpointed, forget, release, slices, text_bytes, tidied

_STEP = 1 << 16
#: Words of a fingerprint's shingles, as in op1.
FINGERPRINT_SHINGLE = 3


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the text's distinct shingles, ascending; a shorter text is one shingle."""
    words = text.lower().split()
    parts = []
    n = max(len(words) - shingle + 1, 1) if words else 0
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        stops = (ends[min(shingle, len(part)) - 1 :] - 1).tolist()
        starts = [0, *ends[: len(stops) - 1].tolist()]
        parts.append(np.array([digest(joined[i:j], 7) for i, j in zip(starts, stops)], np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def set_keys(docs: DataFrame, shingle: int, id_col: str, text_col: str, fingerprint: bool = False) -> DataFrame:
    """(id, hash of the text, node: hash of its set of shingles, n: their number, and fp: its SimHash, or null)."""
    longs = [T.StructField(c, T.LongType()) for c in ("hash", "node", "n", "fp")]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *longs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, 2, 8 << 20, 1024):
            known: dict[bytes, tuple[int, int, int | None]] = {}
            for t in batch.column(2).to_pylist():
                if t not in known:
                    h = shingle_set(t, shingle)
                    known[t] = _node(h), len(h), simhash.simhash(t, FINGERPRINT_SHINGLE) if fingerprint else None
            both = [known[t] for t in batch.column(2).to_pylist()]
            columns = [pa.array([x[k] for x in both], pa.int64()) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("hash"), text_bytes(docs, text_col).alias("text")).mapInArrow(tidied(run), schema)


def shared_shingles(docs: DataFrame, shingle: int, buckets: int, text_col: str) -> DataFrame:
    """(node, n, token, df) of every shingle that two nodes or more have; df is the number of those nodes.

    Shingles travel in blocks, one for each slice of documents and bucket of hashes.
    """
    kinds = [("bucket", pa.int64()), ("tokens", pa.binary()), ("at", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, 0, 8 << 20, 1024):
            sets = {_node(h): h for t in set(batch.column(0).to_pylist()) if len(h := shingle_set(t, shingle))}
            if not sets:
                continue
            nodes, sizes = np.array(list(sets), "<i8"), np.array([len(h) for h in sets.values()], "<i4")
            tokens = np.concatenate(list(sets.values()))
            order = np.argsort(tokens)
            tokens, at = tokens[order], np.repeat(np.arange(len(nodes), dtype="<u2"), sizes)[order]
            bucket = (tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(tokens)]):
                used, mine = np.unique(at[i:j], return_inverse=True)
                rows.append((int(bucket[i]), tokens[i:j].tobytes(), mine.astype("<u2").tobytes(), nodes[used].tobytes(), sizes[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    def count(table: pa.Table) -> pa.Table:
        blocks = [[np.frombuffer(x, d) for x in table.column(c).to_pylist()] for c, d in (("tokens", "<u8"), ("at", "<u2"), ("nodes", "<i8"), ("sizes", "<i4"))]
        token = np.concatenate(blocks[0])
        node = np.concatenate([n[a] for a, n in zip(blocks[1], blocks[2])])
        size = np.concatenate([n[a] for a, n in zip(blocks[1], blocks[3])])
        order = np.argsort(token, kind="stable")
        again = token[order]
        same = again[1:] == again[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]  # those of one text are gone
        order = order[np.lexsort((node[order], token[order]))]
        token, node, size = token[order], node[order], size[order]
        first = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])][: len(token)]
        token, node, size = token[first], node[first], size[first]
        _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
        df = counts[inverse] if len(token) else np.zeros(0, np.int64)
        kept = df > 1
        return pa.table({"node": node[kept], "n": size[kept].astype(np.int64), "token": token[kept].view(np.int64), "df": df[kept].astype(np.int64)})

    blocks = docs.select(text_bytes(docs, text_col).alias("text")).mapInArrow(tidied(deal), "bucket long, tokens binary, at binary, nodes binary, sizes binary")
    return blocks.groupBy("bucket").applyInArrow(tidied(count), "node long, n long, token long, df long")


#: Texts that share a shingle of their prefixes, up to which all pairs of them are tested at once. In larger blocks each is
#: tested with some leaders first, and then all pairs that are not in one group by then.
CROWD, LEADERS, ROUNDS = 16, 2, 2


def _linked(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike; what two sets share is among the shingles that ``nodes`` keeps."""
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"of_{c}")) for c in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(x, "a").join(y, "b").where(common * (1 + similarity) >= (F.col("n_a") + F.col("n_b")) * similarity - 1e-6).select("a", "b")


def _entries(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, n, own, token, inner, most) of each text's prefix.

    If the shingle in place k is the first that a text shares with another, they share at most those from there on;
    ``most`` is the largest number of shingles that the other may have for the two to be alike.
    """
    least = F.ceil(F.col("n") * similarity - 1e-6)
    own = F.col("n") - F.size("tokens")  # shingles of this text only come first
    prefix = F.slice("tokens", F.lit(1), F.greatest(F.col("n") - least + 1 - own, F.lit(0)).cast("int"))
    # of two sets the smaller shares one of still fewer
    inner = F.col("own") + F.col("k") < F.col("n") - F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-6) + 1
    most = F.floor((F.col("n") - F.col("own") - F.col("k")) * ((1 + similarity) / similarity) + 1e-6) - F.col("n")
    return nodes.select("node", "n", own.alias("own"), F.posexplode(prefix).alias("k", "token")).select("node", "n", "own", "token", inner.alias("inner"), most.alias("most"))


def _may_pair(x, y, similarity: float):
    """Whether the entry of the smaller set ``x`` and that of ``y`` can be of texts that are alike."""
    return (F.struct(x("n"), x("node")) < F.struct(y("n"), y("node"))) & x("inner") & (x("n") >= y("n") * similarity - 1e-6) & (y("n") <= x("most")) & (x("n") <= y("most"))


def _block_pairs(entries: DataFrame, similarity: float, *differ: str) -> DataFrame:
    """All pairs (a, b) that share a shingle of their prefixes, a the smaller set; those alike in a column of ``differ`` are left out."""
    x, y = (entries.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "inner", "most", *differ)]) for k in "xy")
    may = _may_pair(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"), similarity)
    for c in differ:
        may = may & (F.col(f"{c}_x") != F.col(f"{c}_y"))
    return x.where("inner_x").join(y, "token").where(may).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component), kept: the groups after links (a, b) between their nodes or new ones.

    Only the links between groups are gone through, each group as one node.
    """
    for c in "ab":
        links = links.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    ends = links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = connected_components(ends, "a", "b")
    moved = groups.join(joined.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    fresh = joined.join(groups.select("node"), "node", "left_anti")
    return checkpointed(moved.select("node", F.coalesce("into", "component").alias("component")).unionByName(fresh.select("node", "component")))


def _mixed(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries, with the group of each, of the blocks that hold more than one group."""
    placed = entries.drop("component").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    return checkpointed(spread_join(placed, mixed, "token"))


def _leader_pairs(entries: DataFrame, similarity: float, salt: int) -> DataFrame:
    """Pairs (a, b) of each entry with the leaders of its block that are in other groups, as far as they may be alike.

    The first leader is the text with the fewest shingles of its own, the middle of a family of
    edited copies; the others are any, by ``salt``.
    """
    fields = ("node", "n", "inner", "most", "component")
    central = F.col("own") / F.col("n") if not salt else F.xxhash64("node", F.lit(-salt))
    picks = [F.min(F.struct(central.alias("by"), *fields)).alias("first")] + [F.min(F.struct(F.xxhash64("node", F.lit(salt * LEADERS + k)).alias("by"), *fields)) for k in range(1, LEADERS)]
    leaders = entries.groupBy("token").agg(F.array(*[F.struct(*[p.getField(f).alias(f) for f in fields]) for p in picks]).alias("leaders"))
    mine = lambda c: F.col(c)
    fit = F.filter("leaders", lambda x: (x["component"] != F.col("component")) & (_may_pair(mine, x.getField, similarity) | _may_pair(x.getField, mine, similarity)))
    pairs = spread_join(entries, leaders, "token").select("node", F.explode(fit).alias("leader"))
    return pairs.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def fingerprint_links(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b): links between nodes that connect those whose SimHash fingerprints differ in ``bits`` bits or fewer.

    A fingerprint's first node stands for it; its other nodes are linked to that one.
    """
    known = checkpointed(rows.select("node", "fp").distinct())
    firsts = checkpointed(known.groupBy("fp").agg(F.min("node").alias("first")))
    own = spread_join(known, firsts, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    between = simhash.near_links(firsts.select("fp"), bits)
    for c in "ab":
        between = spread_join(between.withColumnRenamed(c, "fp"), firsts, "fp").drop("fp").withColumnRenamed("first", c)
    return own.unionByName(between.select("a", "b")).where("a <> b")


def linked_nodes(docs: DataFrame, similarity: float, shingle: int, buckets: int, text_col: str, given: DataFrame | None = None) -> DataFrame:
    """(node, component), kept: the groups of the links ``given`` and of links that connect all that are ``similarity`` alike, without single nodes."""
    least = F.ceil(F.col("n") * similarity - 1e-6)
    shared = shared_shingles(docs, shingle, buckets, text_col).groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by_df"))
    nodes = checkpointed(shared.where(F.size("by_df") >= least).select("node", "n", F.col("by_df.token").alias("tokens")))
    every = _entries(nodes, similarity)
    blocks = every.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    entries = checkpointed(spread_join(every, blocks, "token"))
    links = _linked(_block_pairs(entries.where(F.col("members") <= CROWD), similarity), nodes, similarity)
    groups = checkpointed(connected_components(links if given is None else links.unionByName(given), "a", "b"))
    rest = entries.where(F.col("members") > CROWD)
    for k in range(ROUNDS + 1):
        now = _mixed(rest, groups)
        forget(rest if k else entries)
        rest = now
        if rest.isEmpty():
            break
        # what the leaders have not joined is compared with all of its block
        pairs = _leader_pairs(rest, similarity, k) if k < ROUNDS else _block_pairs(rest, similarity, "component")
        after = regrouped(groups, _linked(pairs, nodes, similarity))
        forget(groups)
        groups = after
    forget(rest)
    forget(nodes)
    return groups


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """(id, hash, first_id, first_hash) of every row: the group's least id and that document's text hash.

    With ``bits`` texts whose SimHash fingerprints differ in that many bits or fewer are linked, too.

    Wordless and null texts are one group.  A null id sorts first.  Of rows that tie for the
    least id the one with the least hash is named; repeated rows give repeated results.  An empty table gives no rows.
    """
    rows = checkpointed(set_keys(docs, shingle, id_col, text_col, bits is not None))
    buckets = ((rows.agg(F.sum("n")).first()[0] or 0) >> 19) + 1
    near = None if bits is None else checkpointed(fingerprint_links(rows, bits))
    groups = linked_nodes(docs, similarity, shingle, buckets, text_col, near)
    nodes = rows.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("least"))
    grouped = nodes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    firsts = grouped.groupBy("component").agg(F.min("least").alias("first"))
    return rows.join(spread_join(grouped, firsts, "component").select("node", "first"), "node").select("id", "hash", F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least id; all columns.

    Rows with equal id and equal text are one document, of which one row stays.
    """
    groups = similar_groups(docs, similarity, shingle, id_col, text_col, bits)
    firsts = groups.where(F.col("id").eqNullSafe(F.col("first_id")) & F.col("hash").eqNullSafe(F.col("first_hash"))).select(F.col("id").alias("__id"), F.col("hash").alias("__first")).distinct()
    text = docs[text_col].cast("string")
    # the row travels as one struct, so that no name of its columns can clash
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.xxhash64(text).alias("__hash"), docs[id_col].alias("__doc"))
    marked = marked.withColumn("__key", F.coalesce(F.col("__doc").cast("string"), F.lit("")))
    firsts = firsts.withColumn("__first_key", F.coalesce(F.col("__id").cast("string"), F.lit("")))
    same = (F.col("__key") == F.col("__first_key")) & (F.col("__hash") == F.col("__first")) & F.col("__doc").eqNullSafe(F.col("__id"))
    kept = marked.join(firsts, same, "left_semi").dropDuplicates(["__key", "__hash", "__doc"])
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
