"""Document fingerprints from prefix polynomial hashes.

The code points of a slice of texts lie in one array, and modular prefix arrays of it (three
bases, modulus 2**31 - 1) give the hash of any span from two of their entries.  Whether two spans are equal is
thus one comparison at any length, and a longest common extension is a binary search over such comparisons.

A text's fingerprint is its length and the hashes of all of it.  The likeness of two fingerprinted texts is the
part of both that common spans cover: each aligned block of 32 code points of the one is looked up among all
spans of 32 of the other, found blocks and both texts' ends are extended to the left and the right as far as the texts agree, and the covered code points are counted.

Documents are compared with the next one in descending order of their ids: rows are dealt by ranges of the ids,
a task compares the rows that follow each other in it, and the rows at the ranges' ends, two a task, are compared afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basinforge.llm.textcols import checkpointed, slices, text_bytes, tidied, utf8

MODULUS = (1 << 31) - 1
#: Any three different numbers below the modulus do.
BASES = (1_103_515_245, 1_812_433_253, 1_664_525_019)
#: Code points of a block that is looked up.
SEED = 32
#: Bytes of texts that are compared at once, but for a single pair of longer ones.
COMPARED_BYTES = 1 << 19


def _reduced(v: np.ndarray) -> np.ndarray:
    """The numbers, below 2**63, modulo 2**31 - 1; the array is overwritten."""
    for _ in range(2):
        high = v >> 31
        v &= MODULUS
        v += high
    over = v >= MODULUS
    if over.any():
        v[over] -= MODULUS
    return v


class Powers:
    """A base's powers and their inverses, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, MODULUS)
        self.up = self.down = np.ones(1, np.int64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _reduced(self.up * pow(self.base, k, MODULUS))])
            self.down = np.concatenate([self.down, _reduced(self.down * pow(self.inverse, k, MODULUS))])
        return self.up[:n], self.down[:n]


_powers = [Powers(b) for b in BASES]


def _union(start: np.ndarray, stop: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many positions the intervals of each of n texts cover; texts lie in their order, and intervals within them."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    before = np.concatenate([[0], np.maximum.accumulate(stop)[:-1]])
    return np.bincount(of[order], np.maximum(stop - np.maximum(start, before), 0), n)


@dataclass
class PrefixHashes:
    """Texts side by side: where each starts and ends, and the prefix arrays of the first two bases."""

    starts: np.ndarray
    ends: np.ndarray
    prefixes: list[np.ndarray]
    down: list[np.ndarray]
    whole: list[list[int]]

    @classmethod
    def of(cls, texts: list[bytes]) -> PrefixHashes:
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
        points += 1
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        if len(points) < len(data):
            edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[edges]
        starts, ends = edges[:-1], edges[1:]
        prefixes, downs, whole = [], [], []
        for k, powers in enumerate(_powers):
            up, down = powers.get(len(points) + 1)
            terms = points * up[: len(points)]
            high = terms >> 31
            terms &= MODULUS
            terms += high
            prefix = np.zeros(len(points) + 1, np.int64)
            np.cumsum(terms, out=prefix[1:])
            whole.append(_reduced((_reduced(prefix[ends]) - _reduced(prefix[starts]) + MODULUS) * down[starts]).tolist())
            if k < 2:
                prefixes.append(_reduced(prefix))
                downs.append(down)
        return cls(starts, ends, prefixes, downs, whole)

    def fingerprints(self) -> list[str]:
        """Of each text: its length and its hash to each base, in hexadecimal."""
        sizes = (self.ends - self.starts).tolist()
        return [f"{n:x}-" + "".join([f"{h:08x}" for h in hashes]) for n, *hashes in zip(sizes, *self.whole)]

    def spans(self, at: np.ndarray, length: np.ndarray | int, base: int) -> np.ndarray:
        """The hashes of spans, which do not depend on where they stand."""
        p = self.prefixes[base]
        return _reduced((p[at + length] - p[at] + MODULUS) * self.down[base][at])

    @cached_property
    def seeds(self) -> np.ndarray:
        """The hash to the first base of the SEED code points from each position on."""
        p = self.prefixes[0]
        out = p[SEED:] - p[:-SEED]
        out += MODULUS
        out *= self.down[0][: len(out)]
        return _reduced(out)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.spans(a, length, 0) == self.spans(b, length, 0)) & (self.spans(a, length, 1) == self.spans(b, length, 1))

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How far the spans that start at a and b (``back``: end before them) agree, at most ``most``: binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo] + 1) // 2
            x, y = (a[todo] - middle, b[todo] - middle) if back else (a[todo], b[todo])
            same = self.equal(x, y, middle)
            low[todo] = np.where(same, middle, low[todo])
            high[todo] = np.where(same, high[todo], middle - 1)
        return low

    def likeness(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Of the texts xs[k] and ys[k]: the part of their code points that common spans cover; two empty texts are alike.

        ``xs`` and ``ys`` are ascending, and no text stands twice in one of them.
        """
        ax, ex, ay, ey = self.starts[xs], self.ends[xs], self.starts[ys], self.ends[ys]
        every = np.arange(len(xs))
        at, of, first, spots, spots_of = self._matches(ax, ex, ay, ey)
        a = np.concatenate([ax, ex, at])
        b = np.concatenate([ay, ey, first])
        pair = np.concatenate([every, every, of])
        after = self.extension(a, b, np.minimum(ex[pair] - a, ey[pair] - b))
        before = self.extension(a, b, np.minimum(a - ax[pair], b - ay[pair]), back=True)
        covered = _union(a - before, a + after, pair, len(xs))
        covered += _union(np.concatenate([b - before, spots]), np.concatenate([b + after, spots + SEED]), np.concatenate([pair, spots_of]), len(xs))
        sizes = ex - ax + ey - ay
        return np.where(sizes > 0, covered / np.maximum(sizes, 1), 1.0)

    def _matches(self, ax: np.ndarray, ex: np.ndarray, ay: np.ndarray, ey: np.ndarray) -> tuple[np.ndarray, ...]:
        """The aligned blocks of the first texts that stand in the second ones: where, of which pair, and where first there;
        and all positions of the second texts where some block stands, and of which pair."""
        nothing = np.zeros(0, np.int64)
        blocks = (ex - ax) // SEED
        of = np.repeat(np.arange(len(ax)), blocks)
        if not len(of) or not len(self.seeds):
            return (nothing,) * 5
        at = ax[of] + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * SEED
        keys = of << 31 | self.seeds[at]
        order = np.argsort(keys, kind="stable")
        keys, at, of = keys[order], at[order], of[order]
        # a table of bits keeps most positions from being looked up
        mask = (1 << len(keys).bit_length() + 4) - 1
        there = np.zeros(mask + 1, bool)
        there[keys & mask] = True
        low, high = ay[0], min(ey[-1], len(self.seeds))
        spots = np.flatnonzero(there[self.seeds[low:high] & mask]) + low
        spots_of = np.searchsorted(ay, spots, side="right") - 1
        inside = spots + SEED <= ey[spots_of]
        spots, spots_of = spots[inside], spots_of[inside]
        mine = spots_of << 31 | self.seeds[spots]
        place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        same = np.flatnonzero(keys[place] == mine)
        same = same[self.spans(spots[same], SEED, 1) == self.spans(at[place[same]], SEED, 1)]
        spots, spots_of, place = spots[same], spots_of[same], place[same]
        first = np.full(len(keys), -1, np.int64)
        first[place[::-1]] = spots[::-1]
        first = first[np.searchsorted(keys, keys)]  # equal blocks of a text were looked up as one
        found = np.flatnonzero(first >= 0)
        return at[found], of[found], first[found], spots, spots_of


def edited(text: bytes, following: bytes) -> bytes:
    """The text with its last floor(n / 2) code points replaced by the first as many, or all, of the following one."""
    a, b = text.decode("utf-8"), following.decode("utf-8")
    half = len(a) // 2
    return (a[: len(a) - half] + b[:half]).encode("utf-8")


def compared(texts: list[bytes], followings: list[int]) -> tuple[list[str], ...]:
    """Of the text k and the one at followings[k], for as many as there are: the columns from n_chars to near_next.

    No text may follow two.
    """
    n = len(followings)
    changed = [edited(texts[k], texts[f]) for k, f in enumerate(followings)]
    hashes = PrefixHashes.of(texts + changed)
    prints = hashes.fingerprints()
    xs = np.arange(n)
    sizes = (hashes.ends - hashes.starts)[:n].tolist()
    return (
        sizes,
        [hashlib.sha256(x).hexdigest() for x in changed],
        prints[:n],
        prints[len(texts) :],
        hashes.likeness(xs, len(texts) + xs).tolist(),
        hashes.likeness(xs, np.array(followings, np.int64)).tolist(),
    )


_COLUMNS = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
_ARROW = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
_RESULT, _FIRST, _LAST = 0, 1, 2


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The next document is the one with the next lower id; after the lowest comes the highest again.
    ``near_edited`` is the likeness to the edited text, ``near_next`` to the next document's.

    Nulls: a null text is empty; documents without id come after those with one.  Ties: documents of one
    id follow each other in the order of a hash of their texts; equal rows follow each other.  Two empty texts are alike,
    an empty and another one not at all.  A single document follows itself.  An empty table gives no rows.
    Other columns are left behind, whatever their names.
    """
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    result = T.StructType([id_field, *[T.StructField(*c) for c in _COLUMNS]])
    schema = T.StructType([*result.fields, T.StructField("__edge", T.IntegerType()), T.StructField("__part", T.LongType()), T.StructField("__text", T.BinaryType())])

    def rows(ids: pa.Array, columns: tuple[list, ...], edge: int = _RESULT, part: int = 0, text: bytes | None = None) -> pa.RecordBatch:
        n = len(ids)
        made = [pa.array(values, _ARROW.get(name, pa.string())) for (name, _), values in zip(_COLUMNS, columns or [[None] * n] * len(_COLUMNS))]
        return pa.RecordBatch.from_arrays([ids, *made, pa.array([edge] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array([text] * n, pa.binary())], names=schema.names)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares the rows of one range; its first and its last row go on with their texts."""
        part, last_id, last = TaskContext.get().partitionId(), None, None
        for batch in slices(batches, 1, COMPARED_BYTES):
            ids, texts = batch.column(0), [t.encode() for t in utf8(batch.column(1)).to_pylist()]
            if last is None:
                yield rows(ids[:1], (), _FIRST, part, texts[0])
            else:
                ids, texts = pa.concat_arrays([last_id, ids]), [last, *texts]
            if len(texts) > 1:
                yield rows(ids[:-1], compared(texts, list(range(1, len(texts)))))
            last_id, last = ids[-1:], texts[-1]
        if last is not None:
            yield rows(last_id, (), _LAST, part, last)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares each row's text with the other text of the row."""
        for batch in slices(batches, 1, max_rows=1):
            pair = [batch.column(1)[0].as_py(), batch.column(2)[0].as_py()]
            yield pa.RecordBatch.from_arrays(rows(batch.column(0), compared(pair, [1])).columns[: len(result)], names=result.names)

    pairs = docs.select(docs[id_col].alias(id_col), text_bytes(docs, text_col).alias("__text"))
    order = [F.col(f"`{id_col}`").desc_nulls_last(), F.xxhash64("__text")]
    kept = checkpointed(pairs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(along), schema))
    edges = kept.where(F.col("__edge") != _RESULT)
    # a row for each range, no texts
    parts = edges.where(F.col("__edge") == _FIRST).select("__part")
    ahead = F.lead("__part").over(Window.orderBy("__part"))
    following = parts.select("__part", F.coalesce(ahead, F.min("__part").over(Window.partitionBy())).alias("__next"))
    lasts = edges.where(F.col("__edge") == _LAST).select(F.col(f"`{id_col}`"), "__part", "__text")
    firsts = edges.where(F.col("__edge") == _FIRST).select(F.col("__part").alias("__next"), F.col("__text").alias("__other"))
    seams = lasts.join(following, "__part").join(firsts, "__next").select(F.col(f"`{id_col}`"), "__text", "__other")
    return kept.where(F.col("__edge") == _RESULT).select(*[F.col(f"`{c}`") for c in result.names]).unionByName(seams.mapInArrow(tidied(across), result))
