"""Quality rules by compression bands.

zstandard's ratio (compressed over plain bytes) of a whole text and of its fixed
chunks must lie in a band that depends on the text's length: below it the text
repeats itself, above it the text is noise.  The bands are learned from every
row labelled good outside the held-out fold (``fit``).  Beside that stand counts of words,
symbols, repeated lines and repeated eight-word windows with two limits of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinforge.llm.textcols import crc_bucket, release, slices, text_bytes, tidied

#: (bytes from which it holds, least ratio, greatest ratio), where there are no labels to learn from: wide
#: about what prose in several languages has. A frame costs short texts more.
BANDS = (
    (0, 0.0, 99.0),
    (64, 0.42, 1.35),
    (128, 0.36, 1.20),
    (256, 0.38, 1.00),
    (512, 0.36, 0.88),
    (1024, 0.34, 0.80),
    (2048, 0.32, 0.76),
    (4096, 0.28, 0.74),
    (16384, 0.22, 0.74),
)
#: Bytes that a frame may cost.
FRAME = 18


@dataclass(frozen=True)
class BandSpec:
    """The bands are learned from all rows labelled good, with crc32(id) modulo ``folds`` not ``held_out``.

    Each class of length holds ``per_class`` rows or more, and is made of whole cells, ``cells`` to a doubling of length; a band reaches as far as they do, and ``spread`` standard
    deviations from their mean at least.  Fewer than ``least_rows`` rows (or chunks) only widen the given bands so that they hold those, too.
    """

    cells: int = 8
    folds: int = 5
    held_out: int = 0
    per_class: int = 100
    least_rows: int = 50
    spread: float = 4.0


@dataclass(frozen=True)
class CompressionRules:
    """``chunk_band`` holds for chunks of ``chunk`` bytes; a text fails if over ``chunk_share`` of its bytes lie in chunks outside.

    What is left after the last whole chunk is measured by the text's last ``chunk`` bytes.
    ``learned_from`` is the number of rows that the bands were learned from, 0 for the given ones.
    A text of less than a chunk has its whole ratio only.  Texts shorter than any seen may have a frame's
    bytes more, and the least ratio of those past ``longest`` bytes falls with their length.
    """

    bands: tuple[tuple[int, float, float], ...] = BANDS
    chunk: int = 4096
    chunk_band: tuple[float, float] = (0.28, 0.78)
    chunk_share: float = 0.3
    level: int = 3
    window: int = 8
    least_words: int = 20
    most_repeated_percent: int = 30
    symbols: str = "#*$%&|<>"
    shortest: int = 64
    longest: int = 1 << 16
    learned_from: int = 0

    def band(self, size: int) -> tuple[float, float]:
        low, high = next((low, high) for least, low, high in reversed(self.bands) if size >= least)
        if size < self.shortest:
            high += FRAME / max(size, 1)
        if size > self.longest:
            low *= (self.longest / size) ** 0.2
        return low, high


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words in windows of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    base = np.uint64(0x9E3779B97F4A7C15)
    words = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    words ^= words >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * base + words[k : k + n]
    order = np.argsort(key, kind="stable")
    run = key[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    # equal keys are only suspects: the windows themselves decide
    suspects = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[suspects]
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = suspects[counts[inverse.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def chunk_ratios(text: bytes, size: int, compressor: zstandard.ZstdCompressor) -> Iterator[tuple[float, int]]:
    """Ratio of each chunk and the bytes it stands for; the last is the text's last ``size`` bytes, for what is left."""
    for k in range(0, len(text) if len(text) >= size else 0, size):
        start = min(k, len(text) - size)
        yield len(compressor.compress(text[start : start + size])) / size, min(size, len(text) - k)


def _compressor(rules: CompressionRules) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=rules.level, write_content_size=False, write_checksum=False)


def measure(text: bytes, rules: CompressionRules, compressor: zstandard.ZstdCompressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, share of bytes in chunks outside, base_failed, kept."""
    words = text.split()
    n = len(words)
    data = np.frombuffer(text, np.uint8)
    characters = len(data) - int(((data & 0xC0) == 0x80).sum())
    word_chars = characters - sum(map(text.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(text.count(s.encode()) for s in rules.symbols)
    seen: set[bytes] = set()
    repeated_lines = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated_lines += 1
        elif line and not line.isspace():
            seen.add(line)
    numbers = _Numbers()
    repeats = repeated_words(np.fromiter(map(numbers.__getitem__, words), np.int64, n), rules.window)
    failed = n < rules.least_words or 100 * repeats > rules.most_repeated_percent * n
    ratio = len(compressor.compress(text)) / max(len(text), 1)
    low, high = rules.chunk_band
    outside = sum(n for r, n in chunk_ratios(text, rules.chunk, compressor) if not low <= r <= high) / max(len(text), 1)
    low, high = rules.band(len(text))
    kept = not failed and low <= ratio <= high and outside <= rules.chunk_share
    return n, word_chars, symbols, repeated_lines, repeats, ratio, outside, failed, kept


#: Sums are of whole numbers of this part, so that they don't depend on the order of the rows.
_PART = 1 << 30


@dataclass(frozen=True)
class _Spread:
    """Number, least, greatest, sum and sum of squares (in parts) of some ratios."""

    n: int = 0
    least: float = np.inf
    most: float = -np.inf
    total: int = 0
    squares: int = 0

    @staticmethod
    def of(x: np.ndarray) -> _Spread:
        parts = (int(np.rint(v * _PART).astype(np.int64).sum()) for v in (x, x * x))
        return _Spread(len(x), float(x.min(initial=np.inf)), float(x.max(initial=-np.inf)), *parts)

    def __add__(self, other: _Spread) -> _Spread:
        return _Spread(self.n + other.n, min(self.least, other.least), max(self.most, other.most), self.total + other.total, self.squares + other.squares)

    def reach(self, deviations: float) -> tuple[float, float]:
        mean = self.total / _PART / self.n
        far = deviations * max(self.squares / _PART / self.n - mean * mean, 0.0) ** 0.5
        return min(self.least, mean - far), max(self.most, mean + far)


def _cells(sizes: np.ndarray, rules: CompressionRules, spec: BandSpec) -> tuple[np.ndarray, np.ndarray]:
    """The given band of each size and its cell on a grid of lengths."""
    given = np.searchsorted([least for least, *_ in rules.bands], sizes, side="right") - 1
    return given.astype(np.int64), np.floor(spec.cells * np.log2(np.maximum(sizes, 1))).astype(np.int64)


def _from_cells(cells: list[tuple[int, int, int, _Spread]], chunks: _Spread, rules: CompressionRules, spec: BandSpec) -> CompressionRules:
    """The rules with the bands of cells (given band, least and greatest size, ratios) and of chunks."""
    wider = lambda band, x: (min(band[0], x.least), max(band[1], x.most))
    band = chunks.reach(spec.spread) if chunks.n >= spec.least_rows else wider(rules.chunk_band, chunks)
    n = sum(ratios.n for *_, ratios in cells)
    if n < spec.least_rows:
        bands = list(rules.bands)
        for k, _, _, ratios in cells:
            bands[k] = (bands[k][0], *wider(bands[k][1:], ratios))
        return replace(rules, bands=tuple(bands), chunk_band=band, learned_from=n)
    classes: list[tuple[int, _Spread]] = []
    for _, least, _, ratios in sorted(cells, key=lambda c: c[1]):
        if classes and classes[-1][1].n < spec.per_class:
            classes[-1] = classes[-1][0], classes[-1][1] + ratios
        else:
            classes.append((least if classes else 0, ratios))
    if len(classes) > 1 and classes[-1][1].n < spec.per_class:
        *classes, (start, before), (_, rest) = classes
        classes.append((start, before + rest))
    bands = tuple((start, *ratios.reach(spec.spread)) for start, ratios in classes)
    return replace(rules, bands=bands, chunk_band=band, shortest=min(c[1] for c in cells), longest=max(c[2] for c in cells), learned_from=n)


def learn_bands(sizes: np.ndarray, ratios: np.ndarray, chunks: np.ndarray, rules: CompressionRules, spec: BandSpec) -> CompressionRules:
    """The rules with the bands of these texts and of these chunks, and how many texts those were."""
    given, grid = _cells(sizes, rules, spec)
    cells = []
    for k, g in sorted(set(zip(given.tolist(), grid.tolist()))):
        own = (given == k) & (grid == g)
        cells.append((k, int(sizes[own].min()), int(sizes[own].max()), _Spread.of(ratios[own])))
    return _from_cells(cells, _Spread.of(chunks), rules, spec)


def fit(
    docs: DataFrame, labels: DataFrame, rules: CompressionRules = CompressionRules(), spec: BandSpec = BandSpec(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> CompressionRules:
    """The rules with bands learned from all good rows that pass the other rules.

    Labels with a null id or of two kinds are left out; without labels the rules stay as they are.  Rows of
    the held-out fold are not read; of the others numbers are joined with the labels, not texts, and summed by length.
    """
    good = labels.select(labels[id_col].alias("__id"), labels[label_col].cast("int").alias("label")).where(F.col("__id").isNotNull())
    good = good.groupBy("__id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = 1 and high = 1").where(crc_bucket(F.col("__id"), spec.folds) != spec.held_out)
    text = docs.select(docs[id_col].alias("__id"), text_bytes(docs, text_col).alias("text")).where(F.col("__id").isNotNull() & (crc_bucket(F.col("__id"), spec.folds) != spec.held_out))
    sums = ("n", "least", "most", "total", "squares")
    kinds = [("size", pa.int64()), ("given", pa.int64()), ("grid", pa.int64())]
    kinds += [(f"{of}_{c}", pa.float64() if c in ("least", "most") else pa.int64()) for of in ("text", "chunk") for c in sums]
    names = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType()}
    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), *[T.StructField(n, names[k]) for n, k in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        compressor = _compressor(rules)

        def one(text: bytes) -> tuple | None:
            m = measure(text, rules, compressor)
            if m[7]:
                return None
            (given,), (grid,) = _cells(np.array([len(text)]), rules, spec)
            spreads = (_Spread.of(np.array([m[5]])), _Spread.of(np.array([r for r, _ in chunk_ratios(text, rules.chunk, compressor)])))
            return len(text), int(given), int(grid), *[getattr(x, c) for x in spreads for c in sums]

        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            known = {t: one(t) for t in set(texts)}
            at = [k for k, t in enumerate(texts) if known[t]]
            columns = list(zip(*[known[texts[k]] for k in at])) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds))], names=schema.names)

    of_good = text.mapInArrow(tidied(run), schema).join(good.select("__id"), "__id", "left_semi")
    how = {"n": F.sum, "least": F.min, "most": F.max, "total": F.sum, "squares": F.sum}
    every = [how[c](f"{of}_{c}").alias(f"{of}_{c}") for of in ("text", "chunk") for c in sums]
    # a row for each cell of lengths, of which there are a few hundred at any scale
    rows = of_good.groupBy("given", "grid").agg(F.min("size").alias("low"), F.max("size").alias("high"), *every).collect()
    spread = lambda r, of: _Spread(*[r[f"{of}_{c}"] for c in sums])
    cells = [(r.given, r.low, r.high, spread(r, "text")) for r in rows]
    return _from_cells(cells, sum((spread(r, "chunk") for r in rows), _Spread()), rules, spec)


def apply_rules(docs: DataFrame, rules: CompressionRules = CompressionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, what ``measure`` gives of every row, and band_rows, the number of rows that the bands were learned from.

    A null text has no words and fails; repeated rows are measured each; a null
    id is kept.  An empty table gives no rows.
    """
    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    kinds += [("ratio", pa.float64()), ("outside_chunks", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("band_rows", pa.int64())]
    spark_kinds = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType()}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, spark_kinds[k]) for n, k in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        compressor = _compressor(rules)
        for batch in slices(batches, 1):
            known: dict[bytes, tuple] = {}
            rows = []
            for text in batch.column(1).to_pylist():
                if text not in known:
                    known[text] = (*measure(text, rules, compressor), rules.learned_from)
                rows.append(known[text])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds))], names=schema.names)

    return docs.select(docs[id_col].alias(id_col), text_bytes(docs, text_col).alias("__text")).mapInArrow(tidied(run), schema)
