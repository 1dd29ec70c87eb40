"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

A text is encoded by a byte-level BPE (A) and by a piece-type BPE (B).  Both tokens' ends are merged along the
text's bytes: an end that both have closes a group, and between two ends next to each other exactly one token of
each lies, which is a link.  All of this is done for slices of texts side by side, inside ``mapInArrow`` (the Arrow form of ``mapInPandas``).

A slice gives a row for each document and one of its own, with its different pairs of ids, in how many of its documents each is linked,
and the links of its documents as places among those pairs.  Spark counts the pairs over all slices by groupBy, takes the
greatest count of each id, and joins both back to the slices' pairs; a slice and its answers meet in one group,
whose size is bounded by the slice's.  So what is shuffled is a slice's different pairs and not its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinforge.llm.packing import WordIds
from basinforge.llm.piece_bpe import MARK, Encoder
from basinforge.llm.textcols import checkpointed, held, release, slices, text_bytes, tidied, utf8

#: Bytes of texts that are merged side by side.
SLICE_BYTES = 3 << 20
#: A pair of ids is A's id times this and B's id.
PAIR = 1 << 20


class PlainWordIds(WordIds):
    """The encoder of a tokenizers file to which the names of special tokens are plain text."""

    MOST = 120_000

    def __init__(self, path: str):
        super().__init__(path)
        self._tokenizer.encode_special_tokens = True

    def token_bytes(self) -> list[bytes]:
        """Each id's bytes: a byte-level entry has one character for each byte, printable ones standing for themselves."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain}
        shown |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        out = [b""] * self._tokenizer.get_vocab_size()
        for token, i in self._tokenizer.get_vocab().items():
            out[i] = bytes(shown[c] for c in token)
        return out


class FewerPieces(Encoder):
    """The encoder of a piece model beside another one in a worker."""

    MOST = 100_000


class Side:
    """One tokenizer's ids as bytes, as lengths, and as decimals with a mark behind: ``inside`` a group, or ``last`` of its tokens in it."""

    def __init__(self, tokens: list[bytes], last: bytes):
        self.tokens = pa.array(tokens, pa.large_binary())
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.decimals = [b"%d," % i for i in range(len(tokens))] + [b"%d" % i + last for i in range(len(tokens))]


class Aligner:
    def __init__(self, byte_bpe: str, piece_bpe: str):
        self.words, self.pieces = PlainWordIds(byte_bpe), FewerPieces(piece_bpe)
        model = self.pieces.model
        tokens = [b""] * (1 + max([*model.ids.values(), *model.bytes.values()]))
        for text, i in model.ids.items():
            tokens[i] = text.replace(MARK, " ").encode()
        for byte, i in model.bytes.items():
            tokens[i] = bytes([byte])
        self.a, self.b = Side(self.words.token_bytes(), b"|"), Side(tokens, b";")
        self.decimals = pa.array(self.a.decimals + self.b.decimals, pa.large_binary())

    def slice(self, texts: pa.Array) -> Aligned:
        """Aligns texts that are not empty."""
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        ids = [np.frombuffer(b"".join(self.words.documents(spaced)), "<u4"), np.frombuffer(b"".join(self.pieces.documents(texts, end=False)[0]), "<u4")]
        wanted = spaced.cast(pa.large_binary()).to_pylist()
        sizes = np.array([len(t) for t in wanted], np.int64)
        return self._aligned(wanted, sizes, spaced, texts, ids)

    def _aligned(self, wanted: list[bytes], sizes: np.ndarray, spaced: pa.Array, texts: pa.Array, ids: list[np.ndarray]) -> Aligned:
        good = np.ones(len(wanted), bool)
        joined = b"".join(wanted)
        if any(self._joined(side, i) != joined for side, i in zip((self.a, self.b), ids)):
            # some text is not what its tokens spell: each is looked at by itself, and only whole ones are merged
            each = [[np.frombuffer(x, "<u4") for x in of] for of in (self.words.documents(spaced), self.pieces.documents(texts, end=False)[0])]
            good = np.array([self._joined(self.a, x) == w and self._joined(self.b, y) == w for x, y, w in zip(*each, wanted)], bool)
            ids = [np.concatenate([np.zeros(0, "<u4"), *[x for x, ok in zip(of, good) if ok]]) for of in each]
            sizes = sizes[good]
        return Aligned.merged(self, good, sizes, *ids)

    @staticmethod
    def _joined(side: Side, ids: np.ndarray) -> bytes:
        found = side.tokens.take(pa.array(ids.astype(np.int64)))
        start, stop = np.frombuffer(found.buffers()[1], "<i8")[[found.offset, found.offset + len(found)]]
        return bytes(memoryview(found.buffers()[2] or b"")[start:stop])


@dataclass
class Aligned:
    """Texts whose tokens were merged.  ``good`` tells which of the slice's texts they are; the rest is for those alone.

    ``links`` has A's and B's places among all tokens of the slice, ``link_ends`` how many links there are up to each text's end.
    """

    good: np.ndarray
    a: np.ndarray
    b: np.ndarray
    counts: dict[str, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]
    link_ends: np.ndarray
    groups: list[memoryview]

    @classmethod
    def merged(cls, aligner: Aligner, good: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> Aligned:
        stops = np.cumsum(sizes)
        n = int(stops[-1]) if len(stops) else 0
        at_a, at_b = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        at_a[np.cumsum(aligner.a.lengths[a])] = True
        at_b[np.cumsum(aligner.b.lengths[b])] = True
        ends, common = np.flatnonzero(at_a | at_b), np.flatnonzero(at_a & at_b)
        # tokens that end up to each byte; the one that holds the bytes before an end is the first that ends there or later
        done_a, done_b = np.cumsum(at_a, dtype=np.int32), np.cumsum(at_b, dtype=np.int32)
        links = done_a[ends] - at_a[ends], done_b[ends] - at_b[ends]
        upto = {"n_a": done_a[stops].astype(np.int64), "n_b": done_b[stops].astype(np.int64), "n_groups": np.searchsorted(common, stops, side="right"), "n_links": np.searchsorted(ends, stops, side="right")}
        counts = {k: np.diff(v, prepend=0) for k, v in upto.items()}
        # a group's A tokens stand behind all B tokens of the groups before, its B tokens behind all A tokens up to its own
        group_a, group_b = done_a[common].astype(np.int64), done_b[common].astype(np.int64)
        of_a, of_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
        order = np.zeros(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[group_a - 1] = True
        last_b[group_b - 1] = True
        n_a, n_b = len(aligner.a.lengths), len(aligner.b.lengths)
        order[np.arange(len(a)) + np.repeat(group_b - of_b, of_a)] = a + n_a * last_a
        order[np.arange(len(b)) + np.repeat(group_a, of_b)] = 2 * n_a + b + n_b * last_b
        text = aligner.decimals.take(pa.array(order))
        at = np.frombuffer(text.buffers()[1], "<i8")[np.concatenate([[0], upto["n_a"] + upto["n_b"]])].tolist()
        data = memoryview(text.buffers()[2] or b"")
        return cls(good, a, b, counts, links, upto["n_links"], [data[i : j - 1] for i, j in zip(at, at[1:])])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pairs of ids, how many texts have each linked; and of each text's different links text * pairs + pair, how often)."""
        found = pa.array(self.a[self.links[0]].astype(np.int64) * PAIR + self.b[self.links[1]]).dictionary_encode()
        codes = found.dictionary.to_numpy()
        of = np.repeat(np.arange(len(self.link_ends)), np.diff(self.link_ends, prepend=0))
        different, often = np.unique(of * max(1, len(codes)) + found.indices.to_numpy(), return_counts=True)
        return codes, np.bincount(different % max(1, len(codes)), minlength=len(codes)), different, often


def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    """The worker's encoders of those files; they outlive a task."""
    return held("aligner", f"{byte_bpe} {piece_bpe}", lambda: Aligner(byte_bpe, piece_bpe))


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_DIGESTS = {"groups_sha256": T.StringType(), "groups": T.StringType()}


def _slices(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str, text_col: str, outputs: tuple[str, ...]) -> DataFrame:
    """A row for each document, and one (without ``__nth``) for each slice; kept as a table."""
    digests = [o for o in outputs if o in _DIGESTS]
    schema = T.StructType(
        [T.StructField("__slice", T.LongType()), T.StructField("__nth", T.LongType()), T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField(o, _DIGESTS[o]) for o in digests]
        + [T.StructField("__pairs", T.ArrayType(T.LongType())), T.StructField("__docs", T.ArrayType(T.LongType()))]
        + [T.StructField("__links", T.BinaryType()), T.StructField("__often", T.BinaryType())]
    )
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, first, pack = aligner(byte_bpe, piece_bpe), TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(3).compress
        for nth, batch in enumerate(slices(batches, 1, SLICE_BYTES, 1 << 16)):
            texts = utf8(batch.column(1))
            some = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            found = both.slice(texts.take(pa.array(some)))
            rows = some[found.good]
            n, of = batch.num_rows, pa.array([first + nth] * (batch.num_rows + 1), pa.int64())
            # a row of the slice's own stands behind those of its documents
            place = np.full(n, -1, np.int64)
            place[rows] = np.arange(len(rows))
            made = [of, pa.array([*range(n), None], pa.int64()), pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])]
            for c in COUNTS:
                values = np.zeros(n, np.int64)
                values[rows] = found.counts[c]
                made.append(pa.array([*values.tolist(), None], pa.int64()))
            for o in digests:
                text = [(hashlib.sha256(g).hexdigest() if o == "groups_sha256" else bytes(g).decode()) for g in found.groups]
                made.append(pa.array([*[text[k] if k >= 0 else "" for k in place.tolist()], None], pa.string()))
            codes, n_docs, different, often = found.pairs()
            different = rows[different // max(1, len(codes))] * len(codes) + different % max(1, len(codes))
            blank = [None] * n
            made += [pa.array([*blank, codes], longs), pa.array([*blank, n_docs], longs)]
            made += [pa.array([*blank, pack(np.diff(different, prepend=0).astype("<i8").tobytes())], pa.binary()), pa.array([*blank, pack(often.astype("<u4").tobytes())], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return checkpointed(docs.select(docs[id_col].alias(id_col), text_bytes(docs, text_col).alias("__text")).mapInArrow(tidied(run), schema))


def _asked(kept: DataFrame) -> DataFrame:
    """(slice, place of the pair in it, pair, documents of the slice that have it)."""
    each = kept.where("__nth is null").select("__slice", F.posexplode(F.arrays_zip("__pairs", "__docs")).alias("__place", "p"))
    return each.select("__slice", "__place", F.col("p.__pairs").alias("__pair"), F.col("p.__docs").alias("__n"))


def _counted(asked: DataFrame) -> DataFrame:
    """(pair, its documents in the whole corpus, whether that is the most that its A id has)."""
    counts = asked.groupBy("__pair").agg(F.sum("__n").alias("__count")).withColumn("__a", F.floor(F.col("__pair") / PAIR))
    most = counts.groupBy("__a").agg(F.max("__count").alias("__most"))
    return counts.join(most, "__a").select("__pair", "__count", (F.col("__count") == F.col("__most")).alias("__best"))


def align_documents(
    docs: DataFrame, byte_bpe: str, piece_bpe: str, outputs: tuple[str, ...] = (*COUNTS, "n_best", "count_sum", "groups"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id and the ``outputs`` wanted of: n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256.

    A encodes a space and the text, B the text, to which it adds a space itself.  ``groups`` are ids of A, a bar, ids of B, joined by semicolons.
    A pair's count is the number of documents that hold it linked; ``n_best`` counts the links whose pair has the most of its A id, ties
    included, ``count_sum`` is the sum of the counts over all links.

    Nulls: a null or empty text has no tokens: zeros and an empty string; neither has one that A's or B's tokens don't
    spell byte by byte, such as one with B's own space mark.  A null id is kept.  Repeated rows each count as a document.
    An empty table gives no rows.  Other columns are left behind, whatever their names.
    """
    kept = _slices(docs, byte_bpe, piece_bpe, id_col, text_col, outputs)
    asked = _asked(kept)
    answers = asked.join(_counted(asked), "__pair").select(F.col("__slice").alias("__of"), "__place", "__count", "__best")
    names = [id_col, *outputs]
    kinds = {o: _DIGESTS.get(o, T.LongType()) for o in outputs}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(o, kinds[o]) for o in outputs]])

    def run(slice_: pa.Table, found: pa.Table) -> pa.Table:
        release()  # the encoders
        unpack, own = zstandard.ZstdDecompressor().decompress, slice_.filter(pc.is_null(slice_["__nth"]))
        rows = slice_.filter(pc.is_valid(slice_["__nth"])).sort_by("__nth")
        count, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        place = found["__place"].to_numpy()
        count[place], best[place] = found["__count"].to_numpy(), found["__best"].to_numpy(zero_copy_only=False)
        different = np.cumsum(np.frombuffer(unpack(own["__links"][0].as_py()), "<i8"))
        often = np.frombuffer(unpack(own["__often"][0].as_py()), "<u4").astype(np.int64)
        doc, pair = np.divmod(different, max(1, len(count)))
        edges = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        for name, of in (("count_sum", count), ("n_best", best)):
            sums = np.concatenate([[0], np.cumsum(often * of[pair])])
            rows = rows.append_column(name, pa.array(np.diff(sums[edges]), pa.int64()))
        return rows.select(names)

    def kernel(slice_: pa.Table, found: pa.Table) -> pa.Table:
        return tidied(lambda both: run(*both))((slice_, found))

    slim = kept.drop("__pairs", "__docs")
    return slim.groupBy("__slice").cogroup(answers.groupBy("__of")).applyInArrow(kernel, schema)


def pair_counts(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs, best): in how many documents each pair of ids is linked, and whether no other pair of A's id has more."""
    counted = _counted(_asked(_slices(docs, byte_bpe, piece_bpe, id_col, text_col, ())))
    return counted.select(F.floor(F.col("__pair") / PAIR).alias("a"), (F.col("__pair") % PAIR).alias("b"), F.col("__count").alias("n_docs"), F.col("__best").alias("best"))
