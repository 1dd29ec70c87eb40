"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The encoder never runs the merge queue over a text.  An Aho-Corasick automaton
gives every piece that starts at each position; the longest is tried first.  A
piece may follow another only if merging their joined text again gives just
those two, and a text whose adjacent pieces all pass is the text's encoding.
Where no piece fits, the last one is taken back and the position is marked as
failed in a bitfield, so no position is tried twice.

A slice of documents is cut wherever two characters meet that no piece holds side by
side, so that no piece crosses a cut; what is between two cuts is a unit.  Each distinct unit of a slice is
encoded once, and recent ones are kept in the worker within a bound on its memory.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from basinforge.llm.textcols import Recent, held, slices, text_bytes, tidied, utf8

MARK = "▁"
_NONE: dict[str, bool] = {}
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int | float]]:
    """Fields of one protobuf message: varints as int, fixed 32 as float, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            n = varint() if kind == 2 else 8
            yield key >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A merge-type model file: its pieces, its way to normalise, and the backtracking encoder."""

    #: Pairs of pieces that a worker keeps, and the binary logarithm of the table of pairs of characters.
    MOST_PAIRS, PAIR_BITS = 500_000, 20

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        trainer = next((dict(_fields(v)) for k, v in fields if k == 2), {})
        normalizer = next((dict(_fields(v)) for k, v in fields if k == 3), {})
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type model")
        self.path = path
        self.plain = not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(3, 1) and normalizer.get(5, 1)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown, self.end, self.length = 0, -1, {}
        for i, piece in enumerate(dict(_fields(v)) for k, v in fields if k == 1):
            text, kind = piece[1].decode("utf-8"), piece.get(3, NORMAL)
            if kind == UNUSED:
                raise ValueError("unused pieces are not supported")
            if kind == NORMAL:
                self.ids[text], self.rank[text] = i, piece.get(2, 0.0)
            elif kind == BYTE:
                self.bytes[int(text[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind == USER_DEFINED or kind == CONTROL and text == "</s>":
                if kind == USER_DEFINED:
                    raise ValueError("user-defined pieces are not supported")
                self.end = i
        inside = np.concatenate([self._pairs(np.frombuffer(p.encode("utf-32-le"), "<u4")) for p in self.ids])
        self._joined = np.zeros(1 << self.PAIR_BITS, bool)
        self._joined[inside] = True
        self._single = np.zeros(0x110000, bool)
        self._single[[ord(p) for p in self.ids if len(p) == 1]] = True
        self._automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self._automaton.add_word(p, len(p))
        self._automaton.make_automaton()
        self._fits: dict[str, dict[str, bool]] = {}
        self._known = 0
        self._library = None

    @property
    def library(self):
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._library

    @classmethod
    def _pairs(cls, points: np.ndarray) -> np.ndarray:
        """Places of the adjacent characters in the table of pairs; others that share a place only leave a cut out."""
        return (points[:-1] * np.uint32(8191) + points[1:]) & np.uint32((1 << cls.PAIR_BITS) - 1)

    def normalize(self, texts: pa.Array) -> pa.Array:
        if self.plain:
            marked = pc.replace_substring(texts, " ", MARK)
            led = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string()))
            return pc.if_else(pc.equal(pc.binary_length(texts), 0), "", led)
        return pa.array([self.library.normalize(t) for t in texts.to_pylist()], pa.large_string())

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All units of normalised texts, and how many units stand before each text and in all."""
        edges = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        if not len(data):
            return pa.array([], pa.large_string()), np.zeros(len(edges), np.int64)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        cut = np.r_[True, ~self._joined[self._pairs(points)]]
        if not self.bytes:  # what the model lacks is one unknown piece as far as it goes
            lacks = ~self._single[points]
            cut[1:] &= ~(lacks[1:] & lacks[:-1])
        cut[np.searchsorted(starts, edges[:-1][edges[:-1] < len(data)])] = True
        at = np.append(starts[cut], len(data)).astype("<i8")
        units = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
        return units, np.searchsorted(at, edges)

    def merge(self, text: str) -> list[str]:
        """Merges a short text's characters: best rank first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may stand after ``left`` ("" at the start)."""
        after = self._fits.setdefault(left, {})
        out = after.get(right)
        if out is None:
            if self._known >= self.MOST_PAIRS:
                self._known = 0
                self._fits = {left: (after := {})}
            self._known += 1
            out = after[right] = self.merge(left + right) == ([left, right] if left else [right])
        return out

    def pieces(self, word: str) -> list[str]:
        """The word's pieces; characters that the model lacks stand alone."""
        n = len(word)
        starts: list[list[int]] = [[1] for _ in range(n)]  # lengths, ascending as ends ascend
        for end, length in self._automaton.iter(word):
            starts[end - length + 1].append(length)
        failed = bytearray(n + 1)
        out: list[str] = []
        nth: list[int] = []  # the choice made at each piece, to go on from
        left, at, k = "", 0, -1
        while at < n:
            lengths = starts[at]
            k = len(lengths) - 1 if k < 0 else k - 1
            known = self._fits.get(left, _NONE)
            while k >= 0:
                stop = at + lengths[k]
                if not failed[stop]:
                    piece = word[at:stop]
                    fits = known.get(piece)
                    if fits is None:
                        fits = self.fits(left, piece)
                    if fits:
                        break
                k -= 1
            if k >= 0:
                out.append(piece)
                nth.append(k)
                left, at, k = piece, stop, -1
            elif out:
                failed[at] = 1
                at -= len(out.pop())
                left = out[-1] if out else ""
                k = nth.pop()
                if not k:  # its shortest choice: this position fails in turn
                    starts[at], k = [], -1
            else:
                raise ValueError(f"no encoding of {word[:40]!r}")
        return out

    def word(self, word: str) -> list[int]:
        """Ids of one word, with bytes for characters that the model lacks."""
        out: list[int] = []
        for p in self.pieces(word):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out


class Encoder:
    #: Units of a worker's store in each of its two generations.
    MOST = 150_000

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self._store = Recent(self.MOST)
        self._decimals = [b"%d " % i for i in range(1 + max([*self.model.ids.values(), *self.model.bytes.values(), self.model.unknown, self.model.end]))]

    def _encoded(self, unit: str) -> tuple[bytes, bytes]:
        ids = self.model.word(unit)
        return array("I", ids).tobytes(), b"".join([self._decimals[i] for i in ids])

    def documents(self, texts: pa.Array, end: bool = True, decimal: bool = False) -> tuple[list[memoryview], list[memoryview]]:
        """Ids of each text as little-endian 32-bit integers, and, if ``decimal``, as decimals with a space behind each.

        ``end`` adds the end id.  Both are views, of one buffer for all texts.
        """
        units, bounds = self.model.units(self.model.normalize(texts))
        found = units.dictionary_encode()
        keys = found.dictionary.to_pylist()
        values = self._store.get_all(keys)
        for k, v in enumerate(values):
            if v is None:
                values[k] = self._encoded(keys[k])
        indices = found.indices.to_numpy(zero_copy_only=False)
        again = np.bincount(indices, minlength=len(keys)) > 1
        self._store.keep(compress(keys, again), compress(values, again))
        last = len(values)  # the end id is one more unit, behind each text
        values.append((array("I", [self.model.end]).tobytes(), self._decimals[self.model.end]) if end else (b"", b""))
        order = pa.array(np.insert(indices.astype(np.int64), bounds[1:], last))
        bounds = bounds + np.arange(len(bounds))

        def gathered(of: list[bytes]) -> list[memoryview]:
            out = pa.array(of, pa.large_binary()).take(order)
            at = np.frombuffer(out.buffers()[1], "<i8")[bounds].tolist()
            data = memoryview(out.buffers()[2] or b"")
            return [data[i:j] for i, j in zip(at, at[1:])]

        return gathered([v[0] for v in values]), gathered([v[1] for v in values]) if decimal else []

    def encode(self, text: str, end: bool = True) -> list[int]:
        return np.frombuffer(self.documents(pa.array([text], pa.large_string()), end)[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.model.library.decode(ids)


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file; it outlives a task."""
    return held("pieces", path, lambda: Encoder(path))


_OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode_documents(
    docs: DataFrame, model: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id and the ``outputs`` wanted of: n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    The ids end with the model's end id; the decoded text is that of all ids.

    Nulls: a null text is empty and encodes to the end id alone; a null id is kept.
    Repeated rows give repeated results, equal texts equal ones.  An empty table gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(o, _OUTPUTS[o]) for o in outputs])
    decodes = any(o.startswith("decoded") for o in outputs)
    hashes = "ids_sha256" in outputs
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in slices(batches, 1, 8 << 20):
            texts = utf8(batch.column(1)).dictionary_encode()
            packed, decimals = enc.documents(texts.dictionary, decimal=hashes)
            made: dict[str, list] = {o: [] for o in outputs}
            for k, raw in enumerate(packed):
                values = {"n_tokens": len(raw) // 4}
                if decodes or "ids" in outputs:
                    values["ids"] = np.frombuffer(raw, "<u4").tolist()
                if decodes:
                    values["decoded"] = enc.decode(values["ids"])
                    values["decoded_sha256"] = hashlib.sha256(values["decoded"].encode("utf-8")).hexdigest()
                if hashes:
                    values["ids_sha256"] = hashlib.sha256(decimals[k][:-1]).hexdigest()
                for o in outputs:
                    made[o].append(values[o])
            rows = [pa.array(made[o], kinds.get(o, pa.string())).take(texts.indices) for o in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], names=schema.names)

    return docs.select(docs[id_col].alias(id_col), text_bytes(docs, text_col).alias("__text")).mapInArrow(tidied(run), schema)
