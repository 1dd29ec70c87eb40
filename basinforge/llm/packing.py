"""Packing: documents into token sequences balanced by attention cost.

Each group of documents (a slice of a partition, so nothing is shuffled) is
packed on its own.  Whole sequences are cut from long documents; what is left
of each document is a piece with the cost ``linear * n + quadratic * n**2``.
Pieces go in descending order to the sequence of lowest cost that has room;
a piece that fits nowhere whole is cut over the sequences of lowest cost.  The
sequences of a group hold exactly its tokens: all are full but those that
the binary digits of the remainder make, whose sizes are powers of two and so
are not padded.

Nulls: a null text is empty and still gives its end id; a null id is kept.
Repeated rows are packed each on its own.  An empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from basinforge.llm.textcols import Recent, held, slices, text_bytes, tidied, utf8

#: White space of the splitting pattern but the line end, and whatever else might be taken for it.
_BLANK = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"
_WHITE = r"\n" + _BLANK
#: The pattern starts a token at the first and at the last character of each run of white space that
#: something follows.  So a text may be cut before every space and line end, but within runs of three and in the run at its end.
_RUNS = f"[{_WHITE}]{{3}}|[{_WHITE}]{{2}}$"
#: Before a space that something other than white space follows any text may be cut.
_CUT = re.compile(r"(?= [^\s])")
#: A stop or comma at a word's end, behind a letter, is a token of its own.
_STOPPED = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}][.,]$"
#: Words that must be encoded by themselves: white space alone, or with white space in them.
_ODD = rf"(?s)^\n?$|^[{_BLANK}]|.[{_WHITE}]"


@dataclass(frozen=True)
class PackingSpec:
    """``tokenizer``: a file for the tokenizers library; ``end_id`` ends each document."""

    tokenizer: str
    capacity: int = 1024
    end_id: int = 0
    linear: float = 1.0
    quadratic: float = 1.0 / 1024


class WordIds:
    """Encodes whole slices of texts: each distinct word of a slice once, and recent ones not again."""

    MOST, AT_ONCE = 200_000, 2000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with contextlib.suppress(AttributeError):  # words are kept here, so a second store only costs
            self._tokenizer.model._resize_cache(0)
        # byte-level tokens that start with a space or a line end
        self._first = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._first[[i for t, i in self._tokenizer.get_vocab().items() if t[0] in "\u0120\u010a"]] = True
        self._marks = {c: self.encode(c).tobytes() for c in ".,"}
        self._newline = self.encode("\n").nbytes
        self._store = Recent(self.MOST)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def _spelt(word: str) -> str:
        """The text that a word stands for: a line end is in front of it, or else a space."""
        return word if word[:1] == "\n" else " " + word

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space in them; a word starts at the token with its space or line end."""
        out: list[bytes] = []
        for k in range(0, len(words), self.AT_ONCE):
            some = words[k : k + self.AT_ONCE]
            ids = self.encode("".join(map(self._spelt, some)))
            at = [*(np.flatnonzero(self._first[ids]) * 4).tolist(), ids.nbytes]
            if len(at) != len(some) + 1:
                raise ValueError("the tokenizer joins words")
            data = ids.tobytes()
            out += [data[i:j] for i, j in zip(at, at[1:])]
        return out

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of each word."""
        found = words.dictionary_encode()
        distinct = found.dictionary
        stopped = pc.match_substring_regex(distinct, _STOPPED)
        stems = pc.if_else(stopped, pc.utf8_slice_codeunits(distinct, 0, -1), distinct).dictionary_encode()
        keys = stems.dictionary.to_pylist()
        values = self._store.get_all(keys)
        new = [k for k, v in enumerate(values) if v is None]
        if new:
            odd = pc.match_substring_regex(stems.dictionary, _ODD).to_numpy(zero_copy_only=False)
            plain = [k for k in new if not odd[k]]
            for k, ids in zip(plain, self._learn([keys[k] for k in plain])):
                values[k] = ids
            for k in new:
                if odd[k]:
                    values[k] = self.encode(self._spelt(keys[k])).tobytes()
        again = np.bincount(stems.indices.to_numpy(zero_copy_only=False)[found.indices.to_numpy()], minlength=len(keys)) > 1
        self._store.keep(compress(keys, again), compress(values, again))
        ends = pc.if_else(stopped, pc.utf8_slice_codeunits(distinct, -1), "").dictionary_encode()
        marks = pa.array([self._marks.get(c, b"") for c in ends.dictionary.to_pylist()], pa.large_binary()).take(ends.indices)
        stem_ids = pa.array(values, pa.large_binary()).take(stems.indices)
        return pc.binary_join_element_wise(stem_ids, marks, pa.scalar(b"", pa.large_binary())).take(found.indices)

    def documents(self, texts: pa.Array) -> list[bytes]:
        """Ids of each whole text as little-endian 32-bit bytes, as encoding it at once gives them."""
        led = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        special = pc.match_substring(texts, "<|")  # may name a special token
        runs = pc.and_not(pc.match_substring_regex(led, _RUNS), special)
        out = [b""] * len(texts)

        def fill(rows: list[int], lists: pa.Array, heads: list[bytes] | None) -> None:
            ids = self._words(lists.flatten())
            ends = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset : ids.offset + len(ids) + 1]
            at = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            for k, (row, i, j) in enumerate(zip(rows, at, at[1:])):
                out[row] = heads[k] + data[i:j] if heads else bytes(data[i + self._newline : j])

        if (rows := np.flatnonzero(pc.invert(pc.or_(special, runs)).to_numpy(zero_copy_only=False)).tolist()):
            # a line end in front of the text makes its first word one like others
            spaced = pc.replace_substring(texts.take(pa.array(rows)), "\n", " \n")
            led = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), spaced, pa.scalar("", pa.large_string()))
            fill(rows, pc.split_pattern(led, " "), None)
        if (rows := np.flatnonzero(runs.to_numpy(zero_copy_only=False)).tolist()):
            parts = [_CUT.split(t) for t in texts.take(pa.array(rows)).to_pylist()]
            heads = [self.encode(p[0]).tobytes() for p in parts]
            fill(rows, pa.array([[w[1:] for w in p[1:]] for p in parts], pa.large_list(pa.large_string())), heads)
        for row in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[row] = self.encode(texts[row].as_py()).tobytes()
        return out


def word_ids(path: str) -> WordIds:
    """The worker's encoder of that file; it outlives a task."""
    return held("words", path, lambda: WordIds(path))


def pack_group(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Places documents of those lengths: (document, start, length, sequence, offset) per piece.

    Every token is in one piece; offsets in a sequence have no gaps; every
    sequence is full or has a power of two of tokens.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for doc in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[doc]) - capacity + 1, capacity):
            out.append((int(doc), start, capacity, sequence, 0))
            sequence += 1
    rest = lengths % capacity
    order = np.lexsort((np.arange(len(rest)), -rest))
    order = order[rest[order] > 0]
    total = int(rest.sum())
    full, left = divmod(total, capacity)
    sizes = [capacity] * full + [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
    room = np.array(sizes, np.int64)
    used = np.zeros(len(sizes), np.int64)
    cost = np.zeros(len(sizes))

    def place(doc: int, start: int, n: int, at: int) -> None:
        out.append((doc, start, n, sequence + at, int(used[at])))
        used[at] += n
        room[at] -= n
        cost[at] = cost[at] + linear * n + quadratic * n * n if room[at] else np.inf

    for doc in order.tolist():
        n, start = int(rest[doc]), int(lengths[doc] - rest[doc])
        fits = np.where(room >= n, cost, np.inf)
        at = int(fits.argmin())
        if np.isfinite(fits[at]):
            place(doc, start, n, at)
            continue
        while n:
            at = int(cost.argmin())
            piece = min(n, int(room[at]))
            place(doc, start, piece, at)
            start, n = start + piece, n - piece
    return out


def pack(docs: DataFrame, spec: PackingSpec, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, ids.

    ``sequence_tokens`` is the sequence's own size: ``capacity``, or a power of
    two that needs no padding.  ``ids`` holds the piece's ids as little-endian
    32-bit integers; it is left out unless ``with_ids``.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(spec.tokenizer), np.array([spec.end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1):
            ids = [x + end for x in encoder.documents(utf8(batch.column(1)))]
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            pieces = pack_group(lengths, spec.capacity, spec.linear, spec.quadratic)
            doc, start, n, seq, offset = (np.array(c, np.int64) for c in zip(*pieces))
            cut = [ids[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist())]
            sizes = np.bincount(seq, weights=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                 pa.array(lengths[doc]), pa.array(seq + first), pa.array(offset), pa.array(sizes[seq])] + [pa.array(cut, pa.binary())] * with_ids,
                names=schema.names,
            )
            first += int(seq.max()) + 1

    return docs.select(docs[id_col].alias(id_col), text_bytes(docs, text_col).alias("__text")).mapInArrow(tidied(run), schema)
