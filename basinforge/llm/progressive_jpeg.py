"""Media columns: progressive JPEG, decoded scan by scan in numpy.

A progressive file sends each component's DCT coefficients in several scans: a
scan covers a band of coefficients (spectral selection) and either their upper
bits or one further bit (successive approximation).  The decoder accumulates
the scans in coefficient arrays, dequantises, applies the inverse transform as
one matrix product, repeats the chroma samples to full size and gives an RGB
tensor of shape (height, width, 3).

Entropy-coded data is read symbol by symbol.  Where the first symbol suggests
that all symbols of a scan are alike (as in what ``store_bytes`` writes), the
whole scan is cut at that stride at once, every code is compared, and only a
scan in which all agree is taken that way; any other goes to the reader.

``store_bytes`` keeps any bytes without loss in such a file.  The format's unit
is the coefficient: of the 511 values that have up to eight bits, those of just
eight bits, -255..-128 and 128..255, stand for the 256 byte values.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from basinforge.llm.textcols import release, slices, text_bytes, tidied

#: Bytes of a block, and the format's limit of width and height.
BLOCK, LARGEST = 64, 65500


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in the order of transmission."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def _inverse() -> np.ndarray:
    """(64, 64): coefficients in order of transmission to samples in rows."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * math.pi / 16) / 2
    basis[0] /= math.sqrt(2)
    return np.kron(basis, basis)[_zigzag()]


ZIGZAG, INVERSE = _zigzag(), _inverse()


class BadJpeg(ValueError):
    """The bytes are no progressive JPEG that can be decoded."""


@dataclass
class Component:
    h: int
    v: int
    table: int
    rows: int = 0  # blocks that the component's own scans have
    columns: int = 0
    stride: int = 0  # blocks in a row of the array, whole MCUs
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


class _Bits:
    """Bits of one restart segment, most significant first; ones follow the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            if self.at < len(self.data):
                chunk = self.data[self.at : self.at + 8]
                self.value = self.value << 8 * len(chunk) | int.from_bytes(chunk, "big")
                self.at += len(chunk)
                self.n += 8 * len(chunk)
            else:
                self.value = self.value << 64 | (1 << 64) - 1
                self.n += 64
        return self.value >> self.n - n & (1 << n) - 1

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek(n)
        self.n -= n
        self.value &= (1 << self.n) - 1
        return out


class _Codes:
    """A Huffman table: by the next 16 bits, the symbol and its code's length."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                low = code << 16 - length
                self.symbol[low : low + (1 << 16 - length)] = symbols[at]
                self.length[low : low + (1 << 16 - length)] = length
                code, at = code + 1, at + 1
            code <<= 1

    def read(self, bits: _Bits) -> int:
        key = bits.peek(16)
        if not (n := int(self.length[key])):
            raise BadJpeg("no such code")
        bits.take(n)
        return int(self.symbol[key])


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> size - 1 else value - (1 << size) + 1


def _unstuff(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The data without stuffed zeros and restart markers, and where (in it) each marker stood."""
    ff = data[:-1] == 0xFF
    marker = ff & (data[1:] & 0xF8 == 0xD0)
    keep = np.ones(len(data), bool)
    keep[1:][ff & (data[1:] == 0)] = False
    keep[:-1][marker] = False
    keep[1:][marker] = False
    return data[keep], np.cumsum(keep)[:-1][marker]


class ProgressiveDecoder:
    """Parses a file and accumulates all its scans. ``comments`` holds its comment segments."""

    def __init__(self, data: bytes):
        self.data, self.comments = data, []
        self.components: dict[int, Component] = {}
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], _Codes] = {}
        self.height = self.width = self.interval = 0
        if data[:2] != b"\xff\xd8":
            raise BadJpeg("no start of image")
        try:
            self._parse()
        except (IndexError, KeyError, ValueError) as e:
            raise BadJpeg(str(e)) from e

    def _parse(self) -> None:
        data, at = self.data, 2
        while True:
            if data[at] != 0xFF:
                raise BadJpeg("marker expected")
            kind = data[at + 1]
            if kind == 0xD9:
                return
            if kind == 0xFF:
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                self._quantiser(body)
            elif kind == 0xC4:
                self._huffman(body)
            elif kind == 0xC2:
                self._frame(body)
            elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise BadJpeg("not a progressive frame")
            elif kind == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif kind == 0xFE:
                self.comments.append(body)
            elif kind == 0xDA:
                stop = at
                while True:  # the next marker that is neither a stuffed byte nor a restart
                    stop = data.index(b"\xff", stop)
                    if data[stop + 1] and not 0xD0 <= data[stop + 1] <= 0xD7:
                        break
                    stop += 2
                self._scan(body, np.frombuffer(data, np.uint8, stop - at, at))
                at = stop

    def _quantiser(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
            body = body[1 + 64 * (1 + wide) :]

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.codes[body[0] >> 4, body[0] & 15] = _Codes(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise BadJpeg("samples must have 8 bits")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        for k in range(body[5]):
            i, hv, table = body[6 + 3 * k : 9 + 3 * k]
            self.components[i] = Component(hv >> 4, hv & 15, table)
        self.h, self.v = max(c.h for c in self.components.values()), max(c.v for c in self.components.values())
        self.mcu_columns, self.mcu_rows = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components.values():
            c.columns = -(-(-(-self.width * c.h // self.h)) // 8)
            c.rows = -(-(-(-self.height * c.v // self.v)) // 8)
            c.stride = self.mcu_columns * c.h
            c.coefficients = np.zeros((self.mcu_rows * c.v * c.stride, 64), np.int32)

    def _scan(self, body: bytes, stream: np.ndarray) -> None:
        parts = [(self.components[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(body[0])]
        low, high, bits = body[1 + 2 * body[0] : 4 + 2 * body[0]]
        refine, shift = bits >> 4, bits & 15
        if len(parts) == 1:
            c, tables = parts[0]
            at = (np.arange(c.rows)[:, None] * c.stride + np.arange(c.columns)).ravel()
            if self._alike(c, tables, at, low, high, refine, shift, stream):
                return
            mcus = [[(c, tables, b)] for b in at.tolist()]
        else:
            mcus = [
                [(c, t, (y * c.v + v) * c.stride + x * c.h + h) for c, t in parts for v in range(c.v) for h in range(c.h)]
                for y in range(self.mcu_rows)
                for x in range(self.mcu_columns)
            ]
        data, marks = _unstuff(stream)
        edges = [0, *marks.tolist(), len(data)]
        step = self.interval or max(len(mcus), 1)
        for k in range(0, len(mcus), step):
            if k // step >= len(edges) - 1:
                raise BadJpeg("a restart is missing")
            reader = _Bits(data[edges[k // step] : edges[k // step + 1]].tobytes())
            self._segment(mcus[k : k + step], low, high, refine, shift, reader)

    def _segment(self, mcus, low, high, refine, shift, bits) -> None:
        before: dict[int, int] = {}
        self._run = 0
        for mcu in mcus:
            for c, tables, b in mcu:
                block = c.coefficients[b]
                if low == 0:
                    if refine:
                        block[0] |= bits.take(1) << shift
                    else:
                        size = self.codes[0, tables >> 4].read(bits)
                        before[id(c)] = before.get(id(c), 0) + _extend(bits.take(size), size)
                        block[0] = before[id(c)] << shift
                elif refine:
                    self._refine(block, self.codes[1, tables & 15], low, high, shift, bits)
                else:
                    self._first(block, self.codes[1, tables & 15], low, high, shift, bits)

    def _first(self, block, codes, low, high, shift, bits) -> None:
        if self._run:
            self._run -= 1
            return
        k = low
        while k <= high:
            run, size = divmod(codes.read(bits), 16)
            if size:
                k += run
                block[k] = _extend(bits.take(size), size) * (1 << shift)
                k += 1
            elif run == 15:
                k += 16
            else:
                self._run = (1 << run) + bits.take(run) - 1
                return

    def _refine(self, block, codes, low, high, shift, bits) -> None:
        k, one = low, 1 << shift

        def correct(i: int) -> None:
            if bits.take(1) and not abs(int(block[i])) & one:
                block[i] += one if block[i] > 0 else -one

        if not self._run:
            while k <= high:
                run, size = divmod(codes.read(bits), 16)
                value = 0
                if size:
                    value = one if bits.take(1) else -one
                elif run < 15:
                    self._run = (1 << run) + bits.take(run)
                    break
                while k <= high:  # over run zeros, correcting what is not zero
                    if block[k]:
                        correct(k)
                    elif not run:
                        if value:
                            block[k] = value
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
        if self._run:
            for i in range(k, high + 1):
                if block[i]:
                    correct(i)
            self._run -= 1

    def _alike(self, c, tables, at, low, high, refine, shift, stream) -> bool:
        """Reads a scan whose symbols are all alike at once; False, with nothing changed, if they aren't."""
        n, band = len(at), high - low + 1
        if not n or len(stream) < 2 or low == 0 and (refine or high):
            return False
        codes = self.codes.get((int(low > 0), tables >> 4 if low == 0 else tables & 15))
        if codes is None:
            return False
        data, marks = _unstuff(stream)
        key = int.from_bytes(data[:2].tobytes().ljust(2, b"\xff"), "big")
        symbol, length = int(codes.symbol[key]), int(codes.length[key])
        if not length:
            return False
        code = np.unpackbits(np.array([key >> 8, key & 255], np.uint8))[:length]
        if low == 0:  # a segment for each block, so that no value depends on the one before
            width = length + symbol
            step = -(-width // 8)
            if self.interval != 1 or not 0 < symbol <= 11 or len(data) != n * step or not np.array_equal(marks, np.arange(1, n) * step):
                return False
            bits = np.unpackbits(data.reshape(n, step), axis=1)[:, :width]
            if not (bits[:, :length] == code).all():
                return False
            c.coefficients[at, 0] = _signed(bits[:, length:]) << shift
            return True
        if self.interval and self.interval < n:
            return False
        if refine:  # nothing is zero yet: an end of band, then a bit for each value
            width = length + band
            if symbol or len(data) != -(-n * width // 8) or not c.coefficients[at, low : high + 1].all():
                return False
            bits = np.unpackbits(data)[: n * width].reshape(n, width)
            if not (bits[:, :length] == code).all():
                return False
            now = c.coefficients[at, low : high + 1]
            c.coefficients[at, low : high + 1] = now + np.sign(now) * ((bits[:, length:].astype(np.int32) << shift) & ~np.abs(now))
            return True
        width = length + symbol  # no zeros before any value
        if not 0 < symbol < 16 or len(data) != -(-n * band * width // 8):
            return False
        if width == 8:
            if not (data >> 8 - length == code @ (1 << np.arange(length)[::-1])).all():
                return False
            values = (data & (1 << symbol) - 1).astype(np.int32)
            values -= np.where(values >> symbol - 1, 0, (1 << symbol) - 1).astype(np.int32)
        else:
            bits = np.unpackbits(data)[: n * band * width].reshape(-1, width)
            if not (bits[:, :length] == code).all():
                return False
            values = _signed(bits[:, length:])
        c.coefficients[at, low : high + 1] = values.reshape(n, band) << shift
        return True

    def planes(self) -> list[np.ndarray]:
        """Each component's samples, whole MCUs, at its own size."""
        out = []
        for c in self.components.values():
            q = self.quantisers[c.table]
            samples = np.empty(c.coefficients.shape, np.uint8)
            for k in range(0, len(samples), 1 << 14):
                # the small number makes halves round alike however the product was summed
                x = (c.coefficients[k : k + (1 << 14)] * q) @ INVERSE
                samples[k : k + (1 << 14)] = np.clip(np.floor(x + (128.5 + 1e-6)), 0, 255)
            rows = len(samples) // max(c.stride, 1)
            out.append(samples.reshape(rows, c.stride, 8, 8).swapaxes(1, 2).reshape(rows * 8, c.stride * 8))
        return out

    def rgb(self) -> np.ndarray:
        """(height, width, 3) in 8 bits; one component gives grey."""
        full = []
        for c, plane in zip(self.components.values(), self.planes()):
            if self.v // c.v > 1:
                plane = np.repeat(plane, self.v // c.v, axis=0)
            if self.h // c.h > 1:
                plane = np.repeat(plane, self.h // c.h, axis=1)
            full.append(plane[: self.height, : self.width])
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, axis=2)
        if len(full) != 3:
            raise BadJpeg("one or three components are supported")
        y, cb, cr = full[0].astype(np.int32), full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
        out = np.empty((self.height, self.width, 3), np.uint8)  # BT.601 in 16-bit fixed point
        out[:, :, 0] = np.clip(y + (91881 * cr + 32768 >> 16), 0, 255)
        out[:, :, 1] = np.clip(y - (22554 * cb + 46802 * cr + 32768 >> 16), 0, 255)
        out[:, :, 2] = np.clip(y + (116130 * cb + 32768 >> 16), 0, 255)
        return out


def _signed(bits: np.ndarray) -> np.ndarray:
    """Rows of additional bits to the values they stand for."""
    size = bits.shape[1]
    value = bits.astype(np.int32) @ (1 << np.arange(size, dtype=np.int32)[::-1])
    return value - np.where(bits[:, 0], 0, (1 << size) - 1).astype(np.int32)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _stuffed(data: np.ndarray) -> bytes:
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, whose code is a single 0."""
    return _segment(0xC4, bytes([kind << 4, 1] + [0] * 15 + [symbol]))


#: Bands of the first AC scans that ``store_bytes`` writes.
BANDS = ((1, 5), (6, 63))


def store_bytes(payload: bytes) -> bytes:
    """A progressive JPEG (4:2:0) that holds ``payload``, a multiple of 64 bytes, without loss.

    A block holds 64 bytes.  The DC values go in full, a restart before each, so
    that none depends on the one before; the AC values go in two bands of seven
    upper bits and one scan of last bits.  A comment keeps the payload's length.
    """
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    mcus = -(-len(payload) // (6 * BLOCK))
    across = math.isqrt(mcus - 1) + 1
    down = -(-mcus // across)
    if 16 * across > LARGEST:
        raise ValueError("the payload is too large for one image")
    blocks = np.zeros((6 * across * down, BLOCK), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    out = [b"\xff\xd8", _segment(0xFE, b"bytes=%d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    frame = (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    out += [_segment(0xC2, b"\x08" + frame), _one_code(0, 8)]
    n = across * down
    # the luma rows hold two blocks of each MCU
    parts = [blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]]
    for i, b in enumerate(parts, 1):
        out.append(_segment(0xDD, b"\x00\x01"))
        out.append(_segment(0xDA, bytes([1, i, 0, 0, 0, 0])))
        dc = b[:, 0]
        first, last = (dc >> 1).tobytes(), (dc & 1).tolist()  # 0, eight bits, seven ones
        ends = (b"\x7f", b"\xff\x00")
        body = [first[k : k + 1] + ends[last[k]] for k in range(len(dc))]
        marks = [bytes([0xFF, 0xD0 + k % 8]) for k in range(8)]
        out.append(b"".join(x for k, y in enumerate(body) for x in (y, marks[k % 8]))[:-2])
    out.append(_segment(0xDD, b"\x00\x00"))
    out.append(_one_code(1, 7))
    for low, high in BANDS:
        for i, b in enumerate(parts, 1):
            out.append(_segment(0xDA, bytes([1, i, 0, low, high, 1])))
            out.append((b[:, low : high + 1] >> 1).tobytes())
    out.append(_one_code(1, 0))
    for i, b in enumerate(parts, 1):
        out.append(_segment(0xDA, bytes([1, i, 0, 1, 63, 0x10])))
        bits = b & 1 ^ (b < 128)
        bits[:, 0] = 0  # the end of band
        out.append(_stuffed(np.packbits(bits, axis=1)))
    return b"".join([*out, b"\xff\xd9"])


def stored_bytes(decoder: ProgressiveDecoder) -> bytes:
    """The payload that ``store_bytes`` put into the decoded file."""
    length = next(int(c[6:]) for c in decoder.comments if c.startswith(b"bytes="))
    values = np.concatenate([c.coefficients for c in decoder.components.values()])
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()[:length]


def decode_column(df: DataFrame, media_col: str, keys: list[str]) -> DataFrame:
    """The keys with height, width, rgb (rows of RGB samples) and error of each media value.

    A null value gives nulls; bytes that can't be decoded give nulls and the reason.
    """
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    fields += [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType()), T.StructField("error", T.StringType())]
    schema = T.StructType(fields)

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None
        try:
            rgb = ProgressiveDecoder(data).rgb()
        except BadJpeg as e:
            return None, None, None, str(e) or "cut short"
        return rgb.shape[0], rgb.shape[1], rgb.tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, len(keys), 1 << 20):
            columns = list(zip(*map(one, batch.column(len(keys)).to_pylist())))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return df.select(*[df[f"`{k}`"].alias(f"__k{i}") for i, k in enumerate(keys)], df[media_col].cast("binary").alias("__media")).mapInArrow(tidied(run), schema)


def store_column(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """The keys with ``media``: each text's bytes, padded with zeros to whole blocks, in a progressive JPEG."""
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, len(keys), 4 << 20):
            media = [store_bytes(padded(x)) for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(media, pa.binary())], names=schema.names)

    return df.select(*[df[f"`{k}`"].alias(f"__k{i}") for i, k in enumerate(keys)], text_bytes(df, text_col).alias("__text")).mapInArrow(tidied(run), schema)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def describe(data: bytes) -> tuple:
    """Stores a text's bytes, reads the file back and describes both; see ``describe_documents``."""
    media = store_bytes(padded(data))
    decoder = ProgressiveDecoder(media)
    payload = stored_bytes(decoder)
    rgb = decoder.rgb()
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    feature = f"{rgb.shape[0]}x{rgb.shape[1]}x3:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(rgb.tobytes()):08x}"
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature


def describe_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document of its media value, stored and read back in the same task.

    The id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, and ``feature``: shape, sums of red, green and blue, and crc32 of the
    RGB tensor.  A null text is empty (one block of zeros); equal texts have equal values.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.StringType() if k == pa.string() else T.LongType()) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, 1, 4 << 20):
            known: dict[bytes, tuple] = {}
            rows = []
            for data in batch.column(1).to_pylist():
                if data not in known:
                    known[data] = describe(data)
                rows.append(known[data])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

    return docs.select(docs[id_col].alias(id_col), text_bytes(docs, text_col).alias("__text")).mapInArrow(tidied(run), schema)
