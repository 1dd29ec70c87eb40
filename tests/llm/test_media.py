"""Progressive JPEG: a plain encoder here, the decoder there."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from basinforge.llm import progressive_jpeg as jpeg


class Writer:
    """Codes the scans of coefficient arrays bit by bit, with a fixed table of eight-bit codes."""

    def __init__(self, height, width, sampling, seed, interval=0):
        rng = np.random.default_rng(seed)
        self.h, self.w, self.sampling, self.interval = height, width, sampling, interval
        hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
        self.mx, self.my = -(-width // (8 * hm)), -(-height // (8 * vm))
        self.blocks, self.own = [], []
        for h, v in sampling:
            n = self.mx * h * self.my * v
            c = rng.integers(-40, 41, (n, 64)) * (rng.random((n, 64)) < 0.15)
            c[:, 0] = rng.integers(-200, 200, n)
            self.blocks.append(c)
            self.own.append((-(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)))

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)][::-1]

    def symbol(self, s):
        self.put(self.code[s], 9)

    def table(self, kind):
        # 256 codes of nine bits: no code is all ones
        self.code = {s: s for s in range(256)}
        counts = [0] * 16
        counts[8] = 256 - 1
        return jpeg._segment(0xC4, bytes([kind << 4]) + bytes(counts) + bytes(range(255)))

    def flush(self):
        while len(self.bits) % 8:
            self.bits.append(1)
        data = np.packbits(np.array(self.bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
        self.bits = []
        return data

    @staticmethod
    def size(v):
        return abs(v).bit_length()

    def value(self, v):
        s = self.size(v)
        self.put(v if v > 0 else v + (1 << s) - 1, s)

    def scan(self, parts, low, high, refine, shift):
        self.bits, out, before, run = [], [], {}, 0
        if len(parts) == 1:
            k = parts[0]
            rows, columns = self.own[k]
            stride = self.mx * self.sampling[k][0]
            mcus = [[(k, y * stride + x)] for y in range(rows) for x in range(columns)]
        else:
            mcus = [[(k, (y * self.sampling[k][1] + v) * self.mx * self.sampling[k][0] + x * self.sampling[k][0] + h) for k in parts for v in range(self.sampling[k][1]) for h in range(self.sampling[k][0])] for y in range(self.my) for x in range(self.mx)]
        for m, mcu in enumerate(mcus):
            if self.interval and m and m % self.interval == 0:
                out += [self.flush(), bytes([0xFF, 0xD0 + (m // self.interval - 1) % 8])]
                before = {}
            for k, b in mcu:
                block = self.blocks[k][b].tolist()
                if low == 0:
                    if refine:
                        self.put(block[0] >> shift & 1, 1)
                    else:
                        d = (block[0] >> shift) - before.get(k, 0)
                        before[k] = block[0] >> shift
                        self.symbol(self.size(d))
                        self.value(d)
                elif not refine:
                    now = [(abs(v) >> shift) * (1 if v > 0 else -1) for v in block]
                    zeros = 0
                    for i in range(low, high + 1):
                        if not now[i]:
                            zeros += 1
                            continue
                        while zeros > 15:
                            self.symbol(0xF0)
                            zeros -= 16
                        self.symbol(zeros << 4 | self.size(now[i]))
                        self.value(now[i])
                        zeros = 0
                    if zeros:
                        self.symbol(0)
                else:
                    old = [abs(v) >> shift + 1 for v in block]
                    new = [i for i in range(low, high + 1) if not old[i] and abs(block[i]) >> shift == 1]
                    last, zeros, waiting = new[-1] if new else low - 1, 0, []
                    for i in range(low, high + 1):
                        if i > last:
                            break
                        if old[i]:
                            waiting.append(abs(block[i]) >> shift & 1)
                        elif abs(block[i]) >> shift == 1:
                            self.symbol(zeros << 4 | 1)
                            self.put(int(block[i] > 0), 1)
                            for w in waiting:
                                self.put(w, 1)
                            zeros, waiting = 0, []
                        else:
                            zeros += 1
                            if zeros == 16:
                                self.symbol(0xF0)
                                for w in waiting:
                                    self.put(w, 1)
                                zeros, waiting = 0, []
                    rest = [abs(block[i]) >> shift & 1 for i in range(last + 1, high + 1) if old[i]]
                    if last < high or waiting:
                        self.symbol(0)
                        for w in waiting + rest:
                            self.put(w, 1)
        head = jpeg._segment(0xDA, bytes([len(parts)] + [x for k in parts for x in (k + 1, 0)] + [low, high, refine << 4 | shift]))
        return head + b"".join([*out, self.flush()])

    def file(self):
        frame = bytes([8]) + self.h.to_bytes(2, "big") + self.w.to_bytes(2, "big") + bytes([len(self.sampling)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(self.sampling))
        out = [b"\xff\xd8", jpeg._segment(0xDB, b"\x00" + bytes(range(1, 65))), jpeg._segment(0xC2, frame), self.table(0), self.table(1)]
        if self.interval:
            out.append(jpeg._segment(0xDD, self.interval.to_bytes(2, "big")))
        every = list(range(len(self.sampling)))
        out += [self.scan(every, 0, 0, 0, 1)]
        out += [self.scan([k], low, high, 0, 2) for k in every for low, high in ((1, 5), (6, 63))]
        out += [self.scan([k], 1, 63, 2, 1) for k in every]
        out += [self.scan(every, 0, 0, 1, 0)]
        out += [self.scan([k], 1, 63, 1, 0) for k in every]
        return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
@pytest.mark.parametrize("interval", [0, 2])
def test_scans_add_up(sampling, interval):
    w = Writer(37, 51, sampling, len(sampling) + interval, interval)
    d = jpeg.ProgressiveDecoder(w.file())
    for k, c in enumerate(d.components.values()):
        rows, columns = w.own[k]
        at = (np.arange(rows)[:, None] * c.stride + np.arange(columns)).ravel()
        assert np.array_equal(c.coefficients[at], w.blocks[k][at])
        assert np.array_equal(c.coefficients[:, 0], w.blocks[k][:, 0])
    assert d.rgb().shape == (37, 51, 3) and d.rgb().dtype == np.uint8


def slow_plane(blocks, across, own, table):
    """Samples of a component pixel by pixel, from the definition of the transform."""
    rows, columns = own
    zigzag = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
    plane = np.zeros((8 * rows, 8 * columns))
    cos = [[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2 for u in range(8)] for x in range(8)]
    for r in range(rows):
        for q in range(columns):
            grid = np.zeros((8, 8))
            for k, place in enumerate(zigzag):
                grid[place // 8, place % 8] = blocks[r * across + q][k] * table[k]
            for y in range(8):
                for x in range(8):
                    plane[8 * r + y, 8 * q + x] = sum(grid[v, u] * cos[y][v] * cos[x][u] for v in range(8) for u in range(8)) + 128
    return plane


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
def test_pixels_against_the_definition(sampling):
    """Dequantising, the transform, chroma upsampling by repetition and the colour conversion, each pixel by itself."""
    h, w = 19, 21
    source = Writer(h, w, sampling, 3)
    for c in source.blocks:  # small enough not to be clipped everywhere
        c[:, 1:] = np.sign(c[:, 1:]) * (np.arange(63) < 6)
        c[:, 0] %= 400
    got = jpeg.ProgressiveDecoder(source.file()).rgb()
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    planes = [slow_plane(b, source.mx * s[0], own, range(1, 65)) for b, s, own in zip(source.blocks, sampling, source.own)]
    clipped = lambda v: min(max(round(float(v)), 0), 255)
    worst = 0
    for y in range(h):
        for x in range(w):
            v = [min(max(p[y * sv // vm, x * sh // hm], 0), 255) for p, (sh, sv) in zip(planes, sampling)]
            want = [v[0]] * 3 if len(v) == 1 else [v[0] + 1.402 * (v[2] - 128), v[0] - 0.344136 * (v[1] - 128) - 0.714136 * (v[2] - 128), v[0] + 1.772 * (v[1] - 128)]
            worst = max(worst, *(abs(int(g) - clipped(t)) for g, t in zip(got[y, x], want)))
    assert worst <= 2  # samples are rounded before the conversion


def test_inverse_transform():
    rng = np.random.default_rng(1)
    block = rng.integers(-100, 100, 64)
    grid = np.zeros((8, 8))
    grid.ravel()[jpeg.ZIGZAG] = block
    c = lambda k: 1 / np.sqrt(2) if k == 0 else 1
    want = [[sum(c(u) * c(v) / 4 * grid[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.allclose(block @ jpeg.INVERSE, np.array(want).ravel())
    assert list(jpeg.ZIGZAG[:6]) == [0, 1, 8, 16, 9, 2]


@pytest.mark.parametrize("n", [64, 128, 384, 448, 6400])
def test_round_trip_by_both_paths(monkeypatch, n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    media = jpeg.store_bytes(payload)
    fast = jpeg.ProgressiveDecoder(media)
    assert jpeg.stored_bytes(fast) == payload
    monkeypatch.setattr(jpeg.ProgressiveDecoder, "_alike", lambda self, *a: False)
    slow = jpeg.ProgressiveDecoder(media)
    assert jpeg.stored_bytes(slow) == payload and np.array_equal(fast.rgb(), slow.rgb())


def test_bad_files(spark):
    good = jpeg.store_bytes(bytes(64))
    rng = random.Random(1)
    broken = [None, b"", b"no", good[:40], good[:-30], good.replace(b"\xff\xc2", b"\xff\xc0")]
    for _ in range(60):
        x = bytearray(good)
        x[rng.randrange(2, len(x))] = rng.randrange(256)
        broken.append(bytes(x))
    df = spark.createDataFrame([(i, x) for i, x in enumerate([good, *broken])], "id long, media binary")
    rows = sorted(jpeg.decode_column(df, "media", ["id"]).collect())
    assert rows[0].height == 16 and len(rows[0].rgb) == 16 * 16 * 3 and rows[0].error is None
    assert rows[1].error is None and rows[1].rgb is None and all(r.error for r in rows[2:5])
    assert len(rows) == len(broken) + 1


def test_documents(odd_docs, no_docs):
    rows = jpeg.describe_documents(odd_docs).collect()
    source = odd_docs.select("doc_id", "text").collect()
    want = sorted((s.doc_id or -1, hashlib.sha256(jpeg.padded((s.text or "").encode())).hexdigest(), len((s.text or "").encode()), zlib.crc32(jpeg.padded((s.text or "").encode())[-64:])) for s in source)
    assert sorted((r.doc_id or -1, r.payload_sha256, r.n_bytes, r.tail_crc32) for r in rows) == want
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 for r in rows)
    by_text = {}
    assert all(by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature) for r in rows)
    assert jpeg.describe_documents(no_docs).count() == 0
    stored = jpeg.store_column(odd_docs, "text", ["doc_id"])
    assert jpeg.decode_column(stored, "media", ["doc_id"]).where("error is not null or rgb is null").count() == 0
