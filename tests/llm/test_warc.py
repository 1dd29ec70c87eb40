"""Revisits against a plain loop, and the WARC reader."""

import gzip
import random

from pyspark.sql import functions as F

from basinforge.llm import warc_revisit as warc


def record(i, url, t, kind, headers, sha=None):
    return (i, url, t, kind, headers, sha, None if sha is None else 1)


def test_canonical_urls(spark):
    cases = {
        "HTTP://www.Example.com:80/a/?b=2&a=1#x": "example.com/a?a=1&b=2", "https://user@Example.com/": "example.com", "http://e.com/A?utm_source=x&gclid=1": "e.com/A",
        "e.com/a//": "e.com/a", "https://www2.e.com?x": "e.com?x", "": "", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r[0]: r[1] for r in df.select("url", warc.canonical_url(F.col("url"))).collect()} == cases


def test_as_of_join_against_a_loop(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        url = rng.choice(["http://hot.com/"] * 5 + [f"http://e.com/{rng.randint(0, 9)}"])
        kind = rng.choice(["response", "revisit"])
        tag = rng.choice(['"a"', 'W/"a"', '"b"', None])
        headers = [("ETag", tag)] if tag else []
        if rng.random() < 0.4:
            headers.append(("Last-Modified", rng.choice(["x", "y"])))
        rows.append(record(i, url, rng.randint(0, 60), kind, headers, f"s{i}" if kind == "response" else None))
    got = {r.record_id: (r.resolution, r.response_id, r.payload_sha256) for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    want = {}
    for i, url, t, kind, headers, *_ in rows:
        if kind == "revisit":
            before = [r for r in rows if r[3] == "response" and r[1] == url and r[2] < t]
            if not before:
                want[i] = ("no response", None, None)
                continue
            found = max(before, key=lambda r: (r[2], r[0]))
            mine, theirs = dict(headers), dict(found[4])
            verdict = None
            for name in ("ETag", "Last-Modified"):
                if verdict is None and name in mine and name in theirs:
                    verdict = mine[name].removeprefix("W/") == theirs[name].removeprefix("W/")
            state = {True: "resolved", None: "unverified", False: "changed"}[verdict]
            want[i] = (state, *((found[0], found[5]) if verdict is not False else (None, None)))
    assert got == want


def test_headers_are_merged(spark):
    rows = [
        record(1, "http://e.com/", 1, "response", [("Content-Type", "text/html"), ("Date", "1"), ("etag", '"x"'), ("Set-Cookie", "a")], "s"),
        record(2, "https://www.e.com", 2, "revisit", [("DATE", "2"), ("ETag", 'W/"x"'), ("Content-Type", "no"), ("Expires", "9")]),
    ]
    row = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORDS)).first()
    assert [(h.name, h.value) for h in row.headers] == [("Content-Type", "text/html"), ("Set-Cookie", "a"), ("DATE", "2"), ("ETag", 'W/"x"'), ("Expires", "9")]


def test_odd_records(spark):
    rows = [
        record(1, None, 5, "revisit", None), record(2, "http://e.com", None, "revisit", []), record(3, "http://e.com", 5, "revisit", None), record(3, "http://e.com", 5, "revisit", None),
        record(4, "http://e.com", 5, "response", None, "s"), record(5, "http://e.com", 6, None, None), record(None, "http://e.com", 9, "revisit", None), record(7, None, None, "response", None),
    ]
    df = spark.createDataFrame(rows, warc.RECORDS).withColumn("canonical", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("found", F.lit(2))
    got = sorted((str(r.record_id), r.resolution) for r in warc.resolve_revisits(df).collect())
    assert got == [("1", "no key"), ("2", "no key"), ("3", "no response"), ("3", "no response"), ("None", "unverified")]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_reader(spark, tmp_path):
    def block(kind, url, http, more=""):
        body = http.encode()
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-0{1 if kind == 'response' else 2}T00:00:00Z\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    data = block("warcinfo", "x", "format: warc") + block("response", "<http://e.com/>", 'HTTP/1.1 200 OK\r\nETag: "q"\r\nX-Long: a\r\n b\r\n\r\nhello')
    data += block("revisit", "http://e.com/#f", 'HTTP/1.1 304 Not Modified\r\nETag: "q"\r\n\r\n', "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    records = warc.read_warc(spark, str(tmp_path)).cache()
    assert records.count() == 4 and records.where("kind = 'response'").first().payload_bytes == 5
    out = warc.resolve_revisits(records).collect()
    assert len(out) == 2 and {r.resolution for r in out} == {"resolved"}
    assert ("X-Long", "a b") in [(h.name, h.value) for h in out[0].headers]


def test_a_bad_length_costs_one_record():
    def one(url, length):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Length: {length}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nab\r\n\r\n".encode()

    for bad in ("x", "-1", "-5", ""):
        data = one("http://a", 21) + one("http://b", bad) + one("http://c", 21)
        assert [(r["nth"], r["url"], r["payload_bytes"]) for r in warc.parse_warc(data)] == [(0, "http://a", 2), (2, "http://c", 2)]


def plain_record(url, body, length=None, date="2024-01-01T00:00:00Z"):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(http) if length is None else length}\r\n\r\n".encode() + http + b"\r\n\r\n"


def seen(data):
    return [(r["url"], r["kind"], r["payload_bytes"], r["problem"]) for r in warc.parse_warc(data)]


def test_a_length_that_is_too_long_swallows_no_record():
    data = plain_record("http://a", b"x" * 21, 4000) + plain_record("http://b", b"yy")
    assert seen(data) == [("http://a", "response", 21, "length"), ("http://b", "response", 2, None)]
    packed = seen(gzip.compress(data))
    assert packed == seen(data)
    import hashlib

    assert next(warc.parse_warc(data))["payload_sha256"] == hashlib.sha256(b"x" * 21).hexdigest()
    for n in (15, 16, 17, 31, 32, 33, (1 << 20) - 25, (1 << 20) - 19, (1 << 20) - 3, 1 << 20):  # where reads end
        data = plain_record("http://a", b"x" * n, n + 100) + plain_record("http://b", b"yy" * 40)
        assert seen(data) == [("http://a", "response", n, "length"), ("http://b", "response", 80, None)]


def test_a_length_that_is_too_short_costs_one_record():
    data = plain_record("http://a", b"x" * 30, 40) + plain_record("http://b", b"yy")
    assert seen(data) == [("http://a", "response", 21, "length"), ("http://b", "response", 2, None)]


def test_a_payload_that_holds_a_record():
    inner = plain_record("http://inner", b"zz")
    data = plain_record("http://a", b"see\r\n\r\n" + inner) + plain_record("http://b", b"yy")
    assert [r[0] for r in seen(data)] == ["http://a", "http://b"] and {r[3] for r in seen(data)} == {None}


def test_cut_off_and_damaged_files():
    one, two = plain_record("http://a", b"x" * 500), plain_record("http://b", b"y" * 5000)
    assert seen((one + two)[:-1000]) == [("http://a", "response", 500, None), ("http://b", "response", 4004, "truncated")]
    whole = gzip.compress(one) + gzip.compress(two)
    assert seen(whole) == [("http://a", "response", 500, None), ("http://b", "response", 5000, None)]
    assert [r[1:] for r in seen(whole[:-20])][-1] == ("damaged", None, "EOFError")
    assert seen(gzip.compress(one) + b"junk that is not packed")[-1][1:] == ("damaged", None, "BadGzipFile")
    bad = bytearray(gzip.compress(one))
    bad[-6] ^= 255  # the checksum
    assert seen(bytes(bad) + gzip.compress(two))[-1][1] == "damaged"
    broken = bytearray(whole)
    broken[15:40] = b"\xff" * 25
    assert seen(bytes(broken))[-1][1] == "damaged"
    assert seen(b"") == [] and seen(b"\x1f\x8b")[-1][1] == "damaged" and seen(b"nothing of the kind") == []


def test_dates_without_a_zone_are_utc():
    for date, want in (("2024-01-01T00:00:00", 1704067200), ("2024-01-01T01:00:00+01:00", 1704067200), ("2024-01-01", 1704067200), ("soon", None), ("", None)):
        assert [r["captured"] for r in warc.parse_warc(plain_record("http://a", b"x", date=date))] == [want]


def test_bad_files_stop_no_job_and_resolve_nothing(spark, tmp_path):
    (tmp_path / "good.warc").write_bytes(plain_record("http://a", b"x"))
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(plain_record("http://b", b"y" * 999))[:-9])
    (tmp_path / "cut.warc").write_bytes(plain_record("http://c", b"z" * 999)[:-500])
    revisit = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Profile: server-not-modified\r\nWARC-Target-URI: http://c\r\nWARC-Date: 2025-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "later.warc").write_bytes(revisit)
    records = warc.read_warc(spark, str(tmp_path)).cache()
    assert {(r.url, r.kind, r.problem) for r in records.collect()} >= {("http://a", "response", None), ("http://c", "response", "truncated"), (None, "damaged", "EOFError"), ("http://c", "revisit", None)}
    assert [r.resolution for r in warc.resolve_revisits(records).collect()] == ["no response"]
