"""WARC: not-modified revisits resolved to the responses that they stand for.

A revisit record ("304 Not Modified") has no body.  It is joined as of its
capture time with the latest full response of the same canonical URL that was
captured earlier; the validators that it names must agree with that response; the
headers that a 304 may update replace those of the response, and all others stay.

The as-of join keeps no URL in one task: records are dealt by range of (URL,
time), so a URL with very many captures spans partitions; each partition looks back
within itself, and the last response of each (partition, URL) is carried to the
partitions behind.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basinforge.llm.textcols import checkpointed

#: The headers that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name no resource.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|msclkid|mc_eid|sessionid|phpsessid|jsessionid)(=|$)"

HEADERS = "array<struct<name:string,value:string>>"
RECORDS = f"record_id long, url string, captured long, kind string, headers {HEADERS}, payload_sha256 string, payload_bytes long"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, default port, www, fragment and tracking; parameters sorted."""
    s = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(s, "^[^/?]*", 0)
    rest = F.substring(s, F.length(authority) + 1, F.length(s))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, "^[^@]*@", "")), ":(80|443)$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, "\\?.*$", 0), "^\\?", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The first value of that header, or null."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, those replaced that the revisit brings and a 304 may update."""
    brought = F.filter(revisit, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(brought, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(response, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False))), brought)


def latest_earlier(records: DataFrame) -> DataFrame:
    """Each revisit with ``found``: the latest response of its ``canonical`` captured before it, or null.

    ``records`` has canonical, captured, kind and ``row`` (a struct with record_id).
    At equal times a response is not earlier; of responses at one time the
    greatest record_id is the latest.
    """
    is_response = (F.col("kind") == "response").cast("int")
    dealt = records.withColumn("__response", is_response).withColumn("__id", F.col("row.record_id"))
    keys = ("canonical", "captured", "__response", "__id")
    dealt = checkpointed(dealt.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    of = Window.partitionBy("__part", "canonical").orderBy("captured", "__response", "__id")
    response = F.when(F.col("__response") == 1, F.struct("captured", "row"))
    near = dealt.withColumn("__near", F.last(response, ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, -1)))
    last = dealt.where("__response = 1").groupBy("__part", "canonical").agg(F.max_by(F.col("row"), F.struct("captured", "__id")).alias("__last"))
    parts = dealt.select("__part", "canonical").distinct().join(last, ["__part", "canonical"], "left")
    # a URL has one row here for each partition that it spans
    across = Window.partitionBy("canonical").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("__carried", F.last("__last", ignorenulls=True).over(across)).where("__carried is not null").select("__part", "canonical", "__carried")
    # the windows have dealt the revisits by these keys already, so nothing need be sent to all
    revisits = near.where("__response = 0").join(carried.hint("merge"), ["__part", "canonical"], "left")
    return revisits.select("canonical", "captured", "row", F.coalesce("__near.row", "__carried").alias("found"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit record of ``records`` (columns of ``RECORDS``; others are ignored).

    record_id, canonical_url, captured, resolution, response_id, payload_sha256,
    payload_bytes and headers.  ``resolution`` is "resolved" (a validator agrees),
    "unverified" (the revisit names none), "changed" (one that both name differs),
    "no response" or "no key" (null URL or time); only the first two have a payload.
    The entity tag, compared weakly, decides before the date.  Null headers are
    none.  Repeated records are resolved each.  Kinds but response and revisit are ignored.
    Where ``records`` has ``problem``, responses that have one are left out.  An empty table gives no rows.
    """
    if "problem" in records.columns:
        records = records.where((F.col("kind") != "response") | F.col("problem").isNull())
    headers = F.coalesce(F.col("headers"), F.array().cast(HEADERS))
    row = F.struct("record_id", "url", "captured", headers.alias("headers"), "payload_sha256", "payload_bytes")
    usable = records.where(F.col("kind").isin("response", "revisit")).select(canonical_url(F.col("url")).alias("canonical"), "captured", "kind", row.alias("row"))
    keyed = F.col("canonical").isNotNull() & F.col("captured").isNotNull()
    joined = latest_earlier(usable.where(keyed))
    without = usable.where(~keyed & (F.col("kind") == "revisit"))
    joined = joined.unionByName(without.select("canonical", "captured", "row", F.lit(None).cast(joined.schema["found"].dataType).alias("found")))

    mine, theirs = F.col("row.headers"), F.col("found.headers")
    tag, date = header(mine, "etag"), header(mine, "last-modified")
    agrees = (
        F.when(tag.isNotNull() & header(theirs, "etag").isNotNull(), _weak(tag) == _weak(header(theirs, "etag")))
        .when(date.isNotNull() & header(theirs, "last-modified").isNotNull(), F.trim(date) == F.trim(header(theirs, "last-modified")))
    )
    resolution = (
        F.when(F.col("canonical").isNull() | F.col("captured").isNull(), "no key")
        .when(F.col("found").isNull(), "no response")
        .when(agrees, "resolved")
        .when(agrees.isNull(), "unverified")
        .otherwise("changed")
    )
    has = F.col("resolution").isin("resolved", "unverified")
    return joined.withColumn("resolution", resolution).select(
        F.col("row.record_id").alias("record_id"),
        F.col("canonical").alias("canonical_url"),
        "captured",
        "resolution",
        F.when(has, F.col("found.record_id")).alias("response_id"),
        F.when(has, F.col("found.payload_sha256")).alias("payload_sha256"),
        F.when(has, F.col("found.payload_bytes")).alias("payload_bytes"),
        F.when(has, merged_headers(theirs, mine)).alias("headers"),
    )


class _Part(io.RawIOBase):
    """The next ``size`` bytes of a stream as a stream of its own."""

    def __init__(self, stream: io.BufferedReader, size: int):
        self._stream, self._size, self._left = stream, size, size

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._size - self._left

    def readinto(self, into) -> int:
        data = self._stream.read(min(len(into), self._left))
        into[: len(data)] = data
        self._left -= len(data)
        return len(data)


def _lines(stream: io.BufferedReader, first: bytes = b"") -> list[tuple[str, str]]:
    """Header fields up to the empty line; a first line without a colon is named "". Continued lines are joined."""
    out: list[tuple[str, str]] = []
    line = first or stream.readline()
    while line not in (b"", b"\r\n", b"\n"):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif not out and (":" not in text or text.startswith(("WARC/", "HTTP/"))):
            out.append(("", text))
        else:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
        line = stream.readline()
    return out


#: What a damaged stream raises: cut off, a bad checksum, something that is not packed.
_DAMAGE = (EOFError, OSError, zlib.error)
_START = re.compile(rb"(?:\r?\n){2}(?=WARC/1\.[0-9]\r?\n)")


class _Block:
    """A record's block, read once: its HTTP headers, and the digest and size of what follows.

    ``cut`` is the place in the file of a record that seems to start within the block, and with it the digest and
    size up to there, which hold if the length turns out to be wrong; ``whole`` tells whether all bytes were there.
    """

    def __init__(self, stream: io.BufferedReader, size: int, hashed: bool):
        part = io.BufferedReader(_Part(stream, size))
        begin = stream.tell()
        self.headers = [(k, v) for k, v in _lines(part) if k] if hashed else []
        digest, self.size, self.cut = hashlib.sha256(), 0, None
        tail, at = b"", begin + part.tell()
        while data := part.read(1 << 20):
            seen = tail + data
            if self.cut is None and (found := _START.search(seen)):
                before = digest.copy()
                # the digest lags by the tail, so that it can stop before a record that starts in it
                before.update(seen[: found.start()])
                self.cut = (at - len(tail) + found.end(), before.hexdigest(), self.size - len(tail) + found.start())
            digest.update(seen[:-16])
            tail = seen[-16:]
            self.size += len(data)
            at += len(data)
        digest.update(tail)
        self.digest, self.whole = digest.hexdigest(), at - begin >= size


def _when(text: str) -> int | None:
    """Seconds since 1970 of a date; one without a zone is UTC."""
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((found if found.tzinfo else found.replace(tzinfo=timezone.utc)).timestamp())


def parse_warc(data: bytes) -> Iterator[dict]:
    """Response and not-modified revisit records of a file, plain or gzipped (by record or as a whole).

    The file is unpacked and hashed as it is read, so no record need fit in memory.  Records of
    other kinds are passed over, among them revisits for an identical digest, which name their
    payload themselves.  A date without a zone is UTC.

    ``problem`` is null, or "truncated" for a record that the file ends in, or "length" for one whose length is wrong: too
    long if another record starts within, and then the payload ends before that and reading goes on there; too short if no
    empty line follows, and then it is the part that the length names.  A record without a length is passed over.  A file that is cut off or damaged gives what stands before the
    damage, and a last row of kind "damaged" whose problem is the error's name.
    """
    source = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source) if data[:2] == b"\x1f\x8b" else source)
    nth = 0
    try:
        for nth, record in enumerate(_records(stream)):
            if record:
                yield {"nth": nth} | record
    except _DAMAGE as e:
        none = dict.fromkeys(("url", "captured", "payload_sha256", "payload_bytes"))
        yield {"nth": nth + 1, **none, "kind": "damaged", "headers": [], "problem": type(e).__name__}


def _records(stream: io.BufferedReader) -> Iterator[dict | None]:
    """A file's records in order, None for those that are passed over."""
    first = b""
    while True:
        head, first = _lines(stream, first), b""
        if not head:
            if not stream.peek(1):
                return
            continue
        fields = {k.lower(): v for k, v in head}
        length = fields.get("content-length", "0")
        if not (length.isascii() and length.isdigit()):  # the record's end is unknown
            while (first := stream.readline()) and not first.startswith(b"WARC/"):
                pass
            yield None
            continue
        kind = fields.get("warc-type", "")
        wanted = kind == "response" or kind == "revisit" and fields.get("warc-profile", "").endswith("server-not-modified")
        block = _Block(stream, int(length), wanted)
        digest, size = block.digest, block.size
        follows = stream.peek(2)[:2]
        problem = None if block.whole and (follows[:1] == b"\n" or follows in (b"\r\n", b"")) else "length" if block.whole else "truncated"
        if problem and block.cut:
            problem, (at, digest, size) = "length", block.cut
            stream.seek(at)
        elif problem == "length":  # what is left of it stands before the next record
            while (first := stream.readline()) and not first.startswith(b"WARC/"):
                pass
        if not wanted:
            yield None
            continue
        yield {
            "url": fields.get("warc-target-uri", "").strip("<>") or None,
            "captured": _when(fields.get("warc-date", "")),
            "kind": kind,
            "headers": [{"name": k, "value": v} for k, v in block.headers],
            "payload_sha256": digest if kind == "response" else None,
            "payload_bytes": size if kind == "response" else None,
            "problem": problem,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``; record_id is made of the file's name and the record's place in it.

    A file as it is stored, unpacked or not, is one row of Spark's binary reader, and so at most 2 GB.  ``problem`` tells what is
    wrong with a record or, in a row of kind "damaged", with the rest of a file (see ``parse_warc``); no file stops the job.
    Responses with a problem are none that revisits are resolved by.  An empty folder gives no rows.
    """
    schema = "path string, nth long, " + RECORDS.partition(", ")[2] + ", problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        kinds = {"path": pa.string(), "nth": pa.int64(), "url": pa.string(), "captured": pa.int64(), "kind": pa.string()}
        kinds |= {"headers": headers, "payload_sha256": pa.string(), "payload_bytes": pa.int64(), "problem": pa.string()}
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                records = ({"path": name} | r for r in parse_warc(content.as_py()))
                while some := list(islice(records, 1000)):
                    yield pa.RecordBatch.from_pylist(some, schema=pa.schema(list(kinds.items())))

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    return rows.select(F.xxhash64("path", "nth").alias("record_id"), "url", "captured", "kind", "headers", "payload_sha256", "payload_bytes", "problem")
