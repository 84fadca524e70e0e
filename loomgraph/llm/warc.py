"""WARC archives: pages written as records, read back, and their captures merged into one ordered history.

Writing is columns only. A record is a string, and as records end with two line ends, Spark's text writer
with that separator makes archives; its commit survives lost executors on any file system. Payloads that
are equal are stored once: the least page_id responds, others revisit it.

Reading streams each archive by the lengths in its headers, so nothing inside a payload can end a record;
payloads of responses are digested again and held against their header. The captures of an archive are a
run, sorted by URL key and timestamp where it was read. Runs are cut at keys into ranges, and a task merges
its range's slices of all runs with a loser tree. Cuts come from a bounded sample of keys and decide only
how even the ranges are. As keys take in the place in an archive, a URL captured ever so often is cut too.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import shared_dir, table, written

#: Payloads below this many bytes are always stored.
LEAST_SHARED = 100
#: Records of an archive at most, as one is read whole (compressed) before it is streamed.
RECORDS = 2_000
#: Captures of a merged range and number of ranges, which bounds the sample of keys.
RANGE, MOST_RANGES, KEYS_A_RANGE = 100_000, 2_000, 20
CRLF = "\r\n"


# --- writing -----------------------------------------------------------------------------------------

def judged(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, captured) with payload_bytes, payload_digest and refers_to, which is null for responses.

    Only payloads found more than once are joined; short ones, however many are equal, are dealt evenly.
    """
    payload = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", payload.alias("html"), "captured", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    firsts = own.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    deal = F.when(F.col("payload_bytes") < LEAST_SHARED, F.spark_partition_id() + 1).otherwise(0)
    out = own.withColumn("deal", deal).join(firsts.select("payload_digest", "first", F.lit(0).alias("deal")), ["payload_digest", "deal"], "left")
    return out.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))).drop("deal", "first")


def records(pages: DataFrame) -> DataFrame:
    """judged pages -> value: a WARC record without the two line ends after it."""
    lines = lambda *parts: F.concat_ws(CRLF, *parts)
    pair = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    response = F.col("refers_to").isNull()
    seconds = F.expr("pmod(captured, 86400)")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("captured") / 86400).cast("int")), "yyyy-MM-dd")
    clock = F.format_string("%02d:%02d:%02d", F.expr("pmod(captured, 86400) div 3600"), F.expr("pmod(captured, 3600) div 60"), seconds % 60)
    uri = F.replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    http = F.concat(lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), pair("Content-Length", F.col("payload_bytes").cast("string"))), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(response, F.col("payload_bytes")).otherwise(0)
    head = lines(
        F.lit("WARC/1.1"), pair("WARC-Type", F.when(response, "response").otherwise("revisit")), pair("WARC-Record-ID", urn("page_id")), pair("WARC-Target-URI", uri),
        pair("WARC-Date", F.concat(day, F.lit("T"), clock, F.lit("Z"))), pair("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(~response, lines(pair("WARC-Refers-To", urn("refers_to")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http;msgtype=response"), pair("Content-Length", length.cast("string")),
    )
    return pages.select(F.concat(head, F.lit(CRLF + CRLF), http, F.when(response, F.col("html")).otherwise("")).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """pages(page_id long, url, html, captured: seconds since 1970) as compressed archives in a new folder.

    A null payload is an empty one, a null url leaves its header out, a null date counts as 1970. Of equal payloads
    without any page_id all are stored, as are repeated rows of the least page_id; other columns are not written.
    """
    dated = pages.withColumn("captured", F.coalesce(F.col("captured").cast("long"), F.lit(0)))
    records(judged(dated)).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


# --- reading -----------------------------------------------------------------------------------------

CAPTURE = pa.schema([
    ("run", pa.string()), ("nth", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()),
])
_TYPES = {pa.string(): "string", pa.int64(): "long"}
SCHEMA = ", ".join(f"{f.name} {_TYPES[f.type]}" for f in CAPTURE)


def url_key(url: str | None) -> str:
    """The host's parts from the last to the first, then the rest: captures of a site and of a page stand together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]+)?([^#]*)", url or "", re.I)
    if not m:
        return url or ""
    host = re.sub(r"^www[0-9]*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def _headers(stream: io.BufferedIOBase) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line, in lower case, and how many bytes they took."""
    out, size = {}, 0
    while True:
        line = stream.readline()
        size += len(line)
        if line in (b"\r\n", b"\n", b""):
            return out, size
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(m[1]) if m else None


def captures(archive: str, stream: io.BufferedIOBase) -> Iterator[dict]:
    """Responses and revisits of one archive; a broken record or a payload that its digest doesn't fit is an error."""
    at = 0
    while line := stream.readline():
        if not line.strip():
            at += len(line)
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record at {at}")
        head, size = _headers(stream)
        length, digest = int(head["content-length"]), hashlib.sha256()
        kind, left, http = head.get("warc-type"), length, {}
        if kind in ("response", "revisit"):
            http, took = _headers(stream)
            left -= took
        payload = left
        while left > 0:
            part = stream.read(min(left, 1 << 20))
            if not part:
                raise ValueError(f"{archive}: the record at {at} ends early")
            digest.update(part)
            left -= len(part)
        stated = head.get("warc-payload-digest", "").removeprefix("sha256:")
        if kind == "response" and stated != digest.hexdigest():
            raise ValueError(f"{archive}: the payload of the record at {at} is not what its digest says")
        if kind in ("response", "revisit"):
            yield {
                "url_key": url_key(head.get("warc-target-uri")), "captured": head.get("warc-date", ""), "page_id": _page(head.get("warc-record-id")), "record_type": kind,
                "payload_bytes": payload if kind == "response" else int(http["content-length"]), "payload_digest": stated, "refers_to": _page(head.get("warc-refers-to")), "archive": archive, "offset": at,
            }
        at += len(line) + size + length


def place(c: dict) -> tuple:
    """Order of captures; no two have the same place."""
    return c["url_key"], c["captured"], c["page_id"] is not None, c["page_id"] or 0, c["archive"], c["offset"]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in a folder, those of an archive sorted: a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                name = name.as_py().rsplit("/", 1)[-1]
                with gzip.open(pa.BufferReader(content.as_buffer())) as stream:
                    own = sorted(captures(name, io.BufferedReader(stream)), key=place)
                yield pa.RecordBatch.from_pylist([{"run": name, "nth": i, **c} for i, c in enumerate(own)], CAPTURE)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


# --- merging -----------------------------------------------------------------------------------------

class LoserTree:
    """Sorted streams as one: inner nodes hold the losers of their matches, so that the winner's successor plays one path up."""

    def __init__(self, streams: Iterable[Iterator[dict]]):
        self.streams = list(streams)
        self.heads = [self._next(s) for s in self.streams]
        self.nodes = [-1] * max(1, len(self.streams))
        for leaf in range(len(self.streams)):
            self._play(leaf)

    @staticmethod
    def _next(stream: Iterator[dict]) -> tuple[tuple, dict] | None:
        value = next(stream, None)
        return None if value is None else (place(value), value)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[0] < y[0])

    def _play(self, winner: int) -> None:
        node = (winner + len(self.streams)) // 2
        while node:
            if self.nodes[node] < 0:  # nobody to play against yet, while the tree is built
                self.nodes[node] = winner
                return
            if self._beats(self.nodes[node], winner):
                self.nodes[node], winner = winner, self.nodes[node]
            node //= 2
        self.nodes[0] = winner

    def __iter__(self) -> Iterator[dict]:
        while self.streams and (head := self.heads[self.nodes[0]]) is not None:
            yield head[1]
            first = self.nodes[0]
            self.heads[first] = self._next(self.streams[first])
            self._play(first)


def cuts(captured: DataFrame, size: int = RANGE) -> list[tuple]:
    """Places at which ranges begin, from a sample of at most KEYS_A_RANGE keys for each of at most MOST_RANGES ranges."""
    ranges = min(MOST_RANGES, -(-captured.count() // size))
    if ranges < 2:
        return []
    keys = ["url_key", "captured", "page_id", "archive", "offset"]
    some = captured.select(*keys).orderBy(F.xxhash64("page_id", "url_key", "offset"), *keys).limit(ranges * KEYS_A_RANGE)
    places = sorted(place(r.asDict()) for r in some.collect())
    return [places[i * len(places) // ranges] for i in range(1, ranges)]


def histories(captured: DataFrame, size: int = RANGE) -> DataFrame:
    """runs() as a table -> captures in one order: by range, and by number within the range."""
    starts = cuts(captured, size)
    fields = [f for f in CAPTURE if f.name not in ("run", "nth")]
    entry = pa.struct(fields)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each run's stretch within a range as one row."""
        for batch in batches:
            own = defaultdict(list)
            for c in batch.to_pylist():
                own[bisect_right(starts, place(c)), c["run"]].append(c)
            yield pa.record_batch({
                "range": pa.array([r for r, _ in own], pa.int32()), "run": pa.array([n for _, n in own], pa.string()), "nth": pa.array([x[0]["nth"] for x in own.values()], pa.int64()),
                "entries": pa.array(list(own.values()), pa.list_(entry)),
            })

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            ordered = iter(LoserTree(_entries(parts) for parts in held.values()))
            for nth, c in enumerate(ordered):
                rows.append({"range": range_, "nth": nth, **c})
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows.clear()

        schema = pa.schema([("range", pa.int32()), ("nth", pa.int64()), *fields])
        range_, held, rows = None, defaultdict(list), []
        for batch in batches:
            for i, (r, run) in enumerate(zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), strict=True)):
                if r != range_:
                    yield from out()
                    range_, held = r, defaultdict(list)
                held[run].append(batch.column("entries")[i])
        yield from out()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    names = ", ".join(f"{f.name}: {_TYPES[f.type]}" for f in fields)
    dealt = captured.mapInArrow(slices, f"range int, run string, nth long, entries array<struct<{names}>>").repartition(len(starts) + 1, "range").sortWithinPartitions("range", "run", "nth")
    return dealt.mapInArrow(merged, f"range int, nth long, {names.replace(':', '')}")


def _entries(parts: list[pa.ListScalar]) -> Iterator[dict]:
    for part in parts:
        yield from part.as_py()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives in a folder: range, nth, url_key, captured, page_id, record_type, payload_bytes, payload_digest, refers_to, archive, offset."""
    return histories(written(runs(spark, path), "captures"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages have no dates: a page is captured page_id seconds after the start of 2024, of at most 2^31."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.expr("1704067200 + pmod(page_id, 2147483648)").alias("captured"))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end first from p)
select page_id, cast(payload_bytes as bigint) payload_bytes, payload_digest, case when page_id > first or page_id is null and first is not null then 'revisit' else 'response' end record_type,
  case when page_id > first or page_id is null and first is not null then first end refers_to
from f
"""
