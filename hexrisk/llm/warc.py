"""Web archives with an index that is merged externally: sorted runs, a loser tree, globally ordered capture histories.

Each task writes a WARC file of its rows (a gzip member per record) and a run: the file's captures sorted by URL key,
timestamp and page id, cut at bounds that are the same for all runs. A range of keys is then one task's work: it merges
the range's parts of all runs by a loser tree, reading each as a stream, into a part of the global index. Records are
read back through that index.

Of pages with equal payloads (by SHA-256, so equal SHA-1 sums of different payloads don't mix) the one with the largest
page id is a response; the others revisit it and keep only the response's headers.

Defined results: a null html is the empty payload; a null url the empty URL; a null page id counts as the smallest and
stays null; rows with equal page ids are captures each; an empty table gives no archives; other columns are not read.
A capture's time is its page id in seconds after a fixed date where there is no column for it.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hexrisk.llm.dedup import located
from hexrisk.llm.files import Written, opened, stored
from hexrisk.session import scratch_path

RANGE_ROWS = 20_000
SAMPLED = 20
#: A task's archive is closed at this size and another begun.
FILE_BYTES = 256 << 20
FIRST_DATE = datetime(2024, 1, 1)
READ_BYTES = 1 << 16
SEGMENTS = "run string, warc string, range int, begin long, end long, n long"
INDEX = "urlkey string, time string, page_id long, warc string, offset long, length long, position long, range int"
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: F.Column) -> F.Column:
    """Sort key of a URL: labels of the host from the last to the first, then path and query, in lower case, without blanks."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[\x00-\x20]", "_")
    host = F.regexp_extract(plain, r"^[^:/?#]*://([^/?#]*)", 1)
    rest = F.regexp_replace(plain, r"^[^:/?#]*://[^/?#]*|#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {url}'.encode()).digest())}>"


def warc_record(page_id: int | None, url: str, time: str, payload: bytes, revisits: int | None, is_response: bool, digest: str) -> bytes:
    """One record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {datetime.strptime(time, '%Y%m%d%H%M%S').isoformat()}Z", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response",
    ]
    if not is_response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {'' if revisits is None else revisits}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 5, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the response in it, and the payload it holds."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step costs one match per level."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node >= 1:
                if not self._before(at, self.losers[node]) and self.losers[node] >= 0:
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def captures(pages: DataFrame, time: str | None = None) -> DataFrame:
    """What is to be archived of each page, in which role."""
    rows = located(pages, "page_id", "url", "html", *([time] if time else []))
    seconds = F.col(time) if time else F.date_format(F.make_timestamp(*[F.lit(v) for v in (2024, 1, 1, 0, 0, 0)]) + F.make_dt_interval(secs=F.coalesce("page_id", F.lit(0)) % 3_000_000_000), "yyyyMMddHHmmss")
    rows = rows.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
        url_key(F.col("url")).alias("urlkey"), seconds.alias("time"), "locator",
    ).withColumn("same", F.sha2("payload", 256))
    first = F.max(F.struct("page_id", "locator")).alias("first")
    kept = rows.select("same", "page_id", "locator").groupBy("same").agg(first)
    return rows.join(kept, "same").select(
        "page_id", "url", "payload", "urlkey", "time", F.col("first.page_id").alias("refers_to"), (F.col("locator") == F.col("first.locator")).alias("is_response")
    )


def key_bounds(pages: DataFrame, time: str | None, range_rows: int) -> list[tuple]:
    """Keys that cut the captures into ranges of about ``range_rows``, from a sample of ``SAMPLED`` keys per range.

    Only the balance of the ranges hangs on the sample.
    """
    ranges = -(-pages.count() // range_rows)
    if ranges < 2:
        return []
    page = F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63)))
    seconds = F.col(time) if time else F.lit("")
    keys = pages.select(url_key(F.col("url")).alias("urlkey"), seconds.alias("time"), page.alias("page")).orderBy(F.xxhash64("urlkey", "page")).limit(ranges * SAMPLED).collect()
    keys = sorted((r[0].encode(), r[1], r[2]) for r in keys)
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)]


def write_archives(rows: DataFrame, folder: str, bounds: list[tuple], timed: bool) -> DataFrame:
    """Write archives and runs; returns the parts of runs by range. Stored, so files are written once."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, files, warc, entries = TaskContext.get().partitionId(), 0, None, []

        def close() -> pa.RecordBatch:
            warc.done()
            entries.sort()
            run, parts, begin, n, current = Written(warc.path.removesuffix(".warc.gz") + ".run"), [], 0, 0, None
            for urlkey, time, page, line in entries:
                r = bisect.bisect_right(bounds, (urlkey, time if timed else "", page))
                if r != current:
                    if n:
                        parts.append((run_uri, warc_uri, current, begin, run.size, n))
                    current, begin, n = r, run.size, 0
                run.write(line)
                n += 1
            parts.append((run_uri, warc_uri, current, begin, run.size, n))
            run.done()
            return pa.RecordBatch.from_pydict(dict(zip(("run", "warc", "range", "begin", "end", "n"), (list(c) for c in zip(*parts, strict=True)), strict=True)), SEGMENT_TYPES)

        for batch in batches:
            for page, url, payload, urlkey, time, refers_to, is_response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "urlkey", "time", "refers_to", "is_response")), strict=True):
                if warc is None:
                    warc_uri = f"{folder}/captures-{number:06d}-{files:04d}.warc.gz"
                    run_uri = warc_uri.removesuffix(".warc.gz") + ".run"
                    warc, entries = Written(warc_uri), []
                record = warc_record(page, url, time, payload, refers_to, is_response, sha1_base32(payload))
                key = urlkey.encode()
                line = b"%s %s %s %d %d\n" % (key, time.encode(), b"-" if page is None else b"%d" % page, warc.size, len(record))
                entries.append((key, time, -(2**63) if page is None else page, line))
                warc.write(record)
                if warc.size >= FILE_BYTES:
                    yield close()
                    warc, files = None, files + 1
        if warc is not None:
            yield close()

    return stored(rows.mapInArrow(write, SEGMENTS), "archives")


SEGMENT_TYPES = pa.schema([("run", pa.string()), ("warc", pa.string()), ("range", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("n", pa.int64())])
INDEX_TYPES = pa.schema([("urlkey", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("warc", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("range", pa.int32())])


def run_part(run: str, warc: str, begin: int, end: int) -> Iterator[tuple]:
    """Captures of a part of a run, read as a stream."""
    system, path = opened(run)
    with system.open_input_file(path) as f:
        at, rest = begin, b""
        while at < end:
            f.seek(at)
            data = f.read(min(READ_BYTES, end - at))
            at += len(data)
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                urlkey, time, page, offset, length = line.split(b" ")
                yield urlkey, time, -(2**63) if page == b"-" else int(page), warc, int(offset), int(length)


def merge_runs(segments: DataFrame) -> DataFrame:
    """The global index: ranges in order, and in each range the captures in order of (key, time, page id)."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "warc", "begin", "end")), strict=True):
                parts.setdefault(r[0], []).append(r[1:])
        for r, runs in sorted(parts.items()):
            out: list[tuple] = []
            for position, (urlkey, time, page, warc, offset, length) in enumerate(LoserTree([run_part(*x) for x in sorted(runs)])):
                out.append((urlkey.decode(), time.decode(), None if page == -(2**63) else page, warc, offset, length, position, r))
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), INDEX_TYPES.types, strict=True)], schema=INDEX_TYPES)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), INDEX_TYPES.types, strict=True)], schema=INDEX_TYPES)

    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.select("range", "run", "warc", "begin", "end").repartition(tasks, "range").mapInArrow(merge, INDEX)


def read_archives(index: DataFrame) -> DataFrame:
    """Every capture of the index, read from its archive by offset; digests of responses are checked."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, f = None, None
        for batch in batches:
            out = []
            for warc, offset, length in zip(*(batch.column(c).to_pylist() for c in ("warc", "offset", "length")), strict=True):
                if warc != current:
                    system, path = opened(warc)
                    current, f = warc, io.BufferedReader(system.open_input_file(path), 1 << 20)
                f.seek(offset)
                headers, http, payload = parse_record(f.read(length))
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                if kind == "response" and sha1_base32(payload) != digest:
                    raise ValueError(f"the payload at {offset} of {warc} is damaged")
                number = lambda v: int(v) if v else None
                out.append((number(headers["X-Page-Id"]), int(http["Content-Length"]), digest, kind, number(headers.get("X-Refers-To-Page-Id"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), CAPTURE_TYPES.types, strict=True)], schema=CAPTURE_TYPES)

    dealt = index.select("warc", "offset", "length").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "warc")
    return dealt.sortWithinPartitions("warc", "offset").mapInArrow(read, CAPTURES)


CAPTURE_TYPES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archived(pages: DataFrame, folder: str | None = None, time: str | None = None, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Archive all pages; returns the global index and the captures read back through it."""
    bounds = key_bounds(pages, time, range_rows)
    segments = write_archives(captures(pages, time), folder or scratch_path(pages.sparkSession, "warc"), bounds, time is not None)
    index = stored(merge_runs(segments), "index")
    return index, read_archives(index)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))[1]


ORACLE = """
with p as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex,
        max(page_id) over (partition by coalesce(html, '')) as kept
    from pages
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(hex, cast(i // 4 * 5 + 1 as bigint), 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31 as integer), 1)), '') as payload_digest,
    case when page_id = kept then 'response' else 'revisit' end as record_type,
    case when page_id = kept then null else kept end as refers_to
from p
"""
