"""WARC archives of captures, and their index in global order by external merging.

Writing: each page becomes one record, its payload the HTML in UTF-8. Of captures
with equal payloads of at least ``SAME`` bytes the one with the smallest page_id is a
``response``, the others are ``revisit`` records without the payload. A record is text, and it
ends in CRLF CRLF, so Spark's text writer with that line separator writes WARC
files (gzip, one member a file) to any file system, and a lost task is written anew.

Reading: a task parses whole archive files by their Content-Length fields and gives a
sorted run of captures for each. The runs are stored; then ranges of (URL key,
timestamp, page_id) are dealt out, and each task merges the pieces of all runs in its range
with a loser tree. Ranges are cut by rows, so one URL key may be spread over many.

Capture time: pages have none, so it is ``EPOCH`` plus page_id seconds unless a
``captured_at`` column is named.

Defined results: null html is an empty payload; a null url is archived as ``urn:none``; control
characters in a url are percent-encoded. Rows that repeat the smallest page_id of their payload are
responses too. A null page_id never leads a group: such a row revisits the group's smallest
page_id if there is one, else it is a response. An empty table gives empty archives and no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import column, shared_path, stored

SAME = 100
SALTS = 16
END = "\r\n\r\n"
#: Rows of an index range that one task merges.
RANGE_ROWS = 200_000
EPOCH = "2020-01-01 00:00:00"
_DATE = "yyyy-MM-dd'T'HH:mm:ss'Z'"

CAPTURE = (
    "url_key string, timestamp string, page_id long, record_type string, payload_bytes long,"
    " payload_digest string, refers_to long, file string, position long, length long"
)


def decisions(captures: DataFrame) -> DataFrame:
    """Captures (salt, payload_digest, ...) with ``first_id``, the smallest page_id of equal payloads.

    Only digests that occur more than once are joined, and both sides are salted, so that a payload
    shared by a third of all pages spreads over ``SALTS`` keys.
    """
    groups = (
        captures.where(F.col("payload_bytes") >= SAME)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    return captures.join(groups, ["payload_digest", "salt"], "left")


def _header(*lines: Column) -> Column:
    return F.concat(*[part for line in lines for part in (line, F.lit("\r\n"))], F.lit("\r\n"))


def records(pages: DataFrame, captured_at: str | None = None) -> DataFrame:
    """One WARC record a page, as text without the closing CRLF CRLF."""
    page_id = column(pages, "page_id").cast("long")
    when = (
        column(pages, captured_at).cast("timestamp")
        if captured_at
        else F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.coalesce(page_id, F.lit(0)) % 3_000_000_000)
    )
    html = F.coalesce(column(pages, "html").cast("string"), F.lit(""))
    flat = pages.select(
        page_id.alias("page_id"),
        F.coalesce(column(pages, "url").cast("string"), F.lit("urn:none")).alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"),
        F.coalesce(F.date_format(when, _DATE), F.lit("2020-01-01T00:00:00Z")).alias("date"),
        F.pmod(F.xxhash64(page_id), F.lit(SALTS)).cast("int").alias("salt"),
    )
    joined = decisions(flat)
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.col("url")
    for code in (*range(0x20), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = _header(
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")),
    )
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    shared = [
        F.concat(F.lit("WARC-Record-ID: <urn:capture:"), name, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    fresh = _header(F.lit("WARC/1.1"), F.lit("WARC-Type: response"), *shared)
    revisit = _header(
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: revisit"),
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("WARC-Refers-To: <urn:capture:"), F.col("first_id").cast("string"), F.lit(">")),
        *shared,
    )
    return joined.select(F.concat(F.when(again, revisit).otherwise(fresh), block).alias("value"))


def write_archives(pages: DataFrame, path: str, captured_at: str | None = None) -> None:
    """WARC files, one for each task, of any size the input splits have."""
    records(pages, captured_at).write.option("lineSep", END).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: captures of a site sort together."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (path or "/")


def _fields(header: bytes) -> dict[str, str]:
    out = {}
    for line in header.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        out[name] = value
    return out


def parse(content: memoryview, file: str) -> Iterator[tuple]:
    """Captures of one archive, in its order; positions count unpacked bytes."""
    data, at = gzip.decompress(content), 0
    while at < len(data):
        close = data.index(b"\r\n\r\n", at) + 4
        head = _fields(data[at : close - 4])
        end = close + int(head["Content-Length"])
        http_close = data.index(b"\r\n\r\n", close) + 4
        kind = head["WARC-Type"]
        size, digest = end - http_close, hashlib.sha256(data[http_close:end]).hexdigest()
        stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "revisit":
            size, digest = int(_fields(data[close : http_close - 4])["Content-Length"]), stated
        elif digest != stated:
            kind = "damaged"
        number = head["WARC-Record-ID"][13:-1]
        refers = head.get("WARC-Refers-To")
        yield (
            url_key(head["WARC-Target-URI"]), head["WARC-Date"], None if number == "none" else int(number), kind,
            size, digest, int(refers[13:-1]) if refers else None, file, at, end - at,
        )
        at = end + len(END)


_ARROW = pa.schema(
    [
        ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
        ("file", pa.string()), ("position", pa.int64()), ("length", pa.int64()),
    ]
)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW
    )


def sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures for each archive file."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                file = name.as_py().rsplit("/", 1)[-1]
                rows = sorted(parse(content.as_buffer(), file), key=sort_key)
                for low in range(0, len(rows), 10_000):
                    yield _rows(rows[low : low + 10_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(runs, CAPTURE)


class LoserTree:
    """K-way merge: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.size = runs, len(runs)
        self.heads = [self._next(i) for i in range(self.size)]
        self.losers = [-1] * max(1, self.size)
        self.winner = self._build(1) if self.size else -1

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (sort_key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        self.losers[node], won = (b, a) if self._beats(a, b) else (a, b)
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.size and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            node = (i + self.size) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures in order of (url_key, timestamp, page_id): partitions by range, each one merged."""
    held = stored(runs, "capture-runs")
    parts = max(1, -(-held.count() // RANGE_ROWS), int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), _ARROW)  # at most a range, RANGE_ROWS on average
        files = table.column("file").combine_chunks().dictionary_encode() if table.num_rows else None
        if files is None:
            return
        edges = [0]
        codes = files.indices.to_numpy()
        edges += (1 + (codes[1:] != codes[:-1]).nonzero()[0]).tolist() + [len(codes)]

        def run(low: int, high: int) -> Iterator[tuple]:
            for at in range(low, high, 1_000):
                cols = [c.to_pylist() for c in table.slice(at, min(1_000, high - at)).columns]
                yield from zip(*cols, strict=True)

        out: list[tuple] = []
        for row in LoserTree([run(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]):
            out.append(row)
            if len(out) == 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return (
        held.repartitionByRange(parts, "url_key", "timestamp", "page_id", "file", "position")
        .sortWithinPartitions("file", "url_key", "timestamp", "page_id", "position")
        .mapInArrow(merge, CAPTURE)
    )


def archive(pages: DataFrame, path: str | None = None, captured_at: str | None = None) -> DataFrame:
    """Write archives, read them back, and give the merged index of what they hold."""
    path = path or shared_path(pages, "warc")
    write_archives(pages, path, captured_at)
    return merged_index(read_runs(pages.sparkSession, path))
