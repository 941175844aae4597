"""WARC archives of pages and their external index merge.

Archives are written by Spark's text sink: a row is one record, the line separator is the blank lines that end a record, so the
files are plain WARC 1.1 on any file system Spark writes to, committed atomically per task. Records with equal payloads of at
least `least` bytes share one response, that of the largest page_id; the others are revisits that refer to it and store no body.

Reading back parses each archive file in a task, takes bytes and digest of a response from its stored payload, and sorts the
file's captures by URL key, timestamp and page_id: a locally sorted run. A range shuffle deals the runs out by that key; each task
merges its k runs with a loser tree, and the partition offsets give every capture its place in the global order. A task reads one
file and merges `MERGE_ROWS` captures, so both are bounded: files by the records they may hold, fewer where pages are large
(`FILE_BYTES`), whatever the table's size.

The table has no times: a capture's is `EPOCH` plus page_id seconds, modulo `CYCLE`, in UTC whatever the session's time zone, so any
page_id has a valid one. Null html is an empty payload; null urls have the empty key; null page_ids stay null and never are a
response that others refer to. Very long pages take a file of their own. Repeated rows are records of their own; captures with
equal keys, times and ids have any order among themselves. Extra columns are ignored. An empty table gives an empty archive and index.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL, cut, new_folder, side

END = "\r\n\r\n"
LEAST = 1000
#: Most records of a file; a file of pages of up to b bytes holds FILE_BYTES / b at most.
FILE_RECORDS = 10_000
FILE_BYTES = 128 << 20
MERGE_ROWS = 50_000
EPOCH = "2024-01-01"
#: Seconds after which capture times begin again.
CYCLE = 1_000_000_000
INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, file string, offset long, length long, run string, seq long"


class LoserTree:
    """Merge k sorted lists: inner nodes hold the loser of their match, so each step replays one path of log2(k) matches."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = len(runs)
        self.nodes = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self.replay(leaf)

    def head(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def beats(self, a: int, b: int) -> bool:
        x, y = self.head(a), self.head(b)
        return y is None and (x is not None or a < b) or (x is not None and y is not None and (x, a) < (y, b))

    def replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.nodes[node]
            if other < 0:  # first to arrive waits for the other side
                self.nodes[node] = winner
                return
            if self.beats(other, winner):
                self.nodes[node], winner = winner, other
            node //= 2
        self.nodes[0] = winner

    def __iter__(self):
        while self.k and self.head(self.nodes[0]) is not None:
            run = self.nodes[0]
            yield self.head(run)
            self.at[run] += 1
            self.replay(run)


def capture_time(page_id: Column) -> Column:
    """The time of a capture as text. Days and seconds are counted apart, so no time zone plays a part."""
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(CYCLE))
    day, rest = (seconds / 86400).cast("int"), (seconds % 86400).cast("int")
    clock = [(rest / 3600).cast("int"), (rest % 3600 / 60).cast("int"), rest % 60]
    return F.concat(F.date_add(F.lit(EPOCH).cast("date"), day).cast("string"), F.lit("T"), F.concat_ws(":", *[F.lpad(x.cast("string"), 2, "0") for x in clock]), F.lit("Z"))


def _rows(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.regexp_replace(F.col(url), r"[\r\n\s]", "%20").alias("uri"), body.alias("body"))
    return rows.withColumns({"n": F.octet_length("body").cast("long"), "digest": F.sha1(F.encode("body", "UTF-8"))})


def repeated(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(digest, keeper) of payloads that several records have."""
    shared = _rows(pages, page_id, url, html).where(F.col("n") >= least).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("c"))
    return cut(shared.where((F.col("c") > 1) & F.col("keeper").isNotNull()).select("digest", "keeper"))


def records(pages: DataFrame, least: int = LEAST, shared: DataFrame | None = None, small: int = SMALL, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column `value`: the WARC record of each page without its final blank lines. `shared` is `repeated` of all pages."""
    shared = repeated(pages, least, page_id, url, html) if shared is None else shared
    joined = _rows(pages, page_id, url, html).join(side(shared, small), "digest", "left").withColumn("keeper", F.when(F.col("n") >= least, F.col("keeper")))
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    when = capture_time(F.col("id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def record(kind: str, extra: list[Column], block: Column) -> Column:
        return F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit(kind)), line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", when),
            F.when(F.col("uri").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", F.col("uri"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), *extra,
            line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
        )

    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    again = record("revisit", [line("WARC-Refers-To", urn(F.col("keeper"))), line("WARC-Profile", profile)], http)
    return joined.select(F.when(revisit, again).otherwise(record("response", [], F.concat(http, F.col("body")))).alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Write `pages` under `path`, a folder for each class of page sizes that occurs (powers of 64), so that no file outgrows `file_bytes` but by one page."""
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    order = sum((F.when(size > file_bytes // file_records * 64**k, 1).otherwise(0) for k in range(5)), F.lit(0))
    found = [r["k"] for r in pages.select(order.alias("k")).distinct().collect()]  # six classes at most
    shared = repeated(pages, least)
    for k in sorted(found) or [0]:
        some = pages if len(found) < 2 else pages.where(order == k)
        most = max(1, file_records // 64**k)
        records(some, least, shared).write.option("lineSep", END).option("maxRecordsPerFile", most).text(f"{path}/{k}")


def url_key(url: str) -> str:
    """Sort-friendly key of a URL: host labels reversed, then path and query in lower case."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    query = "?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port not in (None, 80, 443) else ''}){parts.path.lower() or '/'}{query}"


HEAD = re.compile(rb"([A-Za-z-]+): ([^\r]*)\r\n")


def parse(data: bytes):
    """(headers, block, offset, length) of each record of one archive file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = {k.decode(): v.decode("utf-8") for k, v in HEAD.findall(data[at : end + 2])}
        size = int(headers["Content-Length"])
        yield headers, memoryview(data)[end + 4 : end + 4 + size], at, end + 4 + size - at
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has a wrong length")
        at = end + 8 + size


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _order(row: tuple) -> tuple:
    return row[5], row[6], row[0] is not None, row[0] or 0


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive file under `path`, each file a sorted run."""

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for h, block, offset, length in parse(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    http = bytes(block[:200])
                    cut_at = http.index(b"\r\n\r\n") + 4
                    if h["WARC-Type"] == "response":
                        body = block[cut_at:]
                        size, digest, refers = len(body), hashlib.sha1(body).hexdigest(), None
                        if h["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"payload of {h['WARC-Record-ID']} in {name} doesn't match its digest")
                    else:
                        size, digest, refers = int(http[:cut_at].split(b"Content-Length: ")[1]), h["WARC-Payload-Digest"].removeprefix("sha1:"), _page(h["WARC-Refers-To"])
                    rows.append((_page(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], refers, url_key(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else "", h["WARC-Date"], name, offset, length))
                rows.sort(key=_order)
                run = "/".join(name.rsplit("/", 2)[-2:])
                yield _batch([(*r, run, i) for i, r in enumerate(rows)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, INDEX)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind = {"long": pa.int64(), "string": pa.string()}
    names = [(n, kind[t]) for n, t in (x.split(" ") for x in INDEX.split(", "))]
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, names, strict=True)], [n for n, _ in names])


def merged(index: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """`index` with `position`, the place of each capture in the global order by URL key, timestamp and page_id."""
    index = cut(index)
    parts = max(1, -(-index.count() // merge_rows), min(index.rdd.getNumPartitions(), 64))

    def merge(batches):
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept).combine_chunks()
        by_run: dict[str, list] = {}
        order = zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "run")), strict=True)
        for place, (key, time, page, run) in enumerate(order):  # rows come by run, in their order
            by_run.setdefault(run, []).append(((key, time, page is not None, page or 0), place))
        rows = pa.array([place for _, place in LoserTree(list(by_run.values()))], pa.int64())
        part = pa.array(np.full(len(rows), TaskContext.get().partitionId(), dtype=np.int64))
        done = table.take(rows).append_column("part", part).append_column("place", pa.array(np.arange(len(rows), dtype=np.int64)))
        yield from done.to_batches(max_chunksize=10_000)

    dealt = index.repartitionByRange(parts, "url_key", "captured", "page_id").sortWithinPartitions("run", "seq")
    done = cut(dealt.mapInArrow(merge, INDEX + ", part long, place long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = done.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return done.join(F.broadcast(offsets), "part").withColumn("position", F.col("before") + F.col("place")).drop("part", "place", "before", "run", "seq")


def archive(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Write `pages` as archives under `path` (a new folder in the shared one), read them back and merge their index."""
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write(pages, path, least)
    return merged(runs(spark, path))
