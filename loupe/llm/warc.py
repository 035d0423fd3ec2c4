"""WARC archives of pages and their merged capture index.

Writing: pages of equal payloads (by SHA-1 and length) keep one response record, that of the largest
page id; the others become revisit records that refer to it.  Records are composed by DataFrame
functions and written by Spark's text writer with the record end as its line end, gzip-compressed:
files are committed as a whole and lie in any file system that Spark reaches.

Reading: each file is read by Spark's binary file reader and parsed record by record by its
Content-Length.  A file's captures, sorted by URL key and timestamp, are a run.  Sampled splitters
deal the runs out by ranges of that order, and a task merges the pieces of the k runs that meet in
its range with a loser tree, which gives the capture histories of all URLs in one global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import attach, shared_path, staged

END = "\r\n\r\n"
RECORD_NAME = "urn:loupe:page:"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
#: Records of a file at most, so that a task can hold it.
FILE_RECORDS = 4096
#: First capture time where the table has none, in days; a page's number counts seconds from there.
FIRST_DAY = "2024-01-01"
# The digits of base 32 as Spark's conv() and as RFC 4648 write them.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE = ("urlkey string, date string, page_id long, url string, run string, offset long, length long, payload_bytes long, "
           "payload_digest string, record_type string, refers_to long")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: forty bits (ten hex digits) make eight letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _default_date(page_id: Column) -> Column:
    n = F.coalesce(page_id, F.lit(0))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(n / 86400).cast("int") % 36500).cast("string")
    s = F.pmod(n, F.lit(86400))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("Z"))


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               date_col: str | None = None) -> DataFrame:
    """page_id, url, date, payload, payload_bytes, digest, top (page_id of the response of this payload)."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    named = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        (F.col(date_col) if date_col else _default_date(F.col(id_col).cast("long"))).alias("date"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("digest"))
    groups = (named.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
              .withColumnRenamed("payload_bytes", "group_bytes"))
    return attach(named, groups, "digest", "n", pages.count()).where("payload_bytes = group_bytes").drop("group_bytes", "n")


def write_warc(pages: DataFrame, path: str, **columns) -> None:
    """Write a record for each row of ``pages``.  A null or empty html is an empty payload; a null url is
    an empty target.  A null page_id is never the response unless its payload has no other; rows of
    a payload that share the largest page_id are all responses.  Other columns are not read."""
    rows = classified(pages, **columns)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit(f"<{RECORD_NAME}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    response = F.col("top").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(response, F.concat(http, "payload")).otherwise(http)
    revisit = F.concat(line("WARC-Refers-To", name(F.col("top"))), line("WARC-Profile", F.lit(PROFILE)))
    size = F.octet_length(http) + F.when(response, F.col("payload_bytes")).otherwise(F.lit(0))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Date", F.col("date")), line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), F.when(response, "").otherwise(revisit),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")), F.lit("\r\n"), block)
    (rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


# ---------------------------------------------------------------- reading

def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, then path and query; no scheme, default port or fragment."""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url, re.S)
    host, port, rest = m[1].lower().strip("."), m[2], m[3] or "/"
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + rest


def parse_records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an uncompressed stream."""
    at = 0
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        start, headers = at, {}
        at += len(version)
        while (line := stream.readline()) != b"\r\n":
            at += len(line)
            key, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[key.lower()] = value
        at += 2
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {start} has no end")
        at += len(block) + 4
        yield start, at - start, headers, block


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{RECORD_NAME}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def capture(run: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """Index entry of a record.  A response's digest and length are taken from its payload and held
    against the headers; a revisit has them in its headers."""
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?i)content-length: (\d+)", head)[1])
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response":
        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (real, len(payload)) != (digest, stated):
            raise ValueError(f"payload of {headers['warc-record-id']} is not what was written")
    url = headers["warc-target-uri"]
    return (url_key(url), headers["warc-date"], page_of(headers["warc-record-id"]), url, run, offset, length, stated, digest, kind,
            page_of(headers.get("warc-refers-to")))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives, each file's in the order of URL key, timestamp and page: a run a file."""
    names = [c.split()[0] for c in CAPTURE.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run, data in zip(batch["run"], batch["content"]):
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))
                rows = [capture(run, *record) for record in parse_records(stream)]
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
                if rows:
                    frame = pd.DataFrame(rows, columns=names)
                    yield frame.assign(page_id=frame["page_id"].astype("Int64"), refers_to=frame["refers_to"].astype("Int64"))

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("run"), "content"))
    return files.mapInPandas(parse, CAPTURE)


class LoserTree:
    """k-way merge of sorted iterables: each inner node keeps the loser of its match, so the next
    item costs one match on each level of the winner's path.  Ties go to the earlier iterable."""

    def __init__(self, runs: list[Iterable], key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.k = len(self.runs)
        self.items = [None] * self.k
        self.keys: list = [None] * self.k  # (0, key, run), or (1,) once a run has ended
        for r in range(self.k):
            self._fetch(r)
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.keys[a] <= self.keys[b] else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _fetch(self, run: int) -> None:
        try:
            item = next(self.runs[run])
            self.items[run], self.keys[run] = item, (0, self.key(item), run)
        except StopIteration:
            self.keys[run] = (1,)

    def __iter__(self):
        if not self.k:
            return
        while self.keys[self.winner][0] == 0:
            run = self.winner
            yield self.items[run]
            self._fetch(run)
            node = (run + self.k) // 2
            while node:
                if self.keys[self.losers[node]] < self.keys[run]:
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merge_index(runs: DataFrame) -> DataFrame:
    """The captures of all runs in one global order of URL key, timestamp and page (null pages first):
    range ``part`` and ``place`` in it.  A range holds a bounded share of the rows, as its borders may
    fall between captures of one URL."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, pieces = TaskContext.get().partitionId(), {}
        columns = None
        for batch in batches:
            columns = list(batch.columns)
            for run, rows in batch.groupby("run", sort=False):
                pieces.setdefault(run, []).append(rows)
        if not pieces:
            return

        def piece(frames):
            return (row for frame in frames for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))

        at, page = columns.index("urlkey"), columns.index("page_id")
        tree = LoserTree([piece(f) for _, f in sorted(pieces.items())],
                         key=lambda r: (r[at], r[at + 1], r[page] is not None, r[page] or 0))
        place, out = 0, []
        for row in tree:
            out.append((part, place, *row))
            place += 1
            if len(out) == 10_000:
                yield frame_of(out, columns)
                out = []
        if out:
            yield frame_of(out, columns)

    def frame_of(rows, columns):
        frame = pd.DataFrame(rows, columns=["part", "place", *columns])
        return frame.assign(**{c: frame[c].astype("Int64") for c in ("page_id", "refers_to")})

    dealt = runs.repartitionByRange("urlkey", "date", "page_id").sortWithinPartitions("run", "urlkey", "date", "page_id")
    return dealt.mapInPandas(merge, f"part long, place long, {CAPTURE}")


def archive(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write the pages' archives (under a new shared folder unless ``path`` is given), read them back and
    merge their index: one row per row of ``pages``.  An empty table gives an empty index."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_warc(pages, path, **columns)
    return merge_index(staged(read_runs(spark, path), "runs"))
