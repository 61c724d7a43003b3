"""WARC archives of pages, and their index by external merge.

Archives are written with Spark's text writer, one record a row: a record ends
in two line breaks, which serve as the line separator. Compressed archives are
not split, so a task reads an archive from its start, line by line, and holds
one record at a time.

Index: each archive gives a capture run, sorted by URL key and timestamp where
it is read, and written. Runs are dealt to key ranges of bounded size. Nothing is
sorted again: what a range receives are slices of runs, each in the order of its
run, and a loser tree merges them. Ranges follow one another, so the whole is in
order. Captures of equal URL, time and page are told apart by their place in the
archives, so that no range is filled by one of them.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_lookup, new_path, written

BREAK = "\r\n"
#: Records in one archive, at most.
ARCHIVE_RECORDS = 4096
#: Captures that one range merges, about.
RANGE_ROWS = 50_000
#: The table has no capture times: page n is taken as captured n seconds after this, counted anew after ``TIMES`` of them (4300 years).
FIRST_CAPTURE, TIMES = 1_700_000_000, 1 << 37
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly URL: host labels reversed, lower case, no scheme, ``www`` or fragment, query in order.

    A null or empty URL has the empty key; one that cannot be parsed is its own
    key in lower case.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    port_text = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){parts.path.lower() or '/'}" + (f"?{query}" if query else "")


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes up.

    After a pop only the path from that run's leaf to the root is played again.
    ``key`` gives an item's place; of equal places the run with the smaller
    number goes first.
    """

    def __init__(self, runs: Iterable[Iterable], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [self._next(i) for i in range(len(self.runs))]
        self.losers = [-1] * len(self.runs)
        self.winner = -1
        for leaf in range(len(self.runs)):
            self._play(leaf, building=True)

    def _next(self, run: int):
        for item in self.runs[run]:
            return self.key(item), item
        return None

    def _before(self, a: int, b: int) -> bool:
        left, right = self.heads[a], self.heads[b]
        if left is None or right is None:
            return right is None and (left is not None or a < b)
        return (left[0], a) < (right[0], b)

    def _play(self, run: int, building: bool = False) -> None:
        at = (run + len(self.runs)) // 2
        while at > 0:
            other = self.losers[at]
            if building and other < 0:
                self.losers[at] = run
                return
            if other >= 0 and self._before(other, run):
                self.losers[at], run = run, other
            at //= 2
        self.winner = run

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run][1]
            self.heads[run] = self._next(run)
            self._play(run)


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with payload_digest, payload_bytes, record_type and refers_to.

    Of pages with equal payloads of ``least_bytes`` or more, the largest page_id
    is the response and all others revisit it. A null html is an empty payload.
    Rows that repeat the largest page_id are responses all.
    """
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("_hex"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("payload_bytes"))
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("_hex").agg(F.max("page_id").alias("_to"), F.min("page_id").alias("_from"), F.count("*").alias("_n"))
    groups = written(groups.where("_to <> _from").select("_hex", "_to", "_n"), "payloads")
    rows = hot_lookup(rows, groups, "_hex", "_n")
    revisit = F.coalesce(F.col("page_id") < F.col("_to"), F.lit(False)) & (F.col("payload_bytes") >= least_bytes)
    return rows.select("page_id", "url", "html", base32_column(F.col("_hex")).alias("payload_digest"), "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_to")).alias("refers_to"))


def base32_column(hex_digest: Column) -> Column:
    """A SHA-1 digest in hexadecimal as base32: four letters for each five digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = [F.conv(F.substring(hex_digest, at, 5), 16, 10).cast("int") for at in range(1, 41, 5)]
    return F.concat(*[F.substring(letters, F.shiftright(v, bits).bitwiseAND(31) + 1, F.lit(1)) for v in parts for bits in (15, 10, 5, 0)])


def record_column() -> Column:
    """The WARC record of a planned page, without the two line breaks that end it.

    A record's id is made of its page and its payload: rows that repeat both are
    one record, captured again.
    """
    response = F.col("record_type") == "response"
    html = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK * 2))
    block = F.concat(http, F.when(response, html).otherwise(""))
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    # of no time zone, so that a session's own changes nothing
    moment = F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {FIRST_CAPTURE} + pmod(coalesce(page_id, 0L), {TIMES}L))")
    date = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(":"), "payload_digest", F.lit(">"))
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", name(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        ("WARC-Date", date),
        ("WARC-Target-URI", F.when(target != "", target)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        ("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(~response, name(F.col("refers_to")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length(http) + F.when(response, F.col("payload_bytes")).otherwise(0)).cast("string")),
    ]
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(BREAK)) for k, v in fields]
    return F.concat(F.lit(f"WARC/1.1{BREAK}"), *[F.coalesce(line, F.lit("")) for line in lines], F.lit(BREAK), block)


def write_archives(plan: DataFrame, path: str, records: int = ARCHIVE_RECORDS) -> None:
    """Gzip archives of at most ``records`` records under ``path``."""
    plan.select(record_column().alias("value")).write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def records(lines: Iterator[tuple[str, str]]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(archive, header fields in lower case, block) from (archive, line) pairs in order.

    A block is read by its Content-Length, so its own line breaks do no harm.
    """
    head: dict[str, str] | None = None
    block: list[bytes] | None = None
    missing = 0
    for archive, line in lines:
        if block is not None:
            body = line.encode()
            block.append(body)
            missing -= len(body)
            if missing > 0:
                block.append(BREAK.encode())
                missing -= 2
            if missing <= 0:
                if missing < 0:
                    raise ValueError(f"a block of {archive} passes its length")
                yield archive, head, b"".join(block)[: int(head["content-length"])]
                head = block = None
        elif head is None:
            if line.startswith("WARC/"):
                head = {}
            elif line:
                raise ValueError(f"{archive}: not a record: {line[:60]!r}")
        elif line:
            field, _, value = line.partition(":")
            head[field.lower()] = value.strip()
        else:
            block, missing = [], int(head["content-length"])


def _captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index rows of archives; a payload that is there is measured and hashed anew."""
    lines = ((a, v) for batch in batches for a, v in zip(batch["archive"], batch["value"], strict=True))
    rows: list[tuple] = []
    number = lambda name: None if (text := (name or "").removeprefix("<urn:page:").split(":")[0]) in ("", "none") else int(text)
    places: Counter[str] = Counter()

    def frame() -> pd.DataFrame:
        kinds = {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "record": "int64"}
        return pd.DataFrame(rows, columns=["archive", "record", "urlkey", "captured", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]).astype(kinds)

    for archive, head, block in records(lines):
        http, _, payload = block.partition((BREAK * 2).encode())
        stated = head["warc-payload-digest"].removeprefix("sha1:")
        size = int(dict(f.split(": ", 1) for f in http.decode().split(BREAK)[1:])["Content-Length"])
        if head["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != stated):
            raise ValueError(f"{head['warc-record-id']} in {archive} does not hold the payload that it states")
        places[archive] += 1
        rows.append((archive, places[archive], url_key(head.get("warc-target-uri")), head["warc-date"], number(head["warc-record-id"]), head["warc-type"], size, stated, number(head.get("warc-refers-to"))))
        if len(rows) >= 2048:
            yield frame()
            rows.clear()
    yield frame()


_INDEX = "archive string, record long, urlkey string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"
_ORDER = ["urlkey", "captured", "page_id", "archive", "record"]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of index rows for each archive under ``path``, written to the shared folder."""
    lines = spark.read.option("lineSep", BREAK).text(path).select(F.col("_metadata.file_name").alias("archive"), "value")
    return written(lines.mapInPandas(_captures, _INDEX).sortWithinPartitions("archive", *[c for c in _ORDER if c != "archive"]), "capture-runs")


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range: the slices of runs that it receives, each in order, through the loser tree.

    Slices come one after another; a new one begins where the archive changes or
    the order breaks off.
    """
    slices: list[list[tuple]] = []
    last: tuple | None = None
    columns, kinds = [], {}
    for batch in batches:
        columns, kinds = list(batch.columns), {"page_id": "Int64", "refers_to": "Int64"}
        place, archive = [columns.index(c) for c in _ORDER], columns.index("archive")
        for row in batch.astype(kinds).itertuples(index=False, name=None):
            key = tuple((0, "") if row[i] is pd.NA else (1, row[i]) for i in place)
            if last is None or slices[-1][-1][1][archive] != row[archive] or key < last:
                slices.append([])
            slices[-1].append((key, row))
            last = key
    block: list[tuple] = []
    for _, row in LoserTree(slices, lambda item: item[0]):
        block.append(row)
        if len(block) == 4096:
            yield pd.DataFrame(block, columns=columns).astype(kinds)
            block = []
    if block:
        yield pd.DataFrame(block, columns=columns).astype(kinds)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All runs as one history in the order of URL key, time, page and place in the archives.

    Ranges are cut on the whole order, so that one much visited URL, or one page
    repeated, is spread over as many of them as its captures need. A task holds
    one range.
    """
    count = max(1, -(-runs.count() // range_rows))
    return runs.repartitionByRange(count, *_ORDER).mapInPandas(_merged, _INDEX)


def capture_history(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` under ``path``, read the archives back and merge their index.

    One row per page: the index columns. A null html is an empty payload; a null
    URL has the empty key and comes first; a null page_id is kept. Any LONG is a
    page_id: ids that differ by a multiple of ``TIMES`` share a time and follow in
    their own order. Rows that repeat are archived each. An empty table gives an
    empty history.
    """
    write_archives(planned(pages, least_bytes), path)
    return merge_runs(capture_runs(pages.sparkSession, path))


def op1_warc_index(spark, sf_dir: str) -> DataFrame:
    """Every page's capture, read back from the archives, in the order of the merged index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return capture_history(pages, new_path(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> ((3 - i % 4) * 5)::BIGINT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM g
"""
