"""Removal of repeated passages: content-defined chunks of lines, compared byte for byte.

Each line has a hash, and a rolling hash over neighbouring line hashes decides
where a chunk ends, so the same passage is cut alike wherever it stands and
whatever stands before it. A line of 50 words or more is a passage by itself: it
always makes a chunk of its own. Chunks of several lines, and such long lines,
that occur more than once in the corpus are removed but for their first
occurrence. Equal hashes only propose; the chunks' bytes decide.

A chunk's edges need not be a passage's. So every shortest run of lines that
reaches 50 words, from each line on and up to each line, is compared as well:
these runs cover each repeated passage of 50 words or more from edge to edge,
whatever stands around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import free_name, hot_lookup, packed, release, written

#: Neighbouring lines that the rolling hash covers.
WINDOW = 2
#: A chunk ends after one of so many lines on average.
DIVISOR = 3
#: Words that make a single line a chunk of its own.
LONG_LINE = 50
_BASE = 0x9E3779B97F4A7C15
#: What proposes the runs of a text: (first byte, bytes, lines, hash) of each.
Finder = Callable[[bytes | None], list[tuple[int, int, int, int]]]


def boundaries(hashes: np.ndarray, long: np.ndarray, window: int = WINDOW, divisor: int = DIVISOR) -> np.ndarray:
    """Whether a chunk ends after each line.

    The rolling hash of a line covers it and the ``window - 1`` lines before it,
    so nothing ahead of a passage changes the cuts after its first lines.
    """
    rolled = np.zeros(len(hashes), np.uint64)
    for back in range(min(window, len(hashes))):
        rolled[back:] += hashes[: len(hashes) - back] * np.uint64(pow(_BASE, back, 1 << 64))
    rolled ^= rolled >> np.uint64(29)
    ends = (rolled * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(divisor) == 0
    ends |= long
    ends[:-1] |= long[1:]
    ends[-1:] = True
    return ends


def chunks(text: bytes | None) -> list[tuple[int, int, int, int]]:
    """(first byte, bytes, lines, hash) of the removable chunks: several lines, or one long line.

    A chunk runs to its last line's break, which belongs to it; a chunk of blank
    lines alone is not removable.
    """
    if not text:
        return []
    lines = text.split(b"\n")
    long = np.fromiter((len(line) >= 2 * LONG_LINE - 1 and len(line.split()) >= LONG_LINE for line in lines), bool, len(lines))
    hashes = np.fromiter((xxh64_intdigest(line) for line in lines), np.uint64, len(lines))
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)))
    last = np.flatnonzero(boundaries(hashes, long))
    first = np.concatenate(([0], last[:-1] + 1))
    found = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b > a or long[a]:
            body = b"\n".join(lines[a : b + 1])
            if body.strip():
                found.append((int(starts[a]), len(body), b - a + 1, xxh64_intdigest(body)))
    return found


def passages(text: bytes | None) -> list[tuple[int, int, int, int]]:
    """(first byte, bytes, lines, hash) of the chunks and of all shortest runs of ``LONG_LINE`` words.

    From each line with words on, the run to the first line that makes it
    ``LONG_LINE`` words; up to each line with words, likewise. Any longer run
    that begins and ends with words is the union of such runs within it, so a
    line lies in a repeated run of ``LONG_LINE`` words or more exactly if it
    lies in a repeated shortest one. Runs overlap.
    """
    found = {(at, n): (at, n, lines, h) for at, n, lines, h in chunks(text)}
    if not text:
        return []
    lines = text.split(b"\n")
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)))
    own = np.fromiter((len(line.split()) for line in lines), np.int64, len(lines))
    words = np.concatenate(([0], np.cumsum(own)))
    from_line, to_line = np.flatnonzero(own), np.flatnonzero(own) + 1
    after = np.searchsorted(words, words[from_line] + LONG_LINE, "left")
    before = np.searchsorted(words, words[to_line] - LONG_LINE, "right") - 1
    some, also = after <= len(lines), before >= 0
    for a, b in zip(np.append(from_line[some], before[also]).tolist(), np.append(after[some], to_line[also]).tolist(), strict=True):
        at, n = int(starts[a]), int(starts[b] - starts[a]) - 1
        if (at, n) not in found:
            found[at, n] = (at, n, b - a, xxh64_intdigest(text[at : at + n]))
    return list(found.values())


def _chunk_rows(batches: Iterator[pd.DataFrame], find: Finder) -> Iterator[pd.DataFrame]:
    """Chunks of each batch of texts, in frames of bounded size."""
    kinds = {"doc_id": "Int64", "_version": "int64", "at": "int64", "size": "int64", "lines": "int32", "hash": "int64"}
    for batch in batches:
        rows: list[tuple] = []
        for i, v, t in zip(batch["doc_id"], batch["_version"], batch["_text"], strict=True):
            for at, n, lines, h in find(t):
                rows.append((i, v, at, n, lines, np.uint64(h).astype(np.int64)))
            if len(rows) > 1 << 14:
                yield pd.DataFrame(rows, columns=[*kinds]).astype(kinds)
                rows = []
        yield pd.DataFrame(rows, columns=[*kinds]).astype(kinds)


def chunk_table(docs: DataFrame, find: Finder = chunks) -> DataFrame:
    """(doc_id, _version, at, size, lines, hash) of every removable chunk, or run that ``find`` proposes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_version"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInPandas(lambda it: _chunk_rows(it, find), "doc_id long, _version long, at long, size long, lines int, hash long")


def repeated_chunks(docs: DataFrame, find: Finder = chunks) -> DataFrame:
    """(doc_id, _version, at, size, lines) of each occurrence to be removed: every one but the first.

    First is the smallest (doc_id, version, place); ``_version`` is a hash of the
    whole text, so that rows that repeat a doc_id with another text are told
    apart. Rows that repeat both are one document and keep the same lines. A run
    that overlaps its own first occurrence is no other occurrence.
    """
    runs = written(chunk_table(docs, find), "chunk-hashes")
    often = runs.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    often = written(often.withColumn("often", F.lit(True)), "chunk-often")
    # one plan at every size, a run that stands in very many documents no exception
    own = hot_lookup(runs, often, "hash", "n").where("often").groupBy("doc_id", "_version").agg(F.collect_set(F.struct("at", "size", "lines", "hash")).alias("_runs"))
    own = own.select(F.col("doc_id").alias("_id"), F.col("_version").alias("_v"), "_runs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_version"), F.col("text").cast("binary").alias("_text"))
    texts = texts.join(own.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("_v")))
    # the bodies of repeated hashes alone travel; the texts stay behind
    bodies = F.expr("transform(_runs, r -> struct(r.at, r.size, r.lines, r.hash, substring(_text, int(r.at) + 1, int(r.size)) AS body))")
    met = written(texts.select("doc_id", "_version", F.explode(bodies).alias("_run")).select("doc_id", "_version", "_run.*"), "chunk-bodies")
    release(runs, often)
    place = F.struct("doc_id", "_version", "at")
    first = met.groupBy("hash", "body").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last")
    # bodies that share a hash are told apart by themselves
    first = written(first.select("hash", "body", "first", "n"), "chunk-firsts")
    if first.groupBy("hash").count().where("count > 1").isEmpty():
        pairs = hot_lookup(met.drop("body"), first.drop("body"), "hash", "n").where("first is not null")
    else:
        pairs = met.join(first.drop("n"), ["hash", "body"]).drop("body")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_version") == F.col("first._version"))
    return pairs.where(~same | (F.col("at") > F.col("first.at") + F.col("size"))).select("doc_id", "_version", "at", "size", "lines")


def remove_repeats(docs: DataFrame, find: Finder = chunks, name: str = "_removed") -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``, and the number of their lines in the column ``name``.

    ``find`` proposes the runs that are compared: ``chunks``, or ``passages`` for
    all of them. A line goes if it lies in a run that stands earlier in the
    corpus, too. A removed chunk takes its line breaks with it. A null text stays null; a
    text of repeats alone becomes empty. An empty table stays empty. All other
    columns come out as they went in; if one is called ``name``, the new one's
    name gets underscores before it.
    """
    spans = repeated_chunks(docs, find).groupBy("doc_id", "_version").agg(F.collect_set(F.struct("at", "size")).alias("_spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("_version").alias("_v"), "_spans")
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_version"), F.col("text").alias("_text"))
    rows = rows.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("_v")), "left")

    @F.pandas_udf("text string, lines int")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        def one(text: bytes | None, gone) -> tuple[str | None, int]:
            if text is None:
                return None, 0
            kept, at, lines = [], 0, 0
            for s in sorted(gone if gone is not None else (), key=lambda s: (s["at"], s["size"])):
                kept.append(text[at : s["at"]])
                end = max(at, s["at"] + s["size"] + 1)
                lines += text.count(b"\n", max(at, s["at"]), end) + (end > len(text) >= at)
                at = end
            kept.append(text[at:])
            whole = b"".join(kept)
            if at > len(text) and whole.endswith(b"\n"):  # the last line went: so does the break before it
                whole = whole[:-1]
            return whole.decode("utf-8", "replace"), lines

        return pd.DataFrame([one(t, s) for t, s in zip(texts, spans, strict=True)], columns=["text", "lines"])

    rows = rows.withColumn("_cut", cut(F.col("_text").cast("binary"), F.col("_spans")))
    cleaned = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(F.col("_cut.text"))
    removed = F.when(F.col("_spans").isNull(), F.lit(0)).otherwise(F.col("_cut.lines"))
    own = lambda c: cleaned if c == "text" else F.col("_row")[c]
    return rows.select(*[own(c).alias(c) for c in docs.columns], removed.alias(free_name(docs, name)))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages, and how many lines went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, passages)
    return found.select("doc_id", "text", F.col("_removed").alias("removed_lines"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("clean_crc32"))
