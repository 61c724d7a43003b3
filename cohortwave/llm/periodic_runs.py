"""Runs: stretches of words that repeat with a period, three times or more, found as maximal pairs.

The suffixes of a text's words are sorted, and the tree of their LCP intervals is
walked from the leaves up. A node of LCP l stands for l words that follow several
places. Its places are kept in classes by the word to their left; when a child
joins its node, a place of the one and a place of the other, of different
classes, are a maximal pair: the same l words, which differ before and after.
Two such places at distance p <= l / 2 span a stretch of length l + p and period p
that no neighbouring word extends. So the pairs whose distance satisfies the
length constraints are exactly the runs, and nothing has to be extended. Of pairs
that span the same stretch the least distance is the period.

Texts are taken in batches, each with words of its own in the order, so that one
sort serves them all and no match crosses texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, packed

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: A run of period p is a pair of LCP max(24 - p, 2 p) or more: 16 at least.
LEAST_LCP = -(-LEAST_WORDS * (LEAST_PERIODS - 1) // LEAST_PERIODS)
#: Bytes of text whose suffixes are sorted together; a longer text is sorted alone.
SORTED_BYTES = 4 << 20
#: What stands between words.
GAP = WORD.replace("^", "")
_BASE = np.uint64(0x9E3779B97F4A7C15)
KIND = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def repeated_windows(words: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` words from each place on may occur elsewhere, too: by hashes, so none that do is missed."""
    hashed, have = (words.astype(np.uint64) + np.uint64(1)) * _BASE, 1
    hashed ^= hashed >> np.uint64(31)
    while have < width:
        step = min(have, width - have)
        longer = np.zeros_like(hashed)
        longer[: max(0, len(words) - step)] = hashed[step:]
        hashed, have = hashed * np.uint64(pow(int(_BASE), step, 1 << 64)) + longer, have + step
    order = np.argsort(hashed)
    same = hashed[order][1:] == hashed[order][:-1]
    found = np.zeros(len(words), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return found


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places by the order of their suffixes, ranks of each level) by prefix doubling.

    ``ranks[k][i]`` is the place in the order that the first of all suffixes with
    the 2**k words of suffix i has; a suffix that is alone in its group keeps its rank.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.full(n + 1, -1, np.int64)
    new = np.concatenate(([True], words[order][1:] != words[order][:-1])) if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, width = [rank.astype(np.int32)], 1
    alone = new & np.append(new[1:], True)
    at = np.flatnonzero(~alone)  # the groups that are still open, as they lie in the order
    while len(at):
        own = order[at]
        key = rank[own] * (n + 1) + rank[np.minimum(own + width, n)] + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[own] = np.maximum.accumulate(np.where(first, at, 0))
        ranks.append(rank.astype(np.int32))
        at = at[~(first & np.append(first[1:], True))]
        width *= 2
    return order, ranks


def common_prefixes(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes at ``a`` and at ``b`` share."""
    length, last = np.zeros(len(a), np.int64), len(ranks[0]) - 1
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][np.minimum(a + length, last)] == ranks[k][np.minimum(b + length, last)]
        length += same.astype(np.int64) << k
    return length


class Node:
    """A node of the tree: the places below it, sorted, all together and by the word to their left."""

    __slots__ = ("lcp", "places", "classes")

    def __init__(self, lcp: int, places: list[int], classes: dict[int, list[int]]):
        self.lcp, self.places, self.classes = lcp, places, classes

    def join(self, child: Node, left: np.ndarray, pairs: list[tuple[int, int, int]]) -> None:
        """Take the places of ``child`` over, the smaller side into the larger, and note the maximal pairs that are runs."""
        if len(self.places) < len(child.places):
            self.places, self.classes, places = child.places, child.classes, self.places
        else:
            places = child.places
        reach = self.lcp // (LEAST_PERIODS - 1)
        for x in places:
            a, b = bisect_left(self.places, x - reach), bisect_right(self.places, x + reach)
            if b - a <= len(self.classes):
                near = [y for y in self.places[a:b] if left[y] != left[x]]
            else:
                near = [y for c, own in self.classes.items() if c != left[x] for y in own[bisect_left(own, x - reach) : bisect_right(own, x + reach)]]
            pairs += [(min(x, y), self.lcp + abs(x - y), abs(x - y)) for y in near if self.lcp + abs(x - y) >= LEAST_WORDS]
        for x in places:
            insort(self.places, x)
            insort(self.classes.setdefault(int(left[x]), []), x)


def maximal_pairs(places: np.ndarray, lcps: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of the pairs below one LCP interval: ``lcps[i]`` is that of places i - 1 and i."""
    leaf = lambda x: Node(0, [x], {int(left[x]): [x]})
    pairs: list[tuple[int, int, int]] = []
    open_: list[Node] = []
    last = leaf(int(places[0]))
    for x, lcp in zip([*places[1:].tolist(), None], [*lcps[1:].tolist(), 0], strict=True):
        while open_ and open_[-1].lcp > lcp:
            node = open_.pop()
            node.join(last, left, pairs)
            last = node
        if x is None:
            return pairs
        if open_ and open_[-1].lcp == lcp:
            open_[-1].join(last, left, pairs)
        else:
            open_.append(Node(lcp, last.places, last.classes))
        last = leaf(x)
    return pairs


def runs_of(words: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in ``words``, numbers of words that no two texts share; ``text`` numbers the texts."""
    some = text[repeated_windows(words, LEAST_LCP)]
    if not len(some):
        return []
    holds = np.zeros(text[-1] + 1, bool)
    holds[some] = True
    where = np.flatnonzero(holds[text])
    kept = words[where]
    order, ranks = suffix_order(kept)
    level = min(LEAST_LCP.bit_length() - 1, len(ranks) - 1)
    near = np.flatnonzero(ranks[level][order[1:]] == ranks[level][order[:-1]])
    lcp = np.zeros(len(order), np.int64)
    lcp[near + 1] = common_prefixes(order[near], order[near + 1], ranks)
    # the left word of a text's first place is like no other
    left = np.concatenate(([-1], kept[:-1]))
    begins = np.flatnonzero(np.diff(text[where], prepend=-1))
    left[begins] = -1 - begins
    deep = lcp >= LEAST_LCP
    first = np.flatnonzero(~deep & np.append(deep[1:], False))
    after = np.searchsorted(np.flatnonzero(~deep), first, "right")
    ends = np.append(np.flatnonzero(~deep), len(order))[after]
    pairs: list[tuple[int, int, int]] = []
    for a, b in zip(first.tolist(), ends.tolist(), strict=True):
        places = order[a:b]
        lefts = left[places]
        if (lefts != lefts[0]).any() and np.diff(np.sort(places)).min() * (LEAST_PERIODS - 1) <= lcp[a + 1 : b].max():
            pairs += maximal_pairs(places, lcp[a:b], left)
    least: dict[tuple[int, int], int] = {}
    for start, length, distance in pairs:
        least[start, length] = min(distance, least.get((start, length), distance))
    return [(int(where[start]), length, period) for (start, length), period in least.items()]


def runs_of_texts(texts: list[bytes | None]) -> list[tuple[list[tuple[int, int, int]], bytes | None]]:
    """Of each text its runs, by start and period, and the text with what repeats collapsed."""
    split = [t.split() if t else [] for t in texts]
    ids: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for own in split for w in own), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(split)), sizes)
    ahead = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_of(numbers + text * max(1, len(ids)), text):
        found[text[start]].append((int(start - ahead[text[start]]), length, period))
    out = []
    for t, own, runs in zip(texts, split, found, strict=True):
        runs.sort(key=lambda r: (r[0], r[2]))
        if runs:
            kept = np.ones(len(own), bool)
            for start, length, period in runs:
                kept[start + period : start + length] = False
            own = [own[i] for i in np.flatnonzero(kept).tolist()]
        out.append((runs, None if t is None else b" ".join(own)))
    return out


def _batches(sizes: list[int]) -> list[tuple[int, int]]:
    """Slices of a list of texts, of ``SORTED_BYTES`` each or of one text."""
    cuts, total = [0], 0
    for i, n in enumerate(sizes):
        if total and total + n > SORTED_BYTES:
            cuts.append(i)
            total = 0
        total += n
    return list(zip(cuts, [*cuts[1:], len(sizes)], strict=True))



def _found(texts: pa.Array) -> pa.Array:
    runs, sizes, collapsed = [], [0], []
    for a, b in _batches(pc.binary_length(texts).fill_null(0).to_pylist()):
        for own, text in runs_of_texts(texts[a:b].to_pylist()):
            runs += own
            sizes.append(len(runs))
            collapsed.append(text)
    columns = np.array(runs, np.int64).reshape(-1, 3)
    each = pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)
    return pa.StructArray.from_arrays([lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["runs", "collapsed"])


def collapse_runs(docs: DataFrame, names: tuple[str, str] = ("_runs", "_collapsed")) -> DataFrame:
    """``docs`` with the runs of each whole text and the text without their repeats.

    Words are runs of anything but ASCII white space, numbered from 0. A run has
    start, length and least period in words. A word is dropped if any run holds it
    after that run's first period; the words that stay are joined by one space. A
    null text has no runs and stays null; one without words becomes empty. Rows
    that repeat get equal results; an empty table stays empty. The new columns are
    called ``names``; where ``docs`` has such a column, that stays and the new name
    gets underscores before it.
    """
    rows = docs.select(packed(docs), F.arrow_udf(_found, KIND)(F.col("text").cast("binary")).alias("_found"))
    return rows.select("_row.*", *[F.col(f"_found.{c}").alias(free_name(docs, n)) for c, n in zip(("runs", "collapsed"), names, strict=True)])


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by their ids, go over to repeating a stretch of their words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = F.filter(F.split("text", GAP), lambda w: w != ""), F.floor(h / 10)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    altered = F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", F.when(h % 10 == 0, altered).otherwise(F.col("text")).alias("text"))


def stronger(a: Column, b: Column) -> Column:
    """Whether run ``a`` has the greater exponent; runs come by start and period, so that of equal ones the first stays."""
    return a["length"] * b["period"] > b["length"] * a["period"]


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document's runs: how many, the strongest, and digests of all of them and of the collapsed text."""
    docs = repeating(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = collapse_runs(docs)
    # exponents are compared exactly, by cross products
    best = F.aggregate("_runs", F.get("_runs", F.lit(0)), lambda best, r: F.when(stronger(r, best), r).otherwise(best))
    found = found.withColumn("_best", best)
    listed = F.concat_ws("", F.transform("_runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("1000 * _best.length div _best.period")).alias("exponent_milli"),
        digest(listed).alias("runs_sha256"),
        digest(F.coalesce("_collapsed", F.lit(""))).alias("collapsed_sha256"),
    )
