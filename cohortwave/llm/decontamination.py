"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Every window of a document that has as many words as a benchmark item gets the
SimHash of its 5-word shingles, by counts of the shingles' bits that grow from
length to length. The items' fingerprints of that length are in a multi-index: 64
bits in four blocks, each item filed under every block value within three bits of
its own. Two fingerprints within 15 bits differ by three at most in one block at
least, so the index misses none of them, while an unrelated window meets one item
in twenty-five. A few items are filed under all values, with the bits that differ:
a window within the radius of one has four values whose least bits sum to 15 at
most. What the index proposes within the radius is verified by the exact weighted
similarity of both shingle multisets, together with the windows a few words to
either side.

The items must be few beside the corpus; they are counted, and reach the tasks in
groups of bounded size, one pass for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .simhash import SEED, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: Similarity 0.8 is a cosine of 0.89 or more: 9.7 of 64 bits on average, over 15 in 2 of 100 windows at exactly 0.8.
RADIUS = 15
#: Blocks of 16 bits, and the bits in which one block may differ: RADIUS differing bits leave one block with no more.
BLOCKS, FLIPS = 4, 3
#: Words of benchmark items that one pass over the documents takes.
PASS_WORDS = 1 << 17
#: Windows that are fingerprinted in one step, bytes of text that are cut into words at a time, pairs that are compared at once.
STEP, SEGMENT, PAIRS = 1 << 14, 1 << 22, 1 << 20
#: Items of a length that are compared one after the other.
FEW = 16
#: Widths from which counts are differences of running sums; below, planes of bits are added.
WIDE = 128
_NEAR = np.array([sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(16), n)], np.uint16)
_MIX = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
#: The five primes of XXH64, and the bytes from which on it works in stripes.
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_STRIPE = 32
#: How many bits of a byte are set.
_SET = np.bitwise_count(np.arange(256, dtype=np.uint8))


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def _short_xxh64(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """XXH64 of the ``size`` bytes, fewer than a stripe, from each of the places ``at``."""
    one, two, three, four, five = _PRIMES
    read = lambda place, n: np.lib.stride_tricks.sliding_window_view(data, n)[at + place].view(f"<u{n}")[:, 0].astype(np.uint64)
    h, place = np.full(len(at), SEED + int(five) + size, np.uint64), 0
    while size - place >= 8:
        h = _turned(h ^ _turned(read(place, 8) * two, 31) * one, 27) * one + four
        place += 8
    if size - place >= 4:
        h = _turned(h ^ read(place, 4) * one, 23) * two + three
        place += 4
    for place in range(place, size):
        h = _turned(h ^ data[at + place] * five, 11) * one
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return h ^ h >> np.uint64(32)


def _codes(words: list[bytes] | tuple[bytes, ...]) -> np.ndarray:
    """XXH64 of each word, for all words of a size at once; words hold no space."""
    data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    ends = np.flatnonzero(data == ord(" "))
    start = np.concatenate(([0], ends[:-1] + 1))[: len(ends)]
    sizes = np.minimum(ends - start, _STRIPE).astype(np.uint8)
    order, many = np.argsort(sizes, kind="stable"), np.bincount(sizes, minlength=_STRIPE + 1)
    codes = np.empty(len(words), np.uint64)
    for size, own in enumerate(np.split(order, np.cumsum(many)[:-1])):
        if size == _STRIPE:
            codes[own] = np.fromiter((xxh64_intdigest(words[i], SEED) for i in own.tolist()), np.uint64, len(own))
        elif len(own):
            codes[own] = _short_xxh64(data, start[own], size)
    return codes


def _shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbouring word codes."""
    many = max(len(codes) - size + 1, 0)
    total = np.zeros(many, np.uint64)
    for i in range(size):
        total += codes[i : i + many] * _MIX[i]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def _running(hashes: np.ndarray, kind: type = np.int32) -> np.ndarray:
    """How many of the hashes before each place set each of the 64 bits; differences are right below the kind's bound."""
    upto = np.zeros((len(hashes) + 1, 64), kind)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    np.cumsum(bits, axis=0, dtype=kind, out=upto[1:])
    return upto


def _fingerprints(upto: np.ndarray, width: int, room: np.ndarray | None = None) -> np.ndarray:
    """SimHash of every ``width`` neighbouring shingles: a bit is 1 if set in over half of them.

    ``room`` of the counts' kind is used anew by each call.
    """
    set_ = np.subtract(upto[width:], upto[:-width], out=None if room is None else room[: len(upto) - width])
    return np.packbits(np.greater(set_, width // 2, out=set_.view(bool) if set_.itemsize == 1 else None), bitorder="little").view(np.uint64)


def _plus(planes: list[np.ndarray], more: list[np.ndarray], most: int, room: np.ndarray) -> None:
    """Add the counts ``more`` to ``planes``, of no fewer planes, in place; the last carry becomes a plane if sums up to ``most`` need it."""
    many = len(planes[0])
    carry, next_, both = (r[:many] for r in room[:3])
    np.bitwise_and(planes[0], more[0], out=carry)
    np.bitwise_xor(planes[0], more[0], out=planes[0])
    for k, own in enumerate(planes[1:], 1):
        if k < len(more):
            np.bitwise_and(own, more[k], out=next_)
            np.bitwise_xor(own, more[k], out=own)
            np.bitwise_and(own, carry, out=both)
            np.bitwise_or(next_, both, out=next_)
        else:
            np.bitwise_and(own, carry, out=next_)
        np.bitwise_xor(own, carry, out=own)
        carry, next_ = next_, carry
    if most.bit_length() > len(planes):
        planes.append(carry.copy())


def _growing(hashes: np.ndarray, many: int, widths: list[int], room: np.ndarray) -> Iterator[np.ndarray]:
    """SimHash of the hashes in a window at each of ``many`` places, for one width after the other, ascending.

    Bit k of the 64 counts of a place is a word of plane k, so 64 counts are added
    at once. Counts of 2**k neighbours are sums of two of half as many; those of a
    width are the counts of the width before and of such neighbours behind it.
    What is given out is used anew for the next width.
    """
    gaps = [b - a for a, b in zip([0, *widths], widths, strict=False)]
    dyadic = [[hashes]]
    while 2 ** len(dyadic) <= max(gaps):
        half = len(hashes) - 2 ** len(dyadic) + 1
        planes = [p[:half].copy() for p in dyadic[-1]]
        _plus(planes, [p[-half:] for p in dyadic[-1]], 2 ** len(dyadic), room)
        dyadic.append(planes)
    counts: list[np.ndarray] = []
    over, now = room[3, :many], 0
    for width, gap in zip(widths, gaps, strict=True):
        for k in reversed(range(len(dyadic))):
            if gap >> k & 1:
                more = [p[now : now + many] for p in dyadic[k]]
                now += 1 << k
                if len(counts) < len(more):
                    counts, more = [p.copy() for p in more], counts
                if more:
                    _plus(counts, more, now, room)
        # over half: from the first 0 bit of the half on, "or" where the half has a 0, "and" where it has a 1
        half = width // 2
        first = (half ^ half + 1).bit_length() - 1
        found = counts[first]
        for k, plane in enumerate(counts[first + 1 :], first + 1):
            found = (np.bitwise_and if half >> k & 1 else np.bitwise_or)(found, plane, out=over)
        yield found


def _grams(words: list[bytes] | tuple[bytes, ...], size: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(size)), strict=False))


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the lesser over sum of the greater counts, over all shingles."""
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return common / (a.total() + b.total() - common)


@dataclass
class _Length:
    """The items of one length: their numbers in the benchmark, shingles, fingerprints and the block index."""

    words: int
    numbers: list[int] = field(default_factory=list)
    grams: list[Counter] = field(default_factory=list)
    prints: list[int] = field(default_factory=list)
    hashes: list[set[int]] = field(default_factory=list)

    def __post_init__(self):
        self.size = min(SHINGLE, self.words)
        self.width = self.words - self.size + 1

    def add(self, number: int, words: tuple[bytes, ...], codes: np.ndarray) -> None:
        self.numbers.append(number)
        self.grams.append(_grams(words, self.size))
        hashes = _shingles(codes, self.size)
        self.hashes.append(set(hashes.tolist()))
        self.prints.append(int(_fingerprints(_running(hashes), self.width)[0]))

    @cached_property
    def index(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block (first, many, items): the items filed under value v are ``items[first[v]]`` and the ``many[v] - 1`` after it."""
        values = np.array(self.prints, np.uint64).view(np.uint16).reshape(-1, BLOCKS)
        lists = []
        for block in range(BLOCKS):
            filed = (values[:, block, None] ^ _NEAR).ravel()
            many = np.bincount(filed, minlength=1 << 16)
            items = np.repeat(np.arange(len(values), dtype=np.int32), len(_NEAR))[np.argsort(filed, kind="stable")]
            lists.append(((np.cumsum(many) - many).astype(np.int32), many.astype(np.int32), items))
        return lists

    @cached_property
    def away(self) -> np.ndarray:
        """For each block and value the bits in which the nearest item's value differs; of many items, FLIPS + 1 unless one is filed."""
        if len(self.prints) > FEW:
            return np.stack([np.where(many > 0, 0, FLIPS + 1).astype(np.uint8) for _, many, _ in self.index])
        bytes_ = np.array(self.prints, "<u8").view(np.uint8).reshape(-1, BLOCKS, 2)
        bits = _SET[bytes_[..., None] ^ np.arange(256, dtype=np.uint8)]
        return np.stack([np.min([high[:, None] + low for low, high in bits[:, block]], axis=0).ravel() for block in range(BLOCKS)])

    def passed(self, prints: np.ndarray) -> np.ndarray:
        """The windows whose blocks are no more than the radius away, taken together: all within the radius of an item, and few others."""
        value, bits, total = np.empty(len(prints), np.int64), np.empty(len(prints), np.uint8), np.zeros(len(prints), np.uint8)
        for block in range(BLOCKS):
            np.right_shift(prints, np.uint64(16 * block), out=value.view(np.uint64))
            if block < BLOCKS - 1:
                np.bitwise_and(value, 0xFFFF, out=value)
            total += self.away[block].take(value, out=bits, mode="wrap")
        return np.flatnonzero(total <= RADIUS)

    def met(self, prints: np.ndarray, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, items) of ``some`` windows and the items that are filed under a block value of theirs, in parts."""
        values = prints.view(np.uint16).reshape(-1, BLOCKS)
        for block, (first, many, items) in enumerate(self.index):
            own = values[some, block]
            sizes = many.take(own).astype(np.int64)
            for part in np.array_split(np.flatnonzero(sizes), 1 + int(sizes.sum()) // PAIRS):
                size = sizes[part]
                ahead = np.cumsum(size) - size
                yield np.repeat(some[part], size), items[np.arange(size.sum()) + np.repeat(first.take(own[part]) - ahead, size)]

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item's number here, windows within the radius of it), by the block index.

        A few items are compared with all windows that the index lets pass, more of
        them with those only that share a block value as filed: both find the same.
        """
        some = self.passed(prints)
        if len(some) and len(self.prints) <= FEW:
            close = np.bitwise_count(prints[some] ^ np.array(self.prints, np.uint64)[:, None]) <= RADIUS
            for item in np.flatnonzero(close.any(axis=1)).tolist():
                yield item, some[close[item]]
        elif len(some):
            filed, found = np.array(self.prints, np.uint64), []
            for window, item in self.met(prints, some):
                close = np.bitwise_count(prints[window] ^ filed[item]) <= RADIUS
                found.append(item[close].astype(np.int64) * len(prints) + window[close])
            item, window = np.divmod(np.unique(np.concatenate(found)), len(prints))
            cuts = np.flatnonzero(np.diff(item)) + 1
            yield from zip(item[np.append(0, cuts)].tolist() if len(item) else (), np.split(window, cuts), strict=False)


def _windows(hashes: np.ndarray, lengths: list[_Length]) -> Iterator[tuple[int, _Length, np.ndarray]]:
    """(place, length, fingerprints of all its windows from there on) for the lengths, ascending, in each step."""
    narrow, wide = [own for own in lengths if own.width < WIDE], [own for own in lengths if own.width >= WIDE]
    if narrow:
        widths = [own.width for own in narrow]
        planes = np.empty((4, STEP + widths[-1]), np.uint64)
    if wide:
        widest = wide[-1].width
        kind = np.int16 if widest < 1 << 15 else np.int32
        room = np.empty((STEP, 64), kind)
    for at in range(0, len(hashes), STEP):
        if narrow:
            many = min(STEP, len(hashes) - at)
            near = hashes[at : at + many + widths[-1] - 1]
            behind = np.zeros(many + widths[-1] - 1 - len(near), np.uint64)  # windows that reach there are cut off
            for own, prints in zip(narrow, _growing(np.concatenate((near, behind)), many, widths, planes), strict=True):
                if len(near) >= own.width:
                    yield at, own, prints[: len(near) - own.width + 1]
        if wide:
            upto = _running(hashes[at : at + STEP + widest - 1], kind)
            for own in wide:
                if len(upto) > own.width:
                    yield at, own, _fingerprints(upto[: STEP + own.width], own.width, room)


class Benchmark:
    """Items ready to be searched for. Items without words cannot occur and are left out."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = items
        self._lengths: dict[int, _Length] | None = None

    def __getstate__(self):
        return {"items": self.items, "_lengths": None}  # a task makes its own index

    @property
    def lengths(self) -> dict[int, _Length]:
        if self._lengths is None:
            self._lengths = {}
            for number, (_, text) in enumerate(self.items):
                words = tuple(words_of(text.encode() if text else None))
                if words:
                    self._lengths.setdefault(len(words), _Length(len(words))).add(number, words, _codes(words))
        return self._lengths

    def _segments(self, texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int, bool]]]]:
        """Words of about ``SEGMENT`` bytes of text, and the stretches there: (text, its first word, words, whether that is all).

        A longer text comes in several stretches, each with the last words of
        the one before, so that every window lies in one of them.
        """
        words: list[bytes] = []
        stretches: list[tuple[int, int, int, bool]] = []
        held, overlap = 0, max(self.lengths) - 1
        for number, text in enumerate(texts):
            text, before, first, at = text or b"", [], 0, 0
            while at < len(text) or at == 0:
                end = at + SEGMENT
                while end < len(text) and not text[end : end + 1].isspace():
                    end += 1
                own = before + words_of(text[at:end])
                stretches.append((number, first, len(own), at == 0 and end >= len(text)))
                words += own
                held += end - at if end < len(text) else len(text) - at
                before = own[max(0, len(own) - overlap) :]
                first, at = first + len(own) - len(before), end
                if held >= SEGMENT:
                    yield words, stretches
                    words, stretches, held = [], [], 0
        if words:
            yield words, stretches

    def search(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int, float]]]:
        """(item, first word, Hamming distance, similarity) of every item that each text holds: its best window."""
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        if self.lengths:
            for words, stretches in self._segments(texts):
                self._search(words, stretches, best)
        return [[(self.items[n][0], at, far, -alike) for n, (alike, at, far) in sorted(own.items())] for own in best]

    def _search(self, words: list[bytes], stretches: list[tuple[int, int, int, bool]], best: list[dict]) -> None:
        codes = _codes(words)
        many = np.array([n for _, _, n, _ in stretches])
        start = np.concatenate(([0], np.cumsum(many)))
        left = np.repeat(start[1:], many) - np.arange(len(words))  # words from here to the stretch's end

        def keep(own: _Length, item: int, at: int, size: int) -> None:
            """Verify a window, and those beside it, of the stretch in which it lies."""
            part = int(np.searchsorted(start, at, "right")) - 1
            reach = own.width // 8 if size == own.words else 0
            number, first = stretches[part][:2]
            width = size - own.size + 1
            shared = sum(map(own.hashes[item].__contains__, _shingles(codes[at : at + size], own.size).tolist()))
            if shared < 0.75 * SIMILARITY * (own.width + width - shared):
                return  # shingles that are equal have equal hashes: the similarity is no greater
            if weighted_similarity(_grams(words[at : at + size], own.size), own.grams[item]) < 0.75 * SIMILARITY:
                return
            for now in range(max(at - reach, int(start[part])), min(at + reach, int(start[part + 1]) - size) + 1):
                alike = weighted_similarity(_grams(words[now : now + size], own.size), own.grams[item])
                if alike >= SIMILARITY:
                    print_ = _fingerprints(_running(_shingles(codes[now : now + size], own.size)), size - own.size + 1)
                    found = (-alike, first + now - int(start[part]), int(np.bitwise_count(print_[0] ^ np.uint64(own.prints[item]))))
                    best[number][own.numbers[item]] = min(best[number].get(own.numbers[item], found), found)

        for size in {own.size for own in self.lengths.values()}:
            lengths = [own for own in self.lengths.values() if own.size == size]
            for at, own, prints in _windows(_shingles(codes, size), sorted(lengths, key=lambda own: own.width)):
                for item, rows in own.near(prints):
                    done = -1  # windows side by side are verified once, with what lies beside them
                    for row in rows[left[at + rows] >= own.words].tolist():
                        if row > done:
                            keep(own, item, at + row, own.words)
                            done = row + own.width // 8
        # a text that is shorter than an item is one window
        for part, (_, _, n, whole) in enumerate(stretches):
            if whole and SHINGLE <= n < max(self.lengths):
                at, width = int(start[part]), n - SHINGLE + 1
                fitting = [own for own in self.lengths.values() if own.words > n and width >= SIMILARITY * own.width - 1e-9]
                if fitting:
                    print_ = _fingerprints(_running(_shingles(codes[at : at + n], SHINGLE)), width)
                    for own in fitting:
                        for item, _ in own.near(print_):
                            keep(own, item, at, n)


def benchmarks(items: DataFrame, pass_words: int = PASS_WORDS) -> list[Benchmark]:
    """The items of ``items(item_id, text)`` in groups of about ``pass_words`` words."""
    groups, own, held = [], [], 0
    for r in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        own.append((r["item_id"], r["text"]))
        held += len(words_of((r["text"] or "").encode()))
        if held >= pass_words:
            groups.append(Benchmark(own))
            own, held = [], 0
    return groups + [Benchmark(own)] if own else groups


def matches_column(text: Column, benchmark: Benchmark) -> Column:
    """array<struct(item_id, at, distance, similarity)>: the items that a text holds."""

    @F.pandas_udf("array<struct<item_id:long,at:long,distance:int,similarity:double>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = benchmark.search(texts.tolist())
            yield pd.Series([[dict(zip(("item_id", "at", "distance", "similarity"), m, strict=True)) for m in own] for own in found], dtype=object)

    return of(text.cast("binary"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, at, distance, similarity) for each item that a document holds.

    ``at`` is the first word, from 0, of the item's most similar window among those
    that the index proposes and those beside them, the first of equals. Items of fewer than five words are one shingle, found only
    word for word. A text shorter than an item is one window, compared as a
    whole. Items of null or repeated item_id are items of their own: each that a
    document holds gives a row. Null, empty and blank texts and items match nothing. Rows that repeat
    get a result each; empty tables give an empty result.
    """
    parts = []
    for group in benchmarks(items):
        found = docs.select("doc_id", F.explode(matches_column(F.col("text"), group)).alias("m"))
        parts.append(found.select("doc_id", "m.item_id", "m.at", "m.distance", "m.similarity"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, at long, distance int, similarity double")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``, of any columns, without the documents that hold a benchmark item."""
    for group in benchmarks(items):
        docs = docs.where(F.size(matches_column(F.col("text"), group)) == 0)
    return docs


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its place and similarity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
