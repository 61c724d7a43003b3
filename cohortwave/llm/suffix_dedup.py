"""Removal of repeated byte strings: suffix order and longest previous factors, shard by shard.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document
of smaller id. The suffixes of a corpus are too many to sort in one place, and
all but a few are alone. So every window of ``SPAN`` bytes is named by the
smallest hash among its strings of ``KMER`` bytes, its anchor: equal windows have
equal anchors. Neighbouring windows of one anchor are one stretch of text.

1. Documents are dealt into slices. Each slice sends its anchors' hashes, packed,
   to buckets of hashes, which answer which anchors occur in several documents.
2. Slices send the distinct stretches of these anchors to the anchors' buckets.
   There the stretches' suffixes are sorted. In the suffix order, the previous and
   the next suffix of a smaller document give the longest previous factor: it
   reaches ``SPAN`` if one of them shares that many bytes. The first occurrence
   has neither and stays.
3. Slices get back, for every stretch that they sent, its first document and the
   windows that are repeated even there, and cut their texts.

An anchor that is very frequent has its windows sent one by one, to the buckets
of the windows' own hashes, so that no bucket meets all that surrounds a common
phrase. Hashes only propose: equal bytes decide. All three steps are one Spark
plan over one shuffle of the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import free_name, packed

#: Bytes of a repeated string, and of the strings whose hashes are compared.
SPAN, KMER = 50, 25
#: Bytes of text in a slice, anchors in a bucket, about.
SLICE_BYTES, BUCKET = 8 << 20, 200_000
#: An anchor with more occurrences than this part of a bucket is very frequent.
FREQUENT = 1 / 16
#: Windows that are hashed at once.
CHUNK = 1 << 16
#: Bytes of an anchor's hash that are sent: which anchors repeat is a proposal.
KEY = 6
#: A null id counts as the largest.
NO_ID = (1 << 63) - 1
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
#: A number for each byte, from a rule.
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0xCA5A826395121157)) >> np.uint64(17))
#: A stretch has at most so many bytes; it is held in a row of eight-byte words whose last byte is its length.
MOST, ROW = 2 * SPAN - KMER, 80


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``KMER`` bytes from each place on, as far as they go."""
    powers, have = {1: _TABLE[data]}, 1
    while 2 * have <= KMER:
        h = powers[have]
        powers[2 * have] = h[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have:]
        have *= 2
    h = powers[have]
    for step in sorted((1 << b for b in range(have.bit_length() - 1) if KMER - have >> b & 1), reverse=True):
        more = powers[step][have:]
        h = h[: len(more)] * np.uint64(pow(_BASE, step, 1 << 64)) + more
        have += step
    return mixed(h)


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the ``width`` keys from each place on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    return keys


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a key: buckets follow each other as their keys do."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of starts[i], starts[i] + 1, ... for every i, ``sizes[i]`` of them."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    return owner, starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Slice:
    """The texts of a slice in one array of bytes, cut into stretches of windows that share an anchor.

    ``start`` and ``many`` are a stretch's first window and number of windows,
    ``key`` its anchor's hash, ``doc`` its document's id.
    """

    def __init__(self, ids: np.ndarray, texts: list[bytes | None]):
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join(t for t in texts if t) + bytes(ROW), np.uint8)
        self.size = int(sizes.sum())
        whole = np.ones(self.size, bool)
        whole[np.maximum(self.ends[sizes > 0, None] - np.arange(1, SPAN), self.starts[sizes > 0, None])] = False
        events, anchors, keys, before = [], [], [], -1
        for at in range(0, self.size, CHUNK):
            end = min(at + CHUNK, self.size)
            h = kmer_hashes(self.data[at : end + SPAN])
            bits = np.uint64(CHUNK.bit_length() + 1)
            least = least_of(h >> bits << bits | np.arange(len(h), dtype=np.uint64), SPAN - KMER + 1)[: end - at]
            place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            anchor = np.where(whole[at:end], place + at, -1)
            new = np.flatnonzero(np.diff(anchor, prepend=before))
            before = anchor[-1]
            events.append(new + at)
            anchors.append(anchor[new])
            keys.append(h[place[new]])
        if events:
            event, anchor, key = np.concatenate(events), np.concatenate(anchors), np.concatenate(keys)
            many = np.diff(event, append=self.size)[anchor >= 0]
            self.start, self.key, self.many = event[anchor >= 0], mixed(key[anchor >= 0]), many
        else:
            self.start, self.key, self.many = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.doc = ids[np.searchsorted(self.ends, self.start, "right")]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, which of them each stretch has, one byte of each: twice the bit length of its count, and 1 if in several documents)."""
        order = np.argsort(self.key, kind="stable")
        key = self.key[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        of = np.empty(len(key), np.int64)
        of[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        if not len(first):
            return key, of, np.zeros(0, np.uint8)
        docs = self.doc[order]
        several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
        counts = np.diff(first, append=len(key))
        return key[first], of, (2 * np.ceil(np.log2(counts + 1)) + several).astype(np.uint8)

    def rows(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes of stretches, a row each: padded with zeros, the length at the end."""
        found = np.lib.stride_tricks.sliding_window_view(self.data, ROW)[start]
        found = found * (np.arange(ROW) < size[:, None])
        found[:, -1] = size
        return found

    def distinct(self, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, first, hash): the number of each stretch's text, and where each text stands first by document, with a hash of it."""
        hashed = np.empty(len(start), np.uint64)
        for at in range(0, len(start), CHUNK):
            part = slice(at, at + CHUNK)
            h = np.zeros(len(start[part]), np.uint64)
            for word in self.rows(start[part], size[part]).view(np.uint64).T:
                h = mixed(h ^ word)
            hashed[part] = h
        order = np.lexsort((doc, hashed))
        new = np.concatenate(([True], np.diff(hashed[order]) != 0)) if len(order) else np.zeros(0, bool)
        first = order[np.flatnonzero(new)]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        for at in range(0, len(start), CHUNK):
            part = slice(at, at + CHUNK)
            head = first[which[part]]
            other = at + np.flatnonzero((self.rows(start[part], size[part]) != self.rows(start[head], size[head])).any(axis=1))
            which[other] = len(first) + np.arange(len(other))  # a hash that two texts share: the later one stands alone
            first = np.concatenate((first, other))
        return which, first, hashed[first]


@dataclass
class Sent:
    """What a slice sends of its stretches, in the order of its keys.

    ``stretch`` and ``of`` are the repeated stretches and the text that each has;
    text t is unit ``unit[t]``, or, if its anchor is very frequent, its windows
    are the units ``single[from_[t]]`` and on.
    """

    stretch: np.ndarray
    of: np.ndarray
    frequent: np.ndarray
    unit: np.ndarray
    single: np.ndarray
    from_: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    bucket: np.ndarray


def sent(own: Slice, status: np.ndarray, anchor: np.ndarray, buckets: int) -> Sent:
    """The units of the stretches whose anchors have ``status`` 1 (repeated) or 2 (very frequent)."""
    stretch = np.flatnonzero(status[anchor])
    start, many, doc = own.start[stretch], own.many[stretch], own.doc[stretch]
    of, first, _ = own.distinct(start, many + SPAN - 1, doc)
    frequent = status[anchor[stretch[first]]] == 2
    owner, window = ragged(start[first[frequent]], many[first[frequent]])
    windows = np.full(len(window), SPAN)
    least = doc[first]
    which, head, hashed = own.distinct(window, windows, least[frequent][owner])
    keys = np.concatenate((own.key[stretch[first[~frequent]]], mixed(hashed)))
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    unit = np.full(len(first), -1)
    unit[~frequent] = place[: (~frequent).sum()]
    from_ = np.full(len(first), -1)
    from_[frequent] = np.cumsum(many[first[frequent]]) - many[first[frequent]]
    starts = np.concatenate((start[first[~frequent]], window[head]))[order]
    sizes = np.concatenate((many[first[~frequent]] + SPAN - 1, windows[head]))[order]
    docs = np.concatenate((least[~frequent], least[frequent][owner][head]))[order]
    return Sent(stretch, of, frequent, unit, place[(~frequent).sum() :][which], from_, starts, sizes, docs, bucket_of(keys[order], buckets))


def marked(own: Slice, out: Sent, firsts: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether each byte of a slice goes: ``firsts`` and ``masks`` are the answers to its units."""
    begins = np.zeros(own.size + 1, bool)
    start, many, doc = own.start[out.stretch], own.many[out.stretch], own.doc[out.stretch]
    for d in range(SPAN - KMER + 1):
        some = np.flatnonzero(many > d)
        if len(some):
            text = out.of[some]
            singly = out.frequent[text]
            unit = np.where(singly, 0, out.unit[text])
            unit[singly] = out.single[out.from_[text[singly]] + d]
            bit = np.where(singly, 0, d).astype(np.uint32)
            gone = (doc[some] > firsts[unit]) | ((masks[unit] >> bit & np.uint32(1)) == 1)
            begins[start[some[gone]] + d] = True
    upto = np.concatenate((np.zeros(SPAN, np.int64), np.cumsum(begins[: own.size])))
    return upto[SPAN:] > upto[:-SPAN]


def repeated_windows(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For distinct stretches (rows of bytes with a first document each), the windows that an earlier document has, too, as bits."""
    many = rows[:, -1].astype(np.int64) - (SPAN - 1)
    owner, at = ragged(np.arange(len(rows)) * ROW, many)
    words = np.append(rows.reshape(-1), np.zeros(8, np.uint8)).astype(np.uint64)
    for have in (1, 2, 4):  # the eight bytes from each place on, first byte highest
        words = words[:-have] << np.uint64(8 * have) | words[have:]
    columns = [words[at + min(k, SPAN - 8)] for k in range(0, SPAN, 8)]
    order = np.lexsort(columns[::-1])
    _, doc = np.unique(docs, return_inverse=True)
    doc = doc[owner[order]]
    shares = np.zeros(len(order), bool)  # SPAN bytes with the suffix before it
    shares[1:] = True
    for c in columns:
        c = c[order]
        shares[1:] &= c[1:] == c[:-1]
    # the previous and the next suffix of a smaller document, if they share SPAN bytes: within the interval, the least so far is smaller
    interval = np.cumsum(~shares) * (int(doc.max(initial=0)) + 1)
    before = np.minimum.accumulate(doc - interval) + interval < doc
    after = np.minimum.accumulate((doc + interval)[::-1])[::-1] - interval < doc
    factor = np.zeros(len(order), bool)
    factor[order] = before | after
    masks = np.zeros(len(rows), np.uint32)
    np.bitwise_or.at(masks, owner[factor], (np.uint32(1) << ((at - owner * ROW)[factor]).astype(np.uint32)).astype(np.uint32))
    return masks


def _table(**columns) -> pa.Table:
    kinds = {"bucket": pa.int32(), "slice": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def _own(rows: pa.Table) -> Slice:
    row = rows["_row"].combine_chunks()
    return Slice(rows["_id"].to_numpy(), row.field("text").cast(pa.binary()).to_pylist())


def _by_bucket(own: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array of buckets."""
    new = np.flatnonzero(np.diff(own, prepend=-1))
    return list(zip(own[new].tolist(), new.tolist(), [*new[1:].tolist(), len(own)], strict=True))


def _ask(rows: pa.Table, buckets: int) -> pa.Table:
    """Step 1, a slice: its anchors, by bucket."""
    keys, _, info = _own(rows).anchors()
    parts = _by_bucket(bucket_of(keys, buckets))
    short = keys.view(np.uint8).reshape(-1, 8)[:, 8 - KEY :]
    number = rows["_slice"][0].as_py()
    return _table(bucket=[b for b, _, _ in parts], slice=[number] * len(parts), keys=[short[a:z].tobytes() for _, a, z in parts], info=[info[a:z].tobytes() for _, a, z in parts])


def _answer(rows: pa.Table, frequent: float) -> pa.Table:
    """Step 1, a bucket: 0 for an anchor of one document, 1 for a repeated one, 2 for a very frequent one."""
    keys = []
    for packed_keys in rows["keys"].to_pylist():
        whole = np.zeros((len(packed_keys) // KEY, 8), np.uint8)
        whole[:, 8 - KEY :] = np.frombuffer(packed_keys, np.uint8).reshape(-1, KEY)
        keys.append(whole.view(np.uint64)[:, 0])
    info = np.concatenate([np.frombuffer(k, np.uint8) for k in rows["info"].to_pylist()])
    values, of, slices = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    counts = np.bincount(of, weights=2.0 ** (info // 2 - 1.0), minlength=len(values))
    several = (slices > 1) | (np.bincount(of, weights=info % 2, minlength=len(values)) > 0)
    status = (several.astype(np.uint8) + (several & (counts > frequent)))[of]
    cuts = np.cumsum([0, *map(len, keys)]).tolist()
    out = [(s, b, status[a:z].tobytes()) for s, b, a, z in zip(rows["slice"].to_pylist(), rows["bucket"].to_pylist(), cuts[:-1], cuts[1:], strict=True) if status[a:z].any()]
    return _table(slice=[s for s, _, _ in out], bucket=[b for _, b, _ in out], status=[x for _, _, x in out])


def _status(keys: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """The status of a slice's anchors, from the answers of their buckets."""
    status = np.zeros(len(keys), np.uint8)
    told = dict(zip(answers["bucket"].to_pylist(), answers["status"].to_pylist(), strict=True))
    for b, a, z in _by_bucket(bucket_of(keys, buckets)):
        if told.get(b):
            status[a:z] = np.frombuffer(told[b], np.uint8)
    return status


def _send(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Step 2, a slice: its units by bucket, with the status that the bucket gave its anchors."""
    if not answers.num_rows or not rows.num_rows:
        return _table(bucket=[], slice=[], status=[], firsts=[], rows=[])
    own = _own(rows)
    keys, anchor, _ = own.anchors()
    out = sent(own, _status(keys, answers, buckets), anchor, buckets)
    told = dict(zip(answers["bucket"].to_pylist(), answers["status"].to_pylist(), strict=True))
    parts = {b: (a, z) for b, a, z in _by_bucket(out.bucket)}
    number, every = rows["_slice"][0].as_py(), sorted(told.keys() | parts.keys())
    spans = [parts.get(b, (0, 0)) for b in every]
    bodies = []
    for a, z in spans:
        held = np.arange(ROW) < out.size[a:z, None]
        body = out.size[a:z].astype(np.uint8).tobytes() + own.rows(out.start[a:z], out.size[a:z])[held].tobytes()
        bodies.append(zstandard.compress(body, 1))
    return _table(bucket=every, slice=[number] * len(every), status=[told.get(b, b"") for b in every], firsts=[out.doc[a:z].tobytes() for a, z in spans], rows=bodies)


def _unpacked(body: bytes, many: int) -> np.ndarray:
    body = zstandard.decompress(body)
    sizes = np.frombuffer(body, np.uint8, many)
    rows = np.zeros((many, ROW), np.uint8)
    rows[np.arange(ROW) < sizes[:, None]] = np.frombuffer(body, np.uint8, offset=many)
    rows[:, -1] = sizes
    return rows


def _order(rows: pa.Table) -> pa.Table:
    """Step 2, a bucket: the first document of every unit, and the windows that are repeated even there."""
    docs = [np.frombuffer(x, np.int64) for x in rows["firsts"].to_pylist()]
    texts = np.concatenate([_unpacked(x, len(d)) for x, d in zip(rows["rows"].to_pylist(), docs, strict=True)])
    cuts = np.cumsum([0, *map(len, docs)]).tolist()
    docs = np.concatenate(docs)
    words = texts.view(np.uint64)
    order = np.lexsort((docs, *words.T))
    new = np.concatenate(([True], (words[order][1:] != words[order][:-1]).any(axis=1))) if len(order) else np.zeros(0, bool)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    masks, firsts = repeated_windows(texts[first], docs[first])[of], docs[first][of]
    pieces = list(zip(cuts, cuts[1:], strict=False))
    return _table(slice=rows["slice"].to_pylist(), bucket=rows["bucket"].to_pylist(), status=rows["status"].to_pylist(), firsts=[firsts[a:z].tobytes() for a, z in pieces], masks=[masks[a:z].tobytes() for a, z in pieces])


def _cut(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Step 3, a slice: its rows, each with the bytes that stay, and how many went in how many spans."""
    own = _own(rows)
    gone = np.zeros(own.size, bool)
    if answers.num_rows:
        answers = answers.sort_by("bucket")
        keys, anchor, _ = own.anchors()
        out = sent(own, _status(keys, answers, buckets), anchor, buckets)
        firsts = np.frombuffer(b"".join(answers["firsts"].to_pylist()), np.int64)
        gone = marked(own, out, firsts, np.frombuffer(b"".join(answers["masks"].to_pylist()), np.uint32))
    kept, removed, spans = [], [], []
    null = rows["_row"].combine_chunks().field("text").is_null().to_pylist()
    for a, z, none in zip(own.starts.tolist(), own.ends.tolist(), null, strict=True):
        here = gone[a:z]
        kept.append(None if none else own.data[a:z][~here].tobytes())
        removed.append(int(here.sum()))
        spans.append(int((np.diff(here.astype(np.int8), prepend=0) == 1).sum()))
    return pa.table({"_row": rows["_row"], "_kept": pa.array(kept, pa.binary()), "_removed": pa.array(removed, pa.int64()), "_spans": pa.array(spans, pa.int64())})


def remove_repeated_strings(docs: DataFrame, names: tuple[str, str, str] = ("_kept", "_removed", "_spans"), slice_bytes: int = SLICE_BYTES, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with the bytes of each text that stay, how many went, and in how many maximal runs.

    Texts are compared as UTF-8 bytes; what stays may begin inside a character and
    is binary. A string counts as earlier in a document of smaller ``doc_id``
    only: rows of equal id keep what they share, a null id counts as the largest
    LONG. Strings are judged on the input, overlaps count. A null text stays null
    with nothing removed, texts under ``SPAN`` bytes stay whole, an empty table
    stays empty. The new columns are called ``names``; where ``docs`` has such a
    column, that stays and the new name gets underscores before it.

    ``slice_bytes`` and ``bucket`` set what a task holds at a time. They change no
    result; the packed rows between the steps number at most slices times
    buckets, so a larger corpus wants both larger.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-total // slice_bytes) or 1
    buckets = -(-total * 2 // ((SPAN - KMER + 2) * bucket)) or 1
    identity = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(slices)).cast("int")
    rows = docs.select(place.alias("_slice"), identity.alias("_id"), packed(docs))
    frequent = bucket * FREQUENT
    asked = rows.groupBy("_slice").applyInArrow(lambda t: _ask(t, buckets), "bucket int, slice int, keys binary, info binary")
    told = asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, frequent), "slice int, bucket int, status binary")
    units = rows.groupBy("_slice").cogroup(told.groupBy("slice")).applyInArrow(lambda t, a: _send(t, a, buckets), "bucket int, slice int, status binary, firsts binary, rows binary")
    judged = units.groupBy("bucket").applyInArrow(_order, "slice int, bucket int, status binary, firsts binary, masks binary")
    out = StructType([StructField("_row", rows.schema["_row"].dataType), StructField("_kept", BinaryType()), StructField("_removed", LongType()), StructField("_spans", LongType())])
    found = rows.groupBy("_slice").cogroup(judged.groupBy("slice")).applyInArrow(lambda t, a: _cut(t, a, buckets), out)
    return found.select("_row.*", *[F.col(c).alias(free_name(docs, n)) for c, n in zip(("_kept", "_removed", "_spans"), names, strict=True)])


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes, how many of them earlier documents have, and a digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeated_strings(docs)
    kept = F.sha2(F.coalesce("_kept", F.lit(b"")), 256)
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), kept.alias("kept_sha256"))
