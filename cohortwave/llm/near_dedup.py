"""Near-duplicate groups: SimHash fingerprints searched by BK-trees.

Distinct fingerprints are dealt to shards, and each shard has its own BK-tree; a
search follows only the edges whose distance can hold a match. Shards go by bits
that a match leaves alone: 64 bits in four blocks, and any three differing bits
leave one block whole. A shard is keyed by only so many bits of that block that it
holds some thousand fingerprints. One that outgrows its bound is dealt again, by
the same rule, over the bits that are still free: fingerprints that agree on one
block and differ in three bits agree on one of four blocks of the rest, too. So no
task meets an unbounded group, and no pair within the radius is lost.

The set of all fingerprints has no size bound, so the trees reach the tasks by a
shuffle on the shard key and not by one broadcast of everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_lookup, packed, release, written
from .components import components
from .simhash import as_hex, fingerprint_column

RADIUS = 3
#: Fingerprints of one tree, about, and the number beyond which a shard is dealt again.
TREE, PART = 2048, 8192


def block_masks(fixed: int, radius: int = RADIUS) -> list[int]:
    """The bits that ``fixed`` leaves free, in ``radius + 1`` blocks: one mask each."""
    free = [b for b in range(63, -1, -1) if not fixed >> b & 1]
    many = radius + 1
    return [sum(1 << b for b in free[len(free) * i // many : len(free) * (i + 1) // many]) for i in range(many)]


def _head(mask: int, bits: int) -> int:
    """The highest ``bits`` bits of a mask."""
    return sum(1 << b for b in [b for b in range(63, -1, -1) if mask >> b & 1][:bits])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class BKTree:
    """A BK-tree over 64-bit fingerprints, built and searched many at a time.

    ``children[k]`` of a node holds the fingerprints at Hamming distance ``k``
    from it. A search carries the array of all queries that reach a node and
    sends each on along the edges ``d - radius .. d + radius`` only.
    """

    __slots__ = ("at", "children")

    def __init__(self, prints: np.ndarray, at: np.ndarray):
        stack = [(self, at)]
        while stack:
            node, own = stack.pop()
            node.at, node.children = int(own[0]), {}
            if len(own) > 1:
                far = np.bitwise_count(prints[own[1:]] ^ prints[own[0]])
                order = np.argsort(far, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(far[order])) + 1):
                    child = object.__new__(BKTree)
                    node.children[int(far[part[0]])] = child
                    stack.append((child, own[1:][part]))

    def search(self, prints: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(member, queries within the radius of it), all as positions in ``prints``."""
        stack = [(self, queries)]
        while stack:
            node, asked = stack.pop()
            far = np.bitwise_count(prints[asked] ^ prints[node.at])
            hits = asked[far <= radius]
            if len(hits):
                yield node.at, hits
            for edge, child in node.children.items():
                near = asked[np.abs(far.astype(np.int16) - edge) <= radius]
                if len(near):
                    stack.append((child, near))


def _forest(prints: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what the search joins: at most one for each fingerprint."""
    root = np.arange(len(prints))
    for member, hits in BKTree(prints, root.copy()).search(prints, root.copy(), radius):
        own = np.unique(root[np.append(hits, member)])
        if len(own) > 1:
            root[np.isin(root, own[1:])] = own[0]
    for at in np.flatnonzero(root != np.arange(len(prints))):
        yield int(prints[at]), int(prints[root[at]])


def _links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Spanning links of each shard, from rows that come sorted by shard."""

    def of(keys: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        found = [link for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True) if b - a > 1 for link in _forest(prints[a:b], radius)]
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    keys, prints = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate((keys, batch[["mask", "kept"]].to_numpy()))
        prints = np.concatenate((prints, batch["print"].to_numpy().view(np.uint64)))
        if len(keys):
            whole = np.searchsorted((keys == keys[-1]).all(axis=1), True)  # rows of one shard stand together
            yield of(keys[:whole], prints[:whole]) if whole else pd.DataFrame({"a": [], "b": []}, dtype="int64")
            keys, prints = keys[whole:], prints[whole:]
    if len(keys):
        yield of(keys, prints)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tree: int = TREE, part: int = PART, width: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` of one another.

    ``prints`` has the distinct fingerprints in the LONG column ``print``. The
    links span every component; pairs inside a dense group are not all listed.
    ``width`` bits of a block key a shard: as many as give trees of about ``tree``
    fingerprints, if it is left out. The width changes no component.
    """
    if not 0 <= radius < 32:
        raise ValueError("the radius must be below 32")
    if width is None:
        width = max(0, ceil(log2(max(1, prints.count()) / tree)))
    # the mask that keys a shard -> the bits on which its fingerprints are taken to agree
    masks = {_head(block, width): block if width else 0 for block in block_masks(0, radius)}
    kept = lambda m: F.struct(m.alias("mask"), F.col("print").bitwiseAND(m).alias("kept"))
    dealt = prints.select("print", F.explode(F.array(*[kept(F.lit(_signed(m))) for m in masks])).alias("s")).select("print", "s.*")
    found: list[DataFrame] = []
    while True:
        again = {m: f for m, f in masks.items() if 64 - f.bit_count() > radius}
        counts = dealt.groupBy("mask", "kept").count().where(F.col("count") > part)
        large = written(counts.where(F.col("mask").isin([_signed(m) for m in again])).select("mask", "kept"), "large-shards")
        if large.isEmpty():
            release(large)
            break
        found.append(dealt.join(large, ["mask", "kept"], "left_anti"))
        # one row for each mask dealt again: at most the number of masks, whatever the number of fingerprints
        met = {r["mask"] for r in large.select("mask").distinct().collect()}
        nexts = {_signed(m): [f | b for b in block_masks(f, radius)] for m, f in again.items() if _signed(m) in met}
        rows = prints.sparkSession.createDataFrame([(m, _signed(n)) for m, ns in nexts.items() for n in ns], "mask long, next long")
        over = dealt.join(large, ["mask", "kept"], "left_semi").join(F.broadcast(rows), "mask")
        dealt = written(over.select("print", F.col("next").alias("mask"), F.col("print").bitwiseAND(F.col("next")).alias("kept")).distinct(), "dealt-again")
        masks = {n: n for ns in nexts.values() for n in ns}
    whole = dealt
    for part_ in found:
        whole = whole.unionByName(part_)
    return whole.repartition("mask", "kept").sortWithinPartitions("mask", "kept").mapInPandas(lambda it: _links(it, radius), "a long, b long")


def _classified(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, version and print of each row; print, n and first of each fingerprint.

    ``first`` is the smallest (doc_id, version) of the whole group, null ids
    last; ``version`` is a hash of the text, which tells rows of one id apart.
    """
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("version"), fingerprint_column(F.col("text"), shingle).alias("print")), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    prints = written(rows.groupBy("print").agg(F.min(place).alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(fingerprint_links(prints.select("print"), radius))
    linked = written(prints.join(roots, prints["print"] == roots["node"], "left").select("print", "first", "n", F.coalesce("root", "print").alias("root")), "linked")
    groups = linked.groupBy("root").agg(F.min("first").alias("first"))
    classes = written(linked.drop("first").join(groups, "root").select("print", "n", "first"), "classes")
    release(prints, roots, linked)
    return rows, classes


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, print, component_id) for each row of ``docs(doc_id, text)``.

    ``print`` is the fingerprint as LONG; component_id is the smallest doc_id
    among all documents whose fingerprints chain to this one within ``radius``
    bits. Null, empty and blank texts have fingerprint 0 and are linked like any
    other. Rows that repeat keep a row each. A null doc_id keeps its row; it is
    never the smallest. An empty table gives an empty result.
    """
    rows, classes = _classified(docs, shingle, radius)
    return hot_lookup(rows, classes, "print", "n").select("doc_id", "print", F.col("first.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: its smallest (doc_id, hash of the text), null ids last.

    So a doc_id that comes with several texts is several documents, each judged
    by its own group, and a row without an id stays only if no row of its group
    has one. Columns may have any names.
    """
    rows, classes = _classified(docs, shingle, radius)
    first = written(classes.select("first.doc_id", "first.version").distinct(), "kept")
    release(rows, classes)
    own = docs.select(packed(docs), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_version"))
    own = own.join(first, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_version") == F.col("version")), "left_semi")
    place = F.row_number().over(Window.partitionBy("_id", "_version").orderBy("_version"))
    return own.withColumn("_place", place).where("_place = 1").select("_row.*")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id it chains to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", as_hex(F.col("print")).alias("fingerprint"), "component_id")
