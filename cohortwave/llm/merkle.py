"""A Merkle manifest of a table: content-addressed records, and proofs by descent.

Every row is a leaf, the SHA-256 of its fields. Each source has a tree over its
leaves in the order of their ids, 16 children a node, and a last tree stands over
the sources' roots. Nodes are stored as records from digest to children: equal
subtrees share one record.

A request for a leaf descends from the root. At every level it finds its node's
record by digest, takes the child that the next digit of its rank (base 16) names
and collects the children that it leaves aside; requests that share a prefix of
their ranks descend together until they part. The segments of the path, reversed,
are the proof. A level is a join of records and requests, so that nothing but the
number of levels reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_lookup, release, written

#: Children of a node, and the characters of a digest.
FANOUT, DIGEST = 16, 64
#: Rows that get their ranks in one task, about.
RANK_ROWS = 8_000
#: Records of a level, of a kilobyte each, that may be broadcast; more are joined by shuffle, but for hot digests.
RECORDS = 8_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """One field of a leaf: its bytes counted, a colon, its bytes; a null is a dash."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*values: Column) -> Column:
    """The leaf of a row with these values."""
    return digest(*[field(v) for v in values])


def ranked(rows: DataFrame, tree: str, order: list[str], label: str) -> DataFrame:
    """Written ``rows`` with ``_rank``, gapless from 0 within each tree, and ``_nodes``, the rows of the tree.

    Rows are dealt into ranges of all trees' order, counted there, and numbered
    range by range, so that a tree of any size is numbered by many tasks. Ties
    in ``order`` are told apart by the place at which a row was first written.
    """
    rows = written(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{label}-rows")
    parts = max(1, -(-rows.count() // RANK_ROWS))
    ranges = written(rows.repartitionByRange(parts, tree, *order, "_tie").withColumn("_part", F.spark_partition_id()), f"{label}-ranges")
    release(rows)
    sizes = ranges.groupBy("_part", tree).count()
    whole = Window.partitionBy(tree)
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", tree, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"), F.sum("count").over(whole).alias("_nodes"))
    within = F.row_number().over(Window.partitionBy("_part", tree).orderBy(*order, "_tie")) - 1
    numbered = ranges.withColumn("_within", within).join(starts.hint("merge"), ["_part", tree])
    found = written(numbered.withColumn("_rank", F.col("_start") + F.col("_within")).drop("_part", "_tie", "_start", "_within"), label)
    release(ranges)
    return found


@dataclass
class Forest:
    """Trees over ranked nodes. ``levels[h]`` has the nodes at height h (``_tree, _rank, _nodes, _digest``; from 1 on ``_children``)."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(_tree, _height, _digest) of every tree."""
        tops = [t.where("_nodes = 1").select("_tree", F.lit(h).alias("_height"), "_digest") for h, t in enumerate(self.levels)]
        found = tops[0]
        for t in tops[1:]:
            found = found.unionByName(t)
        return found


def grown(leaves: DataFrame) -> Forest:
    """The trees over ``leaves(_tree, _rank, _nodes, _digest)``: every level a table of a sixteenth of the one below."""
    levels = [leaves]
    most = leaves.agg(F.max("_nodes")).first()[0] or 0
    while most > 1:
        below = levels[-1].where("_nodes > 1")
        runs = below.groupBy("_tree", F.shiftright("_rank", 4).alias("_rank")).agg(F.first("_nodes").alias("_nodes"), F.sort_array(F.collect_list(F.struct("_rank", "_digest"))).alias("_run"))
        nodes = runs.select("_tree", "_rank", F.ceil(F.col("_nodes") / FANOUT).alias("_nodes"), F.concat_ws("", "_run._digest").alias("_children"))
        levels.append(written(nodes.withColumn("_digest", F.sha2(F.col("_children").cast("binary"), 256)), "merkle-level"))
        most = -(-most // FANOUT)
    return Forest(levels)


def records(level: DataFrame) -> DataFrame:
    """(_digest, _children, _many) of a level: one record for equal nodes, however many there are."""
    return level.groupBy("_digest").agg(F.first("_children").alias("_children"), F.count("*").alias("_many"))


def descended(forest: Forest, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(_tree, _rank, ...)`` with the path from each tree's root to the leaf, and what ``starts`` has of the tree.

    ``starts(_tree, _height, _digest, _path, ...)`` are roots, with the path that
    led to them. ``_path`` grows by one pair of texts a level: the digests left and
    right of the child that is taken. ``_digest`` becomes the leaf's own.
    """
    wanted = [requests.select("_tree", "_rank")]
    for h in range(1, len(forest.levels) - 1):
        above = wanted[-1].select("_tree", F.shiftright("_rank", 4).alias("_rank")).distinct()
        wanted.append(written(above, "merkle-wanted") if h == 1 else above)
    at = lambda h: starts.where(F.col("_height") == h).withColumn("_rank", F.lit(0).cast("long")).drop("_height")
    found, here = requests.join(at(0), ["_tree", "_rank"]), None
    for h in range(len(forest.levels) - 1, 0, -1):
        here = at(h) if here is None else here.unionByName(at(h))
        known = records(forest.levels[h])
        if forest.levels[h].count() <= RECORDS:
            met = here.join(F.broadcast(known.drop("_many")), "_digest")
        else:
            met = hot_lookup(written(here, "merkle-frontier"), written(known, "merkle-records"), "_digest", "_many")
        met = met.drop("_digest").withColumnRenamed("_rank", "_up")
        met = (requests if h == 1 else wanted[h - 1]).withColumn("_up", F.shiftright("_rank", 4)).join(met, ["_tree", "_up"]).drop("_up")
        cut = F.col("_rank").bitwiseAND(FANOUT - 1) * DIGEST
        aside = F.struct(F.substring("_children", F.lit(1), cut).alias("l"), F.substring("_children", cut + DIGEST + 1, F.lit(FANOUT * DIGEST)).alias("r"))
        here = met.withColumns({"_digest": F.substring("_children", cut + 1, F.lit(DIGEST)), "_path": F.concat("_path", F.array(aside))}).drop("_children")
    return found if here is None else found.unionByName(here)


def proof(path: Column) -> Column:
    """The digest of a path's siblings, level by level from the leaf to the root, left to right."""
    return F.sha2(F.concat_ws("", F.transform(F.reverse(path), lambda s: F.concat(s["l"], s["r"]))).cast("binary"), 256)


def folded(shown: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(F.reverse(path), shown, lambda below, s: digest(s["l"], below, s["r"]))


@dataclass
class Manifest:
    """``leaves(_tree, _rank, _nodes, _digest, _row)``; the trees of the sources; the tree above them, whose ranks ``sources(_tree, _rank, _source)`` has."""

    leaves: DataFrame
    trees: Forest
    sources: DataFrame
    top: Forest

    def prove(self, requests: DataFrame) -> DataFrame:
        """``requests(_tree, _rank, ...)``, ranks from 0 in a source's tree, with ``_digest`` (the leaf), ``_path``, ``_subroot`` and ``_root``."""
        start = self.top.roots().select("_tree", "_height", "_digest", F.expr("cast(array() AS array<struct<l string, r string>>)").alias("_path"), F.col("_digest").alias("_root"))
        tops = descended(self.top, start, self.sources).select(F.col("_source").alias("_tree"), "_path", "_root")
        starts = self.trees.roots().withColumn("_subroot", F.col("_digest")).join(tops, "_tree")
        return descended(self.trees, written(starts, "merkle-starts"), requests)


def manifest(docs: DataFrame, *carried: Column) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text); ``_row`` holds ``carried``.

    Rows of null source have a tree of their own, the first; others follow in the
    order of their UTF-8 bytes. Null ids come first in a tree; rows of equal id
    follow in the order of their leaves, and rows that repeat every field are
    leaves of equal digest, each with a place and a proof of its own. A source of
    one row has that leaf as its subroot. An empty table has no root. Columns
    other than the five change nothing.
    """
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), "source"))
    rows = docs.select(key.alias("_tree"), leaf(*[F.col(c) for c in FIELDS]).alias("_digest"), F.col("doc_id").cast("long").alias("_id"), F.struct(F.lit(0), *carried).alias("_row"))
    leaves = ranked(rows, "_tree", ["_id", "_digest"], "merkle-leaves").drop("_id")
    trees = grown(leaves.drop("_row"))
    roots = written(trees.roots(), "merkle-roots").withColumnsRenamed({"_tree": "_source"}).withColumn("_tree", F.lit(""))
    tops = ranked(roots, "_tree", ["_source"], "merkle-sources")
    return Manifest(leaves, trees, tops.select("_tree", "_rank", "_source"), grown(tops.select("_tree", "_rank", "_nodes", "_digest")))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a copy, tampered in a fifth of the rows, passes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    shown = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = manifest(docs, F.col("doc_id"), F.when(chosen, leaf(*shown)).alias("shown"))
    found = made.prove(made.leaves.select("_tree", "_rank", "_row"))
    found = found.withColumn("_folded", folded(F.coalesce("_row.shown", "_digest"), F.col("_path")))
    return found.select("_row.doc_id", F.col("_digest").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), proof(F.col("_path")).alias("proof_sha256"), F.col("_folded").alias("folded_root"), (F.col("_folded") == F.col("_root")).alias("verified"))
