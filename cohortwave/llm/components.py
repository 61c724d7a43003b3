"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is one node of its component.

    Each round hooks every node to its least neighbour, follows the hooks two
    steps and contracts the links onto the nodes reached; links inside one node
    vanish, so the table shrinks at least by half its nodes a round. Every
    table is written to the shared folder: lineage stays short, each join reads
    both its sides straight from a shuffle, and skewed joins can be split.

    Links that join a node to itself and repeated links do no harm. An empty
    table gives an empty result.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    roots = written(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    for _ in range(max_rounds):
        if links.isEmpty():
            release(links)
            return roots
        both = links.union(links.select("b", "a"))
        hooks = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("up")), "hooks")
        for _ in range(2):
            step = hooks.select(F.col("n").alias("up"), F.col("up").alias("up2"))
            last, hooks = hooks, written(hooks.join(step, "up").select("n", F.col("up2").alias("up")), "hooks")
            release(last)
        last, links = links, written(
            links.join(hooks.select(F.col("n").alias("a"), F.col("up").alias("ua")), "a")
            .join(hooks.select(F.col("n").alias("b"), F.col("up").alias("ub")), "b")
            .where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct(),
            "links",
        )
        release(last)
        up = hooks.select(F.col("n").alias("root"), "up")
        last, roots = roots, written(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        release(last, hooks)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
