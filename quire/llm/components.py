"""Connected components of links between ids, by alternating large and small stars, as joins and aggregates.

Each round hangs every node's neighbours on the smallest of them (Kiveris et al., 2014), so long chains become short and
in the end every node hangs on its component's smallest id. Links are never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    return moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not nodes.filter("hangs > 1 or (hangs = 1 and holds = 1)").take(1)


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """(node, label) of every node that has a link in (a, b): label is the smallest id of its component."""
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most):
        if _settled(now):
            break
        now = written(_small(_large(now)), "stars")
    else:
        raise RuntimeError(f"components are not settled after {most} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: only the components that these join are worked on."""
    if labels is None:
        return written(components(links), "labels")
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    new = components(between)
    moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(moved.unionByName(new.join(labels, "node", "left_anti")), "labels")
