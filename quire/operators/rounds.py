"""Tables between the rounds of an iteration: written, so that plans don't grow from round to round and lost executors undo nothing."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """The same rows, read back from a table in the folder of spark.checkpoint.dir; a local session without one gets its own."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("quire.rounds.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="quire-rounds-")).as_uri()
        spark.conf.set("quire.rounds.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_once(spark: SparkSession) -> SparkSession:
    """A session like this one, with its settings as they are now, where rows that are dealt out by a document's id meet on more keys without being
    dealt out again: by default Spark shuffles both sides of a join whose keys are more than those they are dealt out by."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def components(links: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """(keys, node, label) of all nodes that links (keys, a, b) name: within equal keys, label is the smallest node that links reach.

    Every node hangs on a smaller one, its neighbours with it (large and small stars in turn), until each hangs on one
    that hangs on none: some log2 of the longest chain rounds.
    """
    ab = lambda a, b: (F.col(a).alias("a"), F.col(b).alias("b"))
    now = settled(links.filter("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most):
        ends = now.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
        if not ends.groupBy(*keys, "e.node").agg(F.sum("e.up").alias("n"), F.min("e.up").alias("low")).filter("n > 1 or (n = 1 and low = 0)").take(1):
            break
        both = now.unionByName(now.select(*keys, *ab("b", "a")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, [*keys, "a"]).select(*keys, *ab("b", "m"))
        down = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(down, [*keys, "a"]).filter("b <> m").select(*keys, *ab("b", "m")).unionByName(down.select(*keys, *ab("a", "m")))
        now = settled(small.distinct())
    else:
        raise RuntimeError(f"components are not settled after {most} rounds")
    roots = now.select(*keys, F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
