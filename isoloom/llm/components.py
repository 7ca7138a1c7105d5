"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable), for all ids of ``edges`` (a, b: long).

    Every vertex hooks to its neighbour of least hash, if less than its own, and edges are contracted until none is
    left. Hash order instead of id order keeps the number of rounds logarithmic on long chains. Each round is a
    written table; a hub's edges are combined before the shuffle or split by the skew join.
    """
    left = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    ids = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = written(ids.select("id", F.col("id").alias("root")))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        hook = written(least.select("a", F.when(F.col("m") < F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("to")), F.col("m.to")).otherwise(F.col("a")).alias("to")))
        labels = written(labels.join(hook, labels["root"] == hook["a"], "left").select("id", F.coalesce("to", "root").alias("root")))
        one = left.join(hook.select("a", F.col("to").alias("x")), "a").select("x", "b")
        left = written(one.join(hook.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(least, "root").select("id", "component")
