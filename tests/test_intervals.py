"""Interval joins with deep bins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from isoloom.operators import intervals

L = "id long, tid int, start int, end int"
R = "r_id long, r_tid int, r_start int, r_end int"


def hot(rng, n, width):
    """Intervals of which a third lie in one bin; some are long, empty (end before start), null or equal."""
    out = []
    for k in range(n):
        at = rng.randrange(width) if k % 3 == 0 else rng.randrange(20 * width)
        out.append((k, rng.choice([0, 0, 1]), at, at + rng.choice([-1, 0, 5, width, 3 * width])))
    return [*out, (n, None, 1, 5), (n + 1, 0, None, 5), out[0]]


@pytest.mark.parametrize("deep", [2, 20, 50_000])
def test_deep_bins_lose_and_double_nothing(spark, deep):
    rng = random.Random(deep)
    a, b = hot(rng, 240, 100), hot(rng, 150, 100)
    got = intervals.band_join(spark.createDataFrame(a, L), spark.createDataFrame(b, R), ["tid"], "start", "end", "r_start", "r_end", 100, deep)
    assert got.columns == ["id", "tid", "start", "end", "r_id", "r_tid", "r_start", "r_end"]
    meet = lambda x, y: None not in (*x, *y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]
    assert sorted((r["id"], r["r_id"]) for r in got.collect()) == sorted((x[0], y[0]) for x in a for y in b if meet(x, y))
    mask = spark.createDataFrame([r[1:] for r in b], "m_tid int, m_start int, m_end int")
    kept = intervals.overlap_anti(spark.createDataFrame(a, L), mask, "start", "end", 100, 0, deep)
    hit = lambda x, y: None not in (*x, *y) and x[1] == y[1] and y[2] <= x[3] and y[3] >= x[2] and x[2] // 100 <= max(x[3] // 100, x[2] // 100)
    assert sorted(r["id"] for r in kept.collect()) == sorted(x[0] for x in a if not any(hit(x, y) for y in b))


def test_a_bin_of_a_third_of_all_rows_is_many_tasks(spark):
    left = spark.range(30_000).select("id", F.lit(0).alias("tid"), F.when(F.col("id") % 3 == 0, F.col("id") % 100).otherwise(F.col("id") * 200).cast("int").alias("start"))
    left = left.withColumn("end", F.col("start") + 10)
    right = spark.createDataFrame([(k, 0, 10 * k, 10 * k + 3) for k in range(10)], R)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for deep, low, high in ((500, 12, 16), (50_000, 1, 1)):
            got = intervals.band_join(left, right, ["tid"], "start", "end", "r_start", "r_end", deep=deep)
            tasks = [r["count"] for r in got.where("start < 100").groupBy(F.spark_partition_id()).count().collect()]
            assert low <= len(tasks) <= high and (deep > 500 or max(tasks) < sum(tasks) / 3)
            n = got.count() if deep == 500 else n
            assert got.count() == n
    finally:
        for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "10485760", "spark.sql.shuffle.partitions": "4"}.items():
            spark.conf.set(k, v)


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, 0, 1, 5)], L)
    assert intervals.band_join(some, spark.createDataFrame([], R), ["tid"], "start", "end", "r_start", "r_end").count() == 0
    assert intervals.band_join(some.limit(0), spark.createDataFrame([(1, 0, 1, 5)], R), ["tid"], "start", "end", "r_start", "r_end").count() == 0
