"""Selection by ranges of values, and exact splice sites against the intron by intron way."""

import random

import pytest
from pyspark.sql import functions as F

from isoloom.operators import details, filtering, novelty
from isoloom.functions import cigar as cg


@pytest.mark.parametrize(("k", "most"), [(1, 5), (7, 1), (40, 10), (200, 3)])
def test_selection_equals_sorting(spark, k, most):
    rng = random.Random(k)
    rows = [("hot", rng.randrange(10**9)) for _ in range(1500)] + [("ties", 7)] * 300 + [("few", v) for v in range(9)] + [(None, rng.choice([1, 2, 10**12])) for _ in range(250)] + [("hot", None)] * 5
    got = details.kth_smallest(spark.createDataFrame(rows, "g string, v long").repartition(3), F.col("v"), k, ["g"], most)
    expected = {}
    for g in {r[0] for r in rows}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        if len(values) >= k:
            expected[g] = values[k - 1]
    assert {r["g"]: r["value"] for r in got.collect()} == expected


def test_selection_of_doubles(spark):
    rows = [(1, x / 7 - 20) for x in range(400)]
    got = details.kth_smallest(spark.createDataFrame(rows, "g int, v double"), F.col("v"), 123, ["g"], 2)
    assert [tuple(r) for r in got.collect()] == [(1, 122 / 7 - 20)]


def test_exact_sites_equal_the_pairwise_way(spark):
    rng, rows = random.Random(2), []
    for k in range(400):
        both = []
        for least in (2, 1):
            at, exons = rng.randrange(0, 200, 50), []
            for _ in range(rng.randint(least, 7)):
                exons.append((at, at + rng.choice([10, 30])))
                at += rng.choice([0, 50, 50, 100]) if k % 10 == 0 else rng.choice([50, 100])  # some have sites twice
            both.append(exons)
        rows.append((k, *both))
    pair = spark.createDataFrame(rows, "tx long, exons array<struct<start:int,end:int>>, r_exons array<struct<start:int,end:int>>")
    e, a = F.col("exons"), F.col("r_exons")
    names = ["iden_n", "iden_intron_n", "consecutive", "matched"]
    other = pair.where("size(r_exons) > 1").select("tx", *[x.alias(n) for n, x in zip(names, novelty._near_sites(e, a, 0), strict=True)])
    ours = novelty.junction_match(pair)
    assert sorted(map(str, ours.where("size(r_exons) > 1").select("tx", *names).collect())) == sorted(map(str, other.collect()))
    assert {(r["iden_n"], tuple(r["matched"])) for r in ours.where("size(r_exons) = 1").collect()} == {(0, ())}


def test_counts_come_with_the_filtering_pass(spark):
    rows = spark.createDataFrame([(0, "a", 0, 0, 0, 100, "33S67M", 0), (1, "b", 0, 0, 0, 100, "32S68M", 0), (2, "c", 4, 0, 0, 100, "100M", 0)], "ord long, qname string, flag int, tid int, pos int, l_qseq int, text string, nm int").withColumn("cigar", cg.parse(F.col("text")))
    kept, counts = filtering.counted(rows, filtering.confident)
    assert [tuple(r) for r in counts.collect()] == [(3, 1, 2)]
    assert [r["qname"] for r in kept.collect()] == ["b"]
