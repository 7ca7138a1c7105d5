from pyspark.sql import functions as F

from isoloom.functions import cigar as cg
from isoloom.operators import filtering
from isoloom.plans import commands
from isoloom.schema import FilterParams

COLUMNS = "ord long, qname string, flag int, tid int, pos int, l_qseq int, text string, nm int"


def aln(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("cigar", cg.parse(F.col("text")))


def test_coverage_boundary(spark):
    rows = aln(spark, [(0, "a", 0, 0, 0, 100, "33S67M", 0), (1, "b", 0, 0, 0, 100, "32S68M", 0), (2, "c", 4, 0, 0, 100, "100M", 0), (3, "d", 0, 0, 0, 100, "100M", 26), (4, "e", 0, 0, 0, 0, "*", None)])
    assert [r["qname"] for r in filtering.confident(rows).collect()] == ["b"]


def test_best_numbers_the_winner(spark):
    rows = aln(spark, [(0, "a", 0, 0, 0, 100, "100M", 10), (1, "a", 0, 0, 0, 150, "150M", 0), (2, "b", 0, 0, 0, 50, "50M", 0), (3, "c", 0, 0, 0, 50, "50M", 0), (4, "c", 0, 0, 9, 50, "50M", 0)])
    for params in (None, ["tid"]):
        got = commands.filter_alignments(rows, None, FilterParams(), params)
        assert sorted((r["qname"], r["second"]) for r in got.collect()) == [("a.path2", 90), ("b.path1", 0)]


def test_a_name_that_returns_is_a_new_run(spark):
    rows = aln(spark, [(0, "a", 0, 0, 0, 50, "50M", 0), (1, "b", 0, 0, 0, 50, "50M", 0), (2, "a", 0, 0, 0, 50, "50M", 0)])
    got = filtering.best(filtering.confident(rows), partition=["tid"])
    assert sorted(r["qname"] for r in got.collect()) == ["a.path1", "a.path1", "b.path1"]


def test_mask_meets_the_zero_based_start(spark):
    rows = aln(spark, [(0, "a", 0, 0, 100, 10, "10M", 0), (1, "b", 0, 0, 101, 10, "10M", 0), (2, "c", 0, 1, 100, 10, "10M", 0)])
    mask = spark.createDataFrame([(0, 50, 100)], "tid int, start int, end int")
    assert [r["qname"] for r in filtering.outside(rows, mask).orderBy("ord").collect()] == ["b", "c"]
    assert [r["qname"] for r in filtering.outside(rows, mask, strict=True).orderBy("ord").collect()] == ["a", "b", "c"]


def test_large_masks_take_the_binned_path(spark, monkeypatch):
    from isoloom.operators import intervals

    rows = aln(spark, [(k, f"r{k}", 0, k % 3, 37 * k, 10, "10M40N10M", 0) for k in range(400)])
    mask = spark.createDataFrame([(k % 3, 311 * k, 311 * k + 90) for k in range(40)], "tid int, start int, end int")
    near = sorted(r["qname"] for r in filtering.outside(rows, mask).collect())
    monkeypatch.setattr(intervals, "small", lambda *a: False)
    assert sorted(r["qname"] for r in filtering.outside(rows, mask).collect()) == near
