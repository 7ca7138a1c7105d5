"""How often the shared steps shuffle, join and work out the same thing: what their time on large tables follows from."""

import pytest
from pyspark.sql import functions as F

from isoloom.operators import details, intervals, novelty, scans, transcripts
from isoloom.schema import JunctionParams


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_scan_shuffles_its_rows_once(spark, no_broadcast):
    df = spark.createDataFrame([(k, "f", k % 3, "x" * k) for k in range(50)], "ord long, file string, v int, more string")
    got = scans.numbered(df, "n", ["file"], 8)
    before = got._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x for x in before.splitlines()) <= 4  # the rows once; the sums of chunks by chunk, by file and by chunk again


def transcript(tx, start, gene="g"):
    exons = [(start + 100 * k, start + 100 * k + 9 + tx % 3) for k in range(3)]
    return (tx, tx % 2, tx // 2 % 2, start, exons[-1][1], exons, gene, gene)


TX = "tx long, tid int, is_rev int, start int, end int, exons array<struct<start:int,end:int>>, gene_id string, gene_name string"


@pytest.mark.parametrize("distance", [0, 1])
def test_short_support_of_reads_needs_no_join_of_pairs(spark, distance):
    tx = spark.createDataFrame([transcript(k, 1 + k // 8 * 150) for k in range(80)], TX)
    reads, anno = tx.where("tx % 3 = 0"), tx.where("tx % 3 <> 0")
    introns = tx.where("tx % 4 = 1").select("tid", "is_rev", (F.get("exons", F.lit(0))["end"] + 1).alias("start"), (F.get("exons", F.lit(1))["start"] - 1).alias("end"))
    by_pair = novelty.short_support(novelty.junction_match(novelty.pairs(reads, anno), distance), introns, distance)
    pair = novelty.junction_match(novelty.pairs(novelty.with_short(reads, introns, distance), anno), distance)
    by_read = novelty.short_support(pair, introns, distance)
    assert plan(by_read).count("Join") == plan(pair).count("Join")
    rows = [sorted((r["tx"], r["r_tx"], r["supported"]) for r in x.collect()) for x in (by_pair, by_read)]
    assert rows[0] == rows[1] and {r[2] for r in rows[0]} >= ({True, False} if distance else {False})


@pytest.mark.parametrize("distance", [0, 20])
def test_cells_of_a_pair_are_worked_out_once(spark, distance):
    tx = spark.createDataFrame([transcript(k, 1 + k // 8 * 150) for k in range(8)], TX)
    assert plan(novelty.junction_match(tx.withColumn("r_exons", F.col("exons")), distance)).count("flatten(") == 1


def test_fused_genes_do_not_depend_on_chunks(spark):
    rows = [(k, k % 2, k // 2 * 7 % 90, k // 2 * 7 % 90 + 5 + k % 11, 0, f"g{k}", "n") for k in range(200)]
    genes = spark.createDataFrame(rows, "ord long, tid int, start int, end int, is_rev int, gene_id string, gene_name string").repartition(5)
    got = [sorted(map(tuple, transcripts.fuse_genes(genes, chunk).collect())) for chunk in (1, 6, 1 << 20)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 4


def test_segments_join_chromosomes_by_broadcast(spark, no_broadcast):
    rows = [(k, 0, 2, k % 3, f"chr{k % 3}", 10 * k, [("M", 5), ("N", 20), ("M", 5 + k)], 1) for k in range(30)]
    aln = spark.createDataFrame(rows, "ord long, x int, flag int, tid int, chr string, pos int, cigar array<struct<op:string,len:int>>, nh int")
    got = details.segments(details.details(aln, JunctionParams(require_proper_pair=False)))
    assert got.count()
    assert intervals.union(got, ["tid"]).count()
