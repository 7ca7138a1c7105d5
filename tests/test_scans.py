"""Ordered scans in chunks against a walk row by row."""

import random

import pytest
from pyspark.sql import functions as F

from isoloom.operators import filtering, scans, transcripts


def walked(rows):
    """(ord, start of the run, last a, last b, number) for each file."""
    out = []
    for file in {r[0] for r in rows}:
        begin = a = b = None
        before, n = object(), 0
        for _, ord_, name, x, y in sorted((r for r in rows if r[0] == file), key=lambda r: r[1]):
            if name != before:
                begin, before = ord_, name
            a, b = x if x is not None else a, y if y is not None else b
            out.append((file, ord_, begin, a, b, n))
            n += 1
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1), (2, 3), (3, 10), (4, 1 << 20)])
def test_scans_over_chunk_edges(spark, seed, chunk):
    rng, rows, ord_ = random.Random(seed), [], 0
    for file in ("f1", "f2", None):
        for _ in range(120):
            ord_ += rng.choice([1, 1, 2, 25])
            rows.append((file, ord_, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, None, ord_]), rng.choice([None, "x", "y"])))
    df = spark.createDataFrame(rows, "file string, ord long, name string, x long, y string").repartition(5)
    got = scans.runs(df, "name", "run", ["file"], chunk)
    got = scans.carried(got, {"a": F.col("x"), "b": F.col("y")}, ["file"], chunk)
    got = scans.numbered(got, "n", ["file"], chunk)
    assert sorted(((r["file"], r["ord"], r["run"], r["a"], r["b"], r["n"]) for r in got.collect()), key=str) == walked(rows)


def test_runs_without_a_partition(spark):
    df = spark.createDataFrame([(k, "abc"[k // 7 % 3]) for k in range(100)], "ord long, name string")
    assert all(r["run"] == r["ord"] // 7 * 7 for r in scans.runs(df, "name", "run", chunk=4).collect())


def test_no_window_by_file_alone(spark):
    """A file is more than one task: what windows and groups are dealt by has the chunk, but for sums of whole chunks."""
    aln = spark.createDataFrame([(k, "f", f"r{k // 2}", 5 + k % 2, 1) for k in range(50)], "ord long, file string, qname string, score int, introns int")
    plan = filtering.best(aln, partition=["file"], chunk=8)._jdf.queryExecution().optimizedPlan().toString()
    rows = [x for x in plan.splitlines() if "Window" in x and "_chunk" not in x and "island" not in x]
    assert not rows


def test_carry_over_chunks(spark):
    kinds = ["exon", "transcript", "exon", "exon", "exon", "transcript", "exon"]
    df = spark.createDataFrame(list(enumerate(kinds)), "ord long, type string")
    got = {r["ord"]: r["tx"] for r in transcripts.carry_transcript(df, chunk=2).collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
