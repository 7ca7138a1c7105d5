"""Bounded samples: every kind, equal rows, long texts."""

import pytest

pytest.importorskip("isoloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from isoloom.llm import language_id, secrets  # noqa: E402
from isoloom.llm.common import ranked_sample  # noqa: E402


def test_few_long_texts(spark):
    rows = spark.createDataFrame([("fr", k, "x" * 100_000 + str(k)) for k in range(3)] + [("en", k, f"text {k}") for k in range(2000)], "kind string, doc_id long, text string")
    got = ranked_sample(rows, 3000)
    assert len(got["fr"]) == 1 and 2900 < sum(map(len, got["en"])) <= 3000
    assert ranked_sample(rows, 10**9).keys() == got.keys() and len(ranked_sample(rows, 10**9)["en"]) == 2000
    assert ranked_sample(rows.limit(0), 10) == {}
    assert ranked_sample(spark.createDataFrame([("a", 1, None), (None, 1, "x")], rows.schema), 10) in ({None: ["x"]}, {})


def test_equal_rows_reach_the_driver_once(spark):
    same = spark.range(100_000).select(F.lit("en").alias("kind"), F.lit(5).cast("long").alias("doc_id"), F.lit("the same text " * 20).alias("text"))
    other = spark.range(50).select(F.lit("en").alias("kind"), F.col("id").alias("doc_id"), F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"))
    got = ranked_sample(same.unionByName(other), 2000)["en"]
    assert len(got) == len(set(got)) == 51


def test_many_labels(spark):
    rows = spark.range(12_000).select("id", (F.col("id") % 3000).cast("string").alias("lang"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    docs = rows.select(F.col("id").alias("doc_id"), "lang", "text")
    got = language_id.sample(docs, 100, 3000 * 20)
    assert {t for t in got} == {r["lang"] for r in docs.where(~language_id.held_out(F.col("doc_id"), 5, 0)).select("lang").distinct().collect()}
    assert all(sum(map(len, t)) <= 20 for t in got.values())


def test_rejects_what_is_no_language(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = [(-1, "7f3a9c0e55d1b2c4a8e6f00192837465" * 8), (-2, "}{$%&/()=?#*+~<>|0918237465xq" * 9)]
    both = rows.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(k, t, None) for k, t in junk], "doc_id long, text string, lang string"))
    kept = language_id.accepted(both, language_id.train(rows))
    assert kept.columns == both.columns
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not left & {-1, -2}
    with_text = rows.where("length(text) > 200").select("doc_id").collect()
    assert sum(r["doc_id"] in left for r in with_text) > 0.98 * len(with_text)


def test_one_sample_for_secrets(spark):
    rows = spark.createDataFrame([(k, "word " * 50 + str(k)) for k in range(40)], "doc_id long, text string")
    assert 1 <= len(secrets.sample(rows, 1000)) < 5 and len(secrets.sample(rows, 10)) == 1 and secrets.sample(rows.limit(0)) == []
