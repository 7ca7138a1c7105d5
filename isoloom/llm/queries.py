"""The corpus queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.llm import align, decontaminate, exact_dedup, language_id, licenses, line_dedup, lm_scoring, merkle, mixing, near_dedup, packing, secrets, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: source, language and groups of 64 ids stand for directories."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.floor(F.col("doc_id") / 64).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.hits(docs, _table(spark, sf_dir, "benchmark"), carry=["doc_id"]).select("doc_id", "hit.n_words", "hit.n_hit", "hit.n_items", "hit.items_sha256", "hit.contaminated")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.mark(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    named = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return named.select("doc_id", language_id.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_licenses": op2_licenses,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secrets": op4_secrets,
    "op5_decontamination": op5_decontamination,
    "op6_near_dedup": op6_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_files": op10_token_files,
    "op11_merkle": op11_merkle,
    "op12_align": op12_align,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": exact_dedup.ORACLE, "op5_decontamination": decontaminate.ORACLE, "op6_near_dedup": near_dedup.ORACLE, "op11_merkle": merkle.oracle()}
