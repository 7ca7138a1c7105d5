"""Operator 3: exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text without its white space is cut where its own characters say so (after a fixed set of letter pairs, between
LEAST and MOST characters), so equal runs give equal chunks wherever they stand. A chunk's identifier is its 64-bit
hash once that is verified: no other chunk of the table shares it (least and greatest content under the hash are the
same). If any hash fails, SHA-256 digests take the place of all hashes. Documents are equal when their ordered lists
of identifiers are; only lists move then, never long texts.

Cases: null or empty text (or white space alone) is the empty list, and all such rows form one group; of equal texts
the one with the most code points stays, then the smallest doc_id (null last); of rows equal in both, every one is
marked kept; an empty table gives no row; further columns are ignored by ``mark`` and carried by ``keep_first``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import listed, written

LEAST, MOST = 200, 4000
#: Longest list of (doc_id, digest) that may be broadcast, about 10 MB.
BROADCAST_KEYS = 200_000
#: Deleted before comparison, [\x20\x09-\x0D].
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: A chunk ends after one of these: a letter of the first class, then one of the second.
CHUNK = f"(?s).{{{LEAST},{MOST}}}?(?<=[aeghknst][dfmopr])|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, code_points, text_sha256, chunks (content)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("code_points"), normalised(F.col("text")).alias("normal"))
    return base.select("doc_id", "code_points", F.sha2("normal", 256).alias("text_sha256"), F.regexp_extract_all("normal", F.lit(CHUNK), F.lit(0)).alias("chunks"))


def ambiguous(docs: DataFrame) -> DataFrame:
    """Hashes that stand for more than one chunk content."""
    chunk = recipes(docs).select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk")
    return chunk.groupBy("h").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("h")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, code_points, text_sha256, recipe: the ordered list of verified chunk identifiers."""
    verified = ambiguous(docs).isEmpty()
    ident = (lambda c: F.xxhash64(c)) if verified else (lambda c: F.sha2(c, 256))
    return recipes(docs).select("doc_id", "code_points", "text_sha256", F.transform("chunks", ident).alias("recipe"))


def mark(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each document."""
    rows = identified(docs)
    # nulls sort last among equals; the aggregate is combined before the shuffle, so a hot group stays small
    first = F.min(F.struct((-F.col("code_points")).alias("less"), F.col("doc_id").isNull().alias("absent"), "doc_id"))
    groups = rows.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("group_size"))
    # written, so that the join deals both sides anew and can split a hot group's documents
    groups = written(groups.select(F.col("recipe").alias("of"), F.col("first.doc_id").alias("keep_id"), "group_size"))
    return rows.join(groups, rows["recipe"] == groups["of"]).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay. Rows equal in text and doc_id are one row then.

    Only keys are listed: of rows that go, and of rows that come more than once. Up to BROADCAST_KEYS of them come to
    the texts; more are joined by a shuffle.
    """
    marks = written(mark(docs).select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"), "kept"))
    here = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    stays = here.join(listed(marks.where("NOT kept").select("_id", "_sha"), BROADCAST_KEYS), same, "left_anti")
    again = marks.where("kept").groupBy("_id", "_sha").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_sha")
    if not again.isEmpty():
        again = listed(again, BROADCAST_KEYS)
        once = here.join(again, same, "left_semi").dropDuplicates(["id", "sha"])
        stays = stays.join(again, same, "left_anti").unionByName(once)
    return stays.select("row.*")


#: The same rows in SQL; \x0B and \x0C by code, as SQL strings have no escapes.
ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS code_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
), s AS (SELECT doc_id, code_points, sha256(t) AS text_sha256 FROM n), w AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY code_points DESC, doc_id) AS keep_id FROM s
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
