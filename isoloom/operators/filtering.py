"""Alignment filter: weak alignments go, the unambiguous best one of each read stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from isoloom.functions import cigar as cg
from isoloom.functions.attributes import path_name
from isoloom.operators.intervals import BROADCAST_ROWS, overlap_anti
from isoloom.operators.scans import ORDER_CHUNK, runs
from isoloom.schema import UNMAPPED, FilterParams
from isoloom.storage import written


def scored(aln: DataFrame) -> DataFrame:
    """Add qlen (aligned query length), score and introns (all N operations)."""
    c, l_qseq = F.col("cigar"), F.col("l_qseq")
    return aln.withColumns({"qlen": cg.aligned_query_length(c, l_qseq), "score": cg.score(c, l_qseq, F.col("nm")), "introns": cg.count_ops(c, "N")})


def confident(aln: DataFrame, params: FilterParams = FilterParams()) -> DataFrame:
    """Mapped alignments with enough of the query aligned and enough identity; thresholds compare in float32."""
    limit = F.lit(params.coverage).cast("float").cast("double")
    rows = scored(aln.where((F.col("flag").bitwiseAND(UNMAPPED) == 0) & (F.size("cigar") > 0) & (F.col("l_qseq") > 0)))
    rows = rows.where(F.col("qlen").cast("double") / F.col("l_qseq") >= limit)
    return rows.where(F.col("score").cast("float") >= F.lit(params.identity).cast("float") * F.col("qlen").cast("float"))


def outside(aln: DataFrame, mask: DataFrame, strict: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Alignments that overlap no transcript of ``mask`` (tid, start, end), such as ribosomal RNA."""
    shift = 1 if strict else 0
    spans = aln.withColumns({"_from": F.col("pos") + shift, "_to": F.col("pos") + shift + cg.reference_length(F.col("cigar")) - 1})
    other = mask.select(F.col("tid").alias("m_tid"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    return overlap_anti(spans, other, "_from", "_to", rows=broadcast_rows).drop("_from", "_to")


def best(rows: DataFrame, params: FilterParams = FilterParams(), partition: list[str] | None = None, chunk: int = ORDER_CHUNK) -> DataFrame:
    """The best alignment of each run of equal names, if the second stays clearly below.

    Runs follow ``ord``, over the edges of splits and chunks; those of ``partition`` (an input file) are apart.
    """
    return _kept(runs(rows, "qname", "island", partition, chunk), [*(partition or []), "island"], params)


def _kept(rows: DataFrame, run: list[str], params: FilterParams) -> DataFrame:
    """The best row of each run (the first of equals), numbered within it, where the second stays clearly below."""
    of = Window.partitionBy(*run)
    ranked = of.orderBy(F.desc("score"), "ord")
    placed = rows.withColumns({"path": F.row_number().over(of.orderBy("ord")), "rank": F.row_number().over(ranked), "second": F.greatest(F.coalesce(F.lead("score").over(ranked), F.lit(0)), F.lit(0))})
    ratio = F.lit(params.second_ratio).cast("float")
    kept = placed.where((F.col("rank") == 1) & (F.col("second").cast("float") < ratio * F.col("score").cast("float")) & (F.col("introns") >= params.min_introns))
    return kept.withColumn("qname", path_name(F.col("qname"), F.col("path"))).drop("rank", "path")


def best_of_names(rows: DataFrame, params: FilterParams = FilterParams()) -> DataFrame:
    """As ``best`` where a name has one run in the whole input: grouped by name, so it scales with the reads."""
    return _kept(rows.withColumn("island", F.min("ord").over(Window.partitionBy("qname"))), ["qname"], params)


def counted(aln: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What ``keep`` leaves of the alignments, written; and one row with how many there were, stayed and went.

    The alignments are counted in the pass that filters them. ``keep`` must not read them twice.
    """
    seen = Observation()
    kept = written(keep(aln.observe(seen, F.count("*").alias("n"))))
    n_in, n_out = seen.get["n"], kept.count()
    return kept, aln.sparkSession.createDataFrame([(n_in, n_out, n_in - n_out)], "n_in long, n_out long, filtered long")
