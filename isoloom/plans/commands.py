"""The commands as plans: filter, transcripts, novel, junctions, sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.functions import cigar as cg
from isoloom.operators import filtering, junctions, merging, novelty, transcripts
from isoloom.operators.scans import ORDER_CHUNK
from isoloom.schema import ExonParams, FilterParams, JunctionParams, UpdateParams


def filter_alignments(aln: DataFrame, mask: DataFrame | None = None, params: FilterParams = FilterParams(), partition: list[str] | None = None) -> DataFrame:
    """The confident, unambiguous best alignment of each read, renamed to name.path<n>."""
    return unambiguous(filtering.confident(aln, params), mask, params, partition)


def unambiguous(rows: DataFrame, mask: DataFrame | None = None, params: FilterParams = FilterParams(), partition: list[str] | None = None) -> DataFrame:
    """As ``filter_alignments`` for confident alignments."""
    if mask is not None:
        rows = filtering.outside(rows, mask, params.strict_coords)
    return filtering.best(rows, params, partition) if partition else filtering.best_of_names(rows, params)


def transcript_lines(aln: DataFrame, params: ExonParams = ExonParams(), source: str = "NONE") -> DataFrame:
    """GTF lines of every mapped alignment."""
    return transcripts.read_lines(transcripts.from_alignments(aln, params), source)


def junction_table(aln: DataFrame, genome: DataFrame | None = None, params: JunctionParams = JunctionParams()) -> DataFrame:
    """The junction table."""
    return junctions.table(aln, genome, params)


def with_anchors(aln: DataFrame, least: int, min_intron: int = 3) -> DataFrame:
    """Alignments without a junction, or whose first and last block are ``least`` long."""
    blocks = aln.withColumn("_blocks", cg.exons(F.col("cigar"), F.col("pos"), 0, min_intron))
    long = lambda k: F.element_at("_blocks", k)["end"] - F.element_at("_blocks", k)["start"] + 1 >= least
    return blocks.where((F.size("_blocks") < 2) | (long(1) & long(-1))).drop("_blocks")


def novel_transcripts(reads: DataFrame, anno: DataFrame, params: UpdateParams = UpdateParams(), introns: DataFrame | None = None) -> DataFrame:
    """Novel transcripts with coverage, merged."""
    kept = merging.merge(novelty.classify(reads, anno, params, introns), params)
    return novelty.name_unclassified(kept) if params.keep_unclassified else kept


def novel_lines(reads: DataFrame, anno: DataFrame, params: UpdateParams = UpdateParams(), introns: DataFrame | None = None) -> DataFrame:
    """GTF lines of novel transcripts."""
    return transcripts.novel_lines(novel_transcripts(reads, anno, params, introns), params.source)


def sorted_lines(lines: DataFrame, partition: list[str] | None = None, chunk: int = ORDER_CHUNK) -> DataFrame:
    return transcripts.sort_lines(lines, partition, chunk)
