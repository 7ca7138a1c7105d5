"""Transcripts: assembly from annotation lines, from alignments, names, bounds, output order, GTF lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoloom.functions import cigar as cg
from isoloom.functions.attributes import coverage_score, gtf_line, tagged
from isoloom.operators.intervals import overlap_islands, run_sums
from isoloom.operators.scans import ORDER_CHUNK, carried
from isoloom.schema import UNMAPPED, ExonParams
from isoloom.storage import written


def carry_transcript(lines: DataFrame, partition: list[str] | None = None, chunk: int = ORDER_CHUNK) -> DataFrame:
    """Give each line the number of the latest transcript line up to it (order ``ord``), over the edges of splits.

    ``partition`` names columns (an input file) over which nothing is carried.
    """
    return carried(lines, {"tx": F.when(F.col("type") == "transcript", F.col("ord"))}, partition, chunk)


def assemble(lines: DataFrame, min_exons: int = 2, partition: list[str] | None = None, chunk: int = ORDER_CHUNK) -> DataFrame:
    """Transcripts of annotation lines (ord, chr, type, start, end, is_rev, gene_id, ...).

    Names are those of the last exon line. Transcripts with fewer than ``min_exons`` exons go, but the last of the
    input stays with one exon or more.
    """
    keys = partition or []
    used = carry_transcript(lines.where(F.col("type").isin("transcript", "exon")), keys, chunk).where("tx IS NOT NULL AND type = 'exon'")
    named = [F.max_by(c, "ord").alias(c) for c in ("chr", "is_rev", "gene_id", "gene_name", "transcript_id", "transcript_name")]
    one = used.groupBy(*keys, "tx").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"), *named)
    last = one.agg(F.max("tx").alias("last"))
    return with_bounds(one.crossJoin(F.broadcast(last)).where((F.size("exons") >= min_exons) | (F.col("tx") == F.col("last"))).drop("last"))


def with_bounds(tx: DataFrame) -> DataFrame:
    """start and end from the first and last exon."""
    return tx.withColumns({"start": F.element_at("exons", 1)["start"], "end": F.element_at("exons", -1)["end"]})


def from_alignments(aln: DataFrame, params: ExonParams = ExonParams()) -> DataFrame:
    """A transcript for each mapped alignment, named by its read; no shuffle."""
    rows = aln.where(F.col("flag").bitwiseAND(UNMAPPED) == 0)
    tx = rows.select(F.col("ord").alias("tx"), "tid", "chr", cg.strand(F.col("xs"), F.col("flag")).alias("is_rev"), F.array_sort(cg.exons(F.col("cigar"), F.col("pos"), params.min_exon, params.min_intron)).alias("exons"), F.col("qname").alias("transcript_id"))
    return with_bounds(tx).withColumns({c: F.lit(None).cast("string") for c in ("gene_id", "gene_name", "transcript_name")})


def gene_bounds(tx: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Least start and greatest end of a gene's transcripts."""
    return tx.groupBy(gene).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_transcripts"))


def fuse_genes(genes: DataFrame, chunk: int = ORDER_CHUNK) -> DataFrame:
    """Genes (ord, tid, start, end, is_rev, name) that overlap in file order become one, with the first one's names.

    Those of a chunk are summed up where they stand, so only sums meet over the edges of chunks.
    """
    first = F.min_by(F.struct("is_rev", "gene_id", "gene_name"), "ord").alias("_first")
    sums = run_sums(genes, ["tid"], ["ord"], False, [F.min("ord").alias("ord"), first, F.count("*").alias("n_genes")], F.floor(F.col("ord") / chunk))
    whole = sums.groupBy("tid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("_first", "ord").alias("_first"), F.sum("n_genes").alias("n_genes"))
    return whole.select("tid", "start", "end", "_first.is_rev", "_first.gene_id", "_first.gene_name", "n_genes").orderBy("tid", "start", "end")


def gene_groups(lines: DataFrame, partition: list[str] | None = None, chunk: int = ORDER_CHUNK) -> DataFrame:
    """Genes of annotation lines (ord, tid, chr, type, start, end, is_rev, names) with their transcripts and exons.

    A transcript belongs to the gene line before it, an exon to the transcript line before it; genes that overlap in
    file order are one, with the names and strand of the first. One row a gene: tid, chr, is_rev, start, end, gene_id,
    gene_name, transcripts (ord, is_rev, start, end, names, exons in the direction of transcription), by tid, start,
    end. ``partition`` as in ``carry_transcript``.
    """
    keys = partition or []
    used = written(lines.where(F.col("type").isin("gene", "transcript", "exon")))  # four passes read them
    of = lambda kind: F.when(F.col("type") == kind, F.col("ord"))
    placed = carried(used, {"_gene": of("gene"), "_tx": of("transcript")}, keys, chunk).where("type <> 'gene' AND _tx IS NOT NULL")
    # a transcript line carries its own number, so it meets its exons in one grouping
    head = F.first(F.when(F.col("type") == "transcript", F.struct("_gene", "ord", "is_rev", "start", "end", "transcript_id", "transcript_name")), ignorenulls=True).alias("_t")
    tx = placed.groupBy("_tx").agg(head, F.sort_array(F.collect_list(F.when(F.col("type") == "exon", F.struct("ord", "start", "end")))).alias("_e")).where("_t._gene IS NOT NULL")
    spans = F.transform("_e", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))
    spans = F.when(F.size("_e") > 0, F.when(F.col("_t.is_rev") == 1, F.reverse(spans)).otherwise(spans))
    one = F.struct(*[F.col(f"_t.{c}").alias(c) for c in ("ord", "is_rev", "start", "end", "transcript_id", "transcript_name")], spans.alias("exons"))
    owned = tx.select(F.col("_t._gene").alias("_gene"), one.alias("t")).groupBy("_gene").agg(F.collect_list("t").alias("_own"))
    genes = overlap_islands(used.where("type = 'gene'"), ["tid"], ["ord"], touch=False, chunk=F.floor(F.col("ord") / chunk))
    first = F.min_by(F.struct("chr", "is_rev", "gene_id", "gene_name"), "ord").alias("_first")
    fused = genes.join(owned, F.col("ord") == F.col("_gene"), "left").groupBy("tid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first, F.sort_array(F.flatten(F.collect_list("_own"))).alias("transcripts"))
    return fused.select("tid", "start", "end", "_first.chr", "_first.is_rev", "_first.gene_id", "_first.gene_name", "transcripts").orderBy("tid", "start", "end")


def strand_order(exons: Column, is_rev: Column) -> Column:
    """Exons in the direction of transcription."""
    return F.when(is_rev == 1, F.reverse(F.array_sort(exons))).otherwise(F.array_sort(exons))


def chromosome_ids(lines: DataFrame) -> DataFrame:
    """chr, tid: numbered by first appearance. One row a chromosome goes through the ordering task."""
    first = lines.groupBy("chr").agg(F.min("ord").alias("ord"))
    return first.select("chr", (F.row_number().over(Window.orderBy("ord")) - 1).alias("tid"))


def sort_lines(lines: DataFrame, partition: list[str] | None = None, chunk: int = ORDER_CHUNK) -> DataFrame:
    """Transcript and exon lines by chromosome, start and end of their transcript, then file order.

    chr1 to chr22, X, Y and M come first; further names follow in order of their first transcript line.
    """
    used = lines.where(~F.col("value").startswith("#") & (F.col("type").contains("transcript") | (F.col("type") == "exon")))
    is_tx = F.col("type") == "transcript"
    known = F.when(F.col("chr").rlike("^chr([1-9]|1[0-9]|2[0-2])$"), F.substring("chr", 4, 2).cast("int")).when(F.col("chr") == "chrX", 23).when(F.col("chr") == "chrY", 24).when(F.col("chr") == "chrM", 25)
    other = used.where(is_tx).withColumn("k", known).where("k IS NULL").groupBy("chr").agg(F.min("ord").alias("o"))
    rank = other.select(F.col("chr").alias("_chr"), (25 + F.row_number().over(Window.orderBy("o"))).alias("_rank"))
    named = carried(used, {f"tx_{c}": F.when(is_tx, F.col(c)) for c in ("chr", "start", "end")}, partition, chunk)
    joined = named.join(F.broadcast(rank), F.col("tx_chr") == F.col("_chr"), "left")  # one row a chromosome
    tx_known = F.when(F.col("tx_chr").rlike("^chr([1-9]|1[0-9]|2[0-2])$"), F.substring("tx_chr", 4, 2).cast("int")).when(F.col("tx_chr") == "chrX", 23).when(F.col("tx_chr") == "chrY", 24).when(F.col("tx_chr") == "chrM", 25)
    return joined.withColumn("rank", F.coalesce(tx_known, F.col("_rank"), F.lit(0))).orderBy("rank", F.coalesce("tx_start", F.lit(0)), F.coalesce("tx_end", F.lit(0)), "ord").select("ord", "rank", "tx_start", "tx_end", "value")


def read_lines(tx: DataFrame, source: str) -> DataFrame:
    """GTF lines of read transcripts: the transcript, then its exons ascending."""
    names = tagged([("gene_id", F.lit("UNCLASSIFIED")), ("transcript_id", F.col("transcript_id"))])
    dot, src = F.lit("."), F.lit(source)
    head = gtf_line(F.col("chr"), src, "transcript", F.col("start"), F.col("end"), dot, F.col("is_rev"), names)
    exon = lambda e: gtf_line(F.col("chr"), src, "exon", e["start"], e["end"], dot, F.col("is_rev"), names)
    return tx.select("tx", F.posexplode(F.concat(F.array(head), F.transform(F.array_sort("exons"), exon))).alias("k", "value"))


def novel_lines(tx: DataFrame, source: str) -> DataFrame:
    """GTF lines of novel transcripts (cov): names that are empty are left out, '-' exons descend, exons carry a score."""
    names = tagged([(c, F.col(c)) for c in ("gene_id", "transcript_id", "gene_name", "transcript_name")])
    src = F.lit(source)
    head = gtf_line(F.col("chr"), src, "transcript", F.col("start"), F.col("end"), F.lit("."), F.col("is_rev"), names)
    exon = lambda e: gtf_line(F.col("chr"), src, "exon", e["start"], e["end"], coverage_score(F.col("cov")), F.col("is_rev"), names)
    return tx.select("tx", F.posexplode(F.concat(F.array(head), F.transform(strand_order(F.col("exons"), F.col("is_rev")), exon))).alias("k", "value"))


def gene_lines(genes: DataFrame, tx: DataFrame, source: str) -> DataFrame:
    """GTF lines of genes (gene, chr, ...) with their transcripts and exons; exons have score 0."""
    src, names = F.lit(source), tagged([("gene_id", F.col("gene_id")), ("gene_name", F.col("gene_name"))])
    top = genes.select("gene", F.lit(-1).cast("long").alias("tx"), F.lit(0).alias("k"), gtf_line(F.col("chr"), src, "gene", F.col("start"), F.col("end"), F.lit("."), F.col("is_rev"), names).alias("value"))
    both = tx.select("gene", "tx", "exons", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "transcript_id", "transcript_name").join(genes.select("gene", "chr", "is_rev", "gene_id", "gene_name"), "gene")
    full = tagged([("gene_id", F.col("gene_id")), ("transcript_id", F.col("transcript_id")), ("gene_name", F.col("gene_name")), ("transcript_name", F.col("transcript_name"))])
    head = gtf_line(F.col("chr"), src, "transcript", F.col("t_start"), F.col("t_end"), F.lit("."), F.col("is_rev"), full)
    exon = lambda e: gtf_line(F.col("chr"), src, "exon", e["start"], e["end"], F.lit(0), F.col("is_rev"), full)
    rest = both.select("gene", "tx", F.posexplode(F.concat(F.array(head), F.transform(strand_order(F.col("exons"), F.col("is_rev")), exon))).alias("k", "value"))
    return top.unionByName(rest.withColumn("k", F.col("k") + 1))
