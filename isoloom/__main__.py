"""Command line: python -m isoloom filter | transcripts | novel | junctions | sort."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.operators import filtering, junctions, transcripts
from isoloom.plans import commands
from isoloom.schema import ExonParams, FilterParams, JunctionParams, UpdateParams
from isoloom.sources import bam, sinks, text
from isoloom.storage import written


def alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and header of a SAM or BAM file, by its name."""
    if path.endswith(".bam"):
        spark.dataSource.register(bam.BamSource)
        return spark.read.format("bam").load(path), bam.header(spark, path)
    return text.sam(spark, path), text.sam_header(spark, path)


def five(text: str) -> list[int]:
    """Five numbers of a limit by class of junction."""
    values = [int(x) for x in text.split(",")]
    if len(values) != 5:
        raise argparse.ArgumentTypeError("five numbers are needed")
    return values


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="isoloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("filter", help="keep the confident, unambiguous best alignment of each read")
    p.add_argument("alignments")
    p.add_argument("rrna", help="annotation of transcripts to mask")
    p.add_argument("out")
    p.add_argument("-v", "--coverage", type=float, default=0.67)
    p.add_argument("-q", "--map-quality", type=float, default=0.75)
    p.add_argument("-s", "--sec-rat", type=float, default=0.98)
    p.add_argument("-i", "--introns", type=int, default=0)
    p = sub.add_parser("transcripts", help="alignments as annotation lines")
    p.add_argument("alignments")
    p.add_argument("out")
    p.add_argument("-e", "--min-exon", type=int, default=3)
    p.add_argument("-i", "--min-intron", type=int, default=3)
    p.add_argument("-s", "--source", default="NONE")
    p = sub.add_parser("novel", help="novel transcripts of reads against an annotation")
    p.add_argument("reads", help="SAM, BAM or GTF")
    p.add_argument("annotation")
    p.add_argument("-m", "--mode", choices=["b", "g"], default="b", help="reads are alignments (b) or annotation lines (g)")
    p.add_argument("-b", "--header", help="SAM or BAM whose header names the chromosomes, if reads are annotation lines")
    p.add_argument("-I", "--introns", help="short-read junctions")
    p.add_argument("-e", "--min-exon", type=int, default=3)
    p.add_argument("-i", "--min-intron", type=int, default=3)
    p.add_argument("-d", "--distance", type=int, default=0)
    p.add_argument("-l", "--full-level", type=int, choices=range(1, 6), default=5)
    p.add_argument("-u", "--unclassified", action="store_true")
    p.add_argument("-s", "--source", default="isoloom")
    p.add_argument("-o", "--out", required=True)
    p = sub.add_parser("junctions", help="junction table of alignments")
    p.add_argument("alignments")
    p.add_argument("out")
    p.add_argument("-g", "--genome")
    p.add_argument("-i", "--min-intron", type=int, default=3)
    p.add_argument("-p", "--single-end", action="store_true", help="keep reads that are not proper pairs")
    limits = "five numbers, by commas: annotated, non-canonical, GT/AG, GC/AG, AT/AC"
    p.add_argument("-U", "--least-unique", type=five, help=f"least unique reads of a junction: {limits}")
    p.add_argument("-A", "--least-all", type=five, help=f"least reads of a junction: {limits}")
    p.add_argument("-a", "--anchor", type=five, help=f"least first and last block of a spliced read, the first of five: {limits}")
    p = sub.add_parser("sort", help="sort annotation lines by transcript")
    p.add_argument("gtf")
    p.add_argument("out")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("isoloom").getOrCreate()
    if a.command == "sort":
        sinks.write_gtf(commands.sorted_lines(text.gtf(spark, a.gtf), ["file"]), a.out)
        return
    if a.command == "novel" and a.mode == "g":
        header = alignments(spark, a.header)[1]
        reads = transcripts.assemble(text.gtf(spark, a.reads), partition=["file"]).join(header.select("tid", "chr"), "chr", "left")
    else:
        rows, header = alignments(spark, a.reads if a.command == "novel" else a.alignments)
    if a.command == "filter":
        mask = transcripts.assemble(text.gtf(spark, a.rrna), partition=["file"]).join(header.select("tid", "chr"), "chr").select("tid", "start", "end")
        params = FilterParams(a.coverage, a.map_quality, a.sec_rat, a.introns)
        confident, counts = filtering.counted(rows, lambda x: filtering.confident(x, params))
        kept = written(commands.unambiguous(confident, mask, params, ["file"] if "file" in rows.columns else None))
        if "value" in kept.columns:
            sinks.write_sam(kept, text.ordered_lines(spark, a.alignments), a.out)
        else:
            names = ",".join(f"{r['chr']}:{r['len']}" for r in header.orderBy("tid").collect())  # one row a chromosome
            out = kept.orderBy("ord").select(*rows.columns).write.format("bam").mode("overwrite")
            out.option("header", names).option("text", bam.header_text(a.alignments)).save(a.out)
        counts.select("n_in", F.lit(kept.count()).alias("n_out"), (F.col("n_in") - kept.count()).alias("filtered")).show()
    elif a.command == "transcripts":
        sinks.write_gtf(commands.transcript_lines(rows, ExonParams(a.min_exon, a.min_intron), a.source), a.out)
    elif a.command == "junctions":
        genome = text.fasta_tiles(spark, a.genome) if a.genome else None
        params = JunctionParams(a.min_intron, not a.single_end)
        used = commands.with_anchors(rows, a.anchor[0], params.min_intron) if a.anchor else rows
        table = commands.junction_table(used, genome, params)
        sinks.write_junctions(junctions.threshold(table, a.least_unique, a.least_all), a.out)
    else:
        if a.mode == "b":
            reads = transcripts.from_alignments(rows, ExonParams(a.min_exon, a.min_intron))
        anno = transcripts.assemble(text.gtf(spark, a.annotation), partition=["file"]).join(header.select("tid", "chr"), "chr", "left")
        introns = text.star_junctions(spark, a.introns, header) if a.introns else None
        lines = commands.novel_lines(reads, anno, UpdateParams(a.distance, a.full_level, a.unclassified, source=a.source), introns)
        sinks.write_gtf(lines.orderBy("tx", "k"), a.out)


if __name__ == "__main__":
    main()
