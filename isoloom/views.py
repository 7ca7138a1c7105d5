"""Genomic views over the star-schema tables: the data the registered queries and their oracle share.

Exons come from line items, reads and annotation from orders, name-grouped alignments from events. The SQL runs alike
in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.functions import cigar as cg
from isoloom.operators.scans import numbered
from isoloom.sources import bam, sinks
from isoloom.storage import shared_folder

EXON = """
SELECT l_orderkey AS tx, CAST(l_orderkey % 25 AS INT) AS tid, CAST(floor(l_orderkey/25) % 2 AS INT) AS is_rev, rn-1 AS k,
  CAST(1+floor(l_orderkey/100)*200 + (rn-1)*100 AS INT) AS s,
  CAST(1+floor(l_orderkey/100)*200 + (rn-1)*100 + 9 + 20*floor(l_quantity/20) AS INT) AS e
FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) AS rn FROM lineitem) q
"""

ALIGNED = """
SELECT ord, concat('r', CAST(rid AS VARCHAR(20))) AS qname, CAST(200+h%100 AS INT) AS l_qseq, CAST(h%70 AS INT) AS clip5,
  CAST(floor(h/7) AS BIGINT)%30 AS clip3, h%4 AS del_len, CAST(CAST(floor(h/11) AS BIGINT)%60 AS INT) AS nm,
  h%5 AS intron_n, CASE WHEN h%13=0 THEN 4 ELSE 0 END AS unmapped, h AS h
FROM (SELECT event_id AS ord, CAST(floor(event_id/3) AS BIGINT) AS rid, CAST(round(value*100) AS BIGINT) AS h FROM events) a
"""


MASK = "SELECT CAST(p_partkey % 25 AS INT) AS tid, CAST(p_partkey * 37 % 12000 AS INT) AS start, CAST(p_partkey * 37 % 12000 + p_size AS INT) AS e FROM part"


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, start, end: an interval to mask for each part."""
    return spark.sql(MASK.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")).withColumnRenamed("e", "end")


def stored_text(lines: DataFrame) -> str:
    """The folder of text files that hold ``lines`` (value)."""
    path = shared_folder(lines.sparkSession)
    lines.write.text(path)
    return path


def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """half, ord, value: SAM lines of the transcripts' alignments, of the even ones and of the odd ones, each half with a
    header of its own sequences."""
    aln = alignments_of(transcripts(spark, sf_dir)).withColumn("half", F.col("ord") % 2)
    tx = transcripts(spark, sf_dir)
    sizes = tx.groupBy("tid", "chr").agg(F.max("end").alias("len"))
    head = tx.select(F.col("tid"), (F.col("tx") % 2).alias("half")).distinct().join(sizes, "tid").select("half", (F.col("tid") - 1_000_000).cast("long").alias("ord"), F.format_string("@SQ\tSN:%s\tLN:%d", "chr", "len").alias("value"))
    fields = ["qname", F.col("flag").cast("string"), "chr", (F.col("pos") + 1).cast("string"), F.lit("60"), cg.text(F.col("cigar")), F.lit("*"), F.lit("0"), F.lit("0"), F.repeat(F.lit("A"), F.col("l_qseq")), F.lit("*"), F.format_string("NH:i:%d", "nh")]
    return head.unionByName(aln.select("half", "ord", F.concat_ws("\t", *fields).alias("value")))


def sam_files(spark: SparkSession, sf_dir: str) -> str:
    """SAM text: a file of the even ones, then a file of the odd ones."""
    rows, base = sam_lines(spark, sf_dir), shared_folder(spark)
    for half in (0, 1):
        sinks.write_single(rows.where(F.col("half") == half).select("ord", "value"), f"{base}/half-{half}.sam", ["ord"])
    return base


def sam_folders(spark: SparkSession, sf_dir: str) -> str:
    """The same lines compressed and with line ends of two letters, in many files; headers are in the first ones."""
    base = shared_folder(spark)
    ordered = sam_lines(spark, sf_dir).orderBy("half", "ord").select("value")
    ordered.write.option("compression", "gzip").option("lineSep", "\r\n").text(base)
    return base


def bam_copy(spark: SparkSession, aln: DataFrame) -> DataFrame:
    """Alignments written as BAM, read, renamed, written and read."""
    spark.dataSource.register(bam.BamSource)
    # the format's greatest lengths less a number, as positions grow with the tables
    names = ",".join(f"chr{k + 1}:{bam.LONGEST - k}" for k in range(25))
    first, second = shared_folder(spark), shared_folder(spark)
    aln.write.format("bam").mode("append").option("header", names).save(first)
    rows = spark.read.format("bam").option("split", 1 << 17).load(first)
    rows.withColumn("qname", F.concat("qname", F.lit(".z"))).write.format("bam").mode("overwrite").option("header", names).save(second)
    return spark.read.format("bam").option("split", 1 << 17).load(second)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx, tid, is_rev, k, s, e."""
    return spark.sql(EXON.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a transcript: tx, tid, chr, is_rev, start, end, exons and names."""
    rows = exon_rows(spark, sf_dir).groupBy("tx").agg(F.first("tid").alias("tid"), F.first("is_rev").alias("is_rev"), F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("exons"))
    return rows.select("tx", "tid", F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string")).alias("chr"), "is_rev", F.element_at("exons", 1)["start"].alias("start"), F.element_at("exons", -1)["end"].alias("end"), "exons", F.concat(F.lit("g"), F.floor(F.col("tx") / 7).cast("string")).alias("gene_id"), F.concat(F.lit("n"), F.floor(F.col("tx") / 7).cast("string")).alias("gene_name"), F.concat(F.lit("t"), F.col("tx").cast("string")).alias("transcript_id"), F.lit(None).cast("string").alias("transcript_name"))


def reads(tx: DataFrame) -> DataFrame:
    return tx.where((F.col("tx") % 3 == 0) & (F.size("exons") > 1))


def annotation(tx: DataFrame) -> DataFrame:
    return tx.where((F.col("tx") % 3 != 0) & (F.size("exons") > 1))


def retained(tx: DataFrame) -> DataFrame:
    """Reads of another third with their second intron kept: exon 1 runs to the end of exon 2."""
    rows = tx.where((F.col("tx") % 3 == 1) & (F.size("exons") > 3))
    joined = F.concat(F.slice("exons", 1, 1), F.array(F.struct(F.get("exons", F.lit(1))["start"].alias("start"), F.get("exons", F.lit(2))["end"].alias("end"))), F.slice("exons", F.lit(4), F.size("exons")))
    return rows.withColumn("exons", joined)


def alignments_of(tx: DataFrame) -> DataFrame:
    """Alignments whose CIGARs were built from transcripts: even numbers are unique, every fifth is not a proper pair."""
    return tx.select(F.col("tx").alias("ord"), F.col("transcript_id").alias("qname"), (F.when(F.col("tx") % 5 == 0, 0).otherwise(2) + F.col("is_rev") * 16).cast("int").alias("flag"), "tid", "chr", (F.col("start") - 1).alias("pos"), F.aggregate("exons", F.lit(0), lambda s, e: s + e["end"] - e["start"] + 1).alias("l_qseq"), cg.from_exons(F.col("exons")).alias("cigar"), F.lit(0).alias("nm"), F.lit(None).cast("string").alias("xs"), F.when(F.col("tx") % 2 == 0, 1).otherwise(2).alias("nh"))


def grouped_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-grouped alignments of events, with CIGARs of clips, a match, a deletion and introns."""
    rows = spark.sql(ALIGNED.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    op = lambda name, n: F.struct(F.lit(name).alias("op"), n.cast("int").alias("len"))
    match = F.col("l_qseq") - F.col("clip5") - F.col("clip3")
    introns = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.col("intron_n"), F.lit(1)).cast("int")), lambda i: F.when(F.col("intron_n") > 0, F.array(op("N", F.lit(100)), op("M", F.lit(1)))).otherwise(F.array().cast("array<struct<op:string,len:int>>"))))
    cigar = F.concat(F.array(op("S", F.col("clip5")), op("M", match - F.col("intron_n"))), F.array(op("D", F.col("del_len"))), introns, F.array(op("S", F.col("clip3"))))
    cigar = F.filter(cigar, lambda c: c["len"] > 0)
    return rows.select("ord", "qname", F.col("unmapped").cast("int").alias("flag"), (F.col("h") % 25).cast("int").alias("tid"), F.concat(F.lit("chr"), (F.col("h") % 25 + 1).cast("string")).alias("chr"), F.floor(F.col("h") / 3).cast("int").alias("pos"), "l_qseq", cigar.alias("cigar"), "nm", F.lit(None).cast("string").alias("xs"), F.lit(1).alias("nh"))


#: Bases of a piece of the genome's period.
PIECE = 1 << 12


def genome_lines(spark: SparkSession, sf_dir: str, copies: int = 20, width: int = 70) -> DataFrame:
    """ord, value: FASTA lines of 25 chromosomes that are alike: a base for each part (size modulo 4) in key order, over
    and over.

    Keys may start anywhere and have gaps, so parts are numbered. The bases are put together once, in pieces that go on
    for a line's width beyond their end (behind the last base comes the first one), and lines are cut from pieces.
    """
    part = table(spark, sf_dir, "part").where("p_size IS NOT NULL").select(F.col("p_partkey").alias("ord"), F.substring(F.lit("ACGT"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)).alias("b"))
    n = part.count()
    if n:
        more = width - 1
        # those up to a line's width behind the end are the first ones again
        again = F.sequence(F.lit(0).cast("long"), F.lit(-(-more // n)).cast("long"))
        at = numbered(part, "_n", chunk=1 << 16).select("b", F.explode(again).alias("turn"), "_n").select("b", (F.col("_n") + F.col("turn") * n).alias("at")).where(F.col("at") < n + more)
        piece = F.floor(F.col("at") / PIECE)
        both = F.when((F.pmod("at", F.lit(PIECE)) < more) & (piece > 0), F.array(piece, piece - 1)).otherwise(F.array(piece))
        pieces = at.select("b", "at", F.explode(both).alias("piece")).groupBy("piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "b"))), lambda x: x["b"]), "").alias("bases"))
        start = F.col("piece") * PIECE
        copied = pieces.where(start < n).select("bases", start.alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"))
        low, end = F.col("copy") * n + F.col("start"), F.col("copy") * n + F.least(F.col("start") + PIECE, F.lit(n))
        first, last = F.ceil(low / width), F.ceil(end / width) - 1
        cut = copied.where(first <= last).select("bases", low.alias("low"), F.explode(F.sequence(first, last)).alias("line"))
        size = F.least(F.lit(width).cast("long"), F.lit(copies * n) - F.col("line") * width)
        line = cut.select("line", F.substr("bases", (F.col("line") * width - F.col("low") + 1).cast("int"), size.cast("int")).alias("value"))
    else:
        line = spark.createDataFrame([], "line long, value string")
    one = 1 << 32  # order keys of a chromosome
    chrs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("c")
    body = line.select(chrs, "line", "value").select((F.col("c") * one + F.col("line") + 1).alias("ord"), "value")
    head = spark.range(25).select((F.col("id") * one).alias("ord"), F.format_string(">chr%d a>b", F.col("id") + 1).alias("value"))
    return head.unionByName(body)


def genome_file(spark: SparkSession, sf_dir: str) -> str:
    """The FASTA file of ``genome_lines``."""
    path = f"{shared_folder(spark)}/genome.fa"
    sinks.write_single(genome_lines(spark, sf_dir), path, ["ord"])
    return path


def lines(tx: DataFrame) -> DataFrame:
    """Annotation lines (ord, value) of transcripts, in table order, as a file would have them."""
    attributes = F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('"; transcript_id "'), F.col("transcript_id"), F.lit('"; gene_name "'), F.col("gene_name"), F.lit('";'))
    part = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"))
    every = F.concat(F.array(part("transcript", F.col("start"), F.col("end"))), F.transform("exons", lambda e: part("exon", e["start"], e["end"])))
    rows = tx.select("tx", "chr", F.when(F.col("is_rev") == 1, "-").otherwise("+").alias("strand"), attributes.alias("attributes"), F.posexplode(every).alias("k", "p"))
    line = F.concat_ws("\t", "chr", F.lit("src"), "p.kind", F.col("p.s").cast("string"), F.col("p.e").cast("string"), F.lit("."), "strand", F.lit("."), "attributes")
    return rows.select((F.col("tx") * 100 + F.col("k")).alias("ord"), line.alias("value"))
