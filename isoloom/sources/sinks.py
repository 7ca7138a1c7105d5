"""Sinks: GTF, junction tables, SAM, and single files in order. Spark writes the rows; only header lines come from the driver.

A single file is written by many tasks: parts sorted by ranges, then joined. Where the file system can join files by
itself (HDFS) only their names move; a local or mounted one is written in place, each task its own range of bytes.
"""

from __future__ import annotations

import os
import shutil
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.sources import bam
from isoloom.storage import shared_folder

#: The head of the junction table's text format.
JUNCTION_HEAD = [
    "###STRAND 0:undefined, 1:+, 2:-",
    "###ANNO 0:novel, 1:annotated",
    "###MOTIF 0:non-canonical, 1:GT/AG, 2:CT/AC, 3:GC/AG, 4:CT/GC, 5:AT/AC, 6:GT/AT",
    "#CHR\tSTART\tEND\tSTRAND\tANNO\tUNIQ_C\tMULTI_C\tMOTIF",
]


def _copy(source: str, target: str, at: int) -> None:
    """The bytes of a file into another one, from a place on."""
    with open(source, "rb") as f, open(target, "r+b") as g:
        g.seek(at)
        shutil.copyfileobj(f, g, 1 << 20)


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def join_files(spark: SparkSession, parts: list[str], target: str, head: bytes = b"", tail: bytes = b"") -> None:
    """One file of ``head``, the files ``parts`` and ``tail``. A file of that name is replaced when all is there."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(target).getFileSystem(conf)
    made = f"{target}.joining"
    if fs.getScheme() == "file":
        sizes = [fs.getFileStatus(at(p)).getLen() for p in parts]
        starts, end = [], len(head)
        for n in sizes:
            starts.append(end)
            end += n
        local = _local(made)
        os.makedirs(os.path.dirname(local) or ".", exist_ok=True)
        with open(local, "wb") as f:
            f.write(head)
            f.seek(end)
            f.write(tail)
            f.truncate(end + len(tail))
        todo = [(_local(p), local, a) for p, n, a in zip(parts, sizes, starts, strict=True) if n]
        if todo:
            spark.sparkContext.parallelize(todo, len(todo)).foreach(lambda x: _copy(*x))
        os.replace(local, _local(target))
        return
    for name, data in ((made, head), (f"{made}-end", tail)):
        out = fs.create(at(name), True)
        out.write(data)
        out.close()
    rest = [*(p for p in parts if fs.getFileStatus(at(p)).getLen()), *([f"{made}-end"] if tail else [])]
    if rest:
        paths = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(rest))
        for k, p in enumerate(rest):
            paths[k] = at(p)
        fs.concat(at(made), paths)  # an error where the file system can't
    fs.delete(at(target), False)
    if not fs.rename(at(made), at(target)):
        raise OSError(f"can't give {made} the name {target}")


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """The part files of a folder, in the order of their tasks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(p for p in (f.getPath().toString() for f in found) if p.rsplit("/", 1)[1].startswith("part-"))


def write_single(lines: DataFrame, path: str, order: list[str | Column], head: str = "") -> None:
    """``lines`` (value and what ``order`` names) as one text file in order, written by many tasks."""
    folder = shared_folder(lines.sparkSession)
    lines.orderBy(*order).select("value").write.text(folder)
    join_files(lines.sparkSession, _parts(lines.sparkSession, folder), path, head.encode())


def write_single_bam(rows: DataFrame, path: str, order: list[str | Column], header: str, text: str | None = None) -> None:
    """Alignments in order as one BAM file, written by many tasks: blocks stand for themselves, so parts have neither
    header nor end block, which the joined file has once. ``header`` and ``text`` as for the BAM writer."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    spark.dataSource.register(bam.BamSource)
    rows.orderBy(*order).write.format("bam").mode("append").option("header", header).option("bare", "true").save(folder)
    refs = bam.parse_refs(header)
    join_files(spark, _parts(spark, folder), path, bam.bgzf_all(bam.head_bytes(refs, text)), bam.END_BLOCK)


def write_gtf(lines: DataFrame, path: str, order: list[str | Column] | None = None) -> None:
    """Lines (value) in their order: a folder of parts, or with ``order`` one file."""
    if order:
        write_single(lines, path, order)
    else:
        lines.select("value").write.mode("overwrite").text(path)


def junction_lines(table: DataFrame) -> DataFrame:
    cols = ["chr", "don", "acc", "strand", "anno", "uniq_c", "multi_c", "motif"]
    return table.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))


def write_junctions(table: DataFrame, path: str) -> None:
    """The table in order, and its head in a file that sorts first."""
    spark = table.sparkSession
    spark.createDataFrame([(h,) for h in JUNCTION_HEAD], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    junction_lines(table).write.mode("overwrite").text(f"{path}/rows")


def sam_lines(rows: DataFrame) -> DataFrame:
    """SAM text of alignments that came from SAM (value): the name is replaced, all else stays."""
    return rows.select("ord", F.concat(F.col("qname"), F.regexp_replace("value", "^[^\t]*", "")).alias("value"))


def write_sam(rows: DataFrame, lines: DataFrame, path: str) -> None:
    """SAM text: the header lines of ``lines`` (ord, file, value; each distinct one once, where it first comes), then
    the alignments of ``rows`` in order. The head is sorted before all rows, so it opens the first part."""
    head = lines.where(F.col("value").startswith("@")).groupBy("value").agg(F.min("ord").alias("ord"))
    both = head.select(F.lit(0).alias("part"), "ord", "value").unionByName(sam_lines(rows).select(F.lit(1).alias("part"), "ord", "value"))
    both.orderBy("part", "ord").select("value").write.mode("overwrite").text(path)
