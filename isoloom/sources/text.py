"""Text sources: SAM, GTF, short-read junctions, FASTA and FASTQ, sample lists. All are read by Spark, compressed or not."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from isoloom.functions import cigar as cg
from isoloom.functions.attributes import attribute
from isoloom.operators.intervals import small
from isoloom.operators.scans import ORDER_CHUNK, carried, summed
from isoloom.schema import STAR
from isoloom.sources import fastq as fq
from isoloom.storage import written


#: Bits of an order key below the file's rank: enough for files of 8 TB.
FILE_BITS = 43


def file_ranks(rows: DataFrame) -> DataFrame:
    """file, rank of the input files in path order. The driver lists them for any scan, so it holds them anyway."""
    files = sorted(rows.inputFiles())
    if len(files) >= 1 << (63 - FILE_BITS):
        raise ValueError("too many files for one order key")
    return rows.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "file string, rank long")


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, file, split (offset of its start), value. The lines of a split stand together and in order."""
    rows = spark.read.text(path)
    named = rows.select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_id"))
    place = F.col("split") + F.col("_id").bitwiseAND((1 << 33) - 1)
    ranks = file_ranks(rows)
    if ranks.limit(2).count() > 1:
        named = named.join(F.broadcast(ranks), "file")  # one row a file
        place += F.shiftleft("rank", FILE_BITS)
    return named.select(place.cast("long").alias("ord"), "file", "split", F.regexp_replace("value", "\r$", "").alias("value"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, file, value: lines in order; ``ord`` is unique over all files of ``path``, which follow each other by path.

    Within a split ids rise with the lines, and a split that shares its task is the last of its file, so the split's
    start plus the id within the task orders a file's lines. The file's rank stands above.
    """
    return _split_lines(spark, path).drop("split")


def dictionary(lines: DataFrame) -> DataFrame:
    """tid, chr, len of the @SQ lines of one or more headers: each name once, numbered by first appearance.

    Headers that give a name different lengths are an error. One row a chromosome goes through the numbering task.
    """
    from pyspark.sql import Window

    rows = lines.where(F.col("value").startswith("@SQ"))
    named = rows.select("ord", F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("chr"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long").alias("len"))
    agree = F.when(F.min("len").eqNullSafe(F.max("len")), F.min("len")).otherwise(F.raise_error(F.concat(F.lit("headers disagree on the length of "), F.first("chr"))).cast("long"))
    once = named.groupBy("chr").agg(F.min("ord").alias("ord"), agree.alias("len"))
    return once.select((F.row_number().over(Window.orderBy("ord")) - 1).alias("tid"), "chr", "len")


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """tid, chr, len of the headers of all files of ``path``."""
    return dictionary(ordered_lines(spark, path))


def sam_records(lines: DataFrame) -> DataFrame:
    """Alignments of SAM lines (ord, file, value) without tid. Tags NM, XS and NH are null if absent."""
    rows = lines.where(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    tag = lambda name, kind: F.nullif(F.regexp_extract("value", f"\t{name}:{kind}:([^\t]*)", 1), F.lit(""))
    # a filter on these may be tried on header lines first, so the casts must not fail
    return rows.select("ord", "file", at(0).alias("qname"), at(1).try_cast("int").alias("flag"), at(2).alias("chr"), (at(3).try_cast("int") - 1).alias("pos"), F.when(at(9) == "*", 0).otherwise(F.length(at(9))).alias("l_qseq"), cg.parse(at(5)).alias("cigar"), tag("NM", "i").try_cast("int").alias("nm"), tag("XS", "A").alias("xs"), tag("NH", "i").try_cast("int").alias("nh"), "value")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of one or more SAM files, with the numbers of their common dictionary."""
    lines = ordered_lines(spark, path)
    return sam_records(lines).join(F.broadcast(dictionary(lines).select("tid", "chr")), "chr", "left")  # one row a chromosome


def gtf(spark: SparkSession, path: str, header: DataFrame | None = None) -> DataFrame:
    """Annotation lines (ord, chr, type, start, end, is_rev, names, value), without comments.

    gene_name falls back to gene_id, transcript_name to gene_name, transcript_id to transcript_name.
    """
    return parse_gtf(ordered_lines(spark, path), header)


def parse_gtf(lines: DataFrame, header: DataFrame | None = None) -> DataFrame:
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 5))
    extra = ["file"] if "file" in lines.columns else []
    fields = rows.select("ord", *extra, "value", f.alias("_f"))
    g = lambda k: F.get("_f", F.lit(k))
    # in steps, so that each tag is sought once a line
    tags = ("gene_id", "gene_name", "transcript_id", "transcript_name")
    found = fields.withColumn("_a", g(8)).withColumns({f"_{t}": attribute(F.col("_a"), t) for t in tags})
    name = F.coalesce("_gene_name", "_gene_id")
    tname = F.coalesce("_transcript_name", name)
    out = found.select("ord", *extra, g(0).alias("chr"), g(2).alias("type"), g(3).try_cast("int").alias("start"), g(4).try_cast("int").alias("end"), (F.coalesce(g(6), F.lit("+")) == "-").cast("int").alias("is_rev"), F.col("_gene_id").alias("gene_id"), name.alias("gene_name"), F.coalesce("_transcript_id", tname).alias("transcript_id"), tname.alias("transcript_name"), "value")
    return out if header is None else out.join(F.broadcast(header.select("tid", "chr")), "chr", "left")  # one row a chromosome


def star_junctions(spark: SparkSession, path: str, header: DataFrame | None = None) -> DataFrame:
    """Short-read junctions of a file."""
    return parse_star(spark.read.text(path), header)


def parse_star(lines: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Short-read junctions of lines (value); is_rev is null for an undefined strand, so it never matches."""
    rows = lines.select(F.from_csv("value", STAR, {"sep": "\t"}).alias("r")).select("r.*")
    rows = rows.withColumn("is_rev", F.when(F.col("strand") == 1, 0).when(F.col("strand") == 2, 1))
    return rows if header is None else rows.join(F.broadcast(header.select("tid", "chr")), "chr")  # one row a chromosome


def star_table(rows: DataFrame) -> DataFrame:
    """Short-read junctions (tid, ...) as a junction table in (tid, don, acc) order; max_over is the longest overhang."""
    return rows.select("tid", "chr", F.col("start").alias("don"), F.col("end").alias("acc"), "strand", F.col("annotated").alias("anno"), F.col("uniq").alias("uniq_c"), F.col("multi").alias("multi_c"), "motif", F.col("overhang").alias("max_over")).orderBy("tid", "don", "acc")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """chr, seq: a record begins with > at the start of a line; its name ends at white space, the rest of that line is
    a comment (which may hold >), sequence lines are joined."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"))
    head, rest = F.substring_index("value", "\n", 1), F.regexp_extract("value", "(?s)^[^\\n]*\\n?(.*)$", 1)
    return rows.select(F.regexp_extract(head, "^([^\\s]*)", 1).alias("chr"), F.regexp_replace(rest, "\\s", "").alias("seq")).where("chr <> ''")


#: Bases of a genome tile.
TILE = 4096


def genome_tiles(genome: DataFrame, width: int = TILE) -> DataFrame:
    """chr, tile, piece: sequences (chr, seq) in pieces of ``width`` bases and the next one, so that any two bases that
    stand together are within a piece. A chromosome is many rows then, and a lookup never walks a long string."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{1,{width + 1}}})).{{1,{width}}}"), F.lit(1))
    return genome.select("chr", F.posexplode(pieces).alias("tile", "piece"))


#: Letters of a sequence in a row of ``_bases``.
PIECE = 1 << 15
_SPACES = dict.fromkeys(map(ord, " \t\n\v\f\r"))


def _bases(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """ord, name, n, off, bases of lines (ord, split, value): a row a header with its name, and lines of a split that
    stand together without white space, in rows of ``size`` letters. ``ord`` is that of the first line, ``n`` counts the
    letters of all these rows and ``off`` those before a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ords, split, lines = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        head = pc.starts_with(batch.column(2), ">").to_numpy(zero_copy_only=False)
        # two files have other ranks in their order keys, or begin their splits anew
        fresh = head[1:] | head[:-1] | (split[1:] != split[:-1]) | (ords[1:] - ords[:-1] != 1)
        begin = [0, *(np.flatnonzero(fresh) + 1).tolist()]
        out: list[tuple] = []
        for a, b in zip(begin, [*begin[1:], len(lines)], strict=True):
            if head[a]:
                out.append((ords[a], re.match(">([^ \t\n\v\f\r]*)", lines[a])[1], 0, 0, None))
            elif text := "".join(lines[a:b]).translate(_SPACES):
                out.extend((ords[a], None, len(text), k, text[k : k + size]) for k in range(0, len(text), size))
        columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def fasta_tiles(spark: SparkSession, path: str, width: int = TILE, chunk: int = ORDER_CHUNK) -> DataFrame:
    """chr, tile, piece, as ``genome_tiles`` gives them, straight from the lines of a file.

    Lines are read once, joined in rows of bounded size where they stand, and written: what orders them depends on the
    splits, which may differ between two readings. Sums of lengths, of one short row a batch of lines, tell each row its
    place in its record, so rows are cut into tiles where they stand and only a tile's pieces meet: no sequence is ever
    whole, neither in a row nor in a task. A record that comes again under its name is an error.
    """
    kind = "ord long, name string, n long, off long, bases string"
    told = functools.partial(_bases, schema=to_arrow_schema(StructType.fromDDL(kind)), size=min(PIECE, chunk))
    rows = written(_split_lines(spark, path).select("ord", "split", "value").mapInArrow(told, kind))
    slim = rows.where("off = 0").select("ord", "name", "n", F.shiftright("ord", FILE_BITS).alias("rank"))
    is_head = F.col("name").isNotNull()
    placed = carried(summed(slim, F.col("n"), "_at", ["rank"], chunk), {"chr": F.col("name"), "_begin": F.when(is_head, F.col("_at")), "_record": F.when(is_head, F.col("ord"))}, ["rank"], chunk)
    known = written(placed.where("name IS NULL AND chr <> ''").select("ord", "chr", "_record", (F.col("_at") - F.col("_begin")).alias("_from")))
    own = rows.join(F.broadcast(known) if small(known) else known.hint("shuffle_hash"), "ord").select("chr", "_record", (F.col("_from") + F.col("off")).alias("_at"), "bases")
    end = F.col("_at") + F.length("bases")
    # a tile has the first base of the next one too
    first, last = F.floor(F.greatest(F.col("_at") - 1, F.lit(0)) / width), F.floor((end - 1) / width)
    cut = own.withColumn("tile", F.explode(F.sequence(first, last)))
    low = F.col("tile") * width
    start, stop = F.greatest(F.col("_at"), low), F.least(end, low + width + 1)
    parts = cut.select("chr", F.col("tile").cast("int").alias("tile"), "_record", start.alias("_at"), F.substr("bases", (start - F.col("_at") + 1).cast("int"), (stop - start).cast("int")).alias("part")).where("part <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "part"))), lambda x: x["part"]), "")
    once = F.when(F.min("_record") == F.max("_record"), joined).otherwise(F.raise_error(F.concat(F.lit("two sequences are named "), F.first("chr"))).cast("string"))
    return parts.groupBy("chr", "tile").agg(once.alias("piece"))


#: Bytes of lines that a task of ``fastq`` holds at a time.
FASTQ_CHUNK = 4 << 20


def fastq(spark: SparkSession, path: str, chunk: int = FASTQ_CHUNK) -> DataFrame:
    """file, name, seq, qual (null for a FASTA record). Sequence and quality may take several lines.

    A quality line may look like a header, so what a line is depends on all before it. The splits of a file are read
    side by side nevertheless: each first tells what it makes of every state it may be entered in (``fastq``), a walk
    over these summaries gives its true one, and it then parses its lines where they stand. Only parts of records that
    reach over an edge are shuffled.
    """
    lines = _split_lines(spark, path)
    mapped = lambda rows, f, kind, *more: rows.mapInArrow(functools.partial(f, schema=to_arrow_schema(StructType.fromDDL(kind)), **dict(more)), kind)
    cut = (("file_bits", FILE_BITS), ("size", chunk))
    told = mapped(lines.select("ord", "split", "value"), fq.summaries, f"rank long, split long, at long, {fq.SUMMARY}", *cut)
    in_order = told.repartition("rank").sortWithinPartitions("rank", "split", "at")
    entered = written(mapped(in_order, fq.entries, f"rank long, split long, lines long, {fq.STATE}"))
    few = small(entered)
    known = lines.withColumn("rank", F.shiftright("ord", FILE_BITS)).join(F.broadcast(entered) if few else entered.hint("shuffle_hash"), ["rank", "split"])
    # a broadcast join leaves the lines in their order
    known = (known if few else known.sortWithinPartitions("rank", "split", "ord")).select("ord", "split", "value", "lines", "kind", "letters", "record")
    part = "record long, at long, name string, seq string, qual string"
    whole, open_ = (mapped(known, fq.parsed, part, *cut, ("edges", e)) for e in (False, True))
    text_of = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c)))), lambda x: x[c]), "")
    joined = open_.groupBy("record").agg(F.max("name").alias("name"), text_of("seq").alias("seq"), F.when(F.count("qual") > 0, text_of("qual")).alias("qual"))
    right = F.col("qual").isNull() | (F.length("qual") == F.length("seq"))
    wrong = F.format_string("the quality of %s has %d letters, its sequence %d", "name", F.length("qual"), F.length("seq"))
    joined = joined.withColumn("qual", F.when(right, F.col("qual")).otherwise(F.raise_error(wrong).cast("string")))
    both = whole.drop("at").unionByName(joined).withColumn("rank", F.shiftright("record", FILE_BITS))
    return both.join(F.broadcast(file_ranks(lines)), "rank").select("file", "name", "seq", "qual")  # one row a file


def samples(spec: str) -> list[list[str]]:
    """"a,b:c" is two samples, the first with two replicates."""
    return [[p for p in s.split(",") if p] for s in spec.split(":") if s]


def sample_table(specs: DataFrame, column: str = "spec") -> DataFrame:
    """sample, replicate, path for a column of such texts."""
    rows = specs.select("*", F.posexplode(F.split(column, ":")).alias("sample", "_s"))
    return rows.select(*specs.columns, "sample", F.posexplode(F.split("_s", ",")).alias("replicate", "path")).where("path <> ''")


def sample_lists(files: DataFrame, column: str = "text") -> DataFrame:
    """sample, replicate, path for a column of whole list files: the number of samples, then for each a count and that
    many paths. A file that ends too early or has a count below 1 is an error."""
    words = F.filter(F.split(column, "\\s+"), lambda w: w != "")
    number = lambda w: w.try_cast("int")
    none = F.array().cast("array<struct<sample:int,replicate:int,path:string>>")
    zero = F.struct(F.lit(-1).alias("sample"), F.lit(0).alias("open"), F.lit(0).alias("size"), F.lit(True).alias("good"), none.alias("out"))

    def step(s: Column, w: Column) -> Column:
        path = s["open"] > 0
        n = F.coalesce(number(w), F.lit(0))
        one = F.array_append(s["out"], F.struct(s["sample"].alias("sample"), (s["size"] - s["open"]).alias("replicate"), w.alias("path")))
        return F.struct(F.when(path, s["sample"]).otherwise(s["sample"] + 1).alias("sample"), F.when(path, s["open"] - 1).otherwise(n).alias("open"), F.when(path, s["size"]).otherwise(n).alias("size"), (s["good"] & (path | (n > 0))).alias("good"), F.when(path, one).otherwise(s["out"]).alias("out"))

    declared = F.coalesce(number(F.get(words, F.lit(0))), F.lit(0))
    read = F.aggregate(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), zero, step)
    rows = files.withColumns({"_n": declared, "_r": read})
    whole = (F.col("_n") > 0) & F.col("_r")["good"] & (F.col("_r")["open"] == 0) & (F.col("_r")["sample"] + 1 >= F.col("_n"))
    out = F.when(whole, F.col("_r")["out"]).otherwise(F.raise_error(F.lit("the list of samples is not whole")).cast("array<struct<sample:int,replicate:int,path:string>>"))
    return rows.select(*files.columns, "_n", F.explode(out).alias("_o")).where("_o.sample < _n").select(*files.columns, "_o.sample", "_o.replicate", "_o.path")


def sample_list(text: str) -> list[list[str]]:
    """A list file: the number of samples; then for each a count and that many paths."""
    words = iter(text.split())
    try:
        n = int(next(words))
        if n <= 0:
            raise ValueError("the number of samples must be positive")
        out = []
        for _ in range(n):
            count = int(next(words))
            if count <= 0:
                raise ValueError("the number of replicates must be positive")
            out.append([next(words) for _ in range(count)])
        return out
    except StopIteration:
        raise ValueError("the list ends too early") from None
