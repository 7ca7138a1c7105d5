"""Splice junctions: extraction, motif lookup, grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoloom.functions import cigar as cg
from isoloom.schema import MOTIFS, PROPER_PAIR, UNMAPPED, JunctionParams
from isoloom.sources.text import TILE, genome_tiles
from isoloom.storage import written


def is_unique(nh: Column) -> Column:
    """A read with one reported alignment; without the NH tag it counts as not unique."""
    return F.coalesce(nh, F.lit(0)) == 1


def usable(aln: DataFrame, params: JunctionParams) -> DataFrame:
    out = aln.where(F.col("flag").bitwiseAND(UNMAPPED) == 0)
    if params.require_proper_pair:
        out = out.where(F.col("flag").bitwiseAND(PROPER_PAIR) > 0)
    return out if params.use_multi else out.where(is_unique(F.col("nh")))


def extract(aln: DataFrame, params: JunctionParams = JunctionParams()) -> DataFrame:
    """tid, chr, don, acc, uniq: one row for each intron of each alignment."""
    rows = usable(aln, params).select("tid", "chr", is_unique(F.col("nh")).cast("int").alias("uniq"), F.explode(cg.introns(F.col("cigar"), F.col("pos"), params.min_intron)).alias("i"))
    return rows.select("tid", "chr", F.col("i.start").alias("don"), F.col("i.end").alias("acc"), "uniq")


def _two(bases: Column) -> Column:
    """Two bases as a number; fewer are like no two."""
    return F.ascii(bases) * 65536 + F.ascii(F.substring(bases, 2, 1))


def motif(ends: Column) -> tuple[Column, Column]:
    """Motif number and strand of an intron's first and last two bases (a struct of ``_two``); 0 and 0 if none of the known."""
    number, strand = F.lit(0), F.lit(0)
    for bases, (n, s) in MOTIFS.items():
        here = (ends["_0"] == (ord(bases[0]) << 16) + ord(bases[1])) & (ends["_1"] == (ord(bases[2]) << 16) + ord(bases[3]))
        number, strand = F.when(here, n).otherwise(number), F.when(here, s).otherwise(strand)
    return number, strand


def with_motif(junctions: DataFrame, genome: DataFrame | None) -> DataFrame:
    """Add motif and strand from the genome (chr, seq, or tiles of ``genome_tiles``), joined by name; 0 without one.

    Each distinct intron asks for the two bases at either end, by chromosome and tile: a hot chromosome is many keys,
    and no sequence longer than a tile is in a join.
    """
    if genome is None:
        return junctions.withColumns({"motif": F.lit(0), "strand": F.lit(0)})
    tiles = genome if "tile" in genome.columns else genome_tiles(genome)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("don").alias("at")), F.struct(F.lit(1).alias("side"), (F.col("acc") - 1).alias("at"))))
    asked = junctions.select("chr", "don", "acc").distinct().select("chr", "don", "acc", ends.alias("s"))
    asked = asked.select("chr", "don", "acc", "s.side", F.floor((F.col("s.at") - 1) / TILE).cast("int").alias("tile"), F.pmod(F.col("s.at") - 1, F.lit(TILE)).alias("in"))
    found = asked.join(tiles, ["chr", "tile"]).select("chr", "don", "acc", "side", _two(F.upper(F.substr("piece", F.col("in") + 1, F.lit(2)))).alias("two"))
    # numbers, as greatest texts would be sorted for
    ends = found.groupBy("chr", "don", "acc").agg(*[F.max(F.when(F.col("side") == k, F.col("two"))).alias(f"_{k}") for k in (0, 1)])
    number, strand = motif(F.struct("_0", "_1"))
    coded = ends.select("chr", "don", "acc", number.alias("motif"), strand.alias("strand"))
    return junctions.join(coded, ["chr", "don", "acc"], "left").fillna(0, ["motif", "strand"])


def count(junctions: DataFrame) -> DataFrame:
    """One row a junction: unique and multi counts, strand (0 where rows differ), motif; anno is 1 throughout."""
    one = F.when(F.min("strand") == F.max("strand"), F.min("strand")).otherwise(0)
    return junctions.groupBy("tid", "chr", "don", "acc").agg(one.alias("strand"), F.lit(1).alias("anno"), F.sum("uniq").cast("long").alias("uniq_c"), F.sum(1 - F.col("uniq")).cast("long").alias("multi_c"), F.min("motif").alias("motif"))


def table(aln: DataFrame, genome: DataFrame | None = None, params: JunctionParams = JunctionParams()) -> DataFrame:
    """The junction table in (tid, don, acc) order. Counting comes first, so motifs are looked up once a junction."""
    counted = count(extract(aln, params).withColumns({"motif": F.lit(0), "strand": F.lit(0)}))
    if genome is not None:
        counted = with_motif(written(counted.drop("motif", "strand")), genome)  # read twice: for what it asks, and again
    return counted.select("tid", "chr", "don", "acc", "strand", "anno", "uniq_c", "multi_c", "motif").orderBy("tid", "don", "acc")


def merge(*tables: DataFrame) -> DataFrame:
    """Junction tables as one: counts add up, a strand that differs becomes 0."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    one = F.when(F.min("strand") == F.max("strand"), F.min("strand")).otherwise(0)
    return every.groupBy("tid", "chr", "don", "acc").agg(one.alias("strand"), F.max("anno").alias("anno"), F.sum("uniq_c").alias("uniq_c"), F.sum("multi_c").alias("multi_c"), F.min("motif").alias("motif"))


def threshold(junctions: DataFrame, min_unique: list[int] | None = None, min_all: list[int] | None = None) -> DataFrame:
    """Optional count limits by class: annotated, non-canonical, GT/AG, GC/AG, AT/AC. Off unless given."""
    kind = F.when(F.col("anno") == 1, 0).when(F.col("motif") == 0, 1).when(F.col("motif") <= 2, 2).when(F.col("motif") <= 4, 3).otherwise(4)
    out = junctions
    for limits, value in ((min_unique, F.col("uniq_c")), (min_all, F.col("uniq_c") + F.col("multi_c"))):
        if limits:
            out = out.where(value >= F.element_at(F.array(*map(F.lit, limits)), kind + 1))
    return out
