"""Alignment details: block arrays, anchors, order, distinct exons, split points, exon segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoloom.functions import cigar as cg
from isoloom.operators import intervals
from isoloom.operators.junctions import is_unique, usable
from isoloom.schema import JunctionParams
from isoloom.storage import written


def details(aln: DataFrame, params: JunctionParams = JunctionParams(), skips_only: bool = False) -> DataFrame:
    """ord, tid, start, end, rlen, is_uniq, is_splice (more than one junction), exon_end, intr_end."""
    rows = usable(aln, params)
    if skips_only:
        rows = rows.where(cg.matches_and_skips_only(F.col("cigar")))
    rows = rows.withColumns({"introns": cg.introns(F.col("cigar"), F.col("pos"), params.min_intron), "rlen": cg.reference_length(F.col("cigar"))})
    end = F.col("pos") + F.col("rlen")
    return rows.select("ord", "tid", (F.col("pos") + 1).alias("start"), end.alias("end"), "rlen", is_unique(F.col("nh")).alias("is_uniq"), (F.size("introns") > 1).alias("is_splice"), F.concat(F.transform("introns", lambda i: i["start"] - 1), F.array(end)).alias("exon_end"), F.transform("introns", lambda i: i["end"]).alias("intr_end"))


def anchored(rows: DataFrame, least: int) -> DataFrame:
    """Spliced details whose first and last block are long enough; unspliced ones pass."""
    first = F.get("exon_end", F.lit(0)) - F.col("start") + 1
    last = F.col("end") - F.get("intr_end", F.size("intr_end") - 1)
    return rows.where((F.size("intr_end") == 0) | ((first >= least) & (last >= least)))


def ordered(rows: DataFrame) -> DataFrame:
    """By tid, start, reference length and block ends."""
    return rows.orderBy("tid", "start", "rlen", "exon_end")


def distinct(rows: DataFrame) -> DataFrame:
    """One of each set of details with equal blocks: the first in file order."""
    keys = ["tid", "start", "rlen", "exon_end"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def blocks(rows: DataFrame) -> DataFrame:
    """tid, start, end of every block."""
    starts = F.concat(F.array("start"), F.transform("intr_end", lambda e: e + 1))
    pairs = F.arrays_zip(starts.alias("start"), F.col("exon_end").alias("end"))
    return rows.select("tid", F.explode(pairs).alias("b")).select("tid", "b.start", "b.end")


def exon_ends(block: DataFrame) -> DataFrame:
    """The greatest end of each exon start."""
    return block.groupBy("tid", "start").agg(F.max("end").alias("end"))


def split_points(rows: DataFrame) -> DataFrame:
    """Distinct first bases after a donor or an intron: exon end + 1 of all blocks but the last, intron end + 1."""
    donors = F.transform(F.slice("exon_end", F.lit(1), F.size("intr_end")), lambda e: e + 1)
    acceptors = F.transform("intr_end", lambda e: e + 1)
    return rows.select("tid", F.explode(F.concat(donors, acceptors)).alias("point")).distinct()


def segments(rows: DataFrame) -> DataFrame:
    """Exon segments of each tid with more than one distinct exon: exon union, cut at the split points."""
    exons = written(exon_ends(blocks(rows)))  # read by three passes
    several = exons.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid")  # one row a chromosome
    return intervals.split(intervals.union(exons.join(F.broadcast(several), "tid", "left_semi"), ["tid"]), split_points(rows), ["tid"])


#: Rows of a group that are sorted; value ranges into which a larger group is cut at once.
SORTED, CUTS = 50_000, 256


def kth_smallest(df: DataFrame, value: Column, k: int, partition: list[str], most: int = SORTED) -> DataFrame:
    """The k-th smallest value (from 1; nulls left out) of each group that has so many.

    A group of more than ``most`` rows is not sorted: its range of values is cut into equal parts, their rows are
    counted, and the search goes on in the part that holds rank k, between the least and greatest value there, until few
    rows or a single value are left. What is passed on is one row a group and part.
    """
    keys = [f"_g{n}" for n in range(len(partition))]
    rows = df.select(*[F.col(c).alias(g) for c, g in zip(partition, keys, strict=True)], value.alias("value")).where("value IS NOT NULL")
    left = written(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi")).where(F.col("_n") >= k).withColumn("_k", F.lit(k).cast("long")))
    while left.where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        wide = (F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))
        share = (F.col("value") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double")
        part = F.least(F.floor(share * CUTS), F.lit(CUTS - 1))
        inside = _within(rows, left.where(wide), keys)
        sums = inside.withColumn("_part", part).groupBy(*keys, "_k", "_part").agg(F.count("*").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part"))  # CUTS rows a group
        found = sums.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
        left = written(left.where(~wide).unionByName(found.select(*keys, "_n", "_lo", "_hi", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_k"))))
    single = left.where("_lo = _hi").select(*keys, F.col("_lo").alias("value"))
    few = _within(rows, left.where("_lo < _hi"), keys)
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).where("_rank = _k")
    return single.unionByName(ranked.select(*keys, "value")).toDF(*partition, "value")


def _within(rows: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the groups of ``left`` between their bounds; null keys are equal."""
    other = left.select(*[F.col(g).alias(f"_o{g}") for g in keys], "_lo", "_hi", "_k")
    on = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    for g in keys:
        on &= F.col(g).eqNullSafe(F.col(f"_o{g}"))
    return rows.join(other, on).drop(*[f"_o{g}" for g in keys])
