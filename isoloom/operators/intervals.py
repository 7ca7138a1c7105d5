"""Interval operators: overlap joins by bins, anti joins, islands, unions, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoloom.operators.scans import chunk_keys, keyed, with_chunk_columns
from isoloom.storage import written

#: Width of a bin of coordinates: about the length of a gene, so most intervals fall into one or two.
BIN = 1 << 15
#: Rows of one side in a bin from which on the bin is cut into parts.
DEEP = 50_000
#: Rows of an interval table up to which it may be broadcast (checked by a count bounded by this).
BROADCAST_ROWS = 200_000


def bins(start: Column, end: Column, width: int = BIN) -> Column:
    return F.sequence(F.floor(start / width), F.greatest(F.floor(end / width), F.floor(start / width)))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def deep_bins(left: DataFrame, right: DataFrame, l_keys: list[str], r_keys: list[str], deep: int) -> DataFrame:
    """l_keys, l_parts, r_parts: the keys (with bins) under which a side has more than ``deep`` rows, and in how many
    parts each side is to be cut. They are at most as many as the rows divided by ``deep``."""
    l, r = (df.select(*[F.col(k).alias(to) for k, to in zip(keys, l_keys, strict=True)], F.lit(side).alias("_r")) for df, keys, side in ((left, l_keys, 0), (right, r_keys, 1)))  # noqa: E741
    n = l.unionByName(r).groupBy(*l_keys).agg(F.sum(1 - F.col("_r")).alias("_nl"), F.sum("_r").alias("_nr"))
    parts = [F.greatest(F.ceil(F.col(c) / deep), F.lit(1)).cast("int").alias(to) for c, to in (("_nl", "l_parts"), ("_nr", "r_parts"))]
    return written(n.where((F.greatest("_nl", "_nr") > deep) & (F.least("_nl", "_nr") > 0)).select(*l_keys, *parts))


def _dealt(df: DataFrame, parts: DataFrame, keys: list[str], own: str, other: str, few: bool) -> DataFrame:
    """``df`` with ``own`` and ``other``: under a deep key a row is in one part of its own side, for each of the other."""
    named = parts.toDF(*[f"_d_{c}" for c in (*keys, "l_parts", "r_parts")])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k) == F.col(f"_d_{k}")
    met = df.join(F.broadcast(named) if few else named, on, "left")
    # a row keeps its part when its task is run again, as that follows from its values
    part = F.when(F.col(f"_d_{own}") > 1, F.pmod(F.xxhash64(*df.columns), f"_d_{own}").cast("int")).otherwise(0)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(f"_d_{other}", F.lit(1)) - 1))
    return met.withColumn(own, part).withColumn(other, every).drop(*named.columns)


def spread(left: DataFrame, right: DataFrame, l_keys: list[str], r_keys: list[str], deep: int) -> tuple[DataFrame, DataFrame, Column, list[str]]:
    """Both sides of a join on ``l_keys`` = ``r_keys``, the condition that joins them, and columns to drop after it.

    Keys are counted first, without any other column. One with more than ``deep`` rows of a side is cut into parts of
    about so many, and the rows of the other side go to each part, so a key with a third of all rows is as many tasks
    as its depth asks for, and each pair still meets once. Rows equal in every column share a part.
    """
    on = F.lit(True)
    for l, r in zip(l_keys, r_keys, strict=True):  # noqa: E741
        on &= F.col(l) == F.col(r)
    parts = deep_bins(left, right, l_keys, r_keys, deep)
    if parts.isEmpty():
        return left, right, on, []
    few = small(parts)
    a = _dealt(left, parts, l_keys, "l_parts", "r_parts", few)
    b = _dealt(right, parts, r_keys, "r_parts", "l_parts", few).withColumnsRenamed({"l_parts": "_l_parts", "r_parts": "_r_parts"})
    return a, b, on & (F.col("l_parts") == F.col("_l_parts")) & (F.col("r_parts") == F.col("_r_parts")), ["l_parts", "r_parts", "_l_parts", "_r_parts"]


def band_join(left: DataFrame, right: DataFrame, keys: list[str], l_start: str, l_end: str, r_start: str, r_end: str, width: int = BIN, deep: int = DEEP) -> DataFrame:
    """Pairs of overlapping intervals with equal ``keys`` (right's are named with r_ before).

    Either side is exploded to bins and joined on keys and bin; a pair counts in its first common bin alone, so no
    distinct is needed. A chromosome is many join keys then, which keeps large ones from landing in one task, and a bin
    of more than ``deep`` rows is cut into parts (``spread``).
    """
    a = left.withColumn("_bin", F.explode(bins(F.col(l_start), F.col(l_end), width)))
    b = right.withColumn("_bin_r", F.explode(bins(F.col(r_start), F.col(r_end), width)))
    a, b, on, more = spread(a, b, [*keys, "_bin"], [*(f"r_{k}" for k in keys), "_bin_r"], deep)
    on &= (F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end))
    first = F.greatest(F.floor(F.col(l_start) / width), F.floor(F.col(r_start) / width))
    return a.join(b, on & (F.col("_bin") == first)).drop("_bin", "_bin_r", *more)


def overlap_anti(left: DataFrame, mask: DataFrame, l_start: str, l_end: str, width: int = BIN, rows: int = BROADCAST_ROWS, deep: int = DEEP) -> DataFrame:
    """Rows of ``left`` (tid) that overlap no interval of ``mask`` (m_tid, m_start, m_end).

    A mask of ``rows`` intervals or fewer is broadcast; beyond that both sides meet by bins, deep ones in parts.
    """
    hit = (F.col("tid") == F.col("m_tid")) & (F.col("m_start") <= F.col(l_end)) & (F.col("m_end") >= F.col(l_start))
    if small(mask, rows):
        return left.join(F.broadcast(mask), hit, "left_anti")
    key = left.withColumn("_key", F.monotonically_increasing_id())
    a = key.select("tid", "_key", l_start, l_end, F.explode(bins(F.col(l_start), F.col(l_end), width)).alias("_bin"))
    b = mask.withColumn("_bin_m", F.explode(bins(F.col("m_start"), F.col("m_end"), width)))
    a, b, on, _ = spread(a, b, ["tid", "_bin"], ["m_tid", "_bin_m"], deep)
    bad = a.join(b, hit & on, "left_semi").select("_key").distinct()
    return key.join(bad, "_key", "left_anti").drop("_key")


def overlap_islands(df: DataFrame, partition: list[str], order: list[str], touch: bool, name: str = "island", chunk: Column | None = None) -> DataFrame:
    """Runs of overlapping intervals (start, end). With ``touch``, an equal end and start overlap too.

    ``chunk`` is a number that never falls along ``order``, by default the bin of the start. Rows are dealt by
    partition and chunk, so a chromosome is many tasks; what reaches into a chunk from those before comes from a table
    of one row a chunk. A run is named by the chunk in which it begins and its number there.
    """
    return _named_runs(_local_runs(df, partition, order, touch, chunk), partition, name)


def _local_runs(df: DataFrame, partition: list[str], order: list[str], touch: bool, chunk: Column | None = None) -> DataFrame:
    """Rows with chunk_keys and _run: the number of their run among those that begin in the chunk, 0 for one that began
    before it."""
    by = chunk_keys(partition)
    rows = keyed(df.withColumn("_chunk", (F.floor(F.col("start") / BIN) if chunk is None else chunk).cast("long")), partition)
    along = Window.partitionBy(*by[1:]).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*by).agg(F.max("end").alias("_end")).select(*by, F.max("_end").over(along).alias("_into"))
    inside = Window.partitionBy(*by).orderBy(*order)
    placed = rows.withColumn("_reach", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    reach = F.greatest("_reach", "_into")
    begins = (F.col("start") > reach) if touch else (F.col("start") >= reach)
    marked = with_chunk_columns(placed, before, partition).withColumn("_new", F.coalesce(begins, F.lit(True)).cast("int"))
    return marked.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach", "_into", "_new")


def _named_runs(rows: DataFrame, partition: list[str], name: str) -> DataFrame:
    """``name``: the chunk in which a run begins and its number there, for rows of ``_local_runs`` or sums of them by run."""
    by = chunk_keys(partition)
    along = Window.partitionBy(*by[1:]).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    number = F.when(F.col("_n") > 0, F.concat_ws("-", F.col("_chunk").cast("string"), F.col("_n").cast("string")))
    earlier = rows.groupBy(*by).agg(F.max("_run").alias("_n")).select(*by, F.last(number, ignorenulls=True).over(along).alias("_from"))
    own = F.concat_ws("-", F.col("_chunk").cast("string"), F.col("_run").cast("string"))
    return with_chunk_columns(rows, earlier, partition).withColumn(name, F.when(F.col("_run") > 0, own).otherwise(F.col("_from"))).drop(*by, "_run", "_from")


def run_sums(df: DataFrame, partition: list[str], order: list[str], touch: bool, more: list[Column], chunk: Column | None = None) -> DataFrame:
    """Sums of the runs of ``overlap_islands``: partition, island, start, end and ``more``. A run has a row for each
    chunk that it is in, which the caller sums up by partition and island."""
    by = chunk_keys(partition)
    local = _local_runs(df, partition, order, touch, chunk).groupBy(*by, *partition, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *more)
    return _named_runs(written(local), partition, "island")


def union(df: DataFrame, partition: list[str]) -> DataFrame:
    """Merged intervals: an interval joins the one before if it starts at or before its end."""
    runs = run_sums(df, partition, ["start", "end"], True, [])
    return runs.groupBy(*partition, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def split(blocks: DataFrame, points: DataFrame, partition: list[str]) -> DataFrame:
    """Cut every block at the points p with start < p <= end into [.., p - 1] and [p, ..]."""
    p = points.select(*[F.col(k).alias(f"p_{k}") for k in partition], F.col("point"), F.floor(F.col("point") / BIN).alias("_p"))
    b = blocks.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"))))
    on = (F.col("_bin") == F.col("_p")) & (F.col("point") > F.col("start")) & (F.col("point") <= F.col("end"))
    for k in partition:
        on &= F.col(k) == F.col(f"p_{k}")
    inside = b.join(p, on).select(*partition, "start", "end", "point")
    cuts = blocks.select(*partition, "start", "end", F.col("start").alias("point")).unionByName(inside).repartition(*partition, "start", "end").distinct()  # dealt once for both
    w = Window.partitionBy(*partition, "start", "end").orderBy("point")
    return cuts.select(*partition, F.col("point").alias("start"), F.coalesce(F.lead("point").over(w) - 1, F.col("end")).alias("end"))
