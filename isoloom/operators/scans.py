"""Ordered scans in two levels: what a row takes from those before it, without one task that sees all rows.

Rows are dealt by ``partition`` and by chunks of their order key ``ord``, so a file is many tasks. A chunk is summed up in
one row; what reaches into a chunk comes from these rows, and all else from the rows within it. Null keys are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order keys of a chunk: about a megabyte of lines, or a block of binary alignments.
ORDER_CHUNK = 1 << 20


def _chunked(rows: DataFrame, chunk: int, partition: list[str]) -> DataFrame:
    """``rows`` with their chunk, unless they have it from a scan before (``keep``)."""
    return rows if "_chunk" in rows.columns else keyed(rows.withColumn("_chunk", F.floor(F.col("ord") / chunk)), partition)


def chunk_keys(partition: list[str]) -> list[str]:
    """The columns of ``keyed`` by which rows are dealt."""
    return ["_chunk", *(f"_chunk_{k}{n}" for n in range(len(partition)) for k in "vz")]


def keyed(rows: DataFrame, partition: list[str]) -> DataFrame:
    """``rows`` (_chunk) with columns that are never null and stand for ``partition``, so that windows and joins over a
    chunk deal rows alike: a row is shuffled and sorted once for both."""
    types = dict((f.name, f.dataType) for f in rows.schema)
    rows = rows.withColumn("_chunk", F.coalesce("_chunk", F.lit(-(1 << 62))))
    return rows.withColumns({k: v for n, c in enumerate(partition) for k, v in ((f"_chunk_v{n}", F.coalesce(F.col(c), F.lit("0").cast(types[c]))), (f"_chunk_z{n}", F.col(c).isNull()))})


def with_chunk_columns(rows: DataFrame, chunks: DataFrame, partition: list[str]) -> DataFrame:
    """``rows`` with the further columns of their chunk; both are ``keyed``, so null keys are equal."""
    keys = chunk_keys(partition)
    return rows.join(chunks.select(*keys, *[c for c in chunks.columns if c not in keys and c not in partition]), keys)


def _joined(rows: DataFrame, chunks: DataFrame, partition: list[str]) -> DataFrame:
    """``rows`` with the further columns of their chunk, joined by its own keys: small tables of chunks are broadcast then. Null keys are equal."""
    keys = [*partition, "_chunk"]
    named = chunks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in chunks.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(named, on).drop(*[f"_k_{k}" for k in keys])


def carried(rows: DataFrame, values: dict[str, Column], partition: list[str] | None = None, chunk: int = ORDER_CHUNK) -> DataFrame:
    """``rows`` with a column for each of ``values``: its last value that is not null, at the row or before it."""
    keys = partition or []
    placed = rows.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_chunk", F.floor(F.col("ord") / chunk))
    last = [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("ord"))).alias(f"_l_{n}") for n in values]
    along = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    into = placed.groupBy(*keys, "_chunk").agg(*last).select(*keys, "_chunk", *[F.last(f"_l_{n}", ignorenulls=True).over(along).alias(f"_i_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumns({f"_v_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    both = _joined(found, into, keys).withColumns({n: F.coalesce(f"_v_{n}", f"_i_{n}") for n in values})
    return both.drop("_chunk", *[f"_{k}_{n}" for n in values for k in "vi"])


def runs(rows: DataFrame, value: str, name: str, partition: list[str] | None = None, chunk: int = ORDER_CHUNK) -> DataFrame:
    """``rows`` with ``name``: the order key with which the row's run of equal values begins; nulls are equal."""
    keys = partition or []
    by = chunk_keys(keys)
    inside = Window.partitionBy(*by).orderBy("ord")
    boxed = F.struct(F.col(value).alias("v"))  # a null value is not a missing one
    before = F.lag(boxed).over(inside)
    begins = before.isNotNull() & ~before["v"].eqNullSafe(F.col(value))
    marked = _chunked(rows, chunk, keys).withColumn("_begin", F.when(begins, F.col("ord")))
    ends = marked.groupBy(*by).agg(F.min("ord").alias("_first"), F.min_by(boxed, "ord").alias("_head"), F.max_by(boxed, "ord").alias("_tail"), F.max("_begin").alias("_last"))
    along = Window.partitionBy(*by[1:]).orderBy("_chunk")
    tail = F.lag("_tail").over(along)
    fresh = F.when(tail.isNull() | ~tail["v"].eqNullSafe(F.col("_head")["v"]), F.col("_first"))
    ends = ends.withColumn("_fresh", fresh).withColumn("_last", F.coalesce("_last", "_fresh"))
    into = F.coalesce("_fresh", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    open_ = ends.select(*by, into.alias("_into"))
    found = marked.withColumn("_begin", F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return with_chunk_columns(found, open_, keys).withColumn(name, F.coalesce("_begin", "_into")).drop(*by, "_begin", "_into")


def summed(rows: DataFrame, size: Column, name: str, partition: list[str] | None = None, chunk: int = ORDER_CHUNK, keep: bool = False) -> DataFrame:
    """``rows`` with ``name``: the sum of ``size`` (an integer) over the rows before, by ``ord``. With ``keep`` they stay
    dealt by chunks for a further scan over the same partition and chunk."""
    keys = partition or []
    by = chunk_keys(keys)
    placed = _chunked(rows.withColumn("_size", size.cast("long")), chunk, keys)
    along = Window.partitionBy(*by[1:]).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*by).agg(F.sum("_size").alias("_n")).select(*by, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_upto", F.sum("_size").over(inside))
    return with_chunk_columns(found, before, keys).withColumn(name, F.col("_upto") - F.col("_size") + F.col("_before")).drop(*([] if keep else by), "_size", "_upto", "_before")


def numbered(rows: DataFrame, name: str, partition: list[str] | None = None, chunk: int = ORDER_CHUNK) -> DataFrame:
    """``rows`` with ``name``: how many rows come before, by ``ord``."""
    return summed(rows, F.lit(1), name, partition, chunk)
