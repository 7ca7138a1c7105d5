"""Shared storage and Arrow plumbing of the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoloom.storage import shared_folder


def small_batches(df: DataFrame, most: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch, as 10,000 whole texts are a large share of a task's memory.

    Plans run after their operator has returned, so the bound stays in the session; a smaller one of the user's holds.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key)
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > most:
        df.sparkSession.conf.set(key, str(most))


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(keys: DataFrame, most: int) -> DataFrame:
    """Distinct ``keys``, written; marked for broadcast if they are ``most`` rows or fewer, so that texts can stay put."""
    keys = written(keys.distinct())
    return F.broadcast(keys) if keys.count() <= most else keys


#: Rows of a table of sums up to which it is broadcast.
BROADCAST_SUMS = 100_000


def running(rows: DataFrame, group: list[str], order: list[str | Column], size: str | None = None) -> DataFrame:
    """``rows`` with ``before``: the sum of ``size`` (null: a row counts 1) over the rows of its ``group`` that precede it.

    The rows are dealt by ranges of group and order, so a hot group spreads over many tasks. A task sums its own rows;
    the sums of whole tasks, one row for each task and group in it, are then added up. ``order`` must tell all rows
    apart that may not trade places.
    """
    places = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    counted = places.select(*rows.columns, (F.col(size) if size else F.lit(1)).cast("long").alias("_n"), F.spark_partition_id().alias("_task"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            n = b.column(len(b.schema) - 2).to_numpy(zero_copy_only=False)
            upto = np.cumsum(n) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - n, pa.int64())], [*b.schema.names, "_at"])
            total = int(upto[-1]) if len(upto) else total

    placed = written(counted.mapInArrow(sum_up, f"{fields}, _at long"))
    mine = [F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]
    keys = [f"_g{k}" for k in range(len(group))]
    sums = placed.groupBy(F.col("_task").alias("_part"), *mine).agg(F.min("_at").alias("_first"), F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("_prior", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))))
    on = F.col("_task") == F.col("_part")
    for g, k in zip(group, keys, strict=True):
        on &= F.col(g).eqNullSafe(F.col(k))
    found = placed.join(F.broadcast(sums) if sums.count() <= BROADCAST_SUMS else sums, on)
    return found.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_prior")).alias("before"))


#: Steps of a rank to a factor of two in the share of rows: a step has 19 percent more rows than all before it.
STEPS = 4


def ranked_sample(rows: DataFrame, most: int) -> dict[str, list[str]]:
    """For each ``kind`` of ``rows`` (kind, doc_id, text) distinct whole texts in hash order, up to about ``most`` bytes:
    the first text always, then those that still fit.

    How far down the ranks a kind has to go is read off sums over steps of the rank, so only that much reaches the
    driver. Rows equal in doc_id and text count once; where such rows fill a kind's share, it goes on down.
    """
    share = F.xxhash64("doc_id", "text").cast("double") / 2.0**64 + 0.5
    ranked = rows.where("text IS NOT NULL").select("kind", "text", share.alias("share"))
    ranked = ranked.withColumn("step", F.floor(-F.log2(F.greatest("share", F.lit(2.0**-60))) * STEPS).cast("int"))
    sums: dict[str, dict[int, int]] = {}
    for r in ranked.groupBy("kind", "step").agg(F.sum(F.octet_length("text")).alias("n")).collect():  # 240 rows a kind at most
        sums.setdefault(r["kind"], {})[r["step"]] = r["n"]
    got: dict[str, list[tuple[float, str]]] = {k: [] for k in sorted(sums)}
    size, below = dict.fromkeys(got, 0), {k: math.inf for k in got}
    open_ = [k for k in got if sums[k]]
    while open_:
        limits = []
        for kind in open_:
            more, least = 0, below[kind]
            for step in sorted((x for x in sums[kind] if x < below[kind]), reverse=True):
                more, least = more + sums[kind][step], step
                if size[kind] + more >= most:
                    break
            limits.append((kind, int(least), int(min(below[kind], 1 << 30))))
            below[kind] = least
        wanted = rows.sparkSession.createDataFrame(limits, "kind string, least int, below int")
        found = ranked.join(F.broadcast(wanted), "kind").where("step >= least AND step < below").select("kind", "share", "text")  # a row a kind
        for r in found.dropDuplicates(["kind", "share", "text"]).collect():
            got[r["kind"]].append((r["share"], r["text"]))
            size[r["kind"]] += len(r["text"].encode())
        open_ = [k for k in open_ if size[k] < most and any(x < below[k] for x in sums[k])]
    out: dict[str, list[str]] = {}
    for kind, texts in got.items():
        used = 0
        for _, text in sorted(texts):
            n = len(text.encode())
            if not used or used + n <= most:
                out.setdefault(kind, []).append(text)
                used += n
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (rows + 1); nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each (one row at least), so that scratch arrays stay small."""
    _, offsets = text_buffer(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def per_row(values: np.ndarray, first: np.ndarray, how=np.add) -> np.ndarray:
    """Reduce values of consecutive rows; ``first`` has rows + 1 bounds; empty rows give 0."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = how.reduceat(values, first[:-1][full])
    return out
