"""Operator 13: mixing sources to target weights.

The words of a source, document after document by doc_id, are packed into blocks of a fixed length (its last one is what
is left). Targets give each source a number of slots in the mix. They are drawn onto output shards: halving a range of
shards splits a source's slots by a binomial draw whose seed is the range, so the counts of all shards are one
multinomial draw for each source, any task can draw its own shards, and the slots of a source always add up to its
target. Slot j of a source holds block P(j mod n) of its n blocks, where P is a pseudorandom permutation of indices of
its own for each pass j // n (a Feistel network, walked until it falls into range); slots and blocks meet by index.

Only words are counted, so texts are read once and never move. Within a shard, slots of all sources are shuffled by one
more such permutation.

Cases: null or empty text has size 0 and takes nothing; a null source is one of its own, the last; equal doc_ids follow by
size and each take their own; sources without words have target 0; an empty table gives no row; further columns are
ignored. One row a source goes through the task that numbers and weighs sources; nothing else meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoloom.llm.common import BROADCAST_SUMS, running, written

#: Words of a block.
BLOCK = 64
#: Slots of an output shard, about.
SHARD = 1 << 16
#: Weights of the sources in order, repeating; and how often at most a source's words are taken.
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 13
#: Shards that one row asks a task to draw; tasks at most that fill slots.
DRAWN, TASKS = 1 << 12, 10_000
_ROUNDS = 4
_U = np.uint64


def words(text: Column) -> Column:
    """The number of runs of letters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``totals`` (source, source_size) with k (place by code point, null last) and target.

    Targets share all words by weight. One that would exceed ``most`` times its source stops there, and the others share
    what it leaves by their weights, until none is above. With sources in the order in which a rising level of words a
    unit of weight fills them up, the full ones are a head of the list, so sums along it give the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double")
    rows = totals.withColumn("k", F.row_number().over(by_name) - 1).withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    rows = rows.withColumn("_full", F.col("_cap") / F.col("_w"))
    upto, every = Window.orderBy("_full", "k").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    rows = rows.withColumns({"_caps": F.sum("_cap").over(upto), "_ws": F.sum("_w").over(upto), "_all": F.sum(F.col("source_size").cast("double")).over(every), "_w_all": F.sum("_w").over(every)})
    rows = rows.withColumn("_is_full", F.col("_caps") + F.col("_full") * (F.col("_w_all") - F.col("_ws")) <= F.col("_all"))
    left = F.col("_all") - F.sum(F.when(F.col("_is_full"), F.col("_cap")).otherwise(0.0)).over(every)
    share = F.sum(F.when(F.col("_is_full"), 0.0).otherwise(F.col("_w"))).over(every)
    target = F.when(F.col("_is_full"), F.col("_cap")).otherwise(left * F.col("_w") / F.nullif(share, F.lit(0.0)))
    return rows.select("source", "k", "source_size", target.alias("target"))


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit words, well mixed with a key."""
    x = (x ^ _U(key)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def permuted(index: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of range(size) sends each index; ``keys`` (one for each index) name it.

    A Feistel network over the least even number of bits; what falls outside goes through it again.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = _U((1 << half) - 1)
    out, open_ = index.astype(np.uint64), np.arange(len(index))
    while len(open_):
        left, right, key = out[open_] >> _U(half), out[open_] & low, keys[open_].astype(np.uint64)
        for r in range(_ROUNDS):
            left, right = right, left ^ (mixed(right ^ (key << _U(8)), r + 1) & low)
        out[open_] = left << _U(half) | right
        open_ = open_[out[open_] >= size]
    return out.astype(np.int64)


def drawn(k: int, slots: int, shards: int, first: int, last: int, seed: int = SEED) -> Iterator[tuple[int, int, int]]:
    """shard, slots in it and slots before it, of source ``k``, for shards ``first`` to ``last`` - 1."""
    todo = [(0, shards, slots, 0)]
    while todo:
        a, b, n, before = todo.pop()
        if not n or b <= first or a >= last:
            continue
        if b - a == 1:
            yield a, n, before
            continue
        middle = (a + b) // 2
        head = int(np.random.default_rng([seed, k, a, b]).binomial(n, (middle - a) / (b - a)))
        todo += [(middle, b, n - head, before + head), (a, middle, head, before)]


def draws(sources: DataFrame, slots: int, shard: int = SHARD) -> DataFrame:
    """k, shard, n, before, blocks: the slots that each output shard has of each source (k, blocks, slots)."""
    shards = max(1, -(-slots // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, blocks, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = np.array(list(drawn(k, n, shards, first, min(first + DRAWN, shards))), np.int64).reshape(-1, 3)
                whole = np.ones(len(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (whole * k, *found.T, whole * blocks)], ["k", "shard", "n", "before", "blocks"])

    asked = sources.select("k", "blocks", "slots", F.explode(F.sequence(*(F.lit(x).cast("long") for x in (0, shards - 1, DRAWN)))).alias("first"))
    return asked.repartition("k", "first").mapInArrow(run, "k long, shard long, n long, before long, blocks long")


def slot_table(drawn_slots: DataFrame, tasks: int, seed: int = SEED) -> DataFrame:
    """shard, slot, k, block, pass: what stands in each slot of each output shard, by that many tasks."""
    ahead = Window.partitionBy("shard").orderBy("k")
    # a row is thousands of slots, so the number of tasks must not follow from the bytes of the rows
    rows = drawn_slots.repartition(tasks, "shard").withColumn("ahead", F.sum("n").over(ahead) - F.col("n")).withColumn("in_shard", F.sum("n").over(Window.partitionBy("shard")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, shard, n, before, blocks, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for a in range(0, n, 1 << 16):
                    j = np.arange(a, min(n, a + (1 << 16)), dtype=np.int64)
                    slot = permuted(start + j, size, np.full(len(j), shard * 2 + 1 + (seed << 40)))
                    turn, at = np.divmod(before + j, blocks)
                    block = permuted(at, blocks, (turn << 32) + k * 2 + (seed << 40))
                    one = np.ones(len(j), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (one * shard, slot, one * k, block, turn)], ["shard", "slot", "k", "block", "pass"])

    return rows.select("k", "shard", "n", "before", "blocks", "ahead", "in_shard").mapInArrow(run, "shard long, slot long, k long, block long, pass long")


def pieces(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``sized`` (source's k, size, before in the source) for each block that they reach, with ``block``,
    ``start`` in the row and ``length`` there; rows of size 0 have one with a null block."""
    end = F.col("before") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("before") / block), F.floor((end - 1) / block)))
    rows = sized.select("*", F.explode_outer(blocks).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("before"), F.lit(0).cast("long"))
    stop = F.least((F.col("block") + 1) * block - F.col("before"), F.col("size"))
    return rows.withColumns({"start": start, "length": stop - start})


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The pieces of the documents (doc_id, source, k, size, source_size, target, tie, block, start, length), and what
    stands in the mix: shard, slot, k, block, pass. They meet by k and block."""
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("tie")))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    blocks = F.ceil(F.col("source_size") / block)
    wanted = F.coalesce(F.round(F.col("target") * blocks / F.nullif(F.col("source_size"), F.lit(0).cast("long"))), F.lit(0)).cast("long")
    aims = written(aims.withColumn("blocks", blocks).withColumn("slots", F.least(wanted, MOST * blocks)))
    whole = aims.agg(F.sum("slots"), F.count("*")).first()
    placed = running(sized, ["source"], ["doc_id", "size", "tie"], "size")
    names = aims.select(F.col("source").alias("_source"), "k", "source_size", "target")
    named = placed.join(F.broadcast(names) if whole[1] <= BROADCAST_SUMS else names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    slots = whole[0] or 0
    tasks = min(TASKS, max(1, -(-slots // shard)))
    return pieces(named, block), slot_table(draws(aims.where("slots > 0"), slots, shard), tasks, seed)


def taken(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each row of ``docs``, repeats counted."""
    parts, slots = mix(docs, block, shard, seed)
    # as many rows as blocks, though they come from a few rows of draws: never to be broadcast by that estimate
    times = slots.groupBy("k", "block").agg(F.count("*").alias("times")).hint("merge")
    rows = parts.join(times, ["k", "block"], "left").groupBy("tie").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.coalesce(F.sum(F.col("length") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    return rows.drop("tie")
