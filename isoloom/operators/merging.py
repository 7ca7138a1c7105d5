"""The ordered merge of novel transcripts.

Reads go by start along a chromosome. A read looks at the kept transcripts from the newest back: one of its own introns
takes it (coverage, end), one that holds its chain or is held by it drops it, and one that ends before the read starts
ends the search; a read that finds none is kept if it may be (``emit``).

How chains relate does not depend on the order, so distinct chains are joined once, by an index of their introns. A read
then needs three things only: the newest kept transcript related to its chain, which each newly kept one tells its
related chains; and the newest kept one that has ended. So the walk is linear. Reads are dealt by ranges of their place,
in blocks of bounded size; a locus (a run of overlapping reads) that lies in several blocks is settled in as many rounds,
each block taking over what the one before has left open. Nearly all loci need one round.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from isoloom.operators.intervals import overlap_islands
from isoloom.schema import UpdateParams
from isoloom.storage import written

_STATE = "kind string, tx long, tid int, locus string, start int, end int, cid string, cov long"


def chain_of(exons: Column) -> Column:
    """Introns as numbers: the end of the exon before in the high half, the start of the one after in the low half."""
    at = lambda i: F.shiftleft(F.get(exons, i)["end"].cast("long"), 32) + F.get(exons, i + 1)["start"]
    return F.transform(F.sequence(F.lit(0), F.size(exons) - 2), at)


def _site(intron: Column) -> tuple[Column, Column]:
    return F.shiftright(intron, 32), intron.bitwiseAND(0xFFFFFFFF)


def _near(x: Column, y: Column, distance: int) -> Column:
    (a, b), (c, d) = _site(x), _site(y)
    return (F.abs(a - c) <= distance) & (F.abs(b - d) <= distance)


def relations(chains: DataFrame, distance: int = 0) -> DataFrame:
    """a, b, same: a read of chain ``a`` meets a kept transcript of another chain ``b`` (cid, tid, is_rev, chain, emit)
    that has the same introns within ``distance``, or of which one holds the other.

    The shorter chain (of equal ones the read's) begins at an intron of the longer one, the first that fits, and follows
    it until either runs out. Candidates come from an index of introns: exact ones by two introns in a row, so that a
    common first intron is no hot key by itself; near ones by buckets of the first donor.
    """
    n = F.size("chain")
    key = ["tid", "is_rev"]
    if distance == 0:
        pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        one, end = F.lit(-1).cast("long"), F.lit(-2).cast("long")
        first = F.when(n == 1, F.array(pair(F.get("chain", F.lit(0)), one))).otherwise(F.array(pair(F.get("chain", F.lit(0)), F.get("chain", F.lit(1))), pair(F.get("chain", F.lit(0)), end)))
        inner = F.flatten(F.transform("chain", lambda x, i: F.array(pair(x, one), pair(x, F.coalesce(F.get("chain", i + 1), end)))))
    else:
        bucket = lambda x: F.floor(_site(x)[0] / (2 * distance + 1))
        first = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: bucket(F.get("chain", F.lit(0))) + k)
        inner = F.transform("chain", bucket)
    short = chains.select(*[F.col(c).alias(f"s_{c}") for c in (*key, "cid", "chain", "emit")], n.alias("s_n"), F.explode(first).alias("s_key"))
    long = chains.select(*[F.col(c).alias(f"l_{c}") for c in (*key, "cid", "chain", "emit")], n.alias("l_n"), F.posexplode(inner).alias("p", "l_key"))
    on = (F.col("s_key") == F.col("l_key")) & (F.col("s_n") <= F.col("l_n")) & (F.col("s_cid") != F.col("l_cid")) & (F.col("s_emit") | F.col("l_emit"))
    for k in key:
        on &= F.col(f"s_{k}") == F.col(f"l_{k}")
    met = short.join(long, on)
    if distance == 0:
        met = met.withColumn("p", F.floor(F.col("p") / 2).cast("int"))
    else:
        met = met.where(_near(F.get("s_chain", F.lit(0)), F.get("l_chain", F.col("p")), distance))
        names = ["s_chain", "l_chain", "s_n", "l_n", "s_emit", "l_emit"]
        met = met.groupBy("s_cid", "l_cid").agg(F.min("p").alias("p"), *[F.first(c).alias(c) for c in names])
    size = F.least(F.col("s_n"), F.col("l_n") - F.col("p"))
    if distance == 0:
        follows = F.slice("l_chain", F.col("p") + 1, size) == F.slice("s_chain", F.lit(1), size)
    else:
        follows = F.forall(F.sequence(F.lit(0), size - 1), lambda j: _near(F.get("s_chain", j), F.get("l_chain", F.col("p") + j), distance))
    same = (F.col("s_n") == F.col("l_n")) & (F.col("p") == 0)
    held = met.where(follows).select("s_cid", "l_cid", "s_n", "l_n", "s_emit", "l_emit", same.alias("same"))
    down = held.where("l_emit").select(F.col("s_cid").alias("a"), F.col("l_cid").alias("b"), "same")
    up = held.where("s_emit AND s_n < l_n").select(F.col("l_cid").alias("a"), F.col("s_cid").alias("b"), "same")
    return down.unionByName(up)


class Walk:
    """The kept transcripts of a chromosome's stretch, from the first read on."""

    def __init__(self, related: dict[str, list[tuple[str, bool]]]):
        self.related = related
        self.kept: list[list] = []  # tx, start, end, cid, cov, whether it was kept here
        self.newest: dict[str, tuple[int, bool]] = {}
        self.ends: list[tuple[int, int]] = []
        self.ended = -1

    def keep(self, tx: int, start: int, end: int, cid: str, cov: int, here: bool) -> None:
        k = len(self.kept)
        self.kept.append([tx, start, end, cid, cov, here])
        for other, same in self.related.get(cid, ()):
            self.newest[other] = k, same
        self.newest[cid] = k, True
        heapq.heappush(self.ends, (end, k))

    def read(self, tx: int, start: int, end: int, cid: str, emit: bool) -> None:
        while self.ends and self.ends[0][0] < start:
            was, k = heapq.heappop(self.ends)
            if self.kept[k][2] > was:
                heapq.heappush(self.ends, (self.kept[k][2], k))
            else:
                self.ended = max(self.ended, k)
        k, same = self.newest.get(cid, (-1, False))
        if k < 0 or k < self.ended:
            if emit:
                self.keep(tx, start, end, cid, 1, True)
        elif same:
            t = self.kept[k]
            t[4] += 1
            if end > t[2]:
                t[2] = end
                if k == self.ended:  # within a distance a read may start behind the end of its like
                    heapq.heappush(self.ends, (end, k))
                    self.ended = max((j for j, x in enumerate(self.kept) if x[2] < start), default=-1)

    def open(self, start: int) -> list[list]:
        """What a read from ``start`` on may still find."""
        return [t for k, t in enumerate(self.kept) if t[2] >= start or k == self.ended]


def _settle(rows: pa.Table, other: pa.Table) -> pa.Table:
    related: dict[str, list[tuple[str, bool]]] = defaultdict(list)
    begun = []
    for kind, a, b, same, tx, start, end, cid in zip(*(other.column(c).to_pylist() for c in ("kind", "a", "b", "same", "o_tx", "o_start", "o_end", "o_cid")), strict=True):
        if kind == "relation":
            related[b].append((a, same))
        else:
            begun.append((start, tx, end, cid))
    out: list[tuple] = []
    walk, tid, locus, start = None, None, None, 0

    def close(last: bool) -> None:
        for t in walk.kept:
            if t[4]:
                out.append(("kept" if t[5] else "more", t[0], tid, None, t[1], t[2], None, t[4]))
        if last:
            out.extend(("open", t[0], tid, locus, t[1], t[2], t[3], 0) for t in walk.open(start))

    ordered = rows.select(["tid", "start", "tx", "end", "cid", "emit", "locus"]).sort_by([("tid", "ascending"), ("start", "ascending"), ("tx", "ascending")])
    for b in ordered.to_batches(max_chunksize=10_000):
        for t, start, tx, end, cid, emit, locus in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if walk is None or t != tid:
                if walk is not None:
                    close(False)
                tid, walk = t, Walk(related)
                for s, x, e, c in sorted(begun):
                    walk.keep(x, s, e, c, 0, False)
                begun = []
            walk.read(tx, start, end, cid, emit)
    if walk is not None:
        close(True)
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _STATE.split(", ")])


def merge(flags: DataFrame, params: UpdateParams, blocks: int | None = None) -> DataFrame:
    """Kept novel transcripts with coverage, of classified reads. ``blocks`` is their number, by default as Spark deals
    ranges."""
    names = ["chr", "new_gene_id", "new_gene_name", "transcript_id", "transcript_name"]
    # 128 bits of a digest: chains are known by it in all that is shuffled below
    digest = F.sha2(F.concat_ws(",", "tid", "is_rev", F.array_join(F.transform("chain", lambda x: x.cast("string")), ",")), 256)
    cid = F.base64(F.substring(F.unhex(digest), 1, 16))
    reads = flags.where(F.size("exons") > 1).withColumn("chain", chain_of(F.col("exons"))).withColumn("cid", cid)
    whole = written(reads.select("tx", "tid", "is_rev", "start", "end", "exons", "emit", "all_novel", "cid", *names))
    chains = whole.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("tid", "is_rev", "exons")], F.bool_or("emit").alias("emit"))
    chains = chains.select("cid", "tid", "is_rev", chain_of(F.col("exons")).alias("chain"), "emit")
    if params.distance == 0:
        chains = chains.where("emit")
    chains = written(chains)
    related = written(relations(chains, params.distance))
    asked = chains.where("emit").select("cid") if params.distance == 0 else chains.where("emit").select("cid").union(related.select("a")).distinct()
    slim = whole.select("tx", "tid", "start", "end", "cid", "emit").join(asked, "cid", "left_semi")
    placed = overlap_islands(slim, ["tid"], ["start", "end", "tx"], touch=True, name="locus")
    order = ["tid", "start", "tx"]
    dealt = placed.repartitionByRange(blocks, *order) if blocks else placed.repartitionByRange(*order)
    placed = written(dealt.withColumn("block", F.spark_partition_id()))
    turn = F.row_number().over(Window.partitionBy("tid", "locus").orderBy("block")) - 1
    later = written(placed.select("tid", "locus", "block").distinct().withColumn("turn", turn).where("turn > 0"))  # one row a block at most
    rows = placed.join(F.broadcast(later), ["tid", "locus", "block"], "left").fillna(0, ["turn"])
    here = placed.select("block", "cid").distinct()
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("o_tx", "long"), ("o_start", "int"), ("o_end", "int"), ("o_cid", "string"))]
    known = related.join(here, F.col("a") == F.col("cid")).select(F.col("block").alias("o_block"), F.lit("relation").alias("kind"), "a", "b", "same", *nulls)
    last = later.agg(F.max("turn")).first()[0] or 0
    found, result = None, None
    for k in range(last + 1):
        other = known
        if found is not None:
            to = later.where(F.col("turn") == k).select(F.col("tid").alias("t_tid"), F.col("locus").alias("t_locus"), F.col("block").alias("o_block"))
            state = found.where("kind = 'open'").join(F.broadcast(to), (F.col("tid") == F.col("t_tid")) & (F.col("locus") == F.col("t_locus")))
            empty = [F.lit(None).cast(t).alias(c) for c, t in (("a", "string"), ("b", "string"), ("same", "boolean"))]
            other = known.unionByName(state.select("o_block", "kind", *empty, F.col("tx").alias("o_tx"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("cid").alias("o_cid")))
        turn_rows = rows.where(F.col("turn") == k)
        other = other.join(F.broadcast(turn_rows.select(F.col("block").alias("o_block")).distinct()), "o_block", "left_semi") if k else other
        found = written(turn_rows.groupBy("block").cogroup(other.groupBy("o_block")).applyInArrow(_settle, _STATE))
        part = found.where("kind <> 'open'").select("tx", "end", "cov")
        result = part if result is None else result.unionByName(part)
    sums = result.groupBy("tx").agg(F.max("end").alias("_end"), F.sum("cov").alias("cov"))
    kept = whole.where("emit").drop("end", "emit", "cid").join(sums, "tx")
    last_exon = F.element_at("exons", -1)
    stretched = F.concat(F.slice("exons", F.lit(1), F.size("exons") - 1), F.array(F.struct(last_exon["start"].alias("start"), F.col("_end").alias("end"))))
    return kept.select("tx", "tid", "is_rev", "cov", "all_novel", stretched.alias("exons"), "chr", "transcript_id", "transcript_name", "start", F.col("_end").alias("end"), F.col("new_gene_id").alias("gene_id"), F.col("new_gene_name").alias("gene_name"))
