"""CIGAR arithmetic as Column builders over array<struct<op,len>>; all of it runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoloom.schema import CIGAR, EXONS, REVERSE

#: Operations that advance on the reference.
ON_REFERENCE = ["M", "D", "N", "=", "X"]
CLIPS = ["S", "H"]


def parse(text: Column) -> Column:
    """"5S10M" as an array; "*" or null is empty."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("*")), F.lit("[0-9]+[MIDNSHP=XB]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.regexp_extract(p, "^[0-9]+", 0).cast("int").alias("len")))


def text(cigar: Column) -> Column:
    joined = F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    return F.when(F.size(cigar) > 0, joined).otherwise(F.lit("*"))


def _sum(cigar: Column, ops: list[str]) -> Column:
    return F.aggregate(F.filter(cigar, lambda c: c["op"].isin(ops)), F.lit(0), lambda a, c: a + c["len"])


def reference_length(cigar: Column) -> Column:
    return _sum(cigar, ON_REFERENCE)


def count_ops(cigar: Column, op: str, least: int = 0) -> Column:
    """Operations of a kind with a length of ``least`` or more."""
    return F.size(F.filter(cigar, lambda c: (c["op"] == op) & (c["len"] >= least)))


def aligned_query_length(cigar: Column, l_qseq: Column) -> Column:
    """Query length without the outermost clip at either end (soft or hard)."""
    first, last = F.get(cigar, F.lit(0)), F.get(cigar, F.size(cigar) - 1)
    clip = lambda c: F.when(c["op"].isin(CLIPS), c["len"]).otherwise(0)
    return l_qseq - F.coalesce(clip(first), F.lit(0)) - F.when(F.size(cigar) > 1, clip(last)).otherwise(0)


def score(cigar: Column, l_qseq: Column, nm: Column) -> Column:
    """Aligned query length less the edit distance, with deletions counted back in."""
    return aligned_query_length(cigar, l_qseq) - F.coalesce(nm, F.lit(0)) + _sum(cigar, ["D"])


def strand(xs: Column, flag: Column) -> Column:
    """1 for the reverse strand: the XS tag if there is one, else the flag."""
    return F.when(xs.isNotNull(), (xs != "+").cast("int")).otherwise((flag.bitwiseAND(REVERSE) > 0).cast("int"))


def _walk(cigar: Column, pos: Column, min_intron: int, on_intron) -> Column:
    """Fold a CIGAR; ``start`` and ``end`` bound the block so far, on_intron(state, len) gives what ``out`` becomes."""
    zero = F.struct((pos + 1).cast("int").alias("start"), pos.cast("int").alias("end"), F.array().cast(EXONS).alias("out"))

    def step(s: Column, c: Column) -> Column:
        intron = (c["op"] == "N") & (c["len"] >= min_intron)
        end = s["end"] + F.when(c["op"].isin(ON_REFERENCE), c["len"]).otherwise(0)
        return F.struct(F.when(intron, s["end"] + c["len"] + 1).otherwise(s["start"]).alias("start"), end.alias("end"), F.when(intron, on_intron(s, c["len"])).otherwise(s["out"]).alias("out"))

    return F.aggregate(cigar, zero, step)


def _pair(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def exons(cigar: Column, pos: Column, min_exon: int = 3, min_intron: int = 3) -> Column:
    """Exon intervals. An internal exon shorter than ``min_exon`` is dropped, so the introns beside it fuse."""
    keep = lambda s: (F.size(s["out"]) == 0) | (s["end"] - s["start"] + 1 >= min_exon)
    state = _walk(cigar, pos, min_intron, lambda s, n: F.when(keep(s), F.array_append(s["out"], _pair(s["start"], s["end"]))).otherwise(s["out"]))
    return F.transform(F.array(state), lambda s: F.array_append(s["out"], _pair(s["start"], s["end"])))[0]


def introns(cigar: Column, pos: Column, min_intron: int = 3) -> Column:
    """Intron intervals; exon lengths play no part."""
    zero = F.struct(pos.cast("int").alias("end"), F.array().cast(EXONS).alias("out"))

    def step(s: Column, c: Column) -> Column:
        out = F.when((c["op"] == "N") & (c["len"] >= min_intron), F.array_append(s["out"], _pair(s["end"] + 1, s["end"] + c["len"]))).otherwise(s["out"])
        return F.struct((s["end"] + F.when(c["op"].isin(ON_REFERENCE), c["len"]).otherwise(0)).alias("end"), out.alias("out"))

    return F.aggregate(cigar, zero, step)["out"]


def matches_and_skips_only(cigar: Column) -> Column:
    return F.forall(cigar, lambda c: c["op"].isin("M", "N"))


def from_exons(exon: Column) -> Column:
    """The CIGAR of M and N whose exons these are."""
    blocks = F.transform(exon, lambda e, i: F.array(F.struct(F.lit("N").alias("op"), (e["start"] - F.get(exon, i - 1)["end"] - 1).alias("len")), F.struct(F.lit("M").alias("op"), (e["end"] - e["start"] + 1).alias("len"))))
    return F.filter(F.flatten(blocks), lambda c: c["len"].isNotNull()).cast(CIGAR)
