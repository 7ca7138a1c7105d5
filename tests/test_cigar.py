"""Hand-computed CIGAR cases."""

import pytest
from pyspark.sql import functions as F

from isoloom.functions import cigar as cg


def one(spark, cigar, *cols):
    return spark.createDataFrame([(cigar,)], "c string").select(cg.parse(F.col("c")).alias("c")).select(*cols).first()


@pytest.mark.parametrize(
    ("cigar", "pos", "exons", "introns"),
    [
        ("5S10M100N2M50N3D20M", 100, [(101, 110), (263, 285)], [(111, 210), (213, 262)]),
        ("10M2N10M", 0, [(1, 22)], []),
        ("2M10N20M", 5, [(6, 7), (18, 37)], [(8, 17)]),
        ("10M", 7, [(8, 17)], []),
        ("5H5M3I5=2X4D1P10M5H", 0, [(1, 26)], []),
    ],
)
def test_blocks(spark, cigar, pos, exons, introns):
    r = one(spark, cigar, cg.exons(F.col("c"), F.lit(pos)).alias("e"), cg.introns(F.col("c"), F.lit(pos)).alias("i"))
    assert [tuple(x) for x in r["e"]] == exons
    assert [tuple(x) for x in r["i"]] == introns


def test_measures(spark):
    r = one(spark, "5S10M100N2M50N3D20M4H", cg.reference_length(F.col("c")), cg.count_ops(F.col("c"), "N", 60), cg.aligned_query_length(F.col("c"), F.lit(40)), cg.score(F.col("c"), F.lit(40), F.lit(2)), cg.text(F.col("c")))
    assert tuple(r) == (185, 1, 31, 32, "5S10M100N2M50N3D20M4H")
    assert one(spark, "*", cg.text(F.col("c")), cg.reference_length(F.col("c"))) == ("*", 0)
    assert one(spark, "7S", cg.aligned_query_length(F.col("c"), F.lit(10)))[0] == 3


def test_strand(spark):
    df = spark.createDataFrame([("-", 0), ("+", 16), (None, 16), (None, 0), ("?", 0)], "xs string, flag int")
    assert [r[0] for r in df.select(cg.strand(F.col("xs"), F.col("flag"))).collect()] == [1, 0, 1, 0, 1]


def test_round_trip(spark):
    df = spark.createDataFrame([([(11, 40), (100, 130), (200, 209)],)], "e array<struct<start:int,end:int>>")
    c = df.select(cg.from_exons(F.col("e")).alias("c"))
    assert [tuple(x) for x in c.select(cg.exons(F.col("c"), F.lit(10))).first()[0]] == [(11, 40), (100, 130), (200, 209)]
