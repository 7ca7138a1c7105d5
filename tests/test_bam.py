"""BAM by ranges of bytes, and single files written by many tasks."""

import gzip
import io
import random
import struct

import pytest

from isoloom.sources import bam, sinks

REFS = [("chr1", 100_000), ("chr2", 5000)]


def record(rng, i, longest=3000):
    n, tid = rng.choice([0, 5, 50, 300, longest]), rng.choice([-1, 0, 1])
    name, cigar = f"read{i}".encode() + b"\0", [n << 4] if n else []
    bases, quality = bytes(rng.randrange(256) for _ in range((n + 1) // 2)), bytes(rng.randrange(40) for _ in range(n))
    body = struct.pack("<iiBBHHHiiii", tid, rng.randrange(4000) if tid >= 0 else -1, len(name), 60, 0, len(cigar), 0, n, -1, -1, 0)
    body += name + b"".join(struct.pack("<I", c) for c in cigar) + bases + quality + b"NMi" + struct.pack("<i", 3) + b"NHi" + struct.pack("<i", 1)
    return struct.pack("<i", len(body)) + body


def made(seed, n=3000, longest=3000):
    """A file of random blocks, and its records."""
    rng = random.Random(seed)
    records = [record(rng, i, longest) for i in range(n)]
    raw, out, at = bam.head_bytes(REFS) + b"".join(records), io.BytesIO(), 0
    while at < len(raw):
        size = rng.randrange(1, 60_000)
        out.write(bam.bgzf(raw[at : at + size]))
        at += size
        if rng.random() < 0.1:
            out.write(bam.END_BLOCK)  # blocks without data may stand anywhere
    out.write(bam.END_BLOCK)
    return out.getvalue(), [r[4:] for r in records]


@pytest.mark.parametrize(("seed", "n", "longest"), [(1, 3000, 3000), (2, 60, 150_000), (3, 0, 10)])
def test_any_cuts_give_the_same_records_and_keys(seed, n, longest):
    data, records = made(seed, n, longest)
    size, rng = len(data), random.Random(seed)
    whole = list(bam.range_records(io.BytesIO(data), size, 0, size))
    assert [r for _, r in whole] == records
    assert [k for k, _ in whole] == sorted({k for k, _ in whole})
    for _ in range(5):
        cuts = sorted({0, size, *(rng.randrange(1, size) for _ in range(rng.randrange(1, 30)))})
        assert [x for a, b in zip(cuts, cuts[1:]) for x in bam.range_records(io.BytesIO(data), size, a, b)] == whole


def test_damage_names_file_and_place():
    data, _ = made(4, 500)
    broken = bytearray(data)
    broken[len(data) // 2] ^= 255
    cut = data[: len(data) // 2]
    for bad in (bytes(broken), cut):
        with pytest.raises(ValueError, match=r"x\.bam: .* at byte \d+|x\.bam: no whole record in the block at byte \d+"):
            list(bam.range_records(io.BytesIO(bad), len(bad), 0, len(bad), "x.bam"))
    short = bam.bgzf(bam.head_bytes(REFS) + record(random.Random(1), 1)[:-3]) + bam.END_BLOCK
    with pytest.raises(ValueError, match="no whole record"):
        list(bam.range_records(io.BytesIO(short), len(short), 0, len(short), "x.bam"))


def test_magic_within_data_is_no_block():
    """Stored blocks whose data look like the heads of blocks."""
    fake = bam.MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0\x40\0" + b"\0" * 46
    stored = lambda d: struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(d) + 30) + b"\1" + struct.pack("<HH", len(d), len(d) ^ 0xFFFF) + d + struct.pack("<II", __import__("zlib").crc32(d), len(d))
    data = b"".join(stored(fake * k) for k in (3, 2, 4, 2, 5)) + bam.END_BLOCK
    starts, at = [], 0
    while at < len(data):
        starts.append(at)
        at += bam.block_size(data[at:])
    for start in range(len(data)):
        assert bam.first_block(io.BytesIO(data), start, len(data)) == next((s for s in starts if s >= start), len(data))


def test_ranges_in_spark(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    for k in (0, 1):
        (tmp_path / f"{k}.bam").write_bytes(made(k, 2000)[0])
    (tmp_path / "2.bam").write_bytes(gzip.compress(gzip.decompress(made(9, 40)[0])))  # not blocked
    whole = spark.read.format("bam").option("split", 1 << 40).load(str(tmp_path))
    parts = spark.read.format("bam").option("split", 50_000).load(str(tmp_path))
    assert whole.rdd.getNumPartitions() == 3 and parts.rdd.getNumPartitions() > 30
    rows = [sorted((r["ord"], r["qname"], bytes(r["raw"])) for r in x.collect()) for x in (whole, parts)]
    assert rows[0] == rows[1] and len(rows[0]) == 4040
    assert [r[1] for r in rows[0][:2000]] == [f"read{i}" for i in range(2000)]


def test_one_file_from_many_tasks(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    data, records = made(5, 2000)
    (tmp_path / "in.bam").write_bytes(data)
    rows = spark.read.format("bam").option("split", 50_000).load(str(tmp_path / "in.bam"))
    out = tmp_path / "out" / "all.bam"
    sinks.write_single_bam(rows.repartition(7), str(out), ["ord"], "chr1:100000,chr2:5000")
    written = out.read_bytes()
    assert written.endswith(bam.END_BLOCK)
    assert [r for _, r in bam.range_records(io.BytesIO(written), len(written), 0, len(written))] == records
    lines = spark.range(1000).selectExpr("id", "concat('line ', id) AS value").repartition(5)
    sinks.write_single(lines, str(tmp_path / "lines.txt"), ["id"], "head\n")
    sinks.write_single(lines, str(tmp_path / "lines.txt"), ["id"], "head\n")
    assert (tmp_path / "lines.txt").read_text() == "head\n" + "".join(f"line {k}\n" for k in range(1000))


def test_positions_beyond_the_length_are_read_by_any_cuts():
    """Ranges once took records beyond their sequence's length for no records, which a single range reads."""
    rng = random.Random(6)
    records = [record(rng, i, 300) for i in range(3000)]
    refs = [(n, 10) for n, _ in REFS]
    data = bam.bgzf_all(bam.head_bytes(refs) + b"".join(records)) + bam.END_BLOCK
    size = len(data)
    cuts = [*range(0, size, 40_000), size]
    assert len(cuts) > 4
    assert [x[1] for a, b in zip(cuts, cuts[1:]) for x in bam.range_records(io.BytesIO(data), size, a, b)] == [r[4:] for r in records]
