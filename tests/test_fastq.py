"""FASTQ in splits against a sequential reading."""

import random

import numpy as np
import pyarrow as pa
import pytest

from isoloom.sources import fastq as fq
from isoloom.sources import text


def sequential(lines):
    """name, seq, qual of lines, one after the other."""
    lines = iter(lines)
    line = next(lines, None)
    while line is not None:
        if line[:1] not in (">", "@"):
            line = next(lines, None)
            continue
        name = fq.name_of(line)
        seq = ""
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            seq += line
            line = next(lines, None)
        if line is None or line[0] != "+":
            yield name, seq, None
            continue
        qual = ""
        while (line := next(lines, None)) is not None:
            qual += line
            if len(qual) >= len(seq):
                break
        assert len(qual) == len(seq)
        yield name, seq, qual
        line = next(lines, None)


def hard_lines(rng, n):
    """Records whose quality lines are often like headers and marks, with empty lines, junk and FASTA records."""
    out = ["junk", ""] if rng.random() < 0.5 else []
    for k in range(n):
        size = rng.choice([0, 1, 2, 7, 30])
        wrap = rng.choice([1, 3, 50])
        cut = lambda s: [s[i : i + wrap] for i in range(0, len(s), wrap)]  # noqa: B023, E731
        seq = cut("".join(rng.choice("ACGT") for _ in range(size)))
        if rng.random() < 0.2:
            seq.insert(rng.randrange(len(seq) + 1), "")
        out += [f"{rng.choice('@>')}r{k} x", *seq]
        if rng.random() < 0.8:
            out += ["+" + rng.choice(["", f"r{k}"]), *(cut("".join(rng.choice("@>+Ié") for _ in range(size))) or [""])]
            out += ["not a header"] if rng.random() < 0.1 else []
    return out


def test_any_cut_gives_the_sequential_records():
    rng = random.Random(5)
    for _ in range(150):
        lines = hard_lines(rng, rng.choice([0, 1, 3, 12]))
        cuts = sorted({0, len(lines), *(rng.randrange(len(lines) + 1) for _ in range(rng.randrange(6)))})
        s, parts = fq.State(), []
        for lo, hi in zip(cuts, cuts[1:]):
            own, ords = pa.array(lines[lo:hi], pa.string()), np.arange(lo, hi)
            known = fq.Lines(own)
            left = fq.leave(s, fq.summary(known, ords))
            for edges in (False, True):
                found = fq.records(known, lines[lo:hi], ords, s, edges)
                try:
                    while True:
                        parts.append(next(found))
                except StopIteration as end:
                    assert end.value == left
            s = left
        whole = {}
        for record, _, name, seq, qual in sorted(parts, key=lambda p: p[:2]):
            n, a, q = whole.get(record, (None, "", None))
            whole[record] = (n or name, a + seq, q if qual is None else (q or "") + qual)
        assert [(n or "", a, q) for _, (n, a, q) in sorted(whole.items())] == list(sequential(lines))


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "8"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_file_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(8)
    want = []
    for name in ("a", "b"):
        lines = hard_lines(rng, 700)
        # a record over many splits
        lines += ["@long", *["ACGTACGTAC"] * 1000, "+", *["@>+IIIIIII"] * 1000, "@last", "A", "+", "@"]
        (tmp_path / f"{name}.fq").write_text("\n".join(lines) + "\n")
        want += [(f"{name}.fq", *r) for r in sequential(lines)]
    for chunk in (text.FASTQ_CHUNK, 200):
        rows = text.fastq(spark, str(tmp_path), chunk)
        assert sorted((r["file"].rsplit("/", 1)[1], r["name"], r["seq"], r["qual"] or "") for r in rows.collect()) == sorted((f, n, s, q or "") for f, n, s, q in want)
    assert spark.read.text(str(tmp_path / "a.fq")).rdd.getNumPartitions() > 8


def test_splits_beyond_the_broadcast_bound(spark, tmp_path, small_splits, monkeypatch):
    lines = hard_lines(random.Random(9), 900)
    (tmp_path / "a.fq").write_text("\n".join(lines))
    monkeypatch.setattr(text, "small", lambda df: False)
    got = text.fastq(spark, str(tmp_path)).select("name", "seq", "qual").collect()
    assert sorted((r[0], r[1], r[2] or "") for r in got) == sorted((n, s, q or "") for n, s, q in sequential(lines))


def test_empty_and_damaged_files(spark, tmp_path, small_splits):
    (tmp_path / "none.fq").write_text("")
    assert text.fastq(spark, str(tmp_path / "none.fq")).count() == 0
    for k, bad in enumerate(["@a\nACGT\n+\nIIIII\n@b\nA\n+\nI\n", "@a\nACGT\n+\nII\n"]):
        (tmp_path / f"bad{k}.fq").write_text(bad)
        with pytest.raises(Exception, match="the quality of a has"):
            text.fastq(spark, str(tmp_path / f"bad{k}.fq")).collect()
