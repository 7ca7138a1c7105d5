"""The ordered merge against the walk that looks at every kept transcript, in one block and in many."""

import random

import pytest

from isoloom.operators import merging, novelty
from isoloom.schema import UpdateParams

FLAGS = "tx long, tid int, is_rev int, start int, end int, exons array<struct<start:int,end:int>>, emit boolean, all_novel boolean, chr string, new_gene_id string, new_gene_name string, transcript_id string, transcript_name string"


def walk(rows, d):
    """tx, coverage and end of what is kept, looking from the newest back at each read."""
    out = []
    for tid in {r[1] for r in rows}:
        kept = []
        for tx, _, rev, start, end, exons, emit in sorted((r[:7] for r in rows if r[1] == tid), key=lambda r: (r[3], r[0])):
            if len(exons) < 2:
                continue
            for t in reversed(kept):
                if t[1] == rev and novelty.same_chain(exons, t[2], d):
                    t[4] += 1
                    t[3] = max(t[3], end)
                    break
                if t[1] == rev and novelty.contains_chain(exons, t[2], d):
                    break
                if start > t[3]:
                    if emit:
                        kept.append([tx, rev, exons, end, 1])
                    break
            else:
                if emit:
                    kept.append([tx, rev, exons, end, 1])
        out += [(t[0], t[4], t[3]) for t in kept]
    return sorted(out)


def made(seed, n, span, jitter):
    """Reads of a few gene models: runs of their exons, some with an exon less, ends and sites moved."""
    rng, rows = random.Random(seed), []
    models = []
    for _ in range(max(3, n // 40)):
        at, model = rng.randrange(span), []
        for _ in range(rng.randint(2, 9)):
            model.append((at, at + rng.choice([20, 40])))
            at += rng.choice([60, 90])
        models.append((rng.randrange(2), rng.randrange(2), model))
    for tx in range(n):
        tid, rev, model = rng.choice(models)
        a = rng.randrange(len(model) - 1)
        exons = model[a : rng.randint(a + 1, len(model))]
        if len(exons) > 2 and rng.random() < 0.3:
            exons = exons[:1] + exons[2:]
        exons = [(s + rng.choice(jitter), e + rng.choice(jitter)) for s, e in exons]
        exons[0], exons[-1] = (exons[0][0] - rng.randrange(9), exons[0][1]), (exons[-1][0], exons[-1][1] + rng.randrange(9))
        rows.append((tx, tid, rev, exons[0][0], exons[-1][1], exons, rng.random() < 0.6, False, "c", "g", "n", f"t{tx}", None))
    return rows


@pytest.mark.parametrize(("seed", "n", "span", "jitter", "d", "blocks"), [(1, 400, 4000, [0], 0, 1), (2, 400, 900, [0], 0, 9), (3, 300, 300, [0], 0, 40), (4, 300, 2000, [0, 0, 1, 2], 2, 7), (5, 300, 500, [-2, 0, 2], 3, 12)])
def test_merge_equals_the_walk(spark, seed, n, span, jitter, d, blocks):
    rows = made(seed, n, span, jitter)
    got = merging.merge(spark.createDataFrame(rows, FLAGS).repartition(3), UpdateParams(distance=d), blocks).collect()
    assert sorted((r["tx"], r["cov"], r["end"]) for r in got) == walk(rows, d)
    assert all(r["exons"][-1]["end"] == r["end"] and r["exons"][0]["start"] == r["start"] for r in got)


def test_a_deep_locus(spark):
    """Distinct overlapping reads of one locus, most of them with a chain of their own."""
    rng, rows = random.Random(7), []
    for tx in range(1500):
        exons = [(k * 100 + rng.randrange(30), k * 100 + 40 + rng.randrange(30)) for k in range(rng.randint(3, 8))]
        rows.append((tx, 0, 0, exons[0][0], exons[-1][1], exons, True, False, "c", "g", "n", f"t{tx}", None))
    got = merging.merge(spark.createDataFrame(rows, FLAGS), UpdateParams(), 6).collect()
    assert sorted((r["tx"], r["cov"], r["end"]) for r in got) == walk(rows, 0)


def test_nothing_to_merge(spark):
    assert merging.merge(spark.createDataFrame([], FLAGS), UpdateParams()).collect() == []
    single = [(1, 0, 0, 5, 9, [(5, 9)], True, False, "c", "g", "n", "t", None)]
    assert merging.merge(spark.createDataFrame(single, FLAGS), UpdateParams()).collect() == []


def test_chains_travel_as_short_ids(spark, monkeypatch):
    """Of what is written and shuffled only the table of distinct chains has their introns, once, and ids have 24 letters
    (once reads carried their introns beside their exons, and ids of 64 letters)."""
    seen = []
    monkeypatch.setattr(merging, "written", lambda df, f=merging.written: seen.append(f(df)) or seen[-1])
    rows = [(k, 0, 0, 10, 90, [(10, 20), (30, 40 + k % 2), (60, 90)], True, False, "c", "g", "n", "t", "t") for k in range(6)]
    got = merging.merge(spark.createDataFrame(rows, FLAGS), UpdateParams()).collect()
    assert sorted((r["tx"], r["cov"]) for r in got) == [(0, 3), (1, 3)]
    assert [set(t.columns) & {"chain", "exons"} for t in seen[:3]] == [{"exons"}, {"chain"}, set()]
    assert {len(r["cid"]) for t in seen[:2] for r in t.select("cid").collect()} == {24}
