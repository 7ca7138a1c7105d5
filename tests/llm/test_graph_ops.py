"""Near dedup, line dedup, components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("isoloom.llm")

from isoloom.llm import line_dedup, near_dedup  # noqa: E402
from isoloom.llm.common import text_buffer  # noqa: E402
from isoloom.llm.components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, digest string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "en", "clash") for k, t in enumerate(texts)], DOCS)


def roots(n, links):
    to = list(range(n))
    for a, b in links:
        x, y = to[a], to[b]
        if x != y:
            to = [min(x, y) if t in (x, y) else t for t in to]
    return to


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def corpus(rng, n=260):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind < 0.7:
            w = [word() for _ in range(rng.randint(5, 60))]
            texts.append(" ".join(w[:3] + passage + w[3:]))
        else:
            texts.append(" ".join(word() for _ in range(rng.randint(1, 80))))
    return texts


@pytest.mark.parametrize(("seed", "small", "dense", "group"), [(1, 4000, 4, 500), (2, 6, 4, 500), (3, 6, 0, 4), (4, 4000, 0, 6)])
def test_near_dedup(spark, monkeypatch, seed, small, dense, group):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    monkeypatch.setattr(near_dedup, "GROUP", group)
    monkeypatch.setattr(near_dedup, "ROUNDS", 0 if seed == 4 else 3)
    monkeypatch.setattr(near_dedup._groups, "__defaults__", (group,))
    monkeypatch.setattr(near_dedup.crowded_blocks, "__defaults__", (max(1, small // 2),))
    texts = [*corpus(random.Random(seed)), None, "", " \t", "one", "ONE", "a b c d", "A b\nc  d", "w " * 9000 + "x", "w " * 9000 + "x"]
    sets = [shingles(t) for t in texts]
    expected = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if linked(sets[i], sets[j])])
    frame = docs(spark, texts)
    got = near_dedup.mark(frame).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got] == [(k, len(sets[k]), expected[k], expected[k] == k) for k in range(len(texts))]
    if seed == 1:
        kept = near_dedup.keep_first(frame)
        assert kept.columns == frame.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(texts)) if expected[k] == k]


def test_near_dedup_edges(spark):
    assert near_dedup.mark(docs(spark, [])).count() == 0
    rows = docs(spark, ["a b c d e f", "a b c d e f", None, "a b c d e f", "lone"], [5, None, None, 9, None])
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.mark(rows).collect()}
    assert got == {(5, 5, True), (None, 5, False), (None, None, True), (9, 5, False)}


def test_near_dedup_of_shared_and_null_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near, other = long + " tail", "other text here that is like nothing else"
    lost = "another one without any number " + long[::-1]
    rows = docs(spark, [long, near, other, other, lost, lost + " x", "alone", None, "", other], [7, 8, 8, 8, None, None, None, 8, None, 3])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in near_dedup.mark(rows).collect()), key=str)
    n = [len(shingles(t)) for t in (long, near, other, lost)]
    nulls = [g for g in got if g[0] is None]
    assert [g for g in got if g[0] is not None] == sorted([(7, 7, True, n[0]), (8, 7, False, n[1]), (8, 3, False, n[2]), (8, 3, False, n[2]), (8, 8, True, 0), (3, 3, True, n[2])], key=str)
    assert all(g[1] is None for g in nulls) and sorted((g[3], g[2]) for g in nulls if g[3] > 1) in ([(n[3], False), (n[3] + 1, True)], [(n[3], True), (n[3] + 1, False)])
    assert sorted((g[3], g[2]) for g in nulls if g[3] < 2) == [(0, True), (1, True)]
    kept = near_dedup.keep_first(rows)
    assert kept.columns == rows.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(texts) == 6 and {(7, long), (3, other), (8, None), (None, ""), (None, "alone")} < set(texts)


def test_near_dedup_keeps_an_unlike_text_of_a_shared_id(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = docs(spark, [long, long + " tail", "other text here"], [7, 8, 8]).withColumns({"_shared": F.lit(1), "_gone": F.lit(2)})
    kept = near_dedup.keep_first(rows)
    assert kept.columns == rows.columns and sorted((r["doc_id"], r["text"], r["_shared"], r["_gone"]) for r in kept.collect()) == [(7, long, 1, 2), (8, "other text here", 1, 2)]


def test_near_dedup_tells_alternating_words_apart(spark):
    """Words of the two letters by the doubling rule, which a polynomial modulo 2**64 takes for one."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    tail = " two three four five six seven"
    got = near_dedup.mark(docs(spark, [a + tail, b + tail, a, b, a + tail])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)]
    assert len(set(near_dedup.set_digests(pa.array([a, b]))[1])) == 2


def test_set_digests_ignore_order_and_repeats():
    one, two = near_dedup.set_digests(pa.array(["a b c d e a b c d e", "c d e a b c d e a b c d", "", None, "a b"]))
    assert two[0] != two[4] and two[2] == two[3]
    assert (two[0] == two[1]) == (one[0].tolist() == one[1].tolist())
    for x, y in zip(one, near_dedup.shingle_sets(pa.array(["a b c d e a b c d e", "c d e a b c d e a b c d", "", None, "a b"])), strict=True):
        assert x.tolist() == y.tolist()


def test_groups_meet_all_pairs():
    comp = np.array([1] * 30 + list(range(2, 25)) + [40] * 4)
    number, place = near_dedup._groups(77, comp, 10)
    met = set()
    for g in np.unique(number):
        at = place[number == g].tolist()
        assert len(at) <= 10
        met |= {(a, b) for a in at for b in at if a < b}
    assert {(a, b) for a in range(len(comp)) for b in range(a + 1, len(comp)) if comp[a] != comp[b]} <= met


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {"chain": [(k, k + 1) for k in range(60)], "star": [(0, k) for k in range(1, 60)] + [(100, 101)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]}[shape]
    expected = roots(110, edges)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    real = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["id"]: r["component"] for r in got} == {k: expected[k] for k in real}


def line_shingles(t):
    b = re.sub("[A-Z]", lambda m: m[0].lower(), t)  # characters
    return {b[i : i + line_dedup.SHINGLE] for i in range(max(1, len(b) - line_dedup.SHINGLE + 1))}


def test_line_dedup(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(9))
    base = ["".join(word() for _ in range(rng.randint(3, 12))).strip() for _ in range(25)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = rng.choice(base)
            if rng.random() < 0.4:
                k = rng.randrange(len(line))
                line = line[:k] + rng.choice("xyz") + line[k + 1 :]
            lines.append(rng.choice(["", " ", "\t"]) + line + rng.choice(["", "  "]))
        texts.append("\n".join(lines + [""] * rng.randint(0, 2)))
    texts += [None, "", "\n\n", "short", "SHORT", "short", "q" * 40_000, "q" * 39_990]
    all_lines = [(d, k, x.strip(" \t\x0b\x0c\r")) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
    distinct = sorted({x for *_, x in all_lines})
    sets = [line_shingles(x) for x in distinct]
    comp = dict(zip(distinct, roots(len(distinct), [(i, j) for i in range(len(distinct)) for j in range(i) if linked(sets[i], sets[j])]), strict=True))
    seen, gone = set(), {}
    for d, k, x in all_lines:
        if comp[x] in seen:
            gone.setdefault(d, []).append(k)
        seen.add(comp[x])
    frame = docs(spark, texts)
    for small, dense in ((4000, 4), (4, 4), (4000, 0)):
        monkeypatch.setattr(line_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "DENSE", dense)
        monkeypatch.setattr(near_dedup, "ROUNDS", 0 if small == 4 else 3)
        got = line_dedup.mark(frame).orderBy("doc_id").collect()
        assert [(r["doc_id"], r["n_lines"], r["n_kept"], r["dropped"]) for r in got] == [(d, len((t or "").split("\n")), len((t or "").split("\n")) - len(gone.get(d, [])), gone.get(d, [])) for d, t in enumerate(texts)]
    cleaned = line_dedup.clean(frame)
    assert cleaned.columns == frame.columns
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {d: t if d not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in enumerate(texts)}


def test_line_dedup_edges(spark):
    assert line_dedup.mark(docs(spark, [])).count() == 0
    rows = docs(spark, ["the same line", "the same line", "the same line"], [4, 4, None])
    assert sorted((str(r["doc_id"]), r["n_kept"]) for r in line_dedup.mark(rows).collect()) == [("4", 1), ("4", 1), ("None", 0)]


def test_line_shingles_follow_the_definition():
    texts = ["Abc", "abcdefghijkl", "é" * 12]
    for t, s in zip(texts, line_dedup.shingle_sets(pa.array(texts)), strict=True):
        assert len(s) == len(line_shingles(t))


def test_line_buckets_of_many_tasks(spark, monkeypatch):
    """Buckets over several tasks, packs and ranges, a hot one among them, against brute force."""
    rng = random.Random(3)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(16))
    texts = []
    for k in range(400):
        if k % 3:
            w = base.split(" ")
            w[rng.randrange(16)] = f"{k:06d}"  # a large group of near copies
            texts.append(" ".join(w) + "\n" + "".join(rng.choice("abcdefghijklmnop é") for _ in range(rng.randint(1, 90))).strip())
        else:
            texts.append("".join(rng.choice("ijklmnop") for _ in range(rng.randint(40, 200))) + "\n" + base)
    frame = docs(spark, texts).repartition(7)
    monkeypatch.setattr(line_dedup, "PACK", 500)
    monkeypatch.setattr(line_dedup, "RANGE", 3000)
    lines = [(d, k, x.strip()) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.strip()]
    kinds = sorted({x for *_, x in lines})
    sets = [line_shingles(x) for x in kinds]
    comp = dict(zip(kinds, roots(len(kinds), [(i, j) for i in range(len(kinds)) for j in range(i) if linked(sets[i], sets[j])]), strict=True))
    seen, gone = set(), {}
    for d, k, x in lines:
        if comp[x] in seen:
            gone.setdefault(d, []).append(k)
        seen.add(comp[x])
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.mark(frame).collect()}
    assert got == {d: gone.get(d, []) for d in range(len(texts))}


def test_line_recall():
    """Pairs at the threshold and above share a bucket and pass the sketch."""
    rng, pairs = random.Random(8), []
    for _ in range(1500):
        n = rng.choice([40, 60, 70, 85, 120, 300, 600])
        a = "".join(rng.choice("abcdefghij é") for _ in range(n)).strip()
        b = list(a)
        for _ in range(rng.randint(1, max(1, n // 35))):
            b[rng.randrange(len(b))] = rng.choice("xyzé")
        pairs.append((a, "".join(b)))
    flat = [x for p in pairs for x in p]
    data, offsets = text_buffer(pa.array(flat))
    value, first = line_dedup._shingles(data, offsets[:-1], offsets[1:])
    key, line = line_dedup.bucket_keys(value, first)
    buckets = [set() for _ in flat]
    for k, x in zip(key.tolist(), line.tolist(), strict=True):
        buckets[x].add(k)
    sketch = line_dedup._independent(value, first, line_dedup.SKETCH_BYTES)
    close = [i for i in range(0, len(flat), 2) if linked(line_shingles(flat[i]), line_shingles(flat[i + 1]))]
    assert len(close) > 500
    assert sum(bool(buckets[i] & buckets[i + 1]) for i in close) >= 0.995 * len(close)
    assert sum((sketch[i] == sketch[i + 1]).sum() >= line_dedup.SKETCH for i in close) >= 0.995 * len(close)


def test_near_pairs_equal_a_plain_comparison():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 9, 16, 17, 60, 700):
        base = rng.integers(0, 256, (1 + n // 8, 36)).astype(np.uint8)
        sketch = base[rng.integers(0, len(base), n)]
        other = rng.random(sketch.shape) < 0.4
        sketch[other] = rng.integers(0, 256, other.sum())
        comp = rng.integers(0, 1 + n // 2, n)
        expected = [(i, j) for i in range(n) for j in range(i + 1, n) if comp[i] != comp[j] and (sketch[i] == sketch[j]).sum() >= 18]
        assert list(zip(*(x.tolist() for x in near_dedup._near_pairs(sketch, comp, 18, 5000)), strict=True)) == expected


def test_pairs_of_many_nodes(spark):
    node = [k // 3 for k in range(300)]
    members = spark.createDataFrame([(n, k, k) for k, n in enumerate(node)], "node long, cid long, comp long").coalesce(1)
    classes = spark.createDataFrame([(k, bytes([n % 251] * 36)) for k, n in enumerate(node)], "cid long, sketch binary")
    got = near_dedup._promising(members, classes, 18).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(3 * n + i, 3 * n + j) for n in range(100) for i, j in ((0, 1), (0, 2), (1, 2))]
    assert all(r["node"] is None for r in got)


def test_packed_buckets_by_plain_grouping():
    rng = np.random.default_rng(6)
    keys = (rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2))[rng.integers(0, 900, 2000)]
    ids = rng.integers(-50, 50, 2000)
    rows = {}
    for batch in line_dedup._packed(keys, ids, 7):
        r, *blobs = (batch.column(k)[0].as_py() for k in range(7))
        rows[r] = [np.frombuffer(x, t).tolist() for x, t in zip(blobs, (np.uint32, np.int64, np.uint32, np.int64, np.uint64, np.int64), strict=True)]
    buckets = {}
    for k, i in zip(keys.tolist(), ids.tolist(), strict=True):
        buckets.setdefault(k, []).append(i)
    for r in range(7):
        mine = {k: x for k, x in buckets.items() if (k >> 32) * 7 >> 32 == r}
        alone, alone_id, head, head_id, node, member = rows[r]
        assert sorted(zip(alone, alone_id)) == sorted((k & 0xFFFFFFFF, x[0]) for k, x in mine.items() if len(set(x)) == 1)
        assert list(zip(head, head_id)) == [(k & 0xFFFFFFFF, min(x)) for k, x in sorted(mine.items()) if len(set(x)) > 1]
        assert sorted(zip(node, member)) == sorted((r << 32 | k & 0xFFFFFFFF, i) for k, x in mine.items() if len(set(x)) > 1 for i in x)
