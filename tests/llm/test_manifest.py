"""Merkle manifest, tokenizer alignment and source mixing, against brute force on small tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from isoloom.llm import align, merkle, mixing  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(data):
    return hashlib.sha256(data.encode()).hexdigest()


# ---- Merkle manifest


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root of ``nodes`` and each one's runs: (place, others) a level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append((p % 8, run[: p % 8] + run[p % 8 + 1 :]))
        nodes, at = [h("".join(nodes[a : a + 8])) for a in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], paths


def manifest(rows):
    langs = collections.defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    whole = {}
    for name in names:
        mine = sorted(((-1 if i is None else i), leaf(i, s, g, n, t), (i, t, g, s, n)) for i, t, g, s, n in langs[name])
        whole[name] = (mine, *tree([x[1] for x in mine]))
    root, above = tree([whole[n][1] for n in names])
    out = []
    for name, up in zip(names, above, strict=True):
        mine, subroot, paths = whole[name]
        for (_, own, (i, t, g, s, n)), path in zip(mine, paths, strict=True):
            low = t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0
            end = leaf(i, s, g, n, re.sub("[A-Z]", lambda m: m[0].lower(), t)) if low else own
            for at, others in path + up:
                end = h("".join([*others[:at], end, *others[at:]]))
            out.append((i, own, subroot, root, h("".join("".join(o) for _, o in path + up)), end, end == root))
    return out


def check_manifest(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("x"), "g": F.lit(1), "path": F.lit(2), "idx": F.lit(3)})
    got = merkle.manifest(df.repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, manifest(rows)))


def odd_rows():
    rows = [(k, f"Text {k} ÄÖ {'A' * (k % 5)}", f"l{k % 11}" if k % 13 else None, "s", k) for k in range(300)]
    return rows + [(None, "No id", "l1", None, 1), (None, None, None, None, None), (5, "Same", "l5", "s", 1), (5, "Same", "l5", "s", 1), (5, "Other", "l5", "s", 1), (900, "", "é", "", 0), (901, "X" * 300_000 + "É", "é", "s", 2)]


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_manifest_of_few_rows(spark, n):
    check_manifest(spark, [(k, f"T{k}", "en", "s", k) for k in range(n)])


def test_manifest_of_odd_rows(spark):
    check_manifest(spark, odd_rows())


def test_manifest_over_several_blocks(spark):
    """More leaves in one language than a block, and none of the rest has a second one."""
    check_manifest(spark, [(k, f"T{k}", "en" if k > 20 else f"x{k}", "s", k) for k in range(merkle.BLOCK + 90)])


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_equals_sql(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    df = spark.createDataFrame(rows, DOCS)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    theirs = con.execute(merkle.oracle(4)).fetchall()
    assert sorted(map(str, (tuple(r) for r in merkle.manifest(df).collect()))) == sorted(map(str, theirs))


def test_a_proof_folds_to_the_root_only_with_its_leaf():
    nodes = np.frombuffer("".join(h(str(k)) for k in range(100)).encode(), np.uint8).reshape(-1, 64)
    found = merkle.levels(nodes, 100)
    assert [len(x) for x in found] == [100, 13, 2, 1]
    for k in range(100):
        path = merkle.siblings(found, k)
        assert merkle.fold(nodes[k].tobytes(), path) == found[-1].tobytes()
        assert merkle.fold(h("x").encode(), path) != found[-1].tobytes()


# ---- tokenizer alignment

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "  ", "\n", " \n", "\n ", "a", "a ", "a\n", "Ab  c\n\nD", "é̈ ß İ Σς", "<|endoftext|> x<|endoftext|>", "<s>a</s> <unk>", "\0 \0a", "x\0\ny", "x y z\x1c\x85", "!\x1c a\x85\n b", "don't we'll", "12345 678", "日本語 テキスト", "🙂🙂 🙂", "a▁b ▁c", "q▁", "\t\ta\tb", "a b　 c  d\r\ne \rf\r", "ﬁ① x ", "   lead", "x\n\n\n  y", "Same text here.", "Same text here.", "é" * 5000, "word, " * 4000]
ODD += ["".join(chr(c) for c in range(a, a + 60) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3000, 60)]


@pytest.fixture(scope="module")
def pair():
    return align.Pair((public_tokenizers.path(A), public_tokenizers.path(B)))


def tokens(pair, text):
    """Both tokenizers on the whole text: (id, start, end) each, or None."""
    whole, out = f" {text}".encode(), []
    for ids, names in ((pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.bytes_a), (pair.b.encode(text), pair.bytes_b)):
        if b"".join(names[i] for i in ids) != whole:
            return None
        ends = np.cumsum([len(names[i]) for i in ids]).tolist()
        out.append([(i, e - len(names[i]), e) for i, e in zip(ids, ends, strict=True)])
    return out


def aligned(pair, texts):
    found = []
    for t in texts:
        both = tokens(pair, t) if t else None
        if both is None:
            found.append(None)
            continue
        a, b = both
        links, first = [], 0
        for i, s, e in a:
            while b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        groups = [([], []) for _ in range(len({x[2] for x in a} & {x[2] for x in b}))]
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        for side, some in enumerate((a, b)):
            for i, _, e in some:
                groups[np.searchsorted(ends, e)][side].append(str(i))
        found.append((len(a), len(b), len(groups), links, h(";".join(",".join(x) + "|" + ",".join(y) for x, y in groups))))
    count = collections.Counter(p for f in found if f for p in set(f[3]))
    top = collections.Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(count[p] == top[p[0]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for f in found]


def test_alignment_equals_brute_force(spark, pair):
    rng = np.random.default_rng(1)
    words = ["the", "of", "Überraschung", "naïve", "été,", "x1", "(a)", "don't", "\n", "  ", "...", "日本", "end.\n", "\t"]
    texts = ODD + [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"cuts": F.lit(1), "chunk": F.lit(2), "a": F.lit(3)})
    got = sorted(tuple(r) for r in align.align(df.repartition(3), public_tokenizers.path(A), public_tokenizers.path(B)).collect())
    assert got == [(k, *x) for k, x in enumerate(aligned(pair, texts))]


def told(pair, text):
    """The cuts of a text with their counts, groups and links."""
    flat = pair.numbered(align.cuts(" " + text))
    pair.align()
    return [(pair.counts[c].tolist(), pair.groups[c], sorted(pair.links[:, pair.first[c] : pair.first[c + 1]].T.tolist())) for c in flat.tolist()]


def test_alignment_in_blocks_and_sections(pair, monkeypatch):
    text = "The first line, and über.\nThe second line\n\nwith  gaps ▁ and " * 40
    pair.forget()
    whole = told(pair, text)
    monkeypatch.setattr(align, "TOKENS", 7)
    monkeypatch.setattr(align, "SECTION", 30)
    monkeypatch.setattr(align, "JOINED", 5)
    parts = list(align.sections(" " + text))
    assert len(parts) > 20 and "".join(parts) == " " + text
    assert [c for p in parts for c in align.cuts(p)] == align.cuts(" " + text)
    pair.forget()
    assert told(pair, text) == whole


def test_cuts_are_known_and_forgotten(pair, monkeypatch):
    texts = ["one two three", "two three four", None, "one ▁ x", "one two three"]
    rows = lambda: [x for k in range(2) for b in pair.chunk(k, pa.chunked_array([pa.array(range(5))]), texts) for x in b.select(["kind", "doc_id", "n_a", "n_links", "groups_sha256", "a", "b", "docs"]).to_pylist()]
    pair.forget()
    key = lambda r: str(sorted(r.items()))
    first = sorted(map(key, rows()))
    monkeypatch.setattr(align, "REMEMBERED", 2)
    assert sorted(map(key, rows())) == first


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(df, public_tokenizers.path(A), public_tokenizers.path(B)).collect() == []


# ---- mixing


def water(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    total, full, target = sum(sizes), set(), {}
    while True:
        left = total - sum(most * sizes[k] for k in full)
        open_ = [k for k in range(len(sizes)) if k not in full]
        target = {k: float(most * sizes[k]) for k in full} | {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if target[k] > most * sizes[k]]
        if not over:
            return [target[k] for k in range(len(sizes))]
        full |= set(over)


def mixture(rows, block, shard):
    """(doc_id, size, source_size, target, taken) by the rules of slots, one after the other."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = [sum(count(r[1]) for r in rows if r[2] == s) for s in sources]
    aims = water(sizes, [k % 3 + 1 for k in range(len(sources))]) if sum(sizes) else [0.0] * len(sizes)
    blocks = [-(-n // block) for n in sizes]
    slots = [min(3 * b, int(np.floor(t * b / n + 0.5))) if n else 0 for t, b, n in zip(aims, blocks, sizes, strict=True)]
    shards, out = max(1, -(-sum(slots) // shard)), []
    for k, s in enumerate(sources):
        times = collections.Counter()
        for _, n, before in mixing.drawn(k, slots[k], shards, 0, shards):
            for j in range(before, before + n):
                turn, at = divmod(j, blocks[k])
                times[int(mixing.permuted(np.array([at]), blocks[k], np.array([(turn << 32) + k * 2 + (mixing.SEED << 40)]))[0])] += 1
        assert sum(times.values()) == slots[k]
        word = 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is not None, r[0] or 0, count(r[1]))):
            n = count(t)
            out.append((i, n, sizes[k], aims[k], sum(times[w // block] for w in range(word, word + n))))
            word += n
    return out


def mix_rows():
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 200))), f"s{k % 4}" if k % 7 else None) for k in range(60)]
    rows += [(100, "one \t two\n", "tiny"), (101, None, "tiny"), (102, "", "none"), (None, "a b c", "s1"), (7, "again", "s1"), (7, "again", "s1"), (103, "  x　y \x1c", "Z"), (104, "w " * 30_000, "long")]
    return rows


@pytest.mark.parametrize("shard", [1 << 16, 11])
def test_mixing_equals_the_rules(spark, shard):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"k": F.lit("x"), "size": F.lit(1), "tie": F.lit(0), "block": F.lit(2), "target": F.lit(9)})
    got = mixing.taken(df.repartition(3), 16, shard).collect()
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6), r[4])
    assert sorted(map(key, got)) == sorted(map(key, mixture(rows, 16, shard)))
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_a_mix_is_near_its_targets_and_reruns_agree(spark):
    rows = [(k, "w " * (20 + k % 90), f"s{k % 5 if k % 3 else 0}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df)
    for r in got.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect():
        assert abs(r["n"] - r["t"]) <= 2 * mixing.BLOCK
    again = mixing.taken(df.orderBy(F.desc("doc_id")).repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_slots_of_a_shard_are_a_permutation(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    parts, slots = mixing.mix(df, 16, 500)
    found = collections.defaultdict(list)
    for r in slots.collect():
        found[r["shard"]].append(r["slot"])
        assert r["pass"] < 3
    assert len(found) > 3 and all(sorted(x) == list(range(len(x))) for x in found.values())
    lengths = parts.where("block IS NOT NULL").groupBy("k", "block").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in lengths) == 16


def test_shards_drawn_in_parts_are_the_same():
    whole = list(mixing.drawn(2, 100_003, 97, 0, 97))
    assert whole == [x for a in range(0, 97, 10) for x in mixing.drawn(2, 100_003, 97, a, min(a + 10, 97))]
    counts = np.array([n for _, n, _ in whole])
    assert counts.sum() == 100_003 and abs(counts - 100_003 / 97).max() < 6 * np.sqrt(100_003 / 97)


def test_permutations_are_whole():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 5):
            assert sorted(mixing.permuted(np.arange(n), n, np.full(n, key)).tolist()) == list(range(n))


def test_mixing_of_nothing(spark):
    assert mixing.taken(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r) for r in mixing.taken(spark.createDataFrame([(1, None, "en", "s", 0)], DOCS)).collect()] == [(1, 0, 0, 0.0, 0)]
