"""Word scanning, encoders, token files, packing, exact dedup, decontamination on small fixtures."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from isoloom.llm import common, decontaminate, encode, exact_dedup, packing, token_files, words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "\n", "a", "Ab  c\n\nD", "é̈ ß İ Σς", "<|endoftext|> x<|endoftext|>", "<|startoftext|>", "\0 \0a", "x y z\x1c\x85", "don't we'll", "12345 678", "日本語 テキスト", "🙂🙂", "The END. the end, The"]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "en", "s", None) for k, t in enumerate(texts)], DOCS)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@given(st.lists(st.text(alphabet="aB \n\té日,.9\0", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for which, pattern in ((words.WHITE, r"[^\x20\x09-\x0D]+"), (words.PUNCT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, offsets = common.text_buffer(pa.array(texts, pa.string()))
        data = words.LOWER[data]
        starts, ends, first = words.scan(data, offsets, words.separators(which))
        got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
        expected = [re.findall(pattern, low(t)) for t in texts]
        assert got == [w for x in expected for w in x]
        assert np.diff(first).tolist() == [len(x) for x in expected]
        h = words.hashes(data, starts, ends)
        assert len(set(h.tolist())) == len(set(got))
        value, at = words.grams(h, first, 3)
        runs = [[tuple(x[i : i + 3]) for i in range(len(x) - 2)] if len(x) >= 3 else [tuple(x)] if x else [] for x in expected]
        assert np.diff(at).tolist() == [len(r) for r in runs]
        assert len(set(value.tolist())) == len({g for r in runs for g in r})


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", encode.ByteEncoder), ("word_bpe_49k.json", encode.WordEncoder)])
def test_encoders_equal_the_library(name, kind):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole, ours = Tokenizer.from_file(path), kind(path)
    texts = ODD + ["".join(chr(c) for c in range(a, a + 60) if not 0xD800 <= c < 0xE000) for a in range(0, 0x12000, 60)]
    for t, ids in zip(texts, ours.ids(texts), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_the_piece_cache_turns(monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a b c d e f g", "a b c", "g f e d c b a"] * 3
    assert [x.tolist() for x in encode.WordEncoder(path).ids(texts)] == [encode.WordEncoder(path).ids([t])[0].tolist() for t in texts]


@given(st.lists(st.integers(0, 2**13 - 1), max_size=300), st.sampled_from([13, 16, 17]))
@settings(max_examples=40, deadline=None)
def test_bit_packing(ids, bits):
    x = np.array(ids, np.uint32)
    packed = token_files.pack(x, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert token_files.unpack(packed, bits, len(ids)).tolist() == ids


def test_token_file_random_access():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 5000, 1000)
    lengths = np.array([400, 0, 600])
    data = token_files.to_bytes(ids, [7, None, -3], lengths, token_files.width(5000), block=64)
    f = token_files.TokenFile(pa.BufferReader(data))
    assert (f.bits, f.doc_ids, f.lengths.tolist()) == (13, [7, None, -3], [400, 0, 600])
    for a, b in ((0, 1000), (0, 0), (63, 65), (64, 128), (999, 1000), (130, 777)):
        assert f.read(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        token_files.TokenFile(pa.BufferReader(b"x" * 100))


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, None, "the same", "the same", "long " * 30_000]
    ids = [*range(len(texts) - 4, 0, -1), None, 3, 3, 1000]
    got = token_files.round_trip(docs(spark, texts, ids[: len(texts)]), path, 1, 49_408).collect()
    whole, rows = Tokenizer.from_file(path), sorted(zip(ids, texts, strict=False), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, expected = 0, []
    for d, t in rows:
        x = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert token_files.round_trip(docs(spark, []), path, 1, 49_408).count() == 0


def check_packing(pieces, ids, window=1024):
    by_doc, by_sequence = {}, {}
    for d, start, length, crc, total, sequence, offset, *_ in pieces:
        by_doc.setdefault(d, []).append((start, length, crc, total))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert set(by_doc) == set(ids)
    for d, x in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(x):
            assert (start, total) == (at, len(ids[d]))
            assert crc == zlib.crc32(np.array(ids[d][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[d])
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at and length > 0
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, None, "word " * 5000, *[f"common words and number {k} " * (k % 40) for k in range(300)]]
    code = encode.ByteEncoder(path)
    ids = {k: [*x.tolist(), 0] for k, x in enumerate(code.ids([t or "" for t in texts]))}
    for shard in (2_000_000, 5000):
        check_packing([tuple(r) for r in packing.pack(docs(spark, texts), path, shard_ids=shard).collect()], ids)
    assert packing.pack(docs(spark, []), path).count() == 0


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(3)
    topics = [rng.integers(100 * t, 100 * t + 100, (20, 100)) for t in range(4)]
    held = [np.append(x, 0).astype(np.uint16) for k in range(20) for x in (t[k] for t in topics)]
    sequences = {}
    for d, _, n, s, _, _ in packing.pack_shard(held, np.full(packing.IDS, 2.0), 101.0, 512):
        sequences.setdefault(s, []).append((d % 4, n))
    same = sum(n for x in sequences.values() for t, n in x if t == x[0][0])
    assert same > 0.85 * sum(map(len, held))


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(n, []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[n], key=lambda x: x[:3])[3]
        out.append((str(d), str(keep), len(groups[n]), keep == d, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_exact_dedup(spark):
    long_ = "".join(chr(97 + (k * k) % 26) for k in range(60_000))
    texts = [*ODD, None, "a b", "ab", "a\tb ", long_, long_[:30_000] + " " + long_[30_000:], long_[:-1] + "!", "same", "same"]
    ids = [*range(50, 50 + len(texts) - 3), None, 7, 7]
    rows = list(zip(ids, texts, strict=True))
    frame = docs(spark, texts, ids)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.mark(frame).collect()) == brute_exact(rows)
    kept = exact_dedup.keep_first(frame)
    assert kept.columns == frame.columns
    assert kept.count() == len({r[1] + r[4] for r in brute_exact(rows)})
    assert exact_dedup.mark(docs(spark, [])).count() == 0


def test_exact_dedup_with_colliding_hashes(spark, monkeypatch):
    frame = docs(spark, ["aaa", "bbb", "aaa"])
    monkeypatch.setattr(exact_dedup, "ambiguous", lambda d: spark.range(1))
    assert sorted((r["doc_id"], r["keep_id"]) for r in exact_dedup.mark(frame).collect()) == [(0, 0), (1, 1), (2, 0)]


def test_ambiguous_hashes_are_found(spark, monkeypatch):
    assert exact_dedup.ambiguous(docs(spark, ["x" * 9000, "y" * 5000])).isEmpty()
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1))
    assert not exact_dedup.ambiguous(docs(spark, ["aaa", "bbb"])).isEmpty()


def brute_hits(texts, items, window):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for k, t in items:
        w = find(low(t))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if k is None else str(k))
    out = []
    for d, t in enumerate(texts):
        w = find(low(t))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    found |= windows[tuple(w[i : i + n])]
                    hit[i : i + n] = [True] * n
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


@pytest.mark.parametrize(("window", "block"), [(4, 400_000), (4, 6), (13, 400_000)])
def test_decontamination(spark, monkeypatch, window, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = np.random.default_rng(window)
    make = lambda n: " ".join(rng.choice(["a", "b", "c", "Dé"], n))
    items = [(k, make(rng.integers(1, 30))) for k in range(12)] + [(3, "zz"), (4, "zz top!"), (None, "q r s t u"), (5, ""), (6, None), (7, "!!"), (8, "zz")]
    texts = [make(rng.integers(0, 60)) for _ in range(40)] + [None, "", "zz", "ZZ, top", "q r s t u", "x " * 300 + items[0][1] + " y" * 9000]
    frame = docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(frame, bench, window, carry=["doc_id"]).select("doc_id", "hit.n_words", "hit.n_hit", "hit.n_items", "hit.items_sha256", "hit.contaminated")
    expected = brute_hits(texts, items, window)
    assert sorted(map(tuple, got.collect())) == expected
    kept = decontaminate.clean(frame, bench, window)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in expected if not r[5]]


def alternating(n):
    """Two words of 2**n letters that any polynomial modulo a power of two confuses, for n = 11 modulo 2**64."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_unlike_words_have_unlike_hashes():
    texts = [*alternating(11), *alternating(5), "a", "aa", "a\0", "x" * 64, "x" * 65, "x" * 63 + "y", "yx" + "x" * 62]
    data, offsets = common.text_buffer(pa.array(texts))
    one, two = (words.hashes(data, offsets[:-1], offsets[1:], seed) for seed in (0, 7))
    assert len(np.unique(np.concatenate([one, two]))) == 2 * len(texts)
    again = words.hashes(np.concatenate([data[5:], data]), offsets[:-1] + len(data) - 5, offsets[1:] + len(data) - 5)
    assert (again == one).all()


@pytest.mark.parametrize("collide", [False, True])
def test_decontamination_knows_words_by_their_bytes(spark, monkeypatch, collide):
    if collide:  # all words of one length share a hash
        monkeypatch.setattr(decontaminate, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    a, b = alternating(11)
    items = [(1, f"one two {a} four"), (2, "red sea"), (3, "tin man sea cow ant")]
    texts = [f"one two {b} four", f"x one two {a} four", "tin sea", "red man", "a red sea", "cow ant tin", "tin man sea cow ant fox", "six two ten four"]
    automaton = decontaminate.Automaton([(str(k), t) for k, t in items], 4)
    *_, first, found = decontaminate._scan(pa.array(texts), automaton)
    got = [(d, int(n), sum(y - x for x, y in decontaminate._merged(found.get(d, ([], set()))[0])), len(found.get(d, ([], set()))[1])) for d, n in enumerate(np.diff(first))]
    assert got == [r[:4] for r in brute_hits(texts, items, 4)]
    if not collide:
        bench = spark.createDataFrame(items, "item_id long, text string")
        kept = decontaminate.clean(docs(spark, texts), bench, 4).select("doc_id").collect()
        assert sorted(r["doc_id"] for r in kept) == [0, 2, 3, 5, 7]


@given(st.lists(st.sampled_from([-1.0, 0.0, 0.5, 1.0, 2.5]), max_size=30), st.integers(1, 40))
@settings(max_examples=80, deadline=None)
def test_best_is_repeated_argmax(scores, most):
    score, expected = np.array(scores), []
    left = score.copy()
    while len(expected) < most and len(left) and left.max() >= 0:
        expected.append(int(left.argmax()))
        left[expected[-1]] = -1
    assert packing.best(score, most).tolist() == expected


def test_many_tiny_texts_pack_in_steps():
    """Every window of a shard of texts of one id takes some lookups, not one for each text."""
    pieces = packing.pack_shard([np.array([k % 3], np.uint16) for k in range(20_000)], np.full(packing.IDS, 2.0), 1.0, 1024)
    assert len(pieces) == 20_000 and sum(p[2] for p in pieces) == 20_000
    full = [p for p in pieces if p[3] == 0]
    assert len(full) == 1024 and {p[0] % 3 for p in full} == {0}  # the seed's own kind first


def test_decontamination_cuts_spans(spark):
    text = "é " * 100 + "one two three four five" + " y" * 100
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    got = decontaminate.clean(docs(spark, [text]), bench, 5, coverage=2, cut=True).first()["text"]
    assert got == "é " * 100 + " y" * 100
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs(spark, ["a"]), none).count() == 1


def test_blocks_of_items_are_even(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3000)
    items = spark.createDataFrame([(str(k), "ten words of the very same text in each item") for k in range(1000)], "item_id string, text string")
    blocks = list(decontaminate._blocks(items))
    assert sum(map(len, blocks)) == 1000 and max(map(len, blocks)) <= 400 and len(blocks) < 8


def test_several_blocks_make_no_chain(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    frame, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    several = decontaminate.hits(frame.select("doc_id", "text"), bench, carry=["doc_id"])
    assert several._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
    rows = sorted(map(str, several.collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10**9)
    assert rows == sorted(map(str, decontaminate.hits(frame.select("doc_id", "text"), bench, carry=["doc_id"]).collect()))


def test_token_files_of_another_width(spark, monkeypatch):
    """Ids of 17 bits, and many rows of one id over several tasks and files."""
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, f"row number {k % 7} of many") for k in range(60)] + [(k, f"the text {k}") for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wide, plain = (sorted(map(str, token_files.round_trip(frame, path, 1, n).select("doc_id", "n_tokens", "ids_crc32").collect())) for n in (100_000, None))
    assert wide == plain and len(wide) == 80
    assert token_files.vocabulary_of(path) == 49_408
    with pytest.raises(Exception, match="beyond the vocabulary"):
        token_files.round_trip(frame, path, 1, 300).collect()


def test_neighbours_are_the_best_by_bm25():
    """Scores of whole queries against the formula, and the first neighbour of each seed among the unused."""
    rng = np.random.default_rng(6)
    ids = [rng.integers(0, 60, rng.integers(5, 90)).astype(np.uint16) for _ in range(40)]
    df = np.zeros(packing.IDS)
    for x in ids:
        df[np.unique(x)] += 1
    mean = sum(map(len, ids)) / len(ids)
    idf = np.log1p((len(ids) - df + 0.5) / (df + 0.5))

    def bm25(q, d):
        total = 0.0
        for t in set(q.tolist()):
            tf = int((d == t).sum())
            total += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        return total

    index = packing.Index(ids, idf, mean)
    for d in range(40):
        assert index.scores(d) == pytest.approx([bm25(ids[d], x) for x in ids], rel=1e-5)
    left = np.array([len(x) for x in ids])
    left[::2] = 0
    left[1::4] = 0
    index.keep(left)
    assert index.scores(3)[left > 0] == pytest.approx([bm25(ids[3], x) for x, n in zip(ids, left, strict=True) if n], rel=1e-5)
    pieces = packing.pack_shard(ids, idf, mean, 128)
    unused = {d: len(x) for d, x in enumerate(ids)}
    for s in sorted({p[3] for p in pieces}):
        row = sorted((p for p in pieces if p[3] == s), key=lambda p: p[4])
        seed = row[0][0]
        if sum(p[2] for p in row) == 128 and len(row) > 1:
            score = {d: bm25(ids[seed], ids[d]) for d, n in unused.items() if n and d != seed}
            assert score[row[1][0]] == pytest.approx(max(score.values()), rel=1e-5)
        for p in row:
            unused[p[0]] -= p[2]
    assert not any(unused.values())
