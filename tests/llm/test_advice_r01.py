"""Cases from the review of round 1: whole jobs where a part was done."""

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from isoloom.llm import attention, language_id, licenses, line_dedup, lm_scoring  # noqa: E402


def test_an_id_inside_a_text_has_eight_ids_before_it():
    assert attention.WINDOW - attention.STRIDE >= 8


def test_the_network_learns_from_all_training_documents(spark, monkeypatch):
    """Documents beyond the sample change classes and weights."""
    monkeypatch.setattr(lm_scoring, "RATE", 0.2)
    monkeypatch.setattr(lm_scoring, "sample_ids", lambda *_: [])
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(2)
    texts = [" ".join(np.tile(rng.permutation(["red", "green", "blue", "black", "white"]), 12)) for _ in range(80)]
    base = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    ids = lm_scoring.train_ids(base, path, 8).cache()
    whole = [np.frombuffer(r["ids"], np.uint16).astype(np.int64) for r in ids.orderBy("rank").collect()]
    count = lm_scoring.id_counts(ids)
    assert (count == np.bincount(np.concatenate(whole), minlength=attention.VOCABULARY)).all()
    column, near = attention.columns_of(count), np.zeros((attention.VOCABULARY, 2 * attention.NEAR))
    for x in whole:
        for a, b in zip(x[:-1], x[1:], strict=True):
            near[a, column[b]] += column[b] >= 0
            near[b, column[a] + attention.NEAR] += column[a] >= 0
    got = lm_scoring.neighbours(ids, count)
    assert (got == near).all()
    start = attention.Attention([], count, near=got)
    assert set(start.classes[np.flatnonzero(count)]) != {0}
    before = start.score(whole).sum()
    assert lm_scoring.fit_all(start, ids, 8).score(whole).sum() > before + 20


def test_an_epoch_meets_every_id_once():
    rng = np.random.default_rng(4)
    for n in (0, 1, 31, 32, 33, 300):
        m = attention.Attention([], np.ones(attention.VOCABULARY), steps=1, near=np.zeros((attention.VOCABULARY, 2 * attention.NEAR)))
        seen = []
        m._steps = lambda stream, starts, rates, seen=seen: seen.extend((s + k) for x in starts for s in x for k in range(attention.WINDOW))
        total, came = m.epoch([rng.integers(0, 50, n)], 0.01, 0)
        assert total == came.sum() == n + 1
        assert set(range(n + 1)) <= set(seen)


def test_full_licence_texts_rule_their_directory(spark):
    texts = licenses.full_texts()
    assert {"AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"} <= set(texts)
    files = [(0, "plain/x.py", "the words of the work to which you and the other may go, as it is in any of the parts. " * 400)]
    for k, (name, (text,)) in enumerate(sorted(texts.items()), 1):
        files += [(k, f"{name}/LICENSE", "Copyright (c) 2021 Somebody Else, Ltd.\n\n" + text), (100 + k, f"{name}/src/x.py", "code of no licence")]
    got = {r["doc_id"]: (r["license"], r["from_path"]) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got.pop(0) == (None, None)
    assert got == {d: (p.split("/")[0], p.split("/")[0] + "/LICENSE") for d, p, _ in files[1:]}


def test_short_lines_that_differ_in_one_character_link(spark):
    texts = [f"Page {k} of the yearly report of the small company" for k in range(1, 9)] + ["Страница 1 годового отчета небольшой частной компании", "Страница 2 годового отчета небольшой частной компании", "quite another line of about the same length"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_kept"] for r in line_dedup.mark(rows).orderBy("doc_id").collect()] == [1, *[0] * 7, 1, 0, 1]


def test_every_language_has_a_training_text(spark):
    """Few long texts a language, so that a share of the hashes can hold none."""
    rows = [(k, f"text {k} " * 200, f"l{k % 12:02}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~language_id.held_out(F.col("doc_id"), 5, 0))
    got = language_id.sample(docs, 40)
    labels = {r["lang"] for r in docs.select("lang").distinct().collect()}
    assert set(got) == labels and all(len(x) == 1 for x in got.values())
