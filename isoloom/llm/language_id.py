"""Operator 8: language ID by prediction by partial matching.

Each language has a tree of byte contexts up to ORDER bytes with counts. A byte costs -log2 of its share in the longest
context that has it, and each longer known context on the way down costs its escape (method C: distinct bytes over
distinct bytes plus count), down to 1/256 for any byte. Statistics are frozen after training, so the cost of a byte
after its ORDER bytes is one number for each language, tabulated for every string that any language has. A text's
score for a language is its exact code length. ``score`` says how much of the text's bytes the best language's code
saves: 1 less its bits over 8 bits a byte, 0 at least. Prose of a learned language has about 0.7, short prose beside
keys and addresses 0.15 or more; random letters, keys and unlearned scripts have 0, for a byte unknown in its context
costs escapes. ``accepted`` drops what does not save a tenth.

Training takes whole texts of at most SAMPLE_BYTES for each language (distinct documents in hash order, one at least),
and of TOTAL_BYTES over all languages if they are many, so the sample and the tables are bounded by that and by the
number of languages, not by the corpus.

Cases: null text, or one without a letter, is ``und`` with score 0; so is everything if no row has a label; equal code
lengths go to the language that sorts first; labels are never read in prediction; a null doc_id counts as text "";
rows stay as they are, equal ones too; an empty table gives no row; ``accepted`` carries all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import per_row, ranked_sample, slices, small_batches, text_buffer
from isoloom.llm.words import LOWER

ORDER = 4
SAMPLE_BYTES, TOTAL_BYTES = 1_000_000, 32_000_000
#: Bytes of text that are scored together: scratch arrays take some 70 times as much.
SLICE = 1 << 18
#: Documents below it are rejected by ``accepted``.
LEAST_SCORE = 0.1
PAD = np.full(ORDER, 10, np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sample(docs: DataFrame, most: int = SAMPLE_BYTES, total: int = TOTAL_BYTES) -> dict[str, list[bytes]]:
    """Labelled training texts of each language: whole distinct ones, in hash order, up to ``most`` bytes."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"), 5, 0))
    n = rows.select("lang").distinct().count()
    found = ranked_sample(rows.select(F.col("lang").alias("kind"), "doc_id", "text"), min(most, total // max(n, 1)))
    return {lang: [t.encode() for t in texts] for lang, texts in found.items()}


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the ORDER bytes before it in its text (line feeds before the first) and itself, as one number."""
    x = LOWER[data].astype(np.uint64)
    key = x.copy()
    at = np.arange(len(x)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER + 1):
        before = np.full(len(x), 10, np.uint64)
        before[k:] = x[:-k] if k else x
        before[at < k] = 10
        key |= before << np.uint64(8 * k)
    return key


class Model:
    """Code lengths in bits: tables[k] has the sorted (k+1)-byte strings and their costs, escapes[k] the k-byte contexts."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        keys = {}
        for lang in self.langs:
            data = np.frombuffer(b"".join(texts[lang]), np.uint8)
            offsets = np.cumsum([0, *map(len, texts[lang])])
            keys[lang] = windows(data, offsets)
        self.tables, self.escapes = [], []
        n = len(self.langs)
        for k in range(ORDER + 1) if n else ():
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            grams = np.unique(np.concatenate([np.unique(keys[lang] & mask) for lang in self.langs]))
            contexts = np.unique(grams >> np.uint64(8))
            cost, escape = np.zeros((len(grams), n), np.float32), np.zeros((len(contexts), n), np.float32)
            lower = self._cost(k - 1, grams & (mask >> np.uint64(8)))
            of = np.searchsorted(contexts, grams >> np.uint64(8))
            for j, lang in enumerate(self.langs):
                own, count = np.unique(keys[lang] & mask, return_counts=True)
                seen = np.zeros(len(grams))
                seen[np.searchsorted(grams, own)] = count
                total, distinct = np.bincount(of, seen, len(contexts)), np.bincount(of, seen > 0, len(contexts))
                known = total > 0
                escape[known, j] = -np.log2(distinct[known] / (total + distinct)[known])
                with np.errstate(divide="ignore"):
                    cost[:, j] = np.where(seen > 0, -np.log2(seen / np.maximum(total + distinct, 1)[of]), escape[of, j] + lower[:, j])
            self.tables.append((grams, cost))
            self.escapes.append((contexts, escape))
        self._index: list | None = None

    def _cost(self, k: int, grams: np.ndarray) -> np.ndarray:
        if k < 0:
            return np.full((len(grams), len(self.langs)), 8, np.float32)
        return self.tables[k][1][np.searchsorted(self.tables[k][0], grams)]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        if self._index is None:
            self._index = [(pd.Index(g), pd.Index(c)) for (g, _), (c, _) in zip(self.tables, self.escapes, strict=True)]
        key, n = windows(data, offsets), len(self.langs)
        out = np.zeros((len(offsets) - 1, n))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        here = None  # all bytes at first
        for k in range(ORDER, -1, -1):
            part = key & np.uint64((1 << 8 * (k + 1)) - 1)
            place = self._index[k][0].get_indexer(part)
            found = place >= 0
            for j in range(n):
                column = np.ascontiguousarray(self.tables[k][1][:, j])
                if here is None:
                    out[:, j] += per_row(np.where(found, column[place], 0), offsets)
                else:
                    out[:, j] += np.bincount(row[found], column[place[found]], len(out))
            here = ~found
            key, row = key[here], row[here]
            context = self._index[k][1].get_indexer(part[here] >> np.uint64(8))
            known = context >= 0
            for j in range(n):
                out[:, j] += np.bincount(row[known], self.escapes[k][1][context[known], j], len(out))
        return out + 8.0 * np.bincount(row, minlength=len(out))[:, None]


def _named(model: Model, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """lang_pred and score of a column of texts."""
    names = np.array([*model.langs, "und"], object)
    data, offsets = text_buffer(column)
    bits = model.lengths(data, offsets)
    letters = per_row(_LETTER[data].astype(np.int64), offsets) > 0
    for d in np.flatnonzero(~letters):
        letters[d] = any(c.isalpha() for c in column[int(d)].as_py() or "")
    saved = np.maximum(1 - bits.min(1) / np.maximum(8 * np.diff(offsets), 1), 0)
    return pa.array(names[np.where(letters, bits.argmin(1), len(names) - 1)], pa.string()), np.where(letters, saved, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, and lang_pred, score. Only the text is used."""
    small_batches(docs)
    if not model.langs:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole.column(text), SLICE):
                batch = whole.slice(a, b - a)
                named, score = _named(shared.value, batch.column(text))
                yield pa.RecordBatch.from_arrays([*batch.columns, named, pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    schema = docs.select("*", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, most: int = SAMPLE_BYTES) -> Model:
    return Model(sample(docs, most))


def accepted(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The documents with a language: not ``und``, and with a score of ``least`` or more.

    Each text goes to the worker once; what stays comes back as it came.
    """
    small_batches(docs)
    if not model.langs:
        return docs.limit(0)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    # by place, as further columns may have one name
    placed, text = docs.toDF(*[f"c{k}" for k in range(len(names))]), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole.column(text), SLICE):
                batch = whole.slice(a, b - a)
                named, score = _named(shared.value, batch.column(text))
                yield batch.filter(pa.array((score >= least) & (np.asarray(named) != "und")))

    return placed.mapInArrow(run, placed.schema).toDF(*names)
