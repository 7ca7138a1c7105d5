"""Operator 1: lexical retrieval packing.

Documents become ids; every shard (a run of rows of the stored ids, bounded in size) has a BM25 inverted index with
document frequencies and mean length of the whole table. The part of a document beyond its whole windows seeds a
sequence, which its best unused neighbours fill; the last one is cut at the window's end and its rest stays unused.
What is left at a shard's end goes into sequences whose lengths are powers of two, which need no padding.

Shards follow the stored order, so no row moves between tasks after tokenising.

Cases: null or empty text is the end id alone; equal scores go by stored order; rows with equal doc_id are packed each;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import slices, small_batches, written
from isoloom.llm.encode import ByteEncoder, encoder

WINDOW = 1024
SHARD_IDS = 2_000_000
K1, B = 1.2, 0.75
#: Of each batch one text of fewer bytes is encoded by the vocabulary's other library too.
CHECKED = 20_000
IDS = 1 << 16
#: Neighbours that are looked up at once, beside those that fill a window on average; if they don't, eight times as many are.
NEIGHBOURS = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed boolean"


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """doc_id, ids (uint16 bytes); and for each task one row whose ``counts`` has the document frequency of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, counts = encoder(ByteEncoder, tokenizer), np.zeros(IDS, np.int32)
        end = np.array([end_id], np.uint16)
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32())]
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            some = np.flatnonzero((sizes > 0) & (sizes < CHECKED))[:1]
            code.check([batch.column(1)[int(k)].as_py() for k in some])
            for a, b in slices(batch.column(1)):
                ids = [np.concatenate([x, end]) for x in code.ids([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])]
                for x in ids:
                    counts[np.unique(x)] += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in ids], kinds[1]), pa.nulls(b - a, kinds[2])], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.array([counts], kinds[2])], ["doc_id", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, counts array<int>")


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Of each id; the number of documents; their mean length. The vocabulary bounds what the driver gets."""

    def run(batches):
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += x.values.to_numpy()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n, total = tokens.where("ids IS NOT NULL").agg(F.count("*"), F.sum(F.octet_length("ids") / 2)).first()
    found = np.zeros(IDS)
    for r in rows:
        found[r["id"]] = r["n"]
    return found, n, float(total or 0) / max(n, 1)


class Index:
    """BM25 postings of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, places, weights, self.asks = [], [], [], []
        for d, ids in enumerate(docs):
            run = np.sort(ids, kind="stable")
            at = np.flatnonzero(np.diff(run, prepend=-1))
            term, tf = run[at], np.diff(at, append=len(run))
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
            terms.append(term)
            places.append(np.full(len(term), d, np.int32))
            weights.append(weight.astype(np.float32))
            self.asks.append(term)
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.places, self.weights, self.size = np.concatenate(places)[order], np.concatenate(weights)[order], len(docs)
        self.bounds = np.searchsorted(term[order], np.arange(IDS + 1))
        self.alive = len(docs)

    def keep(self, left: np.ndarray) -> None:
        """Drop the postings of used documents, once half of the indexed ones are used."""
        now = int(np.count_nonzero(left))
        if 2 * now <= self.alive:
            stay = left[self.places] > 0
            self.bounds = np.concatenate([[0], np.cumsum(stay)])[self.bounds]
            self.places, self.weights, self.alive = self.places[stay], self.weights[stay], now

    def scores(self, d: int) -> np.ndarray:
        """BM25 of all documents for all distinct ids of document ``d``."""
        begin, end = self.bounds[self.asks[d]], self.bounds[self.asks[d].astype(np.int64) + 1]
        parts = [slice(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if a < b]
        return np.bincount(np.concatenate([self.places[p] for p in parts]), np.concatenate([self.weights[p] for p in parts]), self.size)


def best(score: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` greatest scores that aren't negative, greatest first, equal ones in stored order."""
    if most < len(score):
        least = max(np.partition(score, len(score) - most)[-most], 0)
        above = np.flatnonzero(score > least)
        place = np.sort(np.concatenate([above, np.flatnonzero(score == least)[: most - len(above)]]))
    else:
        place = np.flatnonzero(score >= 0)
    return place[np.argsort(-score[place], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int, bool]]:
    """(document, start, length, sequence, offset, seed) of each piece."""
    out: list[tuple[int, int, int, int, int, bool]] = []
    sequence = 0
    at = np.zeros(len(docs), np.int64)
    size = np.array([len(x) for x in docs], np.int64)
    for d, n in enumerate(size.tolist()):
        for start in range(0, n - window + 1, window):
            out.append((d, start, window, sequence, 0, True))
            sequence += 1
        at[d] = n - n % window
    left, total = size - at, int((size - at).sum())
    index = Index(docs, idf, mean)

    def take(d: int, most: int, offset: int, seed: bool) -> int:
        n = int(min(left[d], most))
        out.append((d, int(at[d]), n, sequence, offset, seed))
        at[d] += n
        left[d] -= n
        return n

    seed = 0
    while total >= window:
        while not left[seed]:
            seed += 1
        index.keep(left)
        score = index.scores(seed)
        filled = take(seed, window, 0, True)
        score[left == 0] = -1
        most = NEIGHBOURS + window * index.alive // total
        while filled < window:  # each neighbour has one id at least, so few rounds do
            found = best(score, min(most, window - filled)).tolist()
            for d in found:
                filled += take(d, window - filled, filled, False)
                if filled == window:
                    break
            score[found] = -1
            most *= 8
        total -= window
        sequence += 1
    rest = [d for d in np.flatnonzero(left).tolist()]
    while total:
        goal, filled = 1 << (total.bit_length() - 1), 0
        while filled < goal:
            while not left[rest[0]]:
                rest.pop(0)
            filled += take(rest[0], goal - filled, filled, filled == 0)
        total -= goal
        sequence += 1
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row a piece: PIECES. sequence_id is unique over the table."""
    small_batches(docs)
    encoder(ByteEncoder, tokenizer).check_vocabulary()
    tokens = written(token_table(docs, tokenizer, end_id))
    found, n, mean = document_frequencies(tokens)
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((n - found + 0.5) / (found + 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list = []
        ids: list[np.ndarray] = []
        sequence, total = TaskContext.get().partitionId() << 40, 0

        def flush() -> pa.RecordBatch:
            pieces = pack_shard(ids, idf.value, mean, window)
            crc = [zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes()) for d, a, n, *_ in pieces]
            d, a, n, s, o, seed = zip(*pieces, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([doc_ids[x] for x in d], pa.int64()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([len(ids[x]) for x in d], pa.int64()), pa.array(np.array(s, np.int64) + sequence), pa.array(o, pa.int64()), pa.array(seed)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "seed"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(d)
                ids.append(np.frombuffer(x.as_buffer(), np.uint16))
                total += len(ids[-1])
                if total >= shard_ids:
                    yield (out := flush())
                    sequence += out.column(5)[-1].as_py() + 1 - sequence
                    doc_ids, ids, total = [], [], 0
        if ids:
            yield flush()

    return tokens.where("ids IS NOT NULL").select("doc_id", "ids").mapInArrow(run, PIECES)
