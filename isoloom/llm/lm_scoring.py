"""Operator 9: language-model scores of whole texts.

The model is a causal self-attention network (``attention``) on subword ids of the lower-cased texts; overlapping
windows score each id once. Unigram shares, the neighbour counts behind the classes of ids and the word counts of the
base score come from all training documents. The network starts on the driver, on whole documents of at most
SAMPLE_BYTES in hash order, and then goes once through all training documents: these are dealt to shards of about
SHARD_BYTES by hash, ROUNDS times a part of the shards takes its gradient steps side by side from the same weights, and
the weights are averaged, each shard by its ids (an input row by how often the shard has it).

Texts are encoded once. Ids spell the lower-cased bytes exactly, so words are read off the table of ids too. Word counts
stay distributed: blocks of at most BLOCK_IDS ids send their distinct words with their own counts to ranges of hashes,
packed as bytes. A range adds up all blocks' counts and sends each block the sums of its words, in the order of the
hashes, so the words need not come back. A word is known by its 64-bit hash.

Cases: null or empty text is the end token alone; a null doc_id counts as text "" in the split; rows are scored each,
equal ones too; without training rows all counts are 0 and the network keeps its initial weights; an empty table gives
no row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.attention import CLASSES, NEAR, OWN, VOCABULARY, Attention, add_neighbours, columns_of
from isoloom.llm.common import per_row, ranked_sample, slices, small_batches, text_buffer, written
from isoloom.llm.encode import ByteEncoder, encoder
from isoloom.llm.language_id import held_out
from isoloom.llm.words import LOWER, WHITE, hashes, scan, separators

#: Text on which the network starts, before it goes through all training documents.
SAMPLE_BYTES = 4_000_000
#: Ids of a block, whose words are looked up together; bytes of text of a training shard.
BLOCK_IDS, SHARD_BYTES = 4_000_000, 6_000_000
ROUNDS = 4
#: Of the distributed steps' first round; it falls in proportion.
RATE = 0.003
#: Sums of weights that come to the driver in a round.
SUMS = 16
#: Bytes of text for each range of word hashes, whose counts one task adds up.
RANGE_BYTES = 12_000_000
WORD = separators(WHITE)
#: Stands for the end token among word hashes.
END_WORD = 1
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and each row's bounds (rows + 1)."""
    parts = [np.frombuffer(x.as_buffer(), np.uint16) for x in column]
    return np.concatenate(parts or [np.zeros(0, np.uint16)]), np.cumsum([0, *map(len, parts)])


def _words(code: ByteEncoder, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts given as ids, and each text's first word. Ids spell the lower-cased text exactly."""
    data, at = code.text(ids)
    starts, ends, first = scan(data, at[bounds], WORD)
    return hashes(data, starts, ends), first


def _parts(column: pa.Array, most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a column of ids in runs of about ``most`` ids: first and last row, ids and bounds."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // 2
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")) + at)
        yield at, end, *_joined(column.slice(at, end - at))
        at = end


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in ascending order, and the place of each number among them."""
    coded = pa.array(words).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[coded.indices.to_numpy()]


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, first bytes first, as these compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(planes.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _bounds(words: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of words begins among sorted ones (ranges + 1)."""
    return np.searchsorted((words >> np.uint64(32)).view(np.int64), -(-(np.arange(ranges + 1) << 32) // ranges))


def block_words(every: DataFrame, tokenizer: str, ranges: int) -> DataFrame:
    """range, block, h, n: the distinct words of each block, by ranges of their hashes, and how often training texts of
    the block have each; the end token too. ``h`` and ``n`` are bytes (_planes), so words never become rows."""

    def packed(block: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, trained = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, place = _distinct(h)
        n = np.bincount(place[trained], minlength=len(h))
        bounds = _bounds(h, ranges)
        full = np.flatnonzero(np.diff(bounds)).tolist()
        rows = [(_planes(h[bounds[r] : bounds[r + 1]]), _planes(n[bounds[r] : bounds[r + 1]])) for r in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], ["range", "block", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ByteEncoder, tokenizer)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for a, b, part, bounds in _parts(batch.column(2)):
                block, held = (batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in (0, 1))
                h, first = _words(code, part, bounds)
                cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b - a]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    ends = np.full(y - x, END_WORD, np.uint64)
                    trained = np.repeat(~held[x:y], np.diff(first[x : y + 1]))
                    found.setdefault(int(block[x]), []).append((np.concatenate([h[first[x] : first[y]], ends]), np.concatenate([trained, ~held[x:y]])))
                last = int(block[-1])
                for k in [k for k in found if k != last]:  # a block's rows follow each other
                    yield packed(k, found.pop(k))
        for k, parts in found.items():
            yield packed(k, parts)

    return every.select("block", "held_out", "ids").mapInArrow(run, "range int, block long, h binary, n binary")


def corpus_counts(words: DataFrame) -> DataFrame:
    """range, block, n, seen, kinds: how often all training texts have each word of a block's range, in the order of the
    hashes, as bytes; one row of each range has the range's tokens and distinct tokens, the others 0."""

    def counted(table: pa.Table) -> pa.Table:
        held = [_numbers(x, np.uint64) for x in table["h"]]
        h, place = _distinct(np.concatenate(held))
        total = np.zeros(len(h), np.int64)
        np.add.at(total, place, np.concatenate([_numbers(x, np.int64) for x in table["n"]]))
        of: dict[int, list[np.ndarray]] = {}
        cuts = np.cumsum([0, *map(len, held)]).tolist()
        for block, x, y in zip(table["block"].to_pylist(), cuts[:-1], cuts[1:], strict=True):
            of.setdefault(block, []).append(place[x:y])
        # a block that two tasks read has its words from both
        n = [_planes(total[x[0] if len(x) == 1 else np.unique(np.concatenate(x))]) for x in of.values()]
        first = np.arange(len(n)) == 0
        sums = [pa.array(np.where(first, x, 0), pa.int64()) for x in (total.sum(), np.count_nonzero(total))]
        return pa.table([pa.array([table["range"][0].as_py()] * len(n), pa.int32()), pa.array(list(of), pa.int64()), pa.array(n, pa.binary()), *sums], ["range", "block", "n", "seen", "kinds"])

    return words.groupBy("range").applyInArrow(counted, "range int, block long, n binary, seen long, kinds long")


def id_table(docs: DataFrame, tokenizer: str, shards: int) -> DataFrame:
    """doc_id, held_out, block, shard, rank, ids (two bytes each) of all texts (doc_id, held_out, text).

    A block is a run of rows of one task, up to BLOCK_IDS ids (one row at least). Shards go by hash and by the place in
    the task, so that equal rows are spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, block, size, place = encoder(ByteEncoder, tokenizer), TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for a, b in slices(batch.column(3)):
                data, offsets = text_buffer(batch.column(3).slice(a, b - a))
                whole, bounds = LOWER[data].tobytes(), offsets.tolist()
                ids = code.ids([whole[x:y].decode() for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
                rank = batch.column(2).slice(a, b - a).to_numpy()
                blocks = []
                for x in ids:
                    if size and size + len(x) > BLOCK_IDS:
                        block, size = block + 1, 0
                    size += len(x) + 1
                    blocks.append(block)
                shard = (rank % shards + np.arange(place, place + b - a)) % shards
                place += b - a
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(blocks, pa.int64()), pa.array(shard), pa.array(rank), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "held_out", "block", "shard", "rank", "ids"])

    return docs.select("doc_id", "held_out", F.xxhash64("doc_id", "text"), "text").mapInArrow(run, "doc_id long, held_out boolean, block long, shard long, rank long, ids binary")


def train_ids(train: DataFrame, tokenizer: str, shards: int) -> DataFrame:
    """shard, rank, ids of training texts (doc_id, text)."""
    return id_table(train.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"), tokenizer, shards).select("shard", "rank", "ids")


def id_counts(ids: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for _, _, part, _ in _parts(batch.column(0)):
                total += np.bincount(part, minlength=VOCABULARY)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["h", "n"])

    out = np.zeros(VOCABULARY)
    for r in ids.select("ids").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        out[r["h"]] = r["n"]
    return out


def _neighbour_cells(batches: Iterator[pa.RecordBatch], column: np.ndarray) -> Iterator[pa.RecordBatch]:
    """cell, n: how often an id (cell // (2 * NEAR)) has a neighbour. A batch is counted in parts, as the counting takes
    many bytes an id."""
    near = np.zeros((VOCABULARY, 2 * NEAR), np.int32)  # a task has fewer than 2**31 ids
    for batch in batches:
        for _, _, part, bounds in _parts(batch.column(0)):
            add_neighbours(near, part, bounds, column)
    cell = np.flatnonzero(near)
    for at in range(0, len(cell), 100_000):
        part = cell[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(near.reshape(-1)[part].astype(np.int64))], ["cell", "n"])


def neighbours(ids: DataFrame, counts: np.ndarray) -> np.ndarray:
    """How often each id has each of the NEAR most frequent ids before or after it, over all training texts."""
    column, wide = columns_of(counts), 2 * NEAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _neighbour_cells(batches, column)

    def rows(table):
        cell, n = table["cell"].to_numpy(), table["n"].to_numpy()
        of, at = np.unique(cell // wide, return_inverse=True)
        near = np.zeros((len(of), wide), np.float32)
        near[at.reshape(-1), cell % wide] = n
        return pa.table({"id": pa.array(of), "near": pa.array([x.tobytes() for x in near], pa.binary())})

    cells = ids.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros((VOCABULARY, wide), np.float32)
    for r in cells.groupBy(F.floor(F.col("cell") / (wide * 1024))).applyInArrow(rows, "id long, near binary").toLocalIterator():  # a row an id
        out[r["id"]] = np.frombuffer(r["near"], np.float32)
    return out


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in sorted(w)]).astype(np.float64)


def _weight(model: Attention, n: int, came: np.ndarray) -> np.ndarray:
    """The weight of each parameter after ``n`` ids, whose input rows came so often."""
    return np.concatenate([np.repeat(came, model.w[k].shape[1]) if k == "emb" else np.full(model.w[k].size, n) for k in sorted(model.w)])


def _round(model: Attention, ids: DataFrame, rate: float, tasks: int) -> Attention:
    """The average of the models that each shard of ``ids`` makes of ``model``."""
    shared = ids.sparkSession.sparkContext.broadcast(model)
    kind = "part long, n long, came binary, moved binary"

    def fit(table):
        m = shared.value.copied()
        rows = sorted(zip(table["rank"].to_pylist(), table["ids"].to_pylist(), strict=True))
        shard = table["shard"][0].as_py()
        n, came = m.epoch([np.frombuffer(x, np.uint16) for _, x in rows], rate, shard)
        moved = (_flat(m.w) - _flat(shared.value.w)) * _weight(m, n, came)
        return pa.table({"part": [shard // ROUNDS % SUMS], "shard": [shard], "n": [n], "came": [came.tobytes()], "moved": [moved.tobytes()]})

    def added(table):
        n, came, moved = 0, np.zeros(OWN + CLASSES, np.int64), 0.0
        for k in np.argsort(table["shard"].to_numpy()).tolist():
            n += table["n"][k].as_py()
            came += np.frombuffer(table["came"][k].as_py(), np.int64)
            moved = moved + np.frombuffer(table["moved"][k].as_py(), np.float64)
        return pa.table({"part": [table["part"][0].as_py()], "n": [n], "came": [came.tobytes()], "moved": [moved.tobytes()]})

    parts = ids.repartition(tasks, "shard").groupBy("shard").applyInArrow(fit, kind.replace("n long", "shard long, n long"))
    got = sorted(parts.groupBy("part").applyInArrow(added, kind).collect(), key=lambda r: r["part"])
    if not got:
        return model
    n, came = sum(r["n"] for r in got), sum(np.frombuffer(r["came"], np.int64) for r in got)
    moved = sum(np.frombuffer(r["moved"], np.float64) for r in got) / np.maximum(_weight(model, n, came), 1)
    out, at = model.copied(), 0
    for k in sorted(out.w):
        size = out.w[k].size
        out.w[k] += moved[at : at + size].reshape(out.w[k].shape).astype(np.float32)
        at += size
    return out


def fit_all(model: Attention, ids: DataFrame, shards: int) -> Attention:
    """``model`` after one pass through all training texts: in each round a part of the shards, then their average."""
    rounds = min(ROUNDS, shards)
    for turn in range(rounds):
        model = _round(model, ids.where(F.col("shard") % rounds == turn), RATE * (1 - turn / rounds), -(-(shards - turn) // rounds))
    return model


def sample_ids(train: DataFrame, tokenizer: str, most: int = SAMPLE_BYTES) -> list[np.ndarray]:
    """Ids of whole distinct training texts in hash order, of about ``most`` bytes of text in all, one at least."""
    code = encoder(ByteEncoder, tokenizer)
    texts = ranked_sample(train.select(F.lit("").alias("kind"), "doc_id", "text"), most).get("", [])
    return [code.ids([LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes().decode()])[0].astype(np.int64) for t in texts]


def score(docs: DataFrame, tokenizer: str, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """One row a document: SCORES."""
    small_batches(docs)
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    every = written(id_table(base, tokenizer, shards))  # texts are encoded once; all that follows reads ids
    ids = every.where("NOT held_out")
    counts = written(corpus_counts(block_words(every, tokenizer, max(1, -(-size // RANGE_BYTES)))))
    totals = counts.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    share = id_counts(ids)
    start = Attention(sample_ids(base.where("NOT held_out"), tokenizer), share, near=neighbours(ids, share))
    model = spark.sparkContext.broadcast(fit_all(start, ids.select("shard", "rank", "ids"), shards))
    seen, kinds = int(totals[0]), int(totals[1])

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        code = encoder(ByteEncoder, tokenizer)
        parts = [(part, bounds, *_words(code, part, bounds)) for column in left["ids"].chunks for _, _, part, bounds in _parts(column)]
        h, place = _distinct(np.concatenate([np.array([END_WORD], np.uint64), *(words for _, _, words, _ in parts)]))
        at = np.argsort(right["range"].to_numpy())
        c = np.concatenate([_numbers(right["n"][k], np.int64) for k in at.tolist()])
        if len(c) != len(h):
            raise ValueError("a block's words and their counts differ")
        log, occurs = np.log10(c + 1.0), (c > 0).astype(np.int64)
        end, place = place[0], place[1:]
        tokens, known, base_score, scores = [], [], [], []
        for part, bounds, words, first in parts:
            mine, place = place[: len(words)], place[len(words) :]
            size = np.diff(first) + 1
            tokens.append(size)
            known.append(per_row(occurs[mine], first) + occurs[end])
            base_score.append(per_row(log[mine], first) + log[end] - size * math.log10(seen + kinds + 1))
            scores.append(model.value.score([part[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]) / math.log(10))
        join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        count = pa.array(np.full(left.num_rows, seen), pa.int64())
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": join(tokens, pa.int64()), "n_known": join(known, pa.int64()), "train_tokens": count, "base_score": join(base_score, pa.float64()), "score": join(scores, pa.float64())})

    return every.select("block", "doc_id", "held_out", "ids").groupBy("block").cogroup(counts.select("block", "range", "n").groupBy("block")).applyInArrow(finish, SCORES)
