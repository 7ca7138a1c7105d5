"""Operator 5: benchmark decontamination by a generalised suffix automaton.

The automaton holds the word sequences of all items. Document words stream through it; after each word its state and
matched length say which item words end here. A match of a whole window (13 item words, or all words of a shorter item)
hits the words it covers. Words that no item has, and word pairs that stand beside each other in no item, end a match,
so only runs without them are streamed. Hashes of words find these runs; within them words are known by their bytes.

Items are taken in blocks of at most BLOCK_WORDS words (about 300 bytes of automaton each), one pass over the
documents for each block; the driver and every executor hold one block at a time.

Cases: null or empty text has no words and no hit; an item without words hits nothing; equal items count once for each
item_id (a null item_id is written "null"); ids of equal rows stay separate rows; no items: nothing is hit; an empty
table gives no row; further columns are carried by ``clean`` and ignored by ``hits``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.llm.common import slices, small_batches, text_buffer, written
from isoloom.llm.words import LOWER, PUNCT, hashes, mix, scan, separators

WINDOW = 13
#: A document is contaminated from one hit word in so many.
COVERAGE = 20
BLOCK_WORDS = 400_000
WORD = separators(PUNCT)
HIT = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, spans: array<struct<start: int, end: int>>>"
HIT_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


class Automaton:
    """Generalised suffix automaton over word numbers (0 is no word of any item)."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        texts = pa.array([t for _, t in items], pa.large_string())
        data, offsets = text_buffer(texts)
        data = LOWER[data]
        starts, ends, first = scan(data, offsets, WORD)
        #: Word numbers by bytes. Hashes, which unlike words may share, have numbers of their own: they choose the runs.
        self.exact: dict[bytes, int] = {}
        number = [self.exact.setdefault(data[a:b].tobytes(), len(self.exact) + 1) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.vocabulary, hashed = np.unique(hashes(data, starts, ends), return_inverse=True)
        hashed = hashed.reshape(-1).astype(np.int64) + 1
        self.length, self.link, self.next = [0], [-1], [{}]
        paths, pairs, self.least = [], [], window
        for k, (item, _) in enumerate(items):
            run, like = number[first[k] : first[k + 1]], hashed[first[k] : first[k + 1]]
            if run:
                self.least = min(self.least, len(run))
                pairs.append(like[:-1] << 32 | like[1:])
                paths.append((item, run))
                self._add(run)
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        #: Items of windows: by the state of a 13-word string, and by the state where a short item ends.
        self.of_state: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for item, run in paths:
            state, n = 0, 0
            for w in run:
                state, n = self.next[state][w], min(n + 1, window)
                while self.length[self.link[state]] >= n and state:
                    state = self.link[state]
                if n == window:
                    self.of_state.setdefault(state, set()).add(item)
            if len(run) < window:
                self.short.setdefault(state, {}).setdefault(len(run), set()).add(item)
        #: The nearest state up the suffix links (itself included) at which a short item ends.
        self.above = [-1] * len(self.length)
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.above[v] = v if v in self.short else self.above[self.link[v]] if v else -1

    def _add(self, run: list[int]) -> None:
        last = 0
        for w in run:
            seen = self.next[last].get(w)
            if seen is not None:
                last = seen if self.length[seen] == self.length[last] + 1 else self._copy(last, w, seen)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, w, q)
            last = new

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _copy(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def stream(self, run: list[int], at: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        """Add the word spans (from ``at``) and items that the run's windows hit."""
        state, n, length, link, window = 0, 0, self.length, self.link, self.window
        for i, w in enumerate(run, at + 1):
            while state and w not in self.next[state]:
                state = link[state]
                n = length[state]
            state, n = (self.next[state][w], n + 1) if w in self.next[state] else (0, 0)
            if n >= window:
                n = window
                while length[link[state]] >= n:
                    state = link[state]
                spans.append((i - window, i))
                items |= self.of_state[state]
            v = self.above[state] if n else -1
            while v > 0:
                for m, found in self.short[v].items():
                    if m <= n:
                        spans.append((i - m, i))
                        items |= found
                v = self.above[link[v]]


def _runs(h: np.ndarray, first: np.ndarray, automaton: Automaton) -> Iterator[tuple[int, int, int]]:
    """(document, first word, word after the last) of runs that can hold a window, going by hashes."""
    vocabulary = automaton.vocabulary
    if not len(vocabulary) or not len(h):
        return
    place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    number = np.where(vocabulary[place] == h, place + 1, 0)
    joined = np.zeros(len(h), bool)  # this word goes on from the one before
    if len(automaton.pairs):
        pair = number[:-1] << 32 | number[1:]
        at = np.minimum(np.searchsorted(automaton.pairs, pair), len(automaton.pairs) - 1)
        joined[1:] = automaton.pairs[at] == pair
    joined[first[:-1][first[:-1] < len(h)]] = False
    begin = np.flatnonzero((number > 0) & ~joined)
    if not len(begin):
        return
    stops = np.flatnonzero(~joined)
    after = np.append(stops, len(h))[np.searchsorted(stops, begin, "right")]
    for a, b in zip(begin[after - begin >= automaton.least].tolist(), after[after - begin >= automaton.least].tolist(), strict=True):
        yield int(np.searchsorted(first, a, "right")) - 1, a, b


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The distinct items, a block at a time; the driver never holds many more than BLOCK_WORDS words (or one item).

    Items go to buckets by hash, of which a block takes as many as its words allow.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = F.size(F.split("text", "[^A-Za-z0-9\u0080-\U0010ffff]+"))
    words = items.agg(F.sum(size)).first()[0] or 0
    if words <= BLOCK_WORDS:
        yield [(r["item_id"], r["text"]) for r in items.collect()]
        return
    n = 64 * -(-words // BLOCK_WORDS)  # a bucket is a small part of a block
    placed = written(items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).withColumn("n", size))
    sums = {r["bucket"]: r["n"] for r in placed.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    low, held = 0, 0
    for k in range(n + 1):
        more = sums.get(k, 0)
        if k == n or (held and held + more > BLOCK_WORDS):
            yield [(r["item_id"], r["text"]) for r in placed.where((F.col("bucket") >= low) & (F.col("bucket") < k)).collect()]
            low, held = k, 0
        held += more


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default), and a struct ``hit``: n_words, n_hit, n_items, items_sha256, contaminated, spans (bytes from, to).

    One block of items is looked for while the texts are read. Of several blocks each has a pass of its own, which
    writes what it finds by a 128-bit hash of the text; then all finds of a text are put together.
    """
    small_batches(docs)
    spark, carry = docs.sparkSession, docs.columns if carry is None else carry
    blocks = _blocks(items)
    block, after = next(blocks), next(blocks, None)
    kept = [c for c in docs.columns if c in carry]
    schema = docs.select(*kept, F.lit(None).cast(HIT).alias("hit")).schema
    if after is None:
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(_digests(kept, coverage, shared), schema)
    finds = []
    keys = [F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")]
    while block is not None:
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        finds.append(written(docs.select(*keys, "text").mapInArrow(_finds(shared), FOUND)))
        shared.destroy()  # before the next one is made
        block, after = after, next(blocks, None)
    every = reduce(DataFrame.unionByName, finds).distinct()  # equal texts find the same
    found = every.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    of = written(found.select(F.col("_k1").alias("_f1"), F.col("_k2").alias("_f2"), F.struct("spans", "items").alias("_found")))
    rows = docs.select(*kept, F.col("text").alias("_text"), *keys).join(of, (F.col("_k1") == F.col("_f1")) & (F.col("_k2") == F.col("_f2")), "left")
    return rows.select(*kept, "_text", "_found").mapInArrow(_digests(kept, coverage, None), schema)


#: What one block's pass finds in a text.
FOUND = "_k1 long, _k2 long, spans array<long>, items array<string>"


def _scan(column: pa.Array, automaton: Automaton):
    """Of a column of texts: offsets, word starts, ends and each text's first, and what the automaton finds by row."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    starts, ends, first = scan(data, offsets, WORD)
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    if automaton is not None:
        for d, at, end in _runs(hashes(data, starts, ends), first, automaton):
            spans: list[tuple[int, int]] = []
            items: set[str] = set()
            run = [automaton.exact.get(data[a:b].tobytes(), 0) for a, b in zip(starts[at:end].tolist(), ends[at:end].tolist(), strict=True)]
            automaton.stream(run, at - int(first[d]), spans, items)
            if spans:
                old = found.setdefault(d, ([], set()))
                old[0].extend(_merged(spans))
                old[1].update(items)
    return offsets, starts, ends, first, found


def _finds(shared):
    """The pass of one of several blocks: FOUND of the texts it hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole.column(2), 1 << 20):
                batch = whole.slice(a, b - a)
                *_, found = _scan(batch.column(2), shared.value)
                rows = sorted(found)
                spans = pa.array([[x << 32 | y for x, y in found[d][0]] for d in rows], pa.list_(pa.int64()))
                items = pa.array([sorted(found[d][1]) for d in rows], pa.list_(pa.string()))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), spans, items], ["_k1", "_k2", "spans", "items"])

    return run


def _digests(kept: list[str], coverage: int, shared):
    """``kept`` and hit, from one automaton, or from the column after the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole.column(len(kept)), 1 << 20):
                batch = whole.slice(a, b - a)
                offsets, starts, ends, first, found = _scan(batch.column(len(kept)), shared and shared.value)
                if shared is None:
                    for d, x in enumerate(batch.column(len(kept) + 1).to_pylist()):
                        if x is not None:
                            found[d] = ([(s >> 32, s & 0xFFFFFFFF) for s in x["spans"]], set(x["items"]))
                digest = pa.array(_digest(found, offsets, starts, ends, first, coverage), HIT_ARROW)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], digest], [*kept, "hit"])

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digest(found: dict[int, tuple[list[tuple[int, int]], set[str]]], offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, coverage: int) -> list[dict]:
    out = []
    for d in range(len(first) - 1):
        spans, items = found.get(d, ([], set()))
        spans, items = _merged(spans), sorted(items)
        n, hit = int(first[d + 1] - first[d]), sum(b - a for a, b in spans)
        base = int(offsets[d])
        where = [{"start": int(starts[first[d] + a]) - base, "end": int(ends[first[d] + b - 1]) - base} for a, b in spans]
        out.append({"n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "contaminated": hit > 0 and coverage * hit >= n, "spans": where})
    return out


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, cut: bool = False) -> DataFrame:
    """``docs`` without contaminated rows; with ``cut``, hit spans of the others are removed from their texts too."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # names of further columns can't clash
    found = hits(rows, items, window, coverage, carry=["row"]).where("NOT hit.contaminated")
    if cut:
        text = F.col("row.text")
        binary = F.encode(text, "UTF-8")
        edges = F.concat(F.array(F.lit(0)), F.transform("hit.spans", lambda s: s["end"]))
        stops = F.concat(F.transform("hit.spans", lambda s: s["start"]), F.array(F.octet_length(text)))
        parts = F.zip_with(edges, stops, lambda a, b: F.decode(F.substring(binary, a + 1, b - a), "UTF-8"))
        found = found.withColumn("row", F.col("row").withField("text", F.when(F.size("hit.spans") > 0, F.array_join(parts, "")).otherwise(text)))
    return found.select("row.*")


#: The same rows in SQL, for tables whose doc_id is unique.
ORACLE = r"""
WITH words AS (
  SELECT 'd' AS k, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', coalesce(CAST(item_id AS VARCHAR), 'null'), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (SELECT id, w, least(13, len(w)) AS m FROM words WHERE k = 'i' AND len(w) > 0
), win AS (SELECT DISTINCT id AS item, m, array_to_string(w[i:i+m-1], ' ') AS g FROM items, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) t(i)
), run AS (SELECT id, m, i, array_to_string(w[i:i+m-1], ' ') AS g FROM words, (SELECT DISTINCT m FROM win) l, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) t(i) WHERE k = 'd' AND len(w) >= m
), hit AS (SELECT run.id, run.m, run.i, item FROM run JOIN win ON win.m = run.m AND win.g = run.g
), cover AS (SELECT id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + m)) u(p) GROUP BY id
), found AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT id, item FROM hit) q GROUP BY id)
SELECT CAST(words.id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN cover ON cover.id = words.id LEFT JOIN found ON found.id = words.id WHERE k = 'd'
"""
