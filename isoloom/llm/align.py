"""Operator 12: alignment of two tokenizers.

Each text is encoded by a byte-level BPE (with a space before it) and by a piece model (which adds one). Tokens of either
are intervals of the same bytes. Neither tokenizer joins anything over a space, tab or line feed that follows another
kind of character, so texts are cut there, and each distinct cut of a chunk (a run of rows of bounded bytes) is encoded
and aligned once. DuckDB does that in the Python worker on Arrow tables of token intervals: an ASOF join finds the piece
that covers a token's first byte, a range join those that begin within the token, window sums over common ends number
the groups. It also counts in how many of the chunk's documents each pair of ids is linked. Spark adds these counts up,
and each chunk gets back the whole counts of its own pairs only, so a pair that all documents have crosses the network
once a chunk.

Cases: null and empty texts, and those whose joined tokens are not the text (the piece model reads U+2581 as a space),
have no tokens: zeros, and an empty ``groups_sha256``. Names of special tokens in a text are text. Equal rows each count
as a document; an empty table gives no row; further columns are ignored. A very long text is a chunk of its own, whose
cuts go through DuckDB in blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import per_row, small_batches, text_buffer, written
from isoloom.llm.encode import encoder

#: Bytes of text of a chunk, at least one row; letters of a text that are cut at once; tokens of a block for DuckDB.
CHUNK = 8 << 20
SECTION = 4 << 20
TOKENS = 250_000
#: Cuts of a text that goes to a tokenizer; cuts above which a worker forgets all, before its next chunk.
JOINED = 2000
REMEMBERED = 300_000
#: Rows of the table of pair counts up to which it is broadcast.
BROADCAST_PAIRS = 200_000

CHUNKS = "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, docs long, cuts array<int>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: Where texts are not cut by plain splitting: white space in a row, at the end, or of other kinds.
_ODD = re.compile(r"\s\s|[^\S \n]|\s$")
_CUT = re.compile(r"\s*\S+(?:(?![ \t\n])\s+\S*)*|\s+")
_BORDER = re.compile(r"(?<=\S)[ \t\n]")
#: A cut is known by its text without the space before it; one that begins with another character has this before it.
_BARE = "\0"


def sections(text: str) -> Iterator[str]:
    """A long text in parts that begin where it may be cut."""
    while len(text) > SECTION and (m := _BORDER.search(text, SECTION)):
        yield text[: m.start()]
        text = text[m.start() :]
    yield text


def cuts(text: str) -> list[str]:
    """The keys of the cuts of a text that begins with white space."""
    if _ODD.search(text):
        return [c[1:] if c[0] == " " else _BARE + c for c in _CUT.findall(text)]
    first, *lines = text.split("\n")
    found = first.split(" ")
    head = [] if first[:1] == " " else [_BARE + found[0]] if found[0] else []
    found = head + found[1:]
    for line in lines:
        a, *rest = line.split(" ")
        found.append(f"{_BARE}\n{a}")
        found += rest
    return found


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = found = len(self)
        return found


def _gather(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of ids, one after the other."""
    size = sizes[ids]
    at = np.cumsum(size) - size
    return letters[np.repeat(starts[ids] - at, size) + np.arange(int(size.sum()))]


class Pair:
    """Both tokenizers, the bytes of their ids, and the cuts that this worker has aligned lately: their numbers by key,
    and by number their counts, groups and links."""

    def __init__(self, paths: tuple[str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(paths[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(re.search("[^▁ \t\n][▁ \t\n]|[▁ ][\t\n]|[\t\n].", n) for n in names):
            raise ValueError("a piece goes over the start of a word")
        self.space = self.b.piece_to_id("▁")
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters: dict[str, int] = {}
        for code in [*range(0x80), *range(0xA0, 0x800, 0x20), *range(0x80, 0xC0), *range(0x1000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x10000)]:
            if not 0xD800 <= code < 0xE000:
                letters.update(zip(level.pre_tokenize_str(chr(code))[0][0], chr(code).encode(), strict=True))
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for name, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.tables = []
        for names in (self.bytes_a, self.bytes_b):
            sizes = np.array([len(x) for x in names], np.int64)
            self.tables.append((np.frombuffer(b"".join(names), np.uint8), np.cumsum(sizes) - sizes, sizes))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.counts = np.zeros((0, 4), np.int64)
        self.groups: list[str] = []
        self.first = np.zeros(1, np.int64)
        self.links = np.zeros((2, 0), np.int32)

    def ids_a(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def ids_b(self, text: str) -> list[int]:
        """The pieces of a text that begins with white space, without a space of the model's own."""
        if text == " ":
            return [self.space]
        return self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By either tokenizer the ids of cuts and the bytes that each cut's ids stand for, as far as those are the cut
        (else it has no ids).

        Cuts in a row are encoded as one text, as in the texts that they come from. Where that does not give its bytes
        back or the ends of its cuts, and for cuts that end in white space, it is done cut by cut.
        """
        data, bounds = text_buffer(pa.array(texts, pa.large_string()))
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for at in range(0, len(texts), JOINED):
            part = texts[at : at + JOINED]
            inner = bounds[at : at + len(part) + 1] - bounds[at]
            bare = data[bounds[at] : bounds[at + len(part)]]
            joined = None if any(t[-1].isspace() for t in part) else "".join(part)
            both = []
            for encode, table in ((self.ids_a, self.tables[0]), (self.ids_b, self.tables[1])):
                ids = np.array(encode(joined) if joined is not None else [], np.int32)
                ends = np.cumsum(table[2][ids])
                upto = np.searchsorted(ends, inner[1:], "right")
                if joined is None or len(ends) == 0 or ends[-1] != inner[-1] or (ends[upto - 1] != inner[1:]).any() or (_gather(*table, ids) != bare).any():
                    break
                both.append((ids, np.diff(upto, prepend=0)))
            if len(both) < 2:
                both = [list(x) for x in zip(*(self._alone(t) for t in part), strict=True)]
                both = [(np.concatenate(x) if x else np.zeros(0, np.int32), np.array([len(i) for i in x], np.int64)) for x in both]
            for k in (0, 1):
                found[k].append(both[k])
        return [(np.concatenate([x[0] for x in f]), np.concatenate([x[1] for x in f])) for f in found]

    def _alone(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        both = [np.array(x, np.int32) for x in (self.ids_a(text), self.ids_b(text))]
        same = all(_gather(*t, x).tobytes() == text.encode() for t, x in zip(self.tables, both, strict=True))
        return tuple(both) if same else (np.zeros(0, np.int32),) * 2

    def numbered(self, keys: Iterator[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, keys), np.int32)

    def align(self) -> None:
        """Align the cuts that have a number only."""
        known = len(self.groups)
        new = list(itertools.islice(self.numbers, known, None))
        texts = [k[1:] if k[:1] == _BARE and k[1:2] in ("\n", "\t") else f" {k}" for k in new]
        if not new:
            return
        (a, n_a), (b, n_b) = self.encoded(texts)
        at_a, at_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        at, parts = 0, []
        while at < len(new):
            end = max(at + 1, int(np.searchsorted(at_a, at_a[at] + TOKENS, "right")) - 1)
            parts.append(self._block(a[at_a[at] : at_a[end]], n_a[at:end], b[at_b[at] : at_b[end]], n_b[at:end]))
            at = end
        self.counts = np.concatenate([self.counts, *(p[0] for p in parts)])
        for p in parts:
            self.groups += p[1]
        self.first = np.r_[0, np.cumsum(np.maximum(self.counts[:, 3], 0))]
        self.links = np.concatenate([self.links, *(p[2] for p in parts)], 1)

    def _block(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """For each cut its numbers of tokens, pieces, groups and links (-1 where it has no tokens) and its groups as
        text; the links by cut."""
        db, tables = self.db, {}
        for name, ids, n, sizes in (("a", a, n_a, self.tables[0][2]), ("b", b, n_b, self.tables[1][2])):
            end = np.cumsum(sizes[ids])
            tables[name] = pa.table({"k": np.arange(len(ids), dtype=np.int32), "cut": np.repeat(np.arange(len(n), dtype=np.int32), n), "id": ids, "s": end - sizes[ids], "e": end})
            db.register("given", tables[name])
            db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
            db.unregister("given")
        db.execute("CREATE OR REPLACE TEMP TABLE covered AS SELECT a.cut, a.id AS a, b.id AS b, a.s, a.e, b.e < a.e AS more FROM a ASOF JOIN b ON a.s >= b.s")
        link = db.execute("""SELECT cut, a, b FROM (SELECT cut, a, b FROM covered UNION ALL
SELECT c.cut, c.a, b.id FROM (SELECT * FROM covered WHERE more) c JOIN (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.s = b.s)) b ON b.s > c.s AND b.s < c.e) z ORDER BY cut""").fetchnumpy()
        joined = []
        for x, y in (("a", "b"), ("b", "a")):
            g = db.execute(f"""SELECT coalesce(sum(CASE WHEN y.e IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY x.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS g
FROM {x} x LEFT JOIN {y} y ON y.e = x.e ORDER BY x.k""").fetchnumpy()["g"]
            first = np.flatnonzero(np.diff(g, prepend=-1))
            names = tables[x].column("id").cast(pa.string()).combine_chunks()
            joined.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[first, len(g)], pa.int32()), names), ","))
            if x == "a":
                of = tables[x].column("cut").to_numpy()[first]
        bound = np.searchsorted(of, np.arange(len(n_a) + 1))
        groups = pc.binary_join_element_wise(*joined, "|")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bound, pa.int32()), groups), ";").to_pylist()
        counts = np.stack([n_a, n_b, np.diff(bound), np.bincount(link["cut"], minlength=len(n_a))], 1)
        counts[n_a == 0] = -1
        return counts, text, np.stack([link["a"], link["b"]]).astype(np.int32)

    def chunk(self, number: int, ids: pa.ChunkedArray, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        """Rows of CHUNKS: one for each text, one for each pair of ids linked in any."""
        if len(self.groups) > REMEMBERED:
            self.forget()
        parts, n = [], []
        for text in texts:
            mine = [self.numbered(cuts(s)) for s in sections(" " + text)] if text else []
            parts += mine
            n.append(sum(map(len, mine)))
        self.align()
        counts, groups = self.counts, self.groups
        flat, n = np.concatenate([*parts, np.zeros(0, np.int32)]), np.array(n, np.int64)
        first = np.r_[0, np.cumsum(n)]
        fine = (n > 0) & (per_row(counts[flat, 0], first, np.minimum) >= 0)
        keep = np.repeat(fine, n)
        flat, first = flat[keep], np.r_[0, np.cumsum(np.where(fine, n, 0))]
        sums = [per_row(counts[flat, k], first) for k in range(4)]
        shas = []
        for k in range(len(texts)):
            mine = flat[first[k] : first[k + 1]]
            shas.append(hashlib.sha256(";".join([groups[c] for c in mine.tolist()]).encode()).hexdigest() if len(mine) else "")
        none = lambda m, kind: pa.nulls(m, kind)
        m = len(texts)
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))
        yield _rows(0, number, m, [ids, *map(pa.array, sums), pa.array(shas), none(m, pa.int32()), none(m, pa.int32()), none(m, pa.int64()), lists])
        given = pa.table({"doc": np.repeat(np.arange(m, dtype=np.int32), np.diff(first)), "cut": flat})
        own = np.unique(flat)
        size = np.maximum(counts[own, 3], 0)
        at = np.repeat(self.first[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        links = pa.table({"cut": np.repeat(own, size), "a": self.links[0][at], "b": self.links[1][at]})
        self.db.register("given", given)
        self.db.register("links", links)
        pairs = self.db.sql("""WITH p AS (SELECT a, b, list(cut) AS cuts FROM links GROUP BY a, b), lp AS (SELECT DISTINCT cut, a, b FROM links),
d AS (SELECT a, b, count(*) AS docs FROM (SELECT DISTINCT doc, a, b FROM (SELECT DISTINCT doc, cut FROM given) x JOIN lp USING (cut)) y GROUP BY a, b)
SELECT a, b, docs, cuts FROM p JOIN d USING (a, b)""").to_arrow_table()
        self.db.unregister("given")
        self.db.unregister("links")
        m = pairs.num_rows
        yield _rows(1, number, m, [none(m, pa.int64())] * 5 + [none(m, pa.string()), *pairs.columns])


def _rows(kind: int, chunk: int, n: int, rest: list) -> pa.RecordBatch:
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, chunk, np.int64)), *rest]
    types = [pa.int32(), pa.int64(), *[pa.int64()] * 5, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])


def chunks(docs: DataFrame, paths: tuple[str, str], most: int = CHUNK) -> DataFrame:
    """The chunks of ``docs`` (doc_id, text), written: rows of documents (kind 0) and of pairs (kind 1)."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = encoder(Pair, paths), TaskContext.get().partitionId() << 32
        held, size = [], 0
        for b in batches:
            if held and size + b.nbytes > most:
                yield from pair.chunk(number, *_texts(held))
                held, size, number = [], 0, number + 1
            held.append(b)
            size += b.nbytes
        if held:
            yield from pair.chunk(number, *_texts(held))

    return written(docs.select("doc_id", "text").mapInArrow(run, CHUNKS))


def _texts(batches: list[pa.RecordBatch]) -> tuple[pa.ChunkedArray, list[str | None]]:
    table = pa.Table.from_batches(batches)
    return table.column(0), table.column(1).to_pylist()


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, count, best: in how many documents each pair is linked, and whether no other of its a is in more."""
    counts = written(found.where("kind = 1").groupBy("a", "b").agg(F.sum("docs").alias("count")))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    joined = counts.join(F.broadcast(highest), "a")  # a row for each id of the vocabulary at most
    return joined.select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """ALIGNED for each row of ``docs`` (doc_id, text); ``a`` and ``b`` are the tokenizers' files."""
    found = chunks(docs, (a, b))
    counts = written(pair_counts(found))
    pairs = found.where("kind = 1").select("chunk", "a", "b", "cuts").join(F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts, ["a", "b"]).select(F.col("chunk").alias("in_chunk"), "count", "best", F.col("cuts").alias("pair_cuts"))
    rows = found.where("kind = 0").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "cuts")

    def run(table: pa.Table, linked: pa.Table) -> pa.Table:
        lists = linked.column("pair_cuts").combine_chunks()
        cut, n = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        sums = np.zeros((2, int(cut.max(initial=-1)) + 1), np.int64)
        np.add.at(sums[0], cut, np.repeat(linked.column("best").to_numpy().astype(np.int64), n))
        np.add.at(sums[1], cut, np.repeat(linked.column("count").to_numpy(), n))
        mine = table.column("cuts").combine_chunks()
        flat, first = mine.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(mine).to_numpy(zero_copy_only=False))]
        both = [pa.array(per_row(s[flat], first)) for s in sums]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(table.column(c) for c in names), *both, table.column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])

    return rows.groupBy("chunk").cogroup(pairs.groupBy("in_chunk")).applyInArrow(run, ALIGNED)
