"""Operator 4: secret scan by a linear-chain conditional random field.

Three patterns give base spans. The field tags each token of a line as begin, inside or outside of a secret, from the
token's shape and prefix, the words beside it, what stands between, and features of the whole file; Viterbi decodes a
line. It is fitted on the base spans of a bounded sample (whole documents of SAMPLE_BYTES in hash order) and adds spans that
no base span covers.

A line is decoded only if some token could leave "outside" with profit under the greatest transition weights; all other
lines are outside throughout, so skipping them changes nothing.

Cases: null or empty text has no span; a sample without base spans gives no model and no further spans; rows stay as
they are, equal ones too; an empty table gives no row; further columns are carried by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import ranked_sample, slices, small_batches, text_buffer
from isoloom.llm.words import LOWER, hashes, scan, separators

#: The base patterns and least lengths, in the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "crf"]

#: Bytes of whole texts to fit on.
SAMPLE_BYTES = 20_000_000
STEPS, WIDTH, NEGATIVES = 80, 40, 3000
B, I, O = 0, 1, 2  # noqa: E741
#: Prefixes and neighbouring words that so many sample secrets share have weights of their own; all others share one.
LEAST = 3
TOKEN = separators(bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c) in "+/_-")))
_KIND = np.zeros(256, np.uint8)
_KIND[48:58], _KIND[97:123], _KIND[65:91], _KIND[128:] = 1, 2, 3, 4
_KIND[[43, 45, 47, 95]] = 5
_LENGTH = np.searchsorted([4, 8, 12, 16, 20, 28, 40], np.arange(4096), "right").astype(np.int64)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) in code points, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _place(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 + the place in the sorted ``known``, 0 for others."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at + 1, 0)


def features(data: np.ndarray, offsets: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Token starts, ends, each text's first token, the first token of each line, and tokens x 6 features: shape, prefix,
    word before, word after, between, file. Without ``known`` (prefixes, words before, words after) their hashes instead."""
    starts, ends, first = scan(data, offsets, TOKEN)
    n = len(starts)
    kind = _KIND[data]
    total = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
    size = ends - starts
    mask = np.zeros(n, np.int64)
    for k in (1, 2, 3, 5):
        sums = total(kind == k)
        mask = mask * 2 + (sums[ends] > sums[starts])
    change = total(np.concatenate([[False], (kind[1:] != kind[:-1])])) if len(kind) else np.zeros(1, np.int32)
    turns = change[ends] - change[np.minimum(starts + 1, len(kind))]
    shape = _LENGTH[np.minimum(size, 4095)] * 128 + mask * 8 + np.minimum(turns, 7)
    lower = LOWER[data]
    h = hashes(lower, starts, ends)
    prefix = hashes(data, starts, np.minimum(starts + 4, ends))
    before, after = np.zeros((2, n), np.uint64)
    gap = np.zeros(n, np.int64)
    newline = total(data == 10)
    head = np.ones(n, bool)
    if n > 1:
        before[1:], after[:-1] = h[:-1], h[1:]
        head[1:] = newline[starts[1:]] > newline[ends[:-1]]
        for k, c in enumerate(b"=:\"'"):
            sums = total(data == c)
            gap[1:] |= (sums[starts[1:]] > sums[ends[:-1]]).astype(np.int64) << k
    head[first[:-1][first[:-1] < n]] = True
    before[head] = 0
    after[:-1][head[1:]] = 0
    gap[head] = 16
    length = np.diff(offsets)
    marks = total(np.isin(data, np.frombuffer(b"{}=;<>", np.uint8)))
    code = (marks[offsets[1:]] - marks[offsets[:-1]]) * 100 > length
    file = np.repeat(code * 8 + np.minimum(np.log2(np.maximum(length, 1)) // 2, 7).astype(np.int64), np.diff(first))
    if known is None:
        return starts, ends, first, np.flatnonzero(head), np.stack([prefix, before, after], 1)
    named = [_place(k, x) for k, x in zip(known, (prefix, before, after), strict=True)]
    return starts, ends, first, np.flatnonzero(head), np.stack([shape, *named, gap, file], 1)


class Field:
    """Weights of the features (one table each) and of transitions between the tags begin, inside, outside."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.known = known
        self.tables = [np.zeros((n, 3)) for n in (1024, *(len(k) + 1 for k in known), 32, 16)]
        self.moves = np.zeros((3, 3))
        self.moves[O, I] = -1e4  # inside follows begin or inside
        self.first = np.array([0.0, -1e4, 0.0])

    def unary(self, f: np.ndarray) -> np.ndarray:
        out = self.tables[0][f[:, 0]]
        for k in range(1, len(self.tables)):
            out = out + self.tables[k][f[:, k]]
        return out

    def fit(self, f: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: int = STEPS, ridge: float = 3e-4) -> None:
        """f: sequences x WIDTH x tables; maximum likelihood by full-batch Adam."""
        n, width = tags.shape
        rows = np.arange(n)
        last = mask.sum(1) - 1
        params = [*self.tables, self.moves]
        one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        flat, live = f.reshape(-1, f.shape[2]), mask.ravel()
        gold = np.eye(3)[tags] * mask[..., None]
        for step in range(1, steps + 1):
            u = self.unary(flat).reshape(n, width, 3)
            alpha, beta = np.empty_like(u), np.zeros_like(u)
            alpha[:, 0] = u[:, 0] + self.first
            for t in range(1, width):
                x = alpha[:, t - 1, :, None] + self.moves
                top = x.max(1)
                alpha[:, t] = np.where(mask[:, t, None], np.log(np.exp(x - top[:, None]).sum(1)) + top + u[:, t], alpha[:, t - 1])
            for t in range(width - 2, -1, -1):
                x = self.moves + (u[:, t + 1] + beta[:, t + 1])[:, None, :]
                top = x.max(2)
                beta[:, t] = np.where(mask[:, t + 1, None], np.log(np.exp(x - top[..., None]).sum(2)) + top, 0)
            end = alpha[rows, last]
            top = end.max(1)
            logz = np.log(np.exp(end - top[:, None]).sum(1)) + top
            p = np.exp(alpha + beta - logz[:, None, None]) * mask[..., None]
            pair = np.zeros((3, 3))
            for t in range(1, width):
                x = np.exp(np.minimum(alpha[:, t - 1, :, None] + self.moves + (u[:, t] + beta[:, t])[:, None, :] - logz[:, None, None], 0))
                hit = mask[:, t]
                pair += x[hit].sum(0)
                np.subtract.at(pair, (tags[hit, t - 1], tags[hit, t]), 1)
            diff = ((p - gold).reshape(-1, 3))[live]
            grads = []
            for k in range(len(self.tables)):
                g = np.zeros_like(self.tables[k])
                for tag in range(3):
                    g[:, tag] = np.bincount(flat[live, k], diff[:, tag], len(g))
                grads.append(g)
            for k, (param, g) in enumerate(zip(params, [*grads, pair], strict=True)):
                g = g / n + ridge * np.where(np.abs(param) < 1e3, param, 0)
                one[k] += 0.1 * (g - one[k])
                two[k] += 0.01 * (g * g - two[k])
                move = 0.1 * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-9)
                param -= np.where(np.abs(param) < 1e3, move, 0)

    def viterbi(self, u: np.ndarray) -> np.ndarray:
        best, back = u[0] + self.first, []
        for row in u[1:]:
            x = best[:, None] + self.moves
            back.append(x.argmax(0))
            best = x.max(0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return np.array(tags[::-1])

    def slack(self) -> float:
        """The most that two transitions can add over staying outside."""
        return 2 * max(0.0, float(self.moves.max() - self.moves[O, O]))


def decode(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first byte, end byte) of each tagged secret."""
    starts, ends, first, heads, f = features(data, offsets, field.known)
    if not len(starts):
        return []
    u = field.unary(f)
    open_ = np.maximum(u[:, B], u[:, I]) - u[:, O] + field.slack() > 0
    line = np.searchsorted(heads, np.flatnonzero(open_), "right") - 1
    bounds = np.append(heads, len(starts))
    out = []
    for k in np.unique(line).tolist():
        a, b = int(bounds[k]), int(bounds[k + 1])
        tags = field.viterbi(u[a:b])
        t = 0
        while t < b - a:
            if tags[t] == B:
                e = t + 1
                while e < b - a and tags[e] == I:
                    e += 1
                d = int(np.searchsorted(first, a, "right")) - 1
                out.append((d, int(starts[a + t] - offsets[d]), int(ends[a + e - 1] - offsets[d])))
                t = e
            else:
                t += 1
    return out


def sample(docs: DataFrame, most: int = SAMPLE_BYTES) -> list[str]:
    """Whole distinct texts in hash order, up to ``most`` bytes, one at least."""
    return ranked_sample(docs.select(F.lit("").alias("kind"), "doc_id", "text"), most).get("", [])


def train(texts: list[str]) -> Field | None:
    """Fit on lines around base spans and on other places; None without a base span."""
    rng = np.random.default_rng(11)
    tagged, seen = [], []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _, _, h = features(data, np.array([0, len(data)]), None)
        tags = np.full(len(starts), O)
        for _, _, end, secret in base_spans(text):
            a, b = (len(text[:x].encode()) for x in (secret, end))
            over = np.flatnonzero((starts < b) & (ends > a))
            if len(over):
                tags[over] = I
                tags[over[0]] = B
        tagged.append(tags)
        seen.append(h[tags == B])
    if not sum(map(len, seen)):
        return None
    known = []
    for column in np.concatenate(seen).T:
        h, n = np.unique(column[column > 0], return_counts=True)
        known.append(h[n >= LEAST])
    f_all, tag_all, mask_all = [], [], []
    share = NEGATIVES / len(texts)
    for text, tags in zip(texts, tagged, strict=True):
        if not len(tags):
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        _, _, _, heads, f = features(data, np.array([0, len(data)]), tuple(known))
        bounds = np.append(heads, len(tags))
        for c in [*np.flatnonzero(tags == B).tolist(), *rng.integers(0, len(tags), int(rng.poisson(share))).tolist()]:
            k = int(np.searchsorted(heads, c, "right")) - 1
            a = max(int(bounds[k]), c - WIDTH // 2)
            b = min(int(bounds[k + 1]), a + WIDTH)
            if tags[a] == I:
                continue
            pad = WIDTH - (b - a)
            f_all.append(np.pad(f[a:b], ((0, pad), (0, 0))))
            tag_all.append(np.pad(tags[a:b], (0, pad), constant_values=O))
            mask_all.append(np.arange(WIDTH) < b - a)
    field = Field(tuple(known))
    field.fit(np.stack(f_all), np.stack(tag_all), np.stack(mask_all))
    return field


RESULT = "n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """All columns of ``docs`` but text, and RESULT."""
    small_batches(docs)
    shared, carry = docs.sparkSession.sparkContext.broadcast(field), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole.column("text")):
                batch = whole.slice(a, b - a)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                added: dict[int, list[tuple[int, int]]] = {}
                if shared.value is not None:
                    for d, x, y in decode(shared.value, *text_buffer(batch.column("text"))):
                        added.setdefault(d, []).append((x, y))
                rows = []
                for d, text in enumerate(texts):
                    base = [(s, k, e) for s, k, e, _ in base_spans(text)]
                    more = []
                    if d in added:
                        raw = text.encode()
                        for x, y in added[d]:
                            s, e = len(raw[:x].decode()), len(raw[:y].decode())
                            if not any(p <= s and e <= q for p, _, q in base):
                                more.append((s, 3, e))
                    name = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                    rows.append((*(sum(k == n for _, k, _ in base) for n in range(3)), len(more), hashlib.sha256(name(base).encode()).hexdigest(), name(sorted(base + more))))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *columns], [*carry, "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    schema = docs.select(*carry, *[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in RESULT.split(", "))]).schema
    return docs.mapInArrow(run, schema)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Fit on a sample of ``docs``, then scan every row."""
    return find(docs, train(sample(docs)))
