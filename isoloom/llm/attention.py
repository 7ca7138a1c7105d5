"""A small causal self-attention model in numpy: one head over subword ids, predicting the class of the next id."""

from __future__ import annotations

import numpy as np

VOCABULARY, END = 50_257, 50_256
WINDOW, STRIDE = 32, 24
DIM, CLASSES, OWN = 16, 64, 4096
#: Windows whose arrays are worked on together, in scoring and in training.
CHUNK, PART = 128, 32
#: Where each input row has its numbers.
_CELLS = np.arange((OWN + CLASSES) * DIM).reshape(-1, DIM)
#: Ids whose neighbourhood tells the classes apart.
NEAR = 128


def columns_of(count: np.ndarray) -> np.ndarray:
    """The column of each of the NEAR most frequent ids among neighbours, -1 for others."""
    column = np.full(VOCABULARY, -1)
    column[np.argsort(-count, kind="stable")[:NEAR]] = np.arange(NEAR)
    return column


def add_neighbours(near: np.ndarray, stream: np.ndarray, first: np.ndarray, column: np.ndarray) -> None:
    """Count the neighbours before and after each id of joined texts; ``first`` has the texts' bounds (texts + 1)."""
    inside = np.ones(max(len(stream) - 1, 0), bool)
    cut = first[(first > 0) & (first < len(stream))] - 1
    inside[cut] = False
    place = column[stream]
    left, right = stream[:-1].astype(np.int64), stream[1:].astype(np.int64)
    one = near.dtype.type(1)  # of the counts' own type, as others are cast one by one
    for mine, of, shift in ((left, place[1:], 0), (right, place[:-1], NEAR)):
        ok = np.flatnonzero(inside & (of >= 0))
        np.add.at(near.reshape(-1), mine[ok] * (2 * NEAR) + (of[ok] + shift), one)


def classes_of(near: np.ndarray, count: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each id: k-means of its neighbours (rows of ``near``); class 0 is for ids that never occur."""
    seen = np.flatnonzero(count)
    near = near[seen].astype(np.float32)
    near /= np.maximum(near.sum(1, keepdims=True), 1)
    np.sqrt(near, near)
    out = np.zeros(VOCABULARY, np.int64)
    if len(seen):
        weight = count[seen].astype(float)
        centre = near[rng.choice(len(seen), min(CLASSES - 1, len(seen)), False, weight / weight.sum())]
        for _ in range(12):
            to = (near @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            for k in range(len(centre)):
                if (to == k).any():
                    centre[k] = np.average(near[to == k], 0, weight[to == k])
        out[seen] = to + 1
    return out


class Attention:
    """Log probability of an id: that of its class after the ids before it, plus its share in the class."""

    def __init__(self, ids: list[np.ndarray], counts: np.ndarray, steps: int = 2000, seed: int = 7, near: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        if near is None:
            near = np.zeros((VOCABULARY, 2 * NEAR), np.int64)
            whole = np.concatenate(ids or [np.zeros(0, np.int64)])
            add_neighbours(near, whole, np.cumsum([0, *map(len, ids)]), columns_of(counts))
        self.classes = classes_of(near, counts, rng)
        total = np.bincount(self.classes, counts, CLASSES) + 0.5 * np.bincount(self.classes, minlength=CLASSES)
        self.within = np.log((counts + 0.5) / total[self.classes]).astype(np.float32)
        self.row = OWN + self.classes
        frequent = np.argsort(-counts, kind="stable")[:OWN]
        self.row[frequent] = np.arange(len(frequent))
        shapes = {"emb": (OWN + CLASSES, DIM), "pos": (WINDOW, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM), "u": (DIM, CLASSES), "b": (CLASSES,)}
        self.w = {n: (rng.standard_normal(s) * (0.3 if n in ("emb", "u") else 0.0 if n == "b" else 0.1 if n == "pos" else DIM**-0.5)).astype(np.float32) for n, s in shapes.items()}
        self.future = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        stream = np.concatenate([np.concatenate([[END], x]) for x in ids] or [np.zeros(0, np.int64)]).astype(np.int64)
        if len(stream) > WINDOW + 1:
            self._train(stream, steps, rng)

    def copied(self) -> Attention:
        """The same model with weights of its own."""
        out = object.__new__(Attention)
        out.__dict__ = {**self.__dict__, "w": {n: p.copy() for n, p in self.w.items()}}
        return out

    def _forward(self, x: np.ndarray):
        """Input rows, queries beside keys and values, attention weights before they are divided by their sums, the
        sums' inverses, what the weights gather, and outputs. Windows stand one below another where they meet weights,
        so that each is one product."""
        w, n = self.w, len(x)
        h = w["emb"].take(x, axis=0)
        h += w["pos"]
        h = h.reshape(-1, DIM)
        qkv = (h @ np.concatenate([w["q"] * np.float32(DIM**-0.5), w["k"], w["v"]], 1)).reshape(n, WINDOW, 3 * DIM)
        e = np.matmul(qkv[..., :DIM], qkv[..., DIM : 2 * DIM].transpose(0, 2, 1))
        np.clip(e, -30, 30, e)
        np.exp(e, e)
        e *= self.future
        inverse = np.reciprocal(e.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), np.float32))
        z = np.matmul(e, qkv[..., 2 * DIM :]).reshape(-1, DIM)
        z *= inverse
        return h, qkv, e, inverse, z, (h + z @ w["o"]).reshape(n, WINDOW, DIM)

    def _train(self, stream: np.ndarray, steps: int, rng: np.random.Generator, batch: int = 64) -> None:
        rates = 0.01 * np.minimum(1, np.arange(1, steps + 1) / 20) * (1 - 0.9 * np.arange(1, steps + 1) / steps)
        self._steps(stream, (rng.integers(0, len(stream) - WINDOW, batch) for _ in range(steps)), rates)

    def epoch(self, ids: list[np.ndarray], rate: float, seed: int, batch: int = 128) -> tuple[int, np.ndarray]:
        """Train on every id of whole texts once, from the present weights. The number of ids, and that of each input row."""
        stream = np.concatenate([*(np.concatenate([[END], x]) for x in ids), [END]]).astype(np.int64)
        came = np.bincount(self.row[stream[:-1]], minlength=OWN + CLASSES)
        n = len(stream) - 1
        if n < WINDOW:
            stream = np.resize(stream, WINDOW + 1)
        start = np.minimum(np.arange(0, n, WINDOW), len(stream) - 1 - WINDOW)
        np.random.default_rng(seed).shuffle(start)
        steps = -(-len(start) // batch)
        self._steps(stream, np.array_split(start, steps), rate * np.minimum(1, np.arange(1, steps + 1) / 20))
        return n, came

    def _steps(self, stream: np.ndarray, starts, rates: np.ndarray) -> None:
        """A step for each batch of windows. Its gradient is summed up over PART windows at a time, whose arrays stay in
        the cache; all weights are one array, of which ``w`` has views."""
        names = list(self.w)
        flat = np.concatenate([self.w[n].ravel() for n in names])
        total, first, second, change = (np.zeros_like(flat) for _ in range(4))

        def views(of: np.ndarray) -> dict[str, np.ndarray]:
            bounds = np.cumsum([0, *(self.w[n].size for n in names)]).tolist()
            return {n: of[a:b].reshape(self.w[n].shape) for n, a, b in zip(names, bounds[:-1], bounds[1:], strict=True)}

        self.w, grad = views(flat), views(total)
        rows, goal = self.row[stream].astype(np.uint16), self.classes[stream].astype(np.uint8)
        for step, (start, rate) in enumerate(zip(starts, rates.tolist(), strict=True), 1):
            total[:] = 0
            for c in range(0, len(start), PART):
                at = start[c : c + PART, None] + np.arange(WINDOW)
                self._add_gradient(rows[at].astype(np.int64), goal[at + 1].ravel().astype(np.int64), len(start) * WINDOW, grad)
            # unseen input rows have no gradient: their averages only shrink
            first *= np.float32(0.9)
            np.multiply(total, np.float32(0.1), change)
            first += change
            second *= np.float32(0.99)
            np.multiply(total, total, change)
            change *= np.float32(0.01)
            second += change
            np.multiply(second, np.float32(1 / (1 - 0.99**step)), change)
            np.sqrt(change, change)
            change += np.float32(1e-8)
            np.divide(first, change, change)
            change *= np.float32(rate / (1 - 0.9**step))
            flat -= change

    def _add_gradient(self, x: np.ndarray, y: np.ndarray, places: int, grad: dict[str, np.ndarray]) -> None:
        """Add to ``grad`` that of the loss of windows ``x`` and their next classes ``y``, as part of a mean over so many
        places. Softmax weights are nowhere divided by their sums: what is narrower is."""
        w, n, scale = self.w, len(x), np.float32(DIM**-0.5)
        h, qkv, e, inverse, z, out = self._forward(x)
        out = out.reshape(-1, DIM)
        p = out @ w["u"]
        p += w["b"]
        np.clip(p, -60, 60, p)
        np.exp(p, p)
        sums = p @ np.ones(CLASSES, np.float32)
        p.reshape(-1)[np.arange(0, p.size, CLASSES) + y] -= sums
        share = np.reciprocal(sums * np.float32(places))
        d_out = p @ w["u"].T
        d_out *= share[:, None]
        out *= share[:, None]
        grad["u"] += (p.T @ out).T
        grad["b"] += share @ p
        grad["o"] += z.T @ d_out
        d_z = d_out @ w["o"].T
        d_z *= inverse
        z *= d_z
        mean = z @ np.ones((DIM, 1), np.float32)
        d_z = d_z.reshape(n, WINDOW, DIM)
        d_s = np.matmul(d_z, qkv[..., 2 * DIM :].transpose(0, 2, 1))
        d_s -= mean.reshape(n, WINDOW, 1)
        d_s *= e
        d_qkv = np.empty_like(qkv)
        np.matmul(d_s, qkv[..., DIM : 2 * DIM], out=d_qkv[..., :DIM])
        np.matmul(d_s.transpose(0, 2, 1), qkv[..., :DIM], out=d_qkv[..., DIM : 2 * DIM])
        np.matmul(e.transpose(0, 2, 1), d_z, out=d_qkv[..., 2 * DIM :])
        d_qkv = d_qkv.reshape(-1, 3 * DIM)
        g_qkv = h.T @ d_qkv
        grad["q"] += g_qkv[:, :DIM] * scale
        grad["k"] += g_qkv[:, DIM : 2 * DIM]
        grad["v"] += g_qkv[:, 2 * DIM :]
        d_out += d_qkv @ np.concatenate([w["q"] * scale, w["k"], w["v"]], 1).T
        grad["pos"] += d_out.reshape(n, -1).sum(0).reshape(WINDOW, DIM)
        np.add.at(grad["emb"].reshape(-1), _CELLS.take(x, axis=0).ravel(), d_out.ravel())

    def _hidden(self, x: np.ndarray, begin: int) -> np.ndarray:
        """Outputs as of _forward at the places from ``begin`` on (places x DIM + 1), for scoring: the other places give
        keys and values alone. A last column of ones stands for the bias."""
        w, n, live = self.w, len(x), WINDOW - begin
        h = w["emb"].take(x, axis=0)
        h += w["pos"]
        kv = (h.reshape(-1, DIM) @ np.concatenate([w["k"], w["v"]], 1)).reshape(n, WINDOW, 2 * DIM)
        h = h[:, begin:].reshape(-1, DIM)
        q = (h @ (w["q"] * np.float32(DIM**-0.5))).reshape(n, live, DIM)
        a = np.matmul(q, kv[..., :DIM].transpose(0, 2, 1))
        np.clip(a, -30, 30, a)
        np.exp(a, a)
        a *= self.future[begin:]
        z = np.matmul(a, kv[..., DIM:]).reshape(-1, DIM)
        z /= a.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), np.float32)
        out = np.ones((len(h), DIM + 1), np.float32)
        np.add(z @ w["o"], h, out=out[:, :DIM])
        return out

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each list of ids and an end; every id is scored once.

        Windows overlap: each but a text's first scores its last STRIDE places, after WINDOW - STRIDE or more ids.
        """
        n = np.array([len(x) + 1 for x in ids], np.int64)
        begin = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
        stream = np.full(int((n + 1).sum()), END, np.uint16)
        if len(ids):
            stream[np.arange(len(stream) - 2 * len(ids)) + np.repeat(2 * np.arange(len(ids)) + 1, n - 1)] = np.concatenate(ids)
        rows, goal, share = self.row[stream].astype(np.uint16), self.classes[stream].astype(np.uint8), self.within[stream]
        count = np.maximum(0, -(-(n - WINDOW) // STRIDE))
        doc = np.repeat(np.arange(len(ids)), count)
        turn = 1 + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        out = np.zeros(len(ids))
        last_layer = np.concatenate([self.w["u"], self.w["b"][None]])
        step, ones = np.arange(WINDOW), np.ones(CLASSES, np.float32)
        for of, start, first in ((np.arange(len(ids)), begin, 0), (doc, begin[doc] + STRIDE * turn, WINDOW - STRIDE)):
            last = (begin + n - 1)[of]
            for c in range(0, len(of), CHUNK):
                end = last[c : c + CHUNK, None]
                at = start[c : c + CHUNK, None] + step
                hidden = self._hidden(rows[np.minimum(at, end)], first)
                at = at[:, first:]
                live = at <= end
                if not live.all():
                    hidden = hidden[live.ravel()]
                next_ = at[live] + 1
                logits = hidden @ last_layer
                np.clip(logits, -60, 60, logits)
                picked = logits.reshape(-1)[np.arange(0, logits.size, CLASSES) + goal[next_]]
                np.exp(logits, logits)
                value = picked - np.log(logits @ ones) + share[next_]
                out += np.bincount(np.repeat(of[c : c + CHUNK], live.sum(1)), value, len(out))
        return out
