"""Operator 6: near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles; documents link at a Jaccard similarity of 0.75 or more. Documents
with the same set are one class. Each of ROOTS independent paths branches the classes by a minwise token (coordinate of
their signature); crowded nodes branch again by BRANCH further coordinates, DEPTH times; small nodes are compared
exhaustively. A pair at the threshold meets in a small root node with probability 1 - 0.25**ROOTS (one in a million
missed), and below crowded ones with about 1 - 0.34**ROOTS.

First, every member of a node is compared with one representative, and found links are joined to components. That
takes rows in proportion to the members, and it makes large groups of near copies one component each. Then only nodes
with more than one component go on, and only pairs across components are compared, so nothing is quadratic in a group
that is linked already. Links are confirmed on the full shingle sets of the texts (64-bit
hashes of shingles; what makes two texts one class is a digest of 128 bits a shingle). What is still crowded at DEPTH is
compared block by block, all pairs across components.

Cases: null or empty text has an empty set and no link; fewer than five words are one shingle; a null doc_id links like
any other, but a component is named by its least doc_id that is not null (null if it has none: then the rows of one set
stay); rows with one doc_id and different sets are documents of their own, those with the same set count as one; an
empty table gives no row; further columns are ignored by ``mark`` and carried by ``keep_first``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import listed, per_row, slices, small_batches, text_buffer, written
from isoloom.llm.components import components
from isoloom.llm.words import LOWER, WHITE, grams, hashes, mix, scan, separators

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDINATES = 64
ROOTS, BRANCH, DEPTH = 10, 2, 5
#: Members of a node that are compared exhaustively.
SMALL = 4000
#: Members whose texts are compared in one group; a larger dense node is cut into blocks that meet pairwise.
GROUP = 500
#: Equal sketch bytes of 64 from which a pair is confirmed; a pair at the threshold has 48 on average, deviation 3.5.
SKETCH = 34
#: Rounds with one representative a node, as long as three quarters of the near pairs link.
ROUNDS = 3
#: A node with more near pairs than so many times its members is compared as a whole, others pair by pair.
DENSE = 4
#: Longest list of ids that may be broadcast (16 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
WORD = separators(WHITE)
#: Seed of the second hashes of words.
SECOND = 20240607
_random = np.random.default_rng(20240607)
_MULTIPLY = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _scanned(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, word starts and ends, and each text's first word."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    return data, *scan(data, offsets, WORD)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    *words, first = _scanned(column)
    value, at = grams(hashes(*words), first, n)
    bounds = at.tolist()
    return [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def set_digests(column: pa.Array, n: int = SHINGLE) -> tuple[list[np.ndarray], list[bytes]]:
    """``shingle_sets``, and a digest of each set in which a shingle counts by two unrelated 64-bit hashes, since texts
    of one digest are never compared."""
    *words, first = _scanned(column)
    value, at = grams(hashes(*words), first, n)
    other, _ = grams(hashes(*words, SECOND), first, n)
    bounds, sets, digests = at.tolist(), [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        found, place = np.unique(value[a:b], return_index=True)
        sets.append(found)
        digests.append(hashlib.sha256(found.tobytes() + other[a:b][place].tobytes()).digest()[:16])
    return sets, digests


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    place = b.searchsorted(a)
    both = int(np.count_nonzero(b[np.minimum(place, len(b) - 1)] == a))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def all_links(sets: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Which sets of a group link: sizes of all intersections as products of incidence matrices, some columns at a time."""
    n, size = len(sets), np.array([len(x) for x in sets])
    both = np.zeros((n, n), np.float32)  # exact below 2**24
    if n and size.sum():
        every = np.concatenate(sets)
        _, column = np.unique(every, return_inverse=True)
        row, column = np.repeat(np.arange(n), size), column.reshape(-1)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, int(column[-1]) + 1, columns):
            a, b = np.searchsorted(column, [low, low + columns])
            part = np.zeros((n, columns), np.float32)
            part[row[a:b], column[a:b] - low] = 1
            both += part @ part.T
    union = size[:, None] + size[None] - both
    return (100 * both >= PERCENT * union) & (both > 0)


class Sets:
    """Shingle sets of a task's texts by id, made once each; ``most`` elements are held, then it starts anew."""

    def __init__(self, make, most: int = 4_000_000):
        self.make, self.most, self.held, self.size = make, most, {}, 0

    def linked(self, pairs: pa.RecordBatch) -> list[bool]:
        """Whether the texts of each row (a, b, text of a, text of b) link."""
        if self.size > self.most:
            self.held, self.size = {}, 0
        ids = pa.concat_arrays([pairs.column(0), pairs.column(1)]).to_numpy()
        new, at = np.unique(ids, return_index=True)
        fresh = np.array([k not in self.held for k in new.tolist()], bool)
        texts = pa.concat_arrays([pairs.column(2), pairs.column(3)]).take(pa.array(at[fresh]))
        for lo, hi in slices(texts):
            for k, made in zip(new[fresh][lo:hi].tolist(), self.make(texts.slice(lo, hi - lo)), strict=True):
                self.held[k] = made
                self.size += len(made)
        return [linked(self.held[a], self.held[b]) for a, b in zip(ids[: len(pairs)].tolist(), ids[len(pairs) :].tolist(), strict=True)]


def confirm(texts: DataFrame, pairs: DataFrame, make) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets link; ``make`` gives the sets of a column of texts."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(make)
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(sets.linked(batch), pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def signatures(docs: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, digest (of the set), sig (minwise hashes), sketch (a byte of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                sets, digests = set_digests(batch.column(2).slice(a, b - a))
                n = np.array([len(s) for s in sets], np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                sig = np.empty((b - a, COORDINATES), np.uint32)
                for k in range(COORDINATES):
                    sig[:, k] = per_row(((every * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), first, np.minimum)
                sketch = (sig & 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * COORDINATES), pa.array(sig.view(np.int32).ravel())), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    ["doc_id", "mark", "n_shingles", "digest", "sig", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(salt), "text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, sig array<int>, sketch binary")


class Identities:
    """A number for each row that no row with another set has: its doc_id where that stands for one set, else a hash of
    its text. Should two texts have one hash, all are made anew with another salt. ``rows`` are the signatures with it."""

    def __init__(self, docs: DataFrame):
        for self.salt in count():
            found = written(signatures(docs, self.salt))
            several = F.min("digest") != F.max("digest")
            self.shared = listed(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(several.alias("_several")).where("_several").select(F.col("doc_id").alias("_shared")), BROADCAST_IDS)
            self.any_shared = not self.shared.isEmpty()
            self.rows = self._joined(found).withColumn("rid", self._number(F.col("doc_id"), F.col("mark")))
            if not self.any_shared and found.where("doc_id IS NULL").isEmpty():
                break
            self.rows = written(self.rows)
            if self.rows.groupBy("rid").agg(several.alias("_several")).where("_several").isEmpty():
                break

    def _joined(self, df: DataFrame) -> DataFrame:
        return df.join(self.shared, df["doc_id"].cast("long") == self.shared["_shared"], "left") if self.any_shared else df

    def _number(self, doc_id: Column, mark: Column) -> Column:
        own = F.when(self.shared["_shared"].isNull(), doc_id.cast("long")) if self.any_shared else doc_id.cast("long")
        return F.coalesce(own, mark)

    def of(self, docs: DataFrame) -> tuple[DataFrame, Column]:
        """``docs``, perhaps with a further column, and their numbers."""
        return self._joined(docs), self._number(docs["doc_id"], F.xxhash64(F.lit(self.salt), docs["text"]))

    def texts(self, docs: DataFrame, ids: DataFrame) -> DataFrame:
        """id, text of the rows whose numbers are in ``ids``."""
        rows, number = self.of(docs.select("doc_id", "text"))
        return rows.select(number.alias("id"), "text").join(listed(ids, BROADCAST_IDS), "id", "left_semi")


def alike(pairs: DataFrame, classes: DataFrame, least: int = SKETCH) -> DataFrame:
    """Those of ``pairs`` whose sketches are near enough to be confirmed."""
    sketch = classes.select("cid", "sketch")
    both = pairs.join(sketch.select(F.col("cid").alias("a"), F.col("sketch").alias("p")), "a").join(sketch.select(F.col("cid").alias("b"), F.col("sketch").alias("q")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (_matrix(batch.column(k)) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((p == q).sum(1) >= least))

    return both.select("a", "b", "p", "q").mapInArrow(run, "a long, b long").distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches, which all have one length, as rows of bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.uint8)


def stars(nodes: DataFrame, order: Column) -> DataFrame:
    """Pairs (a, b) of each member with its node's representative, across components."""
    # written, so that the join deals both sides anew and can split a hot node's members
    head = nodes.groupBy("node").agg(F.min(F.struct(order.alias("o"), "cid", "comp")).alias("head"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("node").alias("at"), F.col("head.cid").alias("h"), F.col("head.comp").alias("h_comp"))
    met = nodes.join(written(head), (F.col("node") == F.col("at")) & (F.col("comp") != F.col("h_comp")))
    return met.select(F.least("cid", "h").alias("a"), F.greatest("cid", "h").alias("b")).distinct()


def labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("comp", F.col("cid"))
    return nodes.join(labels.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")


def _coordinate(root: int, depth: int, branch: int) -> int:
    """Which coordinate branches the nodes of a path at a depth."""
    return ROOTS + (root * 17 + depth * BRANCH + branch) % (COORDINATES - ROOTS)


def _children(crowded: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """Each member of a crowded node goes to BRANCH nodes below it."""
    places = F.array(*[F.array(*[F.lit(_coordinate(r, depth, b)) for b in range(BRANCH)]) for r in range(ROOTS)])
    rows = crowded.join(classes.select("cid", "sig"), "cid").withColumn("place", F.explode(F.get(places, F.col("root"))))
    return rows.select("root", F.xxhash64("node", "place", F.get("sig", F.col("place"))).alias("node"), "cid", "comp")


def crowded_blocks(crowded: DataFrame, half: int = SMALL // 2) -> DataFrame:
    """Nodes that stay crowded, as sub-nodes of two blocks each: all pairs across components meet in one of them.

    The component with most members is cut into blocks that need not meet each other; the rest meets everything.
    """
    sizes = crowded.groupBy("node", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("node").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all")).select("node", F.col("m.comp").alias("main"), F.ceil(F.col("m.n") / half).cast("int").alias("na"), F.ceil((F.col("all") - F.col("m.n")) / half).cast("int").alias("nr"))
    rows = crowded.join(main, "node")
    one = rows.where("comp = main").select("cid", "comp", "node", F.pmod(F.xxhash64("cid"), "na").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("y"), F.lit(0).alias("kind"))
    rest = rows.where("comp <> main").withColumn("y", F.pmod(F.xxhash64("cid"), "nr").cast("int"))
    other = rest.select("cid", "comp", "node", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("x"), "y", F.lit(0).alias("kind"))
    own = rest.select("cid", "comp", "node", "y", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("z")).select("cid", "comp", "node", F.least("y", "z").alias("x"), F.greatest("y", "z").alias("y"), F.lit(1).alias("kind"))
    return one.unionByName(other).unionByName(own).select(F.xxhash64("node", "x", "y", "kind").alias("node"), "cid", "comp")


def small_nodes(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """node, cid, comp: members of the small nodes below ``nodes`` that hold more than one component."""
    found = []
    for depth in range(1, DEPTH + 1):
        size = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node", "n")
        live = written(nodes.join(written(size), "node"))
        found.append(live.where(F.col("n") <= SMALL).select("node", "cid", "comp"))
        crowded = live.where(F.col("n") > SMALL).drop("n")
        if crowded.isEmpty():
            break
        if depth == DEPTH:
            found.append(crowded_blocks(crowded))
        else:
            nodes = written(_children(crowded, classes, depth).distinct())
    return reduce(DataFrame.unionByName, found)


def _promising(members: DataFrame, classes: DataFrame, least: int = SKETCH) -> DataFrame:
    """What small nodes leave to confirm, by sketches across components: pairs (a, b), with node null; of dense nodes
    their near members instead (node, a: class, b: component)."""
    rows = members.join(classes.select("cid", "sketch"), "cid").groupBy("node").agg(F.collect_list(F.struct("cid", "comp", "sketch")).alias("m"))

    def joined(found: list[list[pa.Array]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*found, strict=True)], ["node", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lists = batch.column(0).to_pylist(), batch.column(1)
            values = lists.flatten()
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
            cid, comp, sketch = values.field(0).to_numpy(), values.field(1).to_numpy(), _matrix(values.field(2))
            found: list[list[pa.Array]] = []
            for node, a, b in zip(nodes, bounds[:-1], bounds[1:], strict=True):
                x, y = _near_pairs(sketch[a:b], comp[a:b], least)
                if not len(x):
                    continue
                if len(x) > DENSE * (b - a):
                    keep = a + np.unique(np.concatenate([x, y]))
                    part, place = _groups(node, comp[keep])
                    found.append([pa.array(part), pa.array(cid[keep][place]), pa.array(comp[keep][place])])
                else:
                    p, q = cid[a:b][x], cid[a:b][y]
                    found.append([pa.nulls(len(p), pa.int64()), pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))])
                if sum(len(x[0]) for x in found[-64:]) > 100_000:
                    yield joined(found)
                    found = []
            if found:
                yield joined(found)

    return rows.mapInArrow(run, "node long, a long, b long").distinct()


def _groups(node: int, comp: np.ndarray, most: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers and places of members: one group, or of a large node pairs of blocks in which all pairs across
    components meet. The largest component's blocks need not meet each other."""
    n = len(comp)
    if n <= most:
        return np.full(n, node), np.arange(n)
    _, of, count = np.unique(comp, return_inverse=True, return_counts=True)
    main = of.reshape(-1) == count.argmax()
    half = most // 2
    first, rest = np.flatnonzero(main), np.flatnonzero(~main)
    a = [first[k : k + half] for k in range(0, len(first), half)]
    r = [rest[k : k + half] for k in range(0, len(rest), half)]
    pairs = [np.concatenate([x, y]) for x in a for y in r] + [np.concatenate([x, y]) for k, x in enumerate(r) for y in r[k + 1 :]] + ([] if a else r)
    seed = np.full(len(pairs), node).view(np.uint64) + np.arange(len(pairs), dtype=np.uint64)
    number = mix(seed).view(np.int64)
    return np.repeat(number, [len(x) for x in pairs]), np.concatenate(pairs)


def _near_pairs(sketch: np.ndarray, comp: np.ndarray, least: int, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs across components with ``least`` equal sketch bytes or more. Equal bytes are counted for all
    pairs of some rows and those after them at once, a sketch column at a time."""
    n, first, second = len(sketch), [], []
    columns, step = np.ascontiguousarray(sketch.T), max(1, cells // max(1, len(sketch)))
    for k in range(0, n, step):
        if n <= 16:
            same = np.count_nonzero(sketch[:, None] == sketch, axis=2)
        else:
            same = np.zeros((min(step, n - k), n - k), np.uint8)  # a sketch has fewer than 256 bytes
            for column in columns:
                same += column[k : k + step, None] == column[k:]
        x, y = np.nonzero(np.triu((same >= least) & (comp[k : k + step, None] != comp[k:]), 1))
        first.append(x + k)
        second.append(y + k)
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64),) * 2


def exhaustive(texts: DataFrame, members: DataFrame, make) -> DataFrame:
    """Links (a, b) that join components within each node, on full sets."""
    rows = members.join(texts, F.col("cid") == F.col("id")).select("node", "cid", "comp", "text")

    def run(table: pa.Table) -> pa.Table:
        cid, comp = table["cid"].to_pylist(), table["comp"].to_pylist()
        links = all_links(make(table["text"].combine_chunks()))
        parent: dict[int, int] = {c: c for c in comp}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        found = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.tril(links, -1))), strict=True):
            x, y = root(comp[i]), root(comp[j])
            if x != y:
                parent[x] = y
                found.append((cid[i], cid[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("node").applyInArrow(run, "a long, b long")


def connect(nodes: DataFrame, classes: DataFrame, below, texts, make, least: int = SKETCH, near: DataFrame | None = None) -> DataFrame | None:
    """id, component of all classes with a link; None if there is none.

    ``nodes`` (node, cid) say which classes may be compared, ``classes`` has their sketches. ``below`` gives the small
    nodes of labelled nodes, ``texts`` the rows (id, text) of a table of ids, ``make`` the sets of a column of texts. ``near`` are the first
    round's pairs, if they are known.
    """
    edges, labels = [], None
    for k in range(ROUNDS if near is None else max(ROUNDS, 1)):
        if k or near is None:
            pairs = written(stars(labelled(nodes, labels), F.xxhash64("node", F.lit(k), "cid") if k else F.col("cid")))
            near = written(alike(pairs, classes, least))
        found = written(confirm(texts(near.select(F.explode(F.array("a", "b")).alias("id"))), near, make))
        n = found.count()
        if not n:
            break
        edges.append(found)
        labels = written(components(reduce(DataFrame.union, edges)))
        if 4 * n < 3 * near.count():
            break
    left = written(_promising(below(labelled(nodes, labels)), classes, least))
    pairs, dense = left.where("node IS NULL"), left.where("node IS NOT NULL")
    wanted = texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(dense.select("a")))
    last = confirm(wanted, pairs.select("a", "b"), make)
    if not dense.isEmpty():
        last = last.union(exhaustive(wanted, dense.select("node", F.col("a").alias("cid"), F.col("b").alias("comp")), make))
    last = written(last)
    return labels if last.isEmpty() else written(components(reduce(DataFrame.union, [*edges, last])))


def _marked(docs: DataFrame) -> tuple[DataFrame, Identities]:
    small_batches(docs)
    ids = Identities(docs)
    rows = ids.rows
    classes = written(rows.where("n_shingles > 0").groupBy("digest").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")))
    paths = F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.xxhash64(F.lit(r), F.get("sig", F.lit(r))).alias("node")) for r in range(ROOTS)]))
    nodes = classes.select("cid", paths.alias("p")).select("p.root", "p.node", "cid")
    labels = connect(nodes, classes, lambda n: small_nodes(n, classes), lambda wanted: ids.texts(docs, wanted), shingle_sets)
    of = classes.select("digest", "cid", "first_id")
    if labels is None:
        of = of.select("digest", F.col("cid").alias("comp"), F.col("first_id").alias("component_id"))
    else:
        least = labels.join(of, labels["id"] == of["cid"]).groupBy("component").agg(F.min("first_id").alias("least"))
        named = labels.join(least, "component")
        of = of.join(named, of["cid"] == named["id"], "left").select("digest", F.coalesce("component", "cid").alias("comp"), F.when(F.col("id").isNull(), F.col("first_id")).otherwise(F.col("least")).alias("component_id"))
    some = F.col("n_shingles") > 0
    out = rows.join(of.withColumnRenamed("component_id", "_name"), "digest", "left").withColumn("component_id", F.when(some, F.col("_name")).otherwise(F.col("doc_id")))
    stays = F.when(~some, True).when(F.col("component_id").isNull(), F.col("rid") == F.col("comp")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "rid", "n_shingles", "component_id", stays.alias("kept")), ids


def mark(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document."""
    return _marked(docs)[0].drop("rid")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay: one of each component."""
    marked, ids = _marked(docs)
    gone = listed(marked.where("NOT kept").select(F.col("rid").alias("_gone"), F.col("doc_id").alias("_gone_id")), BROADCAST_IDS)
    rows, number = ids.of(docs)
    left = rows.join(gone, (number == gone["_gone"]) & docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]), "left_anti")
    return left.select(*[docs[c] for c in docs.columns])


#: The same rows in SQL, for tables whose doc_id is unique and not null.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM words, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) t(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, concat(array_to_string(w, ' '), ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (SELECT x, y FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y
), root AS (SELECT x, min(y) AS r FROM reach GROUP BY x)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(words.doc_id, coalesce(r, words.doc_id)) AS component_id, words.doc_id = least(words.doc_id, coalesce(r, words.doc_id)) AS kept
FROM words LEFT JOIN size ON size.doc_id = words.doc_id LEFT JOIN root ON root.x = words.doc_id
"""
