"""Operator 11: Merkle manifest of a dataset.

A row's leaf is the SHA-256 of its five fields; the leaves of a language, by doc_id, are hashed by eights until one node
stays, and these subroots by language likewise. The JVM hashes the texts; after that only digests move. Each aligned
block of 8^4 nodes is one contiguous matrix of hex digests in one task: its rows are hashed level by level, and a node's
siblings are found by index arithmetic. What a block leaves is a node of the next round, so a hot language is many
blocks. Proofs go down the rounds again: a block gets the path above it once, not once a leaf.

Cases: null fields count as ``-``; a null lang is a language of its own, the first; null doc_ids come first in theirs and
are never tampered with; equal doc_ids follow by leaf, and equal rows each get a place and a proof of their own; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import BROADCAST_SUMS, running, text_buffer, written

FANOUT = 8
#: Levels that a block of nodes goes through in one round, and its nodes.
LEVELS = 4
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "path array<struct<at:int,siblings:string>>"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf(*fields: Column) -> Column:
    """The digest of fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def tampered(docs: DataFrame) -> Column:
    """The text that is checked against the manifest: in lower case where 3 divides the id's CRC-32."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))


def matrix(digests: pa.ChunkedArray, places: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Digests in the order of their places as rows of 64 bytes, and that order."""
    order = np.argsort(places.to_numpy(), kind="stable")
    return np.ascontiguousarray(text_buffer(digests)[0].reshape(-1, 64)[order]), order


def digest(data) -> str:
    return hashlib.sha256(data).hexdigest()


def levels(nodes: np.ndarray, n: int, most: int = LEVELS) -> list[np.ndarray]:
    """The nodes of a block and those above them, up to ``most`` levels or until the tree's ``n`` nodes have become one."""
    found = [nodes]
    while len(found) <= most and n > 1:
        rows, step = memoryview(found[-1].reshape(-1)), 64 * FANOUT
        above = "".join(digest(rows[a : a + step]) for a in range(0, len(rows), step))
        found.append(np.frombuffer(above.encode(), np.uint8).reshape(-1, 64))
        n = -(-n // FANOUT)
    return found


def siblings(found: list[np.ndarray], k: int) -> list[tuple[int, bytes]]:
    """For each level over node ``k`` of a block: its place in its run, and the run's other digests."""
    out = []
    for nodes in found[:-1]:
        at, first = k % FANOUT, k - k % FANOUT
        run = nodes[first : first + FANOUT].tobytes()
        out.append((at, run[: 64 * at] + run[64 * (at + 1) :]))
        k //= FANOUT
    return out


def fold(start: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for at, others in path:
        start = digest(others[: 64 * at] + start + others[64 * at :]).encode()
    return start


def _blocks(nodes: DataFrame, name: str = "block") -> DataFrame:
    return nodes.withColumn(name, F.floor(F.col("idx") / BLOCK).cast("long"))


def _above(table: pa.Table) -> list[tuple[int, bytes]]:
    path = table.column("path")[0].as_py() if table.num_rows else []
    return [(x["at"], x["siblings"].encode()) for x in path]


def parents(nodes: DataFrame) -> DataFrame:
    """g, idx, n, digest of what each block of ``nodes`` (same columns) becomes."""

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        top = levels(matrix(table.column("digest"), table.column("idx"))[0], n)[-1]
        g, block = table.column("g")[0].as_py(), table.column("block")[0].as_py()
        return pa.table({"g": [g], "idx": [block], "n": [-(-n // BLOCK)], "digest": [top.tobytes().decode()]})

    return _blocks(nodes).groupBy("g", "block").applyInArrow(run, "g long, idx long, n long, digest string")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes, then what their blocks become, until each g has one."""
    found, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(written(parents(found[-1])))
        most = -(-most // BLOCK)
    return found


def node_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """g, idx, path of each node, from the paths ``above`` their blocks."""

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        rows, order = matrix(table.column("digest"), table.column("idx"))
        found = levels(rows, table.column("n")[0].as_py()) if len(rows) else []
        rest = _above(upper)
        paths = [[{"at": a, "siblings": s.decode()} for a, s in siblings(found, k) + rest] for k in range(len(rows))]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))
        return pa.table({"g": table.column("g"), "idx": table.column("idx").take(pa.array(order)), "path": pa.array(paths, kind)})

    both = _blocks(nodes).groupBy("g", "block").cogroup(above.withColumnRenamed("idx", "block").groupBy("g", "block"))
    return both.applyInArrow(run, f"g long, idx long, {PATH}")


def paths_to(found: list[DataFrame], top: DataFrame) -> DataFrame:
    """g, idx, path above the blocks of the first of ``found``; ``top`` has the paths above the last."""
    for nodes in reversed(found[1:-1]):
        top = written(node_paths(nodes, top))
    return top


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, the roots over it and its proof,
    and the root that the proof gives for the tampered text."""
    fields = [F.col(c) for c in FIELDS]
    changed = leaf(*fields[:-1], tampered(docs))
    leaves = written(docs.select("doc_id", "lang", leaf(*fields).alias("digest"), F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed).alias("changed"), F.monotonically_increasing_id().alias("tie")))
    sizes = running(leaves.groupBy("lang").agg(F.count("*").alias("n")), [], ["lang"])
    sizes = written(sizes.select(F.col("lang").alias("_lang"), "n", F.col("before").alias("g")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_SUMS else sizes
    placed = running(leaves, ["lang"], ["doc_id", "digest", "tie"]).withColumnRenamed("before", "idx")
    nodes = written(placed.join(sizes, F.col("lang").eqNullSafe(F.col("_lang"))).select("doc_id", "g", "idx", "n", "digest", "changed"))
    trees = rounds(nodes.select("g", "idx", "n", "digest"))
    subroots = trees[-1].select(F.col("g").alias("idx"), "digest")
    tops = subroots.select(F.lit(0).cast("long").alias("g"), "idx", F.lit(sizes.count()).alias("n"), "digest")
    whole = rounds(tops)
    root = whole[-1].first()  # one row
    if root is None:
        return nodes.sparkSession.createDataFrame([], PROOFS)
    none = tops.sparkSession.createDataFrame([(0, 0, [])], f"g long, idx long, {PATH}")
    above = node_paths(tops, paths_to(whole, none)).select(F.col("idx").alias("g"), "path")
    above = above.join(subroots.select(F.col("idx").alias("g"), F.col("digest").alias("subroot")), "g")
    subs = written(above.select("g", F.lit(0).cast("long").alias("idx"), "path", "subroot"))
    over = paths_to(trees, subs.drop("subroot")).join(subs.select("g", "subroot"), "g").withColumnRenamed("idx", "block")
    return _proofs(nodes, over, root["digest"])


def _proofs(nodes: DataFrame, over: DataFrame, root: str) -> DataFrame:
    kind = pa.schema([(n, pa.bool_() if n == "verified" else pa.int64() if n == "doc_id" else pa.string()) for n in (x.split()[0] for x in PROOFS.split(", "))])

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        rows, order = matrix(table.column("digest"), table.column("idx"))
        if not len(rows):
            return kind.empty_table()
        found, rest = levels(rows, table.column("n")[0].as_py()), _above(upper)
        ids, changed = table.column("doc_id").to_pylist(), table.column("changed").to_pylist()
        subroot, out = upper.column("subroot")[0].as_py(), []
        for k, row in enumerate(order.tolist()):
            path = siblings(found, k) + rest
            own = rows[k].tobytes()
            end = fold(changed[row].encode() if changed[row] else own, path).decode()
            out.append((ids[row], own.decode(), subroot, root, digest(b"".join(s for _, s in path)), end, end == root))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    both = _blocks(nodes).groupBy("g", "block").cogroup(over.groupBy("g", "block"))
    return both.applyInArrow(run, PROOFS)


def _crc(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text: a fold over its letters, eight steps of one bit each."""
    bit = "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"lambda c, x: list_reduce([CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], {bit}, xor(c, x))"
    letters = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({letters}, {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def oracle(depth: int = 8) -> str:
    """SQL of the whole manifest, for up to 8 ^ depth rows a language and languages."""
    field = lambda c: f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    head = ", ".join(field(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""d AS (SELECT doc_id, lang, sha256(concat({head}, {field("text")})) AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256(concat({head}, {field(low)})) END AS changed FROM documents),
lg AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d GROUP BY lang),
f0 AS (SELECT d.doc_id, d.leaf, lg.g, row_number() OVER (PARTITION BY lg.g ORDER BY d.doc_id NULLS FIRST, d.leaf) - 1 AS idx, coalesce(d.changed, d.leaf) AS t, '' AS proof FROM d JOIN lg ON lg.lang IS NOT DISTINCT FROM d.lang),
n0 AS (SELECT g, idx, leaf AS h FROM f0)"""]

    def climb(n: str, f: str) -> None:
        for k in range(depth):
            parts.append(f"""{n}r{k} AS (SELECT g, CAST(floor(idx / 8) AS BIGINT) AS run, list(h ORDER BY idx) AS hs, sum(count(*)) OVER (PARTITION BY g) > 1 AS more FROM {n}{k} GROUP BY g, CAST(floor(idx / 8) AS BIGINT)),
{n}{k + 1} AS (SELECT g, run AS idx, CASE WHEN more THEN sha256(list_aggregate(hs, 'string_agg', '')) ELSE hs[1] END AS h FROM {n}r{k}),
{f}{k + 1} AS (SELECT f.doc_id, f.leaf, f.g, r.run AS idx, f.own, CASE WHEN more THEN sha256(concat(coalesce(list_aggregate(hs[1:idx % 8], 'string_agg', ''), ''), f.t, coalesce(list_aggregate(hs[idx % 8 + 2:], 'string_agg', ''), ''))) ELSE f.t END AS t,
concat(f.proof, CASE WHEN more THEN concat(coalesce(list_aggregate(hs[1:idx % 8], 'string_agg', ''), ''), coalesce(list_aggregate(hs[idx % 8 + 2:], 'string_agg', ''), '')) ELSE '' END) AS proof
FROM {f}{k} f JOIN {n}r{k} r ON r.g = f.g AND r.run = CAST(floor(f.idx / 8) AS BIGINT))""")

    parts[0] = parts[0].replace("AS t, '' AS proof", "AS t, '' AS proof, 0 AS own")
    climb("n", "f")
    parts.append(f"m0 AS (SELECT 0 AS g, g AS idx, h FROM n{depth}), e0 AS (SELECT doc_id, leaf, 0 AS g, g AS idx, g AS own, t, proof FROM f{depth})")
    climb("m", "e")
    return f"""WITH {", ".join(parts)} SELECT e.doc_id, e.leaf, m0.h AS subroot, m.h AS root, sha256(e.proof) AS proof_sha256, e.t AS folded_root, e.t = m.h AS verified
FROM e{depth} e JOIN m0 ON m0.idx = e.own, m{depth} m"""
