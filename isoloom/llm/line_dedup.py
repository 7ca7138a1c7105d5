"""Operator 7: fuzzy line dedup.

A line is compared without the white space at its ends, by its distinct shingles of SHINGLE characters (A-Z lowered), at
a Jaccard similarity of 0.75 or more. Equal lines are one class, known by 128 bits of a cryptographic hash.

Signatures have BANDS x ROWS minwise hashes, which put a pair at the threshold into a common bucket with probability
0.9987; six rows a band keep unlike lines apart, as these grow with the square of the lines. A line of few shingles has
independent hashes; one of 64 or more has the least hash of each of 64 bins in four permutations, one of 256 or more of
256 bins in one (an empty bin takes the next one's). Lines whose sizes lie near a bound have both kinds, so a pair at
the threshold always shares one.

Bucket keys never become rows. A task packs (key, class) as bytes by ranges of keys, with one class a key: of lines that
share a bucket in the task, the least goes on, and all of them go beside it as members. So a hot bucket sends one entry
from each task. A range's task sorts what comes and reports the buckets with several classes. These are joined to
components by exact Jaccard, first each member with one representative, then what stays apart exhaustively. One line of
each component stays: that of the least (doc_id, line number).

Cases: a line of white space alone always stays; a line shorter than a shingle is one shingle; null or empty text is
one blank line; a null doc_id comes after all others; rows equal in doc_id and text are treated alike; an empty table
gives no row; further columns are ignored by ``mark`` and carried by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import slices, small_batches, text_buffer, written
from isoloom.llm.near_dedup import alike, connect, crowded_blocks
from isoloom.llm.words import LOWER, WHITE, mix, separators

SHINGLE = 5
ROWS, BANDS = 6, 34
#: A pair at the threshold has sizes within this ratio.
RATIO = 0.75
#: Minwise hashes of binned lines in all, of which ROWS x BANDS are used.
COLUMNS = 256
#: By distinct shingles, from and below: how many permutations share the bins (0: independent hashes).
KINDS = ((0, 64, 0), (64, 256, 4), (256, 1 << 40, 1))
#: Numbers of distinct shingles at which the kinds of a line change; places of the table that tells them.
BOUNDS, PLACES = (64, 86, 256, 342), 2048
#: Bytes of text that are hashed together, so that scratch arrays stay in the cache.
SLICE = 1 << 18
#: Equal sketch bytes of 36 from which a pair is verified; a pair at the threshold has 27 on average, deviation 2.6.
SKETCH, SKETCH_BYTES = 18, 36
#: Members of a bucket whose sketches are compared exhaustively.
SMALL = 4000
#: Bucket keys of a range, which one task sorts; of a task before it packs them; lines that a task knows as seen.
RANGE, PACK, SEEN = 2_000_000, 1_500_000, 1_000_000
#: Bytes of the filter that picks the lines whose texts are compared.
FILTER = 1 << 23
_INK = separators(WHITE)
_random = np.random.default_rng(20240611)
_MULTIPLY = (_random.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _random.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_LETTER = (_random.integers(0, 1 << 31, SHINGLE, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FOLD = (_random.integers(0, 1 << 63, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_NONE = np.uint32(0xFFFFFFFF)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines with ink, stripped; the text of each; its line number (blank lines count)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    starts, ends = starts[ends > starts], ends[ends > starts]
    doc = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[doc])
    first, last = data[starts], data[ends - 1]
    if not (_INK[first] & _INK[last]).all():
        ink = np.flatnonzero(_INK[data])
        if not len(ink):
            return (np.zeros(0, np.int64),) * 4
        a, b = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
        full = b > a
        doc, number = doc[full], number[full]
        starts, ends = ink[a[full]], ink[b[full] - 1] + 1
    return starts, ends, doc, number


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each line as two numbers (lines x 2)."""
    whole = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, A-Z lowered, and where the lines start and end among them."""
    data = LOWER[data]
    if data.max(initial=0) < 128:
        return data.astype(np.uint32), starts, ends
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), place[starts], place[ends]


def _inside(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Where shingles begin: the places of each line but the last SHINGLE - 1; a shorter line has its first place."""
    edge = np.zeros(size + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.maximum(ends - SHINGLE + 1, starts + 1), -1)
    return np.cumsum(edge[:size], dtype=np.int8).view(bool)


def _shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of lines (with repeats), and each line's first. ``data`` is UTF-8."""
    code, starts, ends = _codes(data, starts, ends)
    first = np.concatenate([[0], np.cumsum(np.maximum(ends - starts - SHINGLE + 1, 1))])
    pad = np.concatenate([code, np.zeros(SHINGLE - 1, np.uint32)])
    out = pad[: len(code)] * _LETTER[0]
    for k in range(1, SHINGLE):
        out += pad[k : len(code) + k] * _LETTER[k]
    short = np.flatnonzero(ends - starts < SHINGLE)
    for d in short.tolist():
        a, b = starts[d], ends[d]
        out[a] = np.dot(code[a:b], _LETTER[: b - a]) + _LETTER[b - a]
    out = out[_inside(starts, ends, len(code))]
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(16)
    return out, first


def _exact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _shingles, as numbers that tell shingles apart: 12 bits a character below U+1000 (the number of characters
    above them if a shingle is short); a shingle with others has a 63-bit hash and the top bit."""
    code, starts, ends = _codes(data, starts, ends)
    first = np.concatenate([[0], np.cumsum(np.maximum(ends - starts - SHINGLE + 1, 1))])
    pad = np.concatenate([code, np.zeros(SHINGLE - 1, np.uint32)]).astype(np.uint64)
    out, high = np.zeros(len(code), np.uint64), np.zeros(len(code), bool)
    for k in range(SHINGLE):
        part = pad[k : len(code) + k]
        out |= part << np.uint64(12 * k)
        high |= part > 0xFFF
    for at in np.flatnonzero(high).tolist():
        out[at] = int.from_bytes(hashlib.blake2b(pad[at : at + SHINGLE].tobytes(), digest_size=8).digest(), "little") | 1 << 63
    for d in np.flatnonzero(ends - starts < SHINGLE).tolist():
        a, b = starts[d], ends[d]
        text = pad[a:b].tobytes()
        plain = int(sum(int(c) << (12 * k) for k, c in enumerate(pad[a:b].tolist()))) | int(b - a) << 60
        out[a] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") | 1 << 63 if (pad[a:b] > 0xFFF).any() else plain
    return out[_inside(starts, ends, len(code))], first


def _distinct(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values of each line, or a number on the same side of every bound in BOUNDS: between the places of a table
    that the values fill and all values; lines with a bound between these two are counted."""
    n, size = len(first) - 1, np.diff(first)
    used = np.zeros(n * PLACES, bool)
    at = value >> np.uint32(32 - (PLACES - 1).bit_length())
    at += np.repeat((np.arange(n) * PLACES).astype(np.uint32), size)
    used[at] = True
    # eight places at a time; a byte counts up to 128
    out = np.add.reduce(used.view(np.uint64).reshape(n * 2, PLACES // 16), axis=1).view(np.uint8).reshape(n, 16).sum(1, dtype=np.int64)
    unsure = np.searchsorted(BOUNDS, out, "right") != np.searchsorted(BOUNDS, size, "right")
    if unsure.any():
        some, begin = _part(value, first, unsure)
        row = np.repeat(np.arange(len(begin) - 1, dtype=np.uint64) << np.uint64(32), np.diff(begin))
        both = np.sort(row | some)
        new = np.concatenate([[True], both[1:] != both[:-1]])
        out[unsure] = np.bincount((both[new] >> np.uint64(32)).astype(np.int64), minlength=len(begin) - 1)
    return out


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each line of a column, as sorted numbers."""
    data, offsets = text_buffer(column)
    value, first = _exact(data, offsets[:-1], offsets[1:])
    return [np.unique(value[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _independent(value: np.ndarray, first: np.ndarray, columns: int = ROWS * BANDS) -> np.ndarray:
    """Minwise hashes of as many permutations (lines x columns)."""
    out = np.empty((len(first) - 1, columns), np.uint32)
    for k in range(columns):
        out[:, k] = np.minimum.reduceat(value * _MULTIPLY[k] + _ADD[k], first[:-1])
    return out


def _binned(value: np.ndarray, first: np.ndarray, turns: int) -> np.ndarray:
    """Minwise hashes of the bins of ``turns`` permutations (lines x COLUMNS); an empty bin takes the next full one's,
    changed by the distance."""
    n, bins = len(first) - 1, COLUMNS // turns
    shift = np.uint32(32 - (bins - 1).bit_length())
    base = np.repeat(np.arange(n) * COLUMNS, np.diff(first))
    out = np.full((n, turns, bins), _NONE)
    for t in range(turns):
        x = value * _MULTIPLY[t]
        x += _ADD[t]
        np.minimum.at(out.reshape(-1), base + (x >> shift), x)
        base += bins
    out = out.reshape(n * turns, bins)
    gaps = np.flatnonzero((out == _NONE).any(1))
    for r in np.array_split(gaps, 1 + len(gaps) * bins // 500_000):
        part = out[r]
        twice = np.concatenate([part, part], 1)
        full = np.where(twice != _NONE, np.arange(2 * bins), 2 * bins)
        to = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1][:, :bins]
        away = (to - np.arange(bins)).astype(np.uint32)
        out[r] = np.take_along_axis(twice, np.minimum(to, 2 * bins - 1), 1) + away * np.uint32(0x9E3779B1)
    return out.reshape(n, COLUMNS)


def _part(value: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the picked lines."""
    return value[np.repeat(pick, np.diff(first))], np.concatenate([[0], np.cumsum(np.diff(first)[pick])])


def _keys(signature: np.ndarray, kind: int) -> np.ndarray:
    """The keys of all buckets (lines x BANDS). A band's rows lie far apart, so that bins beside each other, which may
    have one value, are in different bands."""
    out = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(kind * BANDS), (len(signature), 1))
    for r in range(ROWS):
        out += signature[:, r * BANDS : (r + 1) * BANDS].astype(np.uint64) * _FOLD[r]
    return mix(out)


def bucket_keys(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the buckets of lines with shingle hashes, and the line of each."""
    size = _distinct(value, first)
    keys, lines = [], []
    for kind, (least, below, turns) in enumerate(KINDS):
        pick = (size >= least) & (size * RATIO < below)
        rows = np.flatnonzero(pick)
        if len(rows):
            part = _part(value, first, pick)
            k = _keys(_binned(*part, turns) if turns else _independent(*part), kind)
            keys.append(k.ravel())
            lines.append(np.repeat(rows, BANDS))
    return (np.concatenate(keys), np.concatenate(lines)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class _Seen:
    """Classes that a task has met, so that a line that comes again there is not hashed again."""

    def __init__(self):
        self.known: set[int] = set()

    def new(self, ids: np.ndarray) -> np.ndarray:
        """Places of the ids that come for the first time."""
        if len(self.known) > SEEN:
            self.known.clear()
        out = []
        for k, x in enumerate(ids.tolist()):
            if x not in self.known:
                self.known.add(x)
                out.append(k)
        return np.array(out, np.int64)
def _new_lines(column: pa.Array, seen: _Seen, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of a column of texts: its bytes, starts, ends and digests of lines that are new to the task (and
    that pass the filter of ``wanted`` ids)."""
    for a, b in slices(column, SLICE):
        data, offsets = text_buffer(column.slice(a, b - a))
        starts, ends, _, _ = _lines(data, offsets)
        if not len(starts):
            continue
        digest = _digests(data, starts, ends)
        if wanted is not None:
            keep = _passes(wanted, digest[:, 0])
            starts, ends, digest = starts[keep], ends[keep], digest[keep]
        new = seen.new(digest[:, 0])
        if len(new):
            yield data, starts[new], ends[new], digest[new]


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the document), line, h and g (the class of the line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                data, offsets = text_buffer(batch.column(2).slice(a, b - a))
                starts, ends, doc, number = _lines(data, offsets)
                digest, doc = _digests(data, starts, ends), pa.array(doc)
                pick = [batch.column(k).slice(a, b - a).take(doc) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*pick, pa.array(number.astype(np.int32)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], ["doc_id", "row", "line", "h", "g"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, line int, h long, g long")


def _packed(keys: np.ndarray, ids: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows of packed bucket keys, one a range: alone (key, class) where a bucket has one line here; where it has more,
    head (key, class) of the least and all members (node, class)."""
    # the first bits of the keys and the places are sorted as one number; unlike keys that share these bits only cut a
    # bucket in two, which meet again in their range
    low = np.uint64((1 << max(1, len(keys) - 1).bit_length()) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    keys, ids = keys[order], ids[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(begin, len(keys)))
    least, several = ids[begin], np.zeros(len(begin), bool)
    many = np.flatnonzero(count > 1)
    if len(many):
        held = ids[np.repeat(count > 1, count)]
        first = np.cumsum(count[many]) - count[many]
        least[many] = np.minimum.reduceat(held, first)
        several[many] = least[many] != np.maximum.reduceat(held, first)
    inside = np.flatnonzero(np.repeat(several, count))
    member, low = ids[inside], keys.astype(np.uint32)
    bounds = np.searchsorted((keys >> np.uint64(32)).view(np.int64), -(-(np.arange(ranges + 1) << 32) // ranges))
    of, within, heads = np.searchsorted(begin, bounds), np.searchsorted(inside, bounds), ~several
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        b = np.s_[of[r] : of[r + 1]]
        at, one = begin[b], heads[b]
        m = np.s_[within[r] : within[r + 1]]
        node = np.uint64(r << 32) | low[inside[m]]
        blobs = [low[at[one]], least[b][one], low[at[~one]], least[b][~one], node, member[m]]
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["range", "alone", "alone_id", "head", "head_id", "node", "member"])


def bucket_rows(docs: DataFrame, ranges: int) -> DataFrame:
    """range and the bytes that ``_packed`` gives, of all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, ids, size = _Seen(), [], [], 0
        for batch in batches:
            for data, starts, ends, digest in _new_lines(batch.column(0), seen):
                k, line = bucket_keys(*_shingles(data, starts, ends))
                keys.append(k)
                ids.append(digest[line, 0])
                size += len(k)
                if size > PACK:
                    yield from _packed(np.concatenate(keys), np.concatenate(ids), ranges)
                    keys, ids, size = [], [], 0
        if size:
            yield from _packed(np.concatenate(keys), np.concatenate(ids), ranges)

    return docs.select("text").mapInArrow(run, "range int, alone binary, alone_id binary, head binary, head_id binary, node binary, member binary")


def shared_buckets(packed: DataFrame, ranges: int) -> DataFrame:
    """node, cid, h of the buckets that hold several classes: each class with a representative (h) it has to be compared
    with, which leads to the least of the bucket. ``node`` is null where the bucket holds but these two."""

    def rows(node: np.ndarray, cid: np.ndarray, h: np.ndarray, pair: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(cid), pa.int64()) if pair else pa.array(node.view(np.int64)), pa.array(cid), pa.array(h)], ["node", "cid", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for k, r in enumerate(batch.column(0).to_pylist()):
                alone, head = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint32) for c in (1, 3))
                alone_id, head_id, member = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in (2, 4, 6))
                node = np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64)
                if len(node):  # members of one bucket follow each other, in the order of its heads
                    new = np.concatenate([[True], node[1:] != node[:-1]])
                    yield rows(node, member, head_id[np.cumsum(new) - 1])
                held.setdefault(r, []).append((np.concatenate([alone, head]), np.concatenate([alone_id, head_id]), np.arange(len(alone) + len(head)) < len(alone)))
        for r in list(held):
            low, ids, single = (np.concatenate(x) for x in zip(*held.pop(r), strict=True))
            order = (np.sort((low.astype(np.uint64) << np.uint64(32)) | np.arange(len(low), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            low, ids, single = low[order], ids[order], single[order]
            begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            count = np.diff(np.append(begin, len(low)))
            least = np.minimum.reduceat(ids, begin)
            several = least != np.maximum.reduceat(ids, begin)
            two = several & (count == 2) & np.logical_and.reduceat(single, begin)
            if two.any():
                pair = np.unique(np.stack([least[two], np.maximum.reduceat(ids, begin)[two]], 1), axis=0)
                yield rows(pair, pair[:, 1].copy(), pair[:, 0].copy(), True)
            use = np.repeat(several & ~two, count)
            if use.any():
                yield rows((np.uint64(r) << np.uint64(32)) | low[use].astype(np.uint64), ids[use], np.repeat(least, count)[use])

    return packed.repartition(ranges, "range").mapInArrow(run, "node long, cid long, h long")


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of an id in the filter."""
    bits, x = FILTER * 8, ids.view(np.uint64)
    return (x % np.uint64(bits)).astype(np.int64), (x // np.uint64(bits) % np.uint64(bits)).astype(np.int64)


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in _places(np.ascontiguousarray(ids)):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER bytes that all ``ids`` (id) pass, and few others while they are some tens of millions; the
    driver gets at most its 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(np.ascontiguousarray(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "bit"])

    words = ids.select("id").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER // 4, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _fetch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, g, text, sketch of the classes in ``ids`` (id), one row each.

    The scan passes on the lines that a filter of bounded size lets through; a join with the ids drops the rest.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(_filter_of(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for data, starts, ends, digest in _new_lines(batch.column(0), seen, wanted.value):
                whole = data.tobytes()
                text = [whole[x:y].decode() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                # only the bytes of these lines
                size = ends - starts
                first = np.concatenate([[0], np.cumsum(size)])
                own = data[np.repeat(starts - first[:-1], size) + np.arange(first[-1])]
                least = _independent(*_shingles(own, first[:-1], first[1:]), SKETCH_BYTES)
                sketch = (mix(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*(pa.array(digest[:, k].copy()) for k in (0, 1)), pa.array(text, pa.string()), pa.array([x.tobytes() for x in sketch], pa.binary())], ["id", "g", "text", "sketch"])

    found = docs.select("text").mapInArrow(run, "id long, g long, text string, sketch binary")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def line_components(docs: DataFrame, n_lines: int) -> DataFrame | None:
    """h, g, component of the line classes that have a link; None if there is none."""
    ranges = max(1, -(-n_lines * (BANDS + 2) // RANGE))
    nodes = written(shared_buckets(bucket_rows(docs, ranges), ranges))
    pairs = written(nodes.where("cid <> h").select(F.least("cid", "h").alias("a"), F.greatest("cid", "h").alias("b")).distinct())
    if pairs.isEmpty():
        return None
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    met = written(_fetch(docs, ids))
    classes = met.select(F.col("id").alias("cid"), "sketch")
    near = written(alike(pairs, classes, SKETCH))
    # only a bucket of three or more can hold pairs that its representatives do not show
    large = nodes.where("node IS NOT NULL").select("node", "cid")
    labels = connect(large, classes, _below, lambda wanted: met.select("id", "text").join(wanted.distinct(), "id", "left_semi"), shingle_sets, SKETCH, near)
    if labels is None:
        return None
    return labels.join(met.select("id", "g"), "id").select(F.col("id").alias("h"), "g", "component")


def _below(nodes: DataFrame) -> DataFrame:
    """Buckets with more than one component; crowded ones in blocks that meet pairwise."""
    size = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node", "n")
    live = written(nodes.join(written(size), "node"))
    return live.where(F.col("n") <= SMALL).select("node", "cid", "comp").unionByName(crowded_blocks(live.where(F.col("n") > SMALL).drop("n"), max(1, SMALL // 2)))


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, row, line of every line that goes."""
    small_batches(docs)
    lines = written(line_table(docs))
    labels = line_components(docs, lines.count())
    # lines of classes that come again or have a link; a class is known by both numbers, a component by its least class
    again = lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g")
    linked = again.withColumn("component", F.lit(None).cast("long")) if labels is None else again.join(written(labels), ["h", "g"], "full")
    at = written(lines.join(written(linked), ["h", "g"]).select("doc_id", "row", "line", F.coalesce("component", "h").alias("comp"), F.when(F.col("component").isNull(), F.col("g")).otherwise(0).alias("more")))
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "line", "row")
    first = written(at.groupBy("comp", "more").agg(F.min(order).alias("first")))  # so that the join can split a hot component
    return at.join(first, ["comp", "more"]).where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("line") != F.col("first.line")) | (F.col("row") != F.col("first.row"))).select("doc_id", "row", "line")


def _marked(docs: DataFrame, *columns) -> DataFrame:
    gone = dropped(docs).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    of = gone.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "dropped")
    here = docs.select(*columns, F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("_here"))
    return here.join(of, here["_doc"].eqNullSafe(of["_id"]) & (here["_here"] == of["_row"]), "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))


def mark(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, dropped (line numbers from 0): one row for each document."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines")
    return _marked(docs, "doc_id", lines).select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go."""
    text = F.col("whole.text")
    split = F.split(text, "\n", -1)
    keep = F.filter(F.transform(split, lambda x, i: F.when(~F.array_contains("dropped", i), x)), lambda x: x.isNotNull())
    rows = _marked(docs, F.struct(*docs.columns).alias("whole"))
    return rows.select(F.col("whole").withField("text", F.when(F.size("dropped") > 0, F.array_join(keep, "\n")).otherwise(text)).alias("whole")).select("whole.*")
