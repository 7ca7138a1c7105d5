"""FASTQ in pieces: what a chunk of lines does to each state in which it may be entered, and its records once that is known.

A quality line may begin with any letter, so where a record begins depends on all lines before. The states between two
lines are: none open (a record is sought), a sequence of so many letters, a quality that lacks so many letters. A chunk
sums up, for every state, in which one it is left; the steps over quality lines are lookups in the running sums of line
lengths, and almost all of them meet soon, so a summary is a few numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Generator, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SOUGHT, SEQUENCE, QUALITY = 0, 1, 2
OTHER, HEADER, PLUS = 0, 1, 2

#: Types of what ``summary`` gives and of a state.
STATE = "kind int, letters long, record long"
SUMMARY = f"n int, total long, sought int, q_least long, q_exit int, s_mark int, s_letters long, s_from long, s_least long, s_exit int, upto array<long>, exit_of array<int>, exits array<struct<{STATE}>>"


class State(NamedTuple):
    """``letters`` of the sequence so far, or which the quality lacks; ``record`` is the order key of its header."""

    kind: int = SOUGHT
    letters: int = 0
    record: int = -1


class Lines:
    """The lines of a chunk: what each begins with, and running sums of letters."""

    def __init__(self, values: pa.Array):
        self.n = len(values)
        first = pc.utf8_slice_codeunits(values, 0, 1)
        head = pc.or_(pc.equal(first, ">"), pc.equal(first, "@")).to_numpy(zero_copy_only=False)
        self.mark = np.where(head, HEADER, np.where(pc.equal(first, "+").to_numpy(zero_copy_only=False), PLUS, OTHER))
        self.upto = np.concatenate([[0], np.cumsum(pc.utf8_length(values).to_numpy(zero_copy_only=False), dtype=np.int64)])
        self.next_mark = self._next(self.mark != OTHER)
        self.next_header = self._next(head)

    def _next(self, hits: np.ndarray) -> np.ndarray:
        """For each line, and for the end, the first hit there or later."""
        at = np.where(hits, np.arange(self.n), self.n)
        return np.append(np.minimum.accumulate(at[::-1])[::-1], self.n)

    def quality_end(self, begin: np.ndarray | int, letters: np.ndarray | int) -> np.ndarray:
        """The line after a quality of so many letters that starts at ``begin`` (one line at least); beyond the end if
        it goes on there."""
        return np.maximum(np.searchsorted(self.upto, self.upto[begin] + letters), np.asarray(begin) + 1)


def summary(lines: Lines, ords: np.ndarray) -> dict[str, Any]:
    """The exit state of every entry state."""
    n, upto = lines.n, lines.upto
    heads = np.flatnonzero(lines.mark == HEADER)
    mark = lines.next_mark[heads + 1]
    plus = (mark < n) & (np.append(lines.mark, OTHER)[mark] == PLUS)
    letters = upto[mark] - upto[heads + 1]
    then = mark.copy()  # a header after the sequence
    then[plus] = lines.quality_end(mark[plus] + 1, letters[plus])
    open_ = (mark == n) | (then > n)
    lacks = np.where(plus, letters - (upto[n] - upto[np.minimum(mark + 1, n)]), letters)
    # from each header to the one that follows its record; those that stay open lead to themselves, no header to n
    to = np.full(n + 1, n)
    to[heads] = np.where(open_, heads, lines.next_header[np.minimum(then, n)])
    while (further := to[to]).tobytes() != to.tobytes():
        to = further
    ends = to[lines.next_header]  # the exit for a record sought at each line: an open header, or n
    kinds, code = np.unique(np.append(n, ends), return_inverse=True)
    code = code[1:]
    place = {int(h): i for i, h in enumerate(heads)}
    exits = [State() if h == n else State(QUALITY if plus[place[int(h)]] else SEQUENCE, int(lacks[place[int(h)]]), int(ords[h])) for h in kinds]
    last = np.append(np.flatnonzero(code[2:] != code[1:-1]) + 1, n)  # last line of each run of equal exits, from 1
    m = int(lines.next_mark[0])
    what = OTHER if m == n else int(lines.mark[m])
    inside = what == PLUS and m + 2 <= n
    return {
        "n": n, "total": int(upto[n]), "sought": int(code[0]), "q_least": int(upto[1]), "q_exit": int(code[1]),
        "s_mark": what, "s_letters": int(upto[m]), "s_from": int(upto[m + 1]) if m < n else 0,
        "s_least": int(upto[m + 2]) if inside else -1, "s_exit": int(code[m + 2] if inside else code[m]),
        "upto": upto[last].tolist(), "exit_of": code[last].tolist(), "exits": [s._asdict() for s in exits],
    }


def leave(s: State, row: dict[str, Any]) -> State:
    """The state after a chunk that is entered in ``s``."""
    exit_at = lambda k: State(**row["exits"][k])

    def quality(goal: int, least: int, code: int) -> State:
        if goal > row["total"]:
            return State(QUALITY, goal - row["total"], s.record)
        return exit_at(code if goal <= least else row["exit_of"][int(np.searchsorted(row["upto"], goal))])

    if s.kind == SOUGHT:
        return exit_at(row["sought"])
    if s.kind == QUALITY:
        return quality(s.letters, row["q_least"], row["q_exit"])
    letters = s.letters + row["s_letters"]
    if row["s_mark"] == OTHER:
        return State(SEQUENCE, letters, s.record)
    if row["s_mark"] == HEADER:
        return exit_at(row["s_exit"])
    if row["s_least"] < 0:
        return State(QUALITY, letters, s.record)
    return quality(row["s_from"] + letters, row["s_least"], row["s_exit"])


def name_of(header: str) -> str:
    return (header[1:].split(None, 1) or [""])[0] if header[1:2].strip() else ""


def records(lines: Lines, values: list[str], ords: np.ndarray, s: State, edges: bool) -> Generator[tuple[int, int, str | None, str, str | None], None, State]:
    """record, at, name, seq, qual: with ``edges`` the parts of records that reach over the chunk's ends, else those that
    begin and end within it. A part without a header has no name, one without any of the quality no qual. The state
    after the chunk is returned."""
    n, upto, at, left = lines.n, lines.upto, int(lines.next_header[0]), State()

    def quality(begin: int, letters: int, record: int) -> int:
        """The line after the quality, beyond the end if it goes on there."""
        nonlocal left
        end = int(lines.quality_end(begin, letters)) if begin < n else n + 1
        if end > n:
            left = State(QUALITY, letters - int(upto[n] - upto[begin]), record)
        return end

    if s.kind != SOUGHT:
        seq, qual, begin, letters = "", None, 0, s.letters
        if s.kind == SEQUENCE:
            at = int(lines.next_mark[0])
            seq, letters = "".join(values[:at]), letters + int(upto[at])
            begin = at + 1 if at < n and lines.mark[at] == PLUS else -1
            if at == n:
                left = State(SEQUENCE, letters, s.record)
        if begin >= 0:
            end = min(quality(begin, letters, s.record), n)
            qual, at = "".join(values[begin:end]), int(lines.next_header[end])
        if edges:
            yield s.record, int(ords[0]), None, seq, qual
    while at < n:
        head, m, span = at, int(lines.next_mark[at + 1]), None
        whole, at = m < n, m
        if not whole:
            left = State(SEQUENCE, int(upto[n] - upto[head + 1]), int(ords[head]))
        elif lines.mark[m] == PLUS:
            end = quality(m + 1, int(upto[m] - upto[head + 1]), int(ords[head]))
            whole, span = end <= n, (m + 1, min(end, n))
            at = int(lines.next_header[span[1]])
        if whole == edges:
            continue
        seq = "".join(values[head + 1 : m])
        qual = None if span is None else "".join(values[span[0] : span[1]])
        if whole and qual is not None and len(qual) != len(seq):
            raise ValueError(f"the quality of {name_of(values[head])} has {len(qual)} letters, its sequence {len(seq)}")
        yield int(ords[head]), int(ords[head]), name_of(values[head]), seq, qual
    return left


def chunks(batches: Iterator[pa.RecordBatch], file_bits: int, size: int) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """(rank of the file, split) and lines of one split, about ``size`` bytes at a time. ``ord`` has the rank above
    ``file_bits``."""
    held: list[pa.RecordBatch] = []
    weight, key = 0, None

    def joined() -> tuple[tuple[int, int], pa.RecordBatch]:
        return key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        rank, split = batch.column("ord").to_numpy() >> file_bits, batch.column("split").to_numpy()
        edges = np.flatnonzero((rank[1:] != rank[:-1]) | (split[1:] != split[:-1])) + 1
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            for at in range(lo, hi, step):
                of = (int(rank[at]), int(split[at]))
                if held and (of != key or weight >= size):
                    yield joined()
                    held, weight = [], 0
                key = of
                held.append(batch.slice(at, min(step, hi - at)))
                weight += held[-1].nbytes
    if held:
        yield joined()


def summaries(batches: Iterator[pa.RecordBatch], schema: pa.Schema, file_bits: int, size: int) -> Iterator[pa.RecordBatch]:
    """One row a chunk: rank, split, at (its first order key) and its summary."""
    for (rank, split), part in chunks(batches, file_bits, size):
        ords = part.column("ord").to_numpy()
        yield pa.RecordBatch.from_pylist([{"rank": rank, "split": split, "at": int(ords[0]), **summary(Lines(part.column("value")), ords)}], schema)


def entries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The state in which each split is entered and its number of lines, from summaries in order, whole files each."""
    file, split, entry, n, s = None, None, State(), 0, State()
    row = lambda: pa.RecordBatch.from_pylist([{"rank": file, "split": split, "lines": n, **entry._asdict()}], schema)
    for r in (r for b in batches for r in b.to_pylist()):
        if (r["rank"], r["split"]) != (file, split):
            if file is not None:
                yield row()
            s = s if r["rank"] == file else State()
            file, split, entry, n = r["rank"], r["split"], s, 0
        n += r["n"]
        s = leave(s, r)
    if file is not None:
        yield row()


def parsed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, file_bits: int, size: int, edges: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ``records`` for lines that carry the state in which their split is entered."""

    def rows() -> Iterator[tuple]:
        key, left, s = None, 0, State()
        for of, part in chunks(batches, file_bits, size):
            if of != key:
                if left:
                    raise ValueError("a split does not have the lines that were counted in it")
                key = of
                left, s = part.column("lines")[0].as_py(), State(*(part.column(c)[0].as_py() for c in State._fields))
            left -= part.num_rows
            s = yield from records(Lines(part.column("value")), part.column("value").to_pylist(), part.column("ord").to_numpy(), s, edges)
        if left:
            raise ValueError("a split does not have the lines that were counted in it")

    found = rows()
    while part := list(itertools.islice(found, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
