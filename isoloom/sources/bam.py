"""Binary alignments: a Python data source that reads and writes BAM (BGZF blocks of gzip, little-endian records).

    spark.dataSource.register(BamSource)
    spark.read.format("bam").load("reads.bam")

A file is read in ranges of bytes, a task each. Blocks and records carry no marks of their start: a range looks for the
first block whose header, and those of the blocks after it, hold together, and in its data for the first place from
which a row of well-formed records follows. A range goes on to where the next one begins, and fails if it does not
arrive at the very record that the next one finds: so, from the first range on, all of them are proved right. Files
that are plain gzip are one range.

Order keys follow the files by path, then the offset of the block in which a record begins, then its number there; they
do not depend on the ranges. One dictionary numbers the sequence names of all headers. Each row carries its whole record
(``raw``), so what is written again keeps bases, qualities, mates and all tags. Paths may be of any file system that
pyarrow opens, which driver and executors must share.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from isoloom.schema import ALIGNMENT

#: A row: the alignment, its file and its record without the length before it.
COLUMNS = f"{ALIGNMENT}, file string, raw binary"
OPS = "MIDNSHP=XB"
_SIZES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: Fixed value: the empty block that ends a BGZF file.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: How a block begins; its longest size; bits for the records that begin in one (37 bytes or more each).
MAGIC, BLOCK, RECORD_BITS = b"\x1f\x8b\x08\x04", 1 << 16, 11
#: Bytes of a range; blocks and records in a row that must hold together where one begins.
SPLIT = 32 << 20
BLOCKS_IN_ROW, RECORDS_IN_ROW = 4, 64
#: Fixed value: the greatest length of a sequence.
LONGEST = (1 << 31) - 1


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> list[str]:
    """The BAM files of a path (a file, a folder, or a pattern in the last part), in order."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    folder, _, pattern = (at, "", "*.bam") if info.type == fs.FileType.Directory else at.rpartition("/")
    base = path if info.type == fs.FileType.Directory else path.rpartition("/")[0]
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(folder or ".")) if f.type == fs.FileType.File]
    return [f"{base.rstrip('/')}/{n}" for n in sorted(names) if fnmatch.fnmatch(n, pattern) and not n.startswith(".")]


def unpacked(path: str):
    system, at = opened(path)
    return gzip.GzipFile(fileobj=system.open_input_file(at))


def read_header(f) -> tuple[str, list[tuple[str, int]]]:
    """The header's text; names and lengths of the reference sequences."""
    if f.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = f.read(struct.unpack("<i", f.read(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        name = f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", f.read(4))[0]))
    return text, refs


def merged_refs(headers: list[list[tuple[str, int]]]) -> list[tuple[str, int]]:
    """Each name once, in order of first appearance; headers must agree on its length."""
    sizes: dict[str, int] = {}
    for refs in headers:
        for name, size in refs:
            if sizes.setdefault(name, size) != size:
                raise ValueError(f"headers disagree on the length of {name}")
    return list(sizes.items())


def tags(data: bytes) -> dict[str, object]:
    """NM, XS and NH of a record's optional fields; all others are skipped."""
    found: dict[str, object] = {}
    at = 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            size = struct.calcsize(_SIZES[chr(data[at])])
            value, at = None, at + 5 + size * struct.unpack_from("<i", data, at + 1)[0]
        else:
            code = "<" + _SIZES[kind]
            value, at = struct.unpack_from(code, data, at)[0], at + struct.calcsize(code)
        if name in ("NM", "XS", "NH"):
            found[name] = value
    return found


def block_size(head: bytes) -> int | None:
    """The size of the block that begins with ``head``, if it is one."""
    if len(head) < 18 or not head.startswith(MAGIC):
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def is_blocked(f) -> bool:
    f.seek(0)
    return block_size(f.read(64)) is not None


def first_block(f, start: int, size: int) -> int:
    """The offset of the first block at ``start`` or later, ``size`` (of the file) if there is none."""
    f.seek(start)
    data = f.read((BLOCKS_IN_ROW + 1) * BLOCK)
    at = data.find(MAGIC)
    while at >= 0:
        end, n = at, 0
        while n < BLOCKS_IN_ROW and start + end < size and (found := block_size(data[end : end + 64])):
            end, n = end + found, n + 1
        if n == BLOCKS_IN_ROW or n and start + end == size:
            return start + at
        at = data.find(MAGIC, at + 1)
    return size


class Blocks:
    """The data of a file from a block on: bytes are looked at by their place in it, and dropped when passed."""

    def __init__(self, f, start: int, size: int, path: str = ""):
        self.f, self.next, self.size, self.path = f, start, size, path
        self.data, self.base, self.starts = bytearray(), 0, []

    def has(self, end: int) -> bool:
        """Whether the data reach ``end``; reads blocks until they do."""
        while self.base + len(self.data) < end and self.next < self.size:
            self.f.seek(self.next)
            packed = self.f.read(BLOCK)
            size = block_size(packed[:64])
            if size is None or size > len(packed):
                raise ValueError(f"{self.path}: no whole block at byte {self.next}")
            try:
                data = gzip.decompress(packed[:size])
            except (OSError, EOFError, zlib.error) as e:
                raise ValueError(f"{self.path}: damaged block at byte {self.next}: {e}") from None
            if data:
                self.starts.append((self.base + len(self.data), self.next))
            self.data += data
            self.next += size
        return self.base + len(self.data) >= end

    def get(self, at: int, n: int) -> bytes:
        return bytes(self.data[at - self.base : at - self.base + n])

    def block(self, at: int) -> tuple[int, int]:
        """The place of the first byte of the block that holds ``at``, and the block's offset; drops all before it."""
        while len(self.starts) > 1 and self.starts[1][0] <= at:
            self.starts.pop(0)
        if self.starts and self.starts[0][0] - self.base > 16 * BLOCK:
            del self.data[: self.starts[0][0] - self.base]
            self.base = self.starts[0][0]
        return self.starts[0] if self.starts and self.has(at + 1) else (at, self.size)


def well_formed(data: Blocks, at: int, n_refs: int) -> int | None:
    """The size of a record at ``at`` with the length before it, None if there can't be one; 0 at the end of the data.

    A position may lie beyond its sequence's length: a file that is one range is read with such records too.
    """
    if not data.has(at + 36):
        return 0 if not data.has(at + 1) else None
    size, tid, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", data.get(at, 36))
    least = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
    if n_name < 1 or n_seq < 0 or size < least or size > 1 << 29:
        return None
    if any(not -1 <= t < n_refs or p < -1 for t, p in ((tid, pos), (mate, mate_pos))):
        return None
    if not data.has(at + 36 + n_name + 4 * n_cigar):
        return None
    name = data.get(at + 36, n_name)
    if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
        return None
    ops = struct.unpack(f"<{n_cigar}I", data.get(at + 36 + n_name, 4 * n_cigar))
    if any(c & 15 >= len(OPS) for c in ops) or n_seq and ops and sum(c >> 4 for c in ops if OPS[c & 15] in "MIS=X") != n_seq:
        return None
    return size + 4 if data.has(at + 4 + size) else None


def first_record(data: Blocks, n_refs: int) -> int | None:
    """The place of the first record in the data, None if none begins there."""
    at = data.base
    while data.has(at + 36):
        end, n = at, 0
        while n < RECORDS_IN_ROW and (size := well_formed(data, end, n_refs)):
            end, n = end + size, n + 1
        if n == RECORDS_IN_ROW or n and size == 0:
            return at
        at += 1
    return None


def place(data: Blocks, at: int | None) -> tuple[int, int]:
    """Block offset and place in the block, which name a record in its file; the file's size for its end."""
    if at is None or not data.has(at + 1):
        return data.size, 0
    start, offset = data.block(at)
    return offset, at - start


def row(data: bytes, ord_: int, refs: list[tuple[str, int]], tids: list[int] | None, file: str) -> tuple:
    tid, pos, n_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
    at = 32 + n_name
    cigar = [{"op": OPS[c & 15], "len": c >> 4} for c in struct.unpack_from(f"<{n_cigar}I", data, at)]
    rest = tags(data[at + 4 * n_cigar + (l_seq + 1) // 2 + l_seq :])
    name, number = (refs[tid][0], tids[tid] if tids else tid) if tid >= 0 else (None, -1)
    return (ord_, data[32 : 31 + n_name].decode(), flag, number, name, pos, l_seq, cigar, rest.get("NM"), rest.get("XS"), rest.get("NH"), file, data)


def range_records(f, size: int, start: int, end: int, path: str = "") -> Iterator[tuple[int, bytes]]:
    """Block offset << RECORD_BITS plus number in the block, and bytes, of the records that begin in the blocks from
    ``start`` on and before ``end``."""
    head = Blocks(f, 0, size, path)
    refs, at = header_of(head)
    if start:
        data = Blocks(f, first_block(f, start, size), size, path)
        at = first_record(data, len(refs)) if data.next < end else None
    else:
        data = head
    last = k = -1
    while at is not None and data.has(at + 1):
        offset = data.block(at)[1]
        if offset >= end:
            break
        k = k + 1 if offset == last else 0
        last = offset
        n = struct.unpack("<i", data.get(at, 4))[0] if data.has(at + 4) else -1
        if n < 32 or not data.has(at + 4 + n):
            raise ValueError(f"{path}: no whole record in the block at byte {offset}, {place(data, at)[1]} bytes into it")
        yield offset << RECORD_BITS | k, data.get(at + 4, n)
        at += 4 + n
    if end < size and at is not None:
        after = Blocks(f, first_block(f, end, size), size, path)
        found = place(after, first_record(after, len(refs)))
        if found != place(data, at):
            raise ValueError(f"{path}: records of the range from byte {start} on end at {place(data, at)}, those after it begin at {found}")


def header_of(data: Blocks) -> tuple[list[tuple[str, int]], int]:
    """Names and lengths of the reference sequences, and where the first record begins."""
    f = io.BufferedReader(_Reader(data))
    refs = read_header(f)[1]
    return refs, f.tell()


class _Reader(io.RawIOBase):
    """Blocks as a file."""

    def __init__(self, data: Blocks):
        self.data_, self.at = data, 0

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        self.data_.has(self.at + 1)
        part = self.data_.get(self.at, len(b))
        b[: len(part)] = part
        self.at += len(part)
        return len(part)

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.at if whence == 1 else offset

    def tell(self) -> int:
        return self.at


def bgzf(data: bytes) -> bytes:
    """One BGZF block of at most 64 KB."""
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf_all(data: bytes) -> bytes:
    return b"".join(bgzf(data[a : a + 60_000]) for a in range(0, len(data), 60_000))


def parse_refs(header: str) -> list[tuple[str, int]]:
    """name:length,name:length as pairs."""
    return [(n, int(s)) for n, s in (x.rsplit(":", 1) for x in header.split(",") if x)]


def head_bytes(refs: list[tuple[str, int]], text: str | None = None) -> bytes:
    """A file's head: its text (else the @SQ lines) and sequences."""
    whole = (text if text is not None else "".join(f"@SQ\tSN:{n}\tLN:{s}\n" for n, s in refs)).encode()
    head = b"BAM\1" + struct.pack("<i", len(whole)) + whole + struct.pack("<i", len(refs))
    return head + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in refs)


def encode(row, tids: dict[str, int]) -> bytes:
    """The record of a row. Where the row has its ``raw`` record, all of it stays but the name and the numbers of the
    sequences, which follow the new header; a row without one has unknown bases and qualities (N and 255)."""
    name = row["qname"].encode() + b"\0"
    raw = row["raw"] if "raw" in row else None
    if raw is not None:
        raw = bytes(raw)
        mine, mate = tids.get(row["chr"], -1), struct.unpack_from("<i", raw, 20)[0]
        if mate >= 0 and mate == struct.unpack_from("<i", raw)[0]:
            mate = mine
        body = struct.pack("<i", mine) + raw[4:8] + bytes([len(name)]) + raw[9:20] + struct.pack("<i", mate) + raw[24:32] + name + raw[32 + raw[8] :]
        return struct.pack("<i", len(body)) + body
    cigar = b"".join(struct.pack("<I", c["len"] << 4 | OPS.index(c["op"])) for c in row["cigar"] or [])
    extra = b"" if row["nm"] is None else b"NMi" + struct.pack("<i", row["nm"])
    extra += b"" if row["xs"] is None else b"XSA" + row["xs"].encode()
    extra += b"" if row["nh"] is None else b"NHi" + struct.pack("<i", row["nh"])
    n = row["l_qseq"] or 0
    body = struct.pack("<iiBBHHHiiii", tids.get(row["chr"], -1), row["pos"], len(name), 255, 4680, len(row["cigar"] or []), row["flag"], n, -1, -1, 0)
    body += name + cigar + b"\xff" * ((n + 1) // 2) + b"\xff" * n + extra
    return struct.pack("<i", len(body)) + body


class BamPartition(InputPartition):
    """A range of a file; ``tids`` has the common numbers of its sequences where they are not its own, ``shift`` the bits
    of order keys below the file's rank; a file that is plain gzip has no ``end``."""

    def __init__(self, path: str, rank: int, start: int, end: int | None, tids: list[int] | None, shift: int):
        self.path, self.rank, self.start, self.end, self.tids, self.shift = path, rank, start, end, tids, shift


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int = SPLIT):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        files = []
        for p in listed(self.path):
            with unpacked(p) as f:
                refs = read_header(f)[1]
            system, at = opened(p)
            with system.open_input_file(at) as f:
                files.append((p, f.size(), is_blocked(f), refs))
        tids = {name: k for k, (name, _) in enumerate(merged_refs([f[3] for f in files]))}
        shift = max((f[1] for f in files), default=0).bit_length() + RECORD_BITS
        if len(files) << shift >= 1 << 63:
            raise ValueError("too many files for one order key")
        out = []
        for rank, (p, size, blocked, refs) in enumerate(files):
            numbers = [tids[n] for n, _ in refs]
            numbers = None if numbers == list(range(len(refs))) else numbers
            cuts = [*range(0, max(size, 1), self.split), size] if blocked else [0, None]
            out += [BamPartition(p, rank, a, b, numbers, shift) for a, b in zip(cuts, cuts[1:])]
        return out

    def read(self, partition: BamPartition) -> Iterator[tuple]:
        p, above = partition, partition.rank << partition.shift
        system, at = opened(p.path)
        if p.end is None:
            yield from self._in_order(p, above)
            return
        with system.open_input_file(at) as f:
            refs, _ = header_of(Blocks(f, 0, f.size(), p.path))
            for key, data in range_records(f, f.size(), p.start, p.end, p.path):
                yield row(data, above | key, refs, p.tids, p.path)

    def _in_order(self, p: BamPartition, above: int) -> Iterator[tuple]:
        with unpacked(p.path) as f:
            refs, k = read_header(f)[1], 0
            while head := f.read(4):
                size = struct.unpack("<i", head)[0] if len(head) == 4 else -1
                data = f.read(max(size, 0))
                if size < 32 or len(data) < size:
                    raise ValueError(f"{p.path}: no whole record after {k} records")
                yield row(data, above | k, refs, p.tids, p.path)
                k += 1


class BamWriter(DataSourceWriter):
    """Each task writes a whole BAM file under a name of its own; the commit gives them their names.

    Overwriting removes the parts of earlier writes when all new ones are there; appending adds parts of new names.
    """

    def __init__(self, path: str, header: str, text: str | None, overwrite: bool, bare: bool = False):
        self.path, self.overwrite, self.job, self.bare = path, overwrite, uuid.uuid4().hex[:12], bare
        self.refs, self.text = parse_refs(header), text

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}"
        temporary = f"{folder}/.{name}.{context.taskAttemptId()}"
        tids = {n: k for k, (n, _) in enumerate(self.refs)}
        head = b"" if self.bare else head_bytes(self.refs, self.text)
        with system.open_output_stream(temporary) as out:
            held = bytearray(head)
            for row in rows:
                held += encode(row, tids)
                while len(held) >= 60_000:
                    out.write(bgzf(bytes(held[:60_000])))
                    del held[:60_000]
            if held:
                out.write(bgzf(bytes(held)))
            if not self.bare:
                out.write(END_BLOCK)
        message = WriterCommitMessage()
        message.files = (temporary, f"{folder}/{name}.bam")
        return message

    def commit(self, messages: list) -> None:
        system, folder = opened(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith("part-") and f.base_name.endswith(".bam")] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(*m.files)
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.files[0]).type == fs.FileType.File:
                system.delete_file(m.files[0])


class BamSource(DataSource):
    """Option of the reader: split, the bytes of a range. Options of the writer: header, as name:length,name:length; text, the header's text (else its @SQ lines); bare,
    for files without header and end block."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options["path"], self.options.get("header", ""), self.options.get("text"), overwrite, self.options.get("bare", "false").lower() == "true")


def references(path: str) -> list[tuple[str, int]]:
    """Names and lengths of the common dictionary of a path's files."""
    found = []
    for p in listed(path):
        with unpacked(p) as f:
            found.append(read_header(f)[1])
    return merged_refs(found)


def header(spark, path: str):
    """tid, chr, len of the common dictionary of a path's files."""
    return spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(references(path))], "tid int, chr string, len long")


def header_text(path: str) -> str:
    """The text of the first file's header, with the @SQ lines of all files in the common order."""
    with unpacked(listed(path)[0]) as f:
        lines = read_header(f)[0].splitlines()
    own = {x.split("SN:", 1)[1].split("\t")[0]: x for x in lines if x.startswith("@SQ") and "SN:" in x}
    sequences = [own.get(n, f"@SQ\tSN:{n}\tLN:{s}") for n, s in references(path)]
    first = [x for x in lines if x.startswith("@HD")]
    return "".join(f"{x}\n" for x in [*first, *sequences, *(x for x in lines if not x.startswith(("@HD", "@SQ")))])
