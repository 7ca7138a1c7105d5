"""Operator 10: token ids in files of fixed-width bit-packed blocks.

A file holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs. Blocks have a fixed
number of ids and start at a byte, so any range is read by its own blocks alone and unpacked by numpy.

    magic "IDPK1\\0\\0\\0" | blocks | footer: block offsets u64, document ids i64, id present u8, lengths i64
    | trailer: bits u32, ids a block u32, ids u64, blocks u64, documents u64, footer start u64

Cases: null or empty text is the end id alone; a null document id comes first and stays null; rows with equal ids have
an order by hash of their texts; an empty table gives no file and no row; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoloom.llm.common import shared_folder, slices, small_batches, written
from isoloom.llm.encode import WordEncoder, encoder

MAGIC, TRAILER = b"IDPK1\0\0\0", struct.Struct("<IIQQQQ")
BLOCK_IDS = 1 << 14
#: Beyond so many ids a task begins another file, which bounds its memory.
FILE_IDS = 1 << 22


def width(vocabulary: int) -> int:
    """The fewest bits for ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def to_bytes(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """One whole file."""
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.cumsum([len(MAGIC), *map(len, blocks)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    footer = offsets.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + lengths.astype("<i8").tobytes()
    return MAGIC + b"".join(blocks) + footer + TRAILER.pack(bits, block, len(ids), len(blocks), len(doc_ids), int(offsets[-1]))


class TokenFile:
    """Random access to one file."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        head = source.read_at(len(MAGIC), 0)
        if head != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.n_ids, blocks, docs, at = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        footer = source.read_at(size - TRAILER.size - at, at)
        self.offsets = np.frombuffer(footer, "<u8", blocks + 1)
        ids = np.frombuffer(footer, "<i8", docs, 8 * (blocks + 1))
        known = np.frombuffer(footer, np.uint8, docs, 8 * (blocks + 1 + docs))
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.lengths = np.frombuffer(footer, "<i8", docs, 8 * (blocks + 1 + docs) + docs)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        data = self.source.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        first = int(self.offsets[a])
        parts = [unpack(data[int(self.offsets[k]) - first : int(self.offsets[k + 1]) - first], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(a, b)]
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]


def _place(folder: str):
    """The file system of a folder and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def vocabulary_of(tokenizer: str) -> int:
    """One more than the greatest id of a tokenizer's file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, folder: str) -> DataFrame:
    """Write files in ascending doc_id order; returns part, piece, path, n_ids, n_docs of each file.

    A task writes under a name of its own and renames at the end, so a repeated task leaves the same file once.
    """
    bits = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, piece, total = encoder(WordEncoder, tokenizer), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list = []

        def flush() -> pa.RecordBatch:
            place, base = _place(folder)
            place.create_dir(base, recursive=True)
            path = f"{base}/part-{part:06d}-{piece:05d}.ids"
            lengths = np.array([len(x) for x in ids], np.int64)
            with place.open_output_stream(temporary := f"{path}.{uuid.uuid4().hex}") as out:
                whole = np.concatenate(ids)
                if int(whole.max()) >= vocabulary:
                    raise ValueError(f"id {int(whole.max())} is beyond the vocabulary of {vocabulary}")
                out.write(to_bytes(whole, doc_ids, lengths, bits))
            if place.get_file_info(path).type == fs.FileType.File:  # of an earlier attempt; some file systems move onto nothing
                place.delete_file(path)
            place.move(temporary, path)
            return pa.RecordBatch.from_pydict({"part": [part], "piece": [piece], "path": [path], "n_ids": [int(lengths.sum())], "n_docs": [len(ids)]}, pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

        end = np.array([end_id], np.uint16)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                ids += [np.concatenate([x, end]) for x in code.ids([t or "" for t in texts])]
                doc_ids += batch.column(0).slice(a, b - a).to_pylist()
                total += sum(map(len, ids[a - b :]))
                if total >= FILE_IDS:
                    yield flush()
                    ids, doc_ids, piece, total = [], [], piece + 1, 0
        if ids:
            yield flush()

    # rows of one doc_id are dealt by their texts, so that many of them are no single task's
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    return dealt.select("doc_id", "text").mapInArrow(run, "part int, piece int, path string, n_ids long, n_docs long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone.

    ``files`` has one row a file, so the running total goes through one task without a share of the documents.
    """
    at = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(at), F.lit(0)).alias("base"))
    step = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _place(folder)[0].open_input_file(path) as source:
                    file = TokenFile(source)
                    ends = np.cumsum(file.lengths)
                    starts, crcs, d = ends - file.lengths, [], 0
                    while d < len(ends):
                        e = max(d + 1, int(np.searchsorted(ends, starts[d] + step, "right")))
                        ids = file.read(int(starts[d]), int(ends[e - 1])).astype("<u4")
                        crcs += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((starts[d:e] - starts[d]).tolist(), (ends[d:e] - starts[d]).tolist(), strict=True)]
                        d = e
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(starts + base), pa.array(file.lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int | None = None) -> DataFrame:
    """Write all documents, then describe each from what the files hold. The vocabulary is that of the tokenizer's file,
    or a larger one."""
    small_batches(docs)
    vocabulary = vocabulary or vocabulary_of(tokenizer)
    folder = shared_folder(docs.sparkSession)
    files = written(write_token_files(docs, tokenizer, end_id, vocabulary, folder))
    return read_token_files(files, folder)
