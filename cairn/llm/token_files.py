"""Token-id files: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of whole documents in ascending doc_id order:

    magic "CPF1" | block size u32 | documents u64 | ids u64 | blocks u64
    doc_id i64 each | doc_id present u8 each | number of ids u32 each
    block start u64 each, and the end
    blocks: minimum u32 | width u8 | exceptions u16 | packed low bits | exception places u16 | exception high bits u32

A block subtracts its minimum and packs the low `width` bits of each id, where width covers the given share of the block's
ids; ids that need more bits are exceptions, whose high bits are stored apart.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import in_order, put, scratch
from .encoding import encoder

MAGIC, HEAD = b"CPF1", struct.Struct("<4sIQQQ")
BLOCK, SHARE, FILE_IDS = 1024, 0.9, 1 << 23


def pack_blocks(ids: np.ndarray, block: int = BLOCK, share: float = SHARE) -> list[bytes]:
    """The blocks of a run of ids (u32)."""
    out = []
    for at in range(0, len(ids), block * 512):
        part = ids[at : at + block * 512]
        full = len(part) // block * block
        for x in (part[:full].reshape(-1, block), part[full:].reshape(1, -1)):
            if not x.size:
                continue
            n = x.shape[1]
            low = x.min(axis=1)
            x = x - low[:, None]
            rank = min(n - 1, max(0, int(np.ceil(share * n)) - 1))
            width = np.ceil(np.log2(np.partition(x, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.int64)
            made: list[bytes] = [b""] * len(x)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                y = x[rows]
                bits = np.packbits(((y[:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
                high = y >> np.uint32(w) if w < 32 else np.zeros_like(y)
                for i, r in enumerate(rows):
                    where = np.flatnonzero(high[i])
                    made[r] = struct.pack("<IBH", int(low[r]), int(w), len(where)) + bits[i].tobytes() + where.astype("<u2").tobytes() + high[i][where].astype("<u4").tobytes()
            out += made
    return out


def unpack_block(data: memoryview, n: int) -> np.ndarray:
    """The n ids of a block."""
    low, width, odd = struct.unpack_from("<IBH", data)
    at = 7 + (n * width + 7) // 8
    x = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data[7:at], np.uint8), bitorder="little", count=n * width).reshape(n, width)
        full = np.zeros((n, -(-width // 8) * 8), np.uint8)
        full[:, :width] = bits
        by = np.packbits(full, axis=1, bitorder="little")
        for k in range(by.shape[1]):
            x |= by[:, k].astype(np.uint32) << np.uint32(8 * k)
    if odd:
        where = np.frombuffer(data[at : at + 2 * odd], "<u2")
        x[where] |= np.frombuffer(data[at + 2 * odd : at + 6 * odd], "<u4") << np.uint32(width)
    return x + np.uint32(low)


def pack_file(doc_ids: list[int | None], ids: list[bytes], block: int = BLOCK, share: float = SHARE) -> bytes:
    flat = np.frombuffer(b"".join(ids), "<u4")
    blocks = pack_blocks(flat, block, share)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in blocks]))).astype("<u8")
    return b"".join([
        HEAD.pack(MAGIC, block, len(ids), len(flat), len(blocks)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
        np.array([len(x) // 4 for x in ids], "<u4").tobytes(), starts.tobytes(), *blocks,
    ])


class TokenFile:
    """A file's documents and ids, decoded a block at a time."""

    def __init__(self, data: bytes):
        magic, self.block, n, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        ids, there = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(x) if y else None for x, y in zip(ids, there, strict=True)]
        self.lengths = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at + 13 * n).astype(np.int64)
        self.body = memoryview(data)[at + 13 * n + 8 * (blocks + 1) :]
        self._at, self._ids = -1, None

    def _block(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._ids = k, unpack_block(self.body[self.starts[k] : self.starts[k + 1]], min(self.block, self.n_ids - k * self.block))
        return self._ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start up to stop; only the blocks that hold them are decoded."""
        found = []
        for k in range(start // self.block, -(-stop // self.block)):
            found.append(self._block(k)[max(0, start - k * self.block) : stop - k * self.block])
        return np.concatenate(found) if found else np.empty(0, np.uint32)


def write_token_files(docs: DataFrame, uri: str, path: str, end_id: int = 1, block: int = BLOCK, share: float = SHARE, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files under uri and returns their manifest (name, part, seq, n_docs, n_ids); evaluating it writes them."""

    def run(batches):
        codec, end = encoder(path, 1_000_000), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        part, attempt = task.partitionId(), str(task.taskAttemptId())
        doc_ids, ids, size, made = [], [], 0, []

        def flush():
            nonlocal doc_ids, ids, size
            name = f"part-{part:07d}-{len(made):05d}.cpf"
            put(uri, name, pack_file(doc_ids, ids, block, share), attempt)
            made.append((name, part, len(made), len(ids), size))
            doc_ids, ids, size = [], [], 0

        for batch in in_order(batches):
            for k, x in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1)), strict=True):
                doc_ids.append(k), ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= file_ids:
                    flush()
        if ids:
            flush()
        columns = list(zip(*made, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["name", "part", "seq", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, "name string, part long, seq long, n_docs long, n_ids long")


def read_token_files(spark, uri: str, starts: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; starts has each file's first place."""

    def run(batches):
        base = dict(starts)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile(data.as_py())
                ends = np.cumsum(f.lengths)
                crc = [zlib.crc32(f.ids(b - n, b).astype("<u4").tobytes()) for b, n in zip(ends.tolist(), f.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids, pa.int64()), pa.array(ends - f.lengths + base[name], pa.int64()), pa.array(f.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cpf").load(uri)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Encodes docs (doc_id, text, ...) into token files in the shared folder and returns what the files hold.

    Null and empty texts are one end id; very long ones are written whole, into one file. Rows order by doc_id, null first, then by
    text; repeated rows are written each, and rows of one doc_id by one task, since their order is one. An empty table writes no file
    and gives no rows. Other columns are ignored. The driver holds one row a file.
    """
    spark, uri = docs.sparkSession, scratch(docs.sparkSession, "tokens")
    made = sorted((r.part, r.seq, r.name, r.n_ids) for r in write_token_files(docs, uri, path, end_id).collect())
    if not made:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    starts, at = [], 0
    for _, _, name, n in made:
        starts.append((name, at))
        at += n
    return read_token_files(spark, uri, starts)
