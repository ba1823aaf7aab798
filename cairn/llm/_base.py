"""Helpers shared by the training-data operators: words, hashes, shared storage, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a local master."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, which cuts its lineage; and the path, for `discard`.

    Once it is written nothing needs the shuffle files behind it, so Spark is told to remove them at the end of the write.
    """
    spark, path, key = df.sparkSession, scratch(df.sparkSession, label), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path), path


def small(df: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """A table of a few numbers a row, stored or cheap to count: broadcast up to `limit` rows (tens of MB), shuffled beyond."""
    return F.broadcast(df) if df.count() <= limit else df


def released(spark: SparkSession) -> None:
    """Lets go of plans that nothing refers to any more, so that Spark removes their broadcast tables now.

    Spark does so when the driver collects garbage, which a driver with little to do may put off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no returned DataFrame reads."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put(uri: str, name: str, data: bytes, attempt: str) -> None:
    """Write a file under another name and move it into place, so that a lost or repeated attempt leaves no half file."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(uri)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/_{name}.{attempt}") as out:
        out.write(data)
    store.move(f"{top}/_{name}.{attempt}", f"{top}/{name}")


def take(uri: str, name: str) -> bytes:
    """A file that `put` wrote."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{top}/{name}") as found:
        return found.read()


def trimmed() -> None:
    """Gives freed memory back to the system, which allocators else keep for the next chunk or group."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def raw(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_order(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes, so that memory follows bytes and not rows."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        pa.default_memory_pool().release_unused()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_TERM = _WORD.copy()
_TERM[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = False
_R = U64(0x9E3779B97F4A7C55)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """R ** i and R ** -i modulo 2 ** 64, for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 20)
        inverse = U64(pow(int(_R), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, x, dtype=U64))), dtype=U64) for x in (_R, inverse)]
    return _POWERS


def content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 places where its texts begin; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and column.buffers()[2] else np.empty(0, np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, terms: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the n + 1 places among them where the texts begin; terms end at ASCII punctuation."""
    word = np.zeros(len(data) + 1, dtype=bool)
    word[:-1] = (_TERM if terms else _WORD)[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = word[:-1]
    before[at] = False
    starts = np.flatnonzero(word & ~before)
    after = word.copy()
    after[at] = False
    ends = np.flatnonzero(word[:-1] & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(column: pa.Array, lower: bool = True, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a text column, by polynomial prefix sums; and where each text's words begin.

    Words are the runs of bytes other than space and x09-x0D; only A-Z change case.
    """
    data, at = content(column)
    starts, ends, where = word_spans(data, at, terms)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(((_LOWER[data] if lower else data).astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * MIX_A), where


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(32))) * MIX_B
    x = (x ^ (x >> U64(29))) * MIX_A
    return x ^ (x >> U64(32))


_ODD = mixed(np.arange(1, 65, dtype=U64)) | U64(1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows; of the whole sequence where it is shorter, none where it is empty."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1] * _ODD[n]
    for k in range(1, n):
        out = (out ^ (out >> U64(31))) * _ODD[k] + h[k : len(h) - n + 1 + k]
    return mixed(out)


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, which the shuffle's codec packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def remainder5(column="doc_id"):
    """crc32 of the id's text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def components(edges: DataFrame, rounds: int = 40) -> tuple[DataFrame, str]:
    """(node, comp): comp is the smallest node reachable over edges (u, v), for every node that has an edge.

    Smallest labels of neighbours and pointer jumping alternate, so chains shorten by half a round; every round is a
    written table, so a lost executor costs one round. Nothing but a count of changes reaches the driver.
    """
    spark = edges.sparkSession
    both, at = stored(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels, path = stored(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("l")).select(F.col("u").alias("node"), F.col("l").alias("comp")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("near"))
        low = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("low"))
        jump = low.join(labels.select(F.col("node").alias("low"), F.col("comp").alias("far")), "low", "left")
        new, new_path = stored(jump.select("node", "was", F.least("low", F.coalesce("far", "low")).alias("comp")), "labels")
        changed = new.filter("was <> comp").limit(1).count()
        discard(spark, path)
        labels, path = new.select("node", "comp"), new_path
        if not changed:
            discard(spark, at)
            return labels, path
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of `counts` words each, from byte spans of words in order, joined by single spaces."""
    last = np.zeros(len(starts) + 1, bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    sizes = ends - starts + ~last[:-1]
    after = np.concatenate(([0], np.cumsum(sizes)))
    take = np.arange(after[-1]) + np.repeat(starts - after[:-1], sizes)
    out = data[np.minimum(take, max(0, len(data) - 1))] if len(data) else np.empty(0, np.uint8)
    out[(after[1:] - 1)[~last[:-1]]] = 32
    offsets = after[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out))])
