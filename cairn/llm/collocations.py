"""Phrase collocations, mined by partitioning (SON): each shard completely at a lower support, then the union counted exactly.

Tasks make up `SHARDS` shards of the documents. A phrase with f occurrences has at least f / SHARDS of them in some shard, so what reaches
ceil(support / SHARDS) in no shard is not frequent. A shard is mined level by level, since no phrase is more frequent than its parts: words, then
pairs of locally frequent words somewhere, then phrases of three and four words all of whose pairs are locally frequent somewhere. Mining counts
40 bits of hashes, added up over many texts before they leave a task; the union of what is locally frequent becomes a bitmap of a fixed number of
bits, whatever the corpus' size. A bitmap only ever lets more pass, so a crowded one costs time but loses nothing: the last
pass counts every occurrence of what passes, by the phrase itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import _LOWER, _powers, MIX_A, U64, content, discard, grams, in_order, joined_words, mixed, stored, trimmed

SHARDS, LONGEST = 4, 4
#: Exact: the product of two 19-digit numbers fits a decimal of 38 digits, and div doesn't round.
SCORE = "cast(cast(2000000 as decimal(19,0)) * cast({a} as decimal(19,0)) div cast({parts} as decimal(19,0)) as long)"
_PARTS = 64  # of a bitmap
_KEY = 40  # bits of a hash that mining counts by
_HOLD = 2_000_000  # phrases that a task counts at a time
_TEXT = 4 << 20  # bytes of text whose phrases are counted exactly at a time
_ROWS = 50_000  # rows that leave a task at a time
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_BREAK
_INSIDE[[32, 9]] = False


class Words:
    """The lower-cased words of some texts, with hashes of phrases that are distinct by language."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        data, at = content(texts)
        self.langs, self.data = langs, _LOWER[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _INSIDE[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        before[at] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = inside.copy()
        after[at] = False
        self.ends = np.flatnonzero(inside[:-1] & ~after[1:]) + 1
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
        self.text = np.searchsorted(at, self.starts, "right") - 1
        self.piece = np.cumsum(_BREAK[data])[self.starts] + self.text if len(data) else np.empty(0, np.int64)
        self.hashes = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64) * MIX_A)

    @classmethod
    def merged(cls, some: list[Words]) -> Words:
        """The words of all of them, one after the other."""
        out, size, texts, pieces = cls.__new__(cls), 0, 0, 0
        for x in some:
            x.starts, x.ends, x.text, x.piece = x.starts + size, x.ends + size, x.text + texts, x.piece + pieces
            size, texts, pieces = size + len(x.data), texts + len(x.langs), int(x.piece[-1]) + 1 if len(x.piece) else pieces
        for name in ("data", "starts", "ends", "text", "piece", "hashes"):
            setattr(out, name, np.concatenate([getattr(x, name) for x in some]))
        out.langs = [lang for x in some for lang in x.langs]
        return out

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word phrases that begin at each word, and whether one lies inside a piece."""
        if len(self.hashes) < n:
            return np.empty(0, U64), np.empty(0, bool)
        x = grams(self.hashes, n)
        seeds = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(self.langs)}
        lang = np.array([seeds[x] for x in self.langs], U64)[self.text[: len(x)]]
        return mixed(x + lang * U64(2 * n + 1)), self.piece[: len(x)] == self.piece[n - 1 :]


class Bitmap:
    """Which hashes may be frequent: one of 2 ** bits bits for each value of their highest bits."""

    def __init__(self, bits: int, parts: list[tuple[int, bytes]]):
        self.shift, size = U64(64 - bits), (1 << bits) // 8 // _PARTS
        self.bits = np.zeros((1 << bits) // 8, np.uint8)
        for part, found in parts:
            self.bits[part * size : (part + 1) * size] = np.frombuffer(found, np.uint8)

    def has(self, x: np.ndarray) -> np.ndarray:
        bit = x >> self.shift
        return (self.bits[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(slots: DataFrame, bits: int) -> Bitmap:
    """The bitmap of a column of distinct bits, made in parts where they are; only the bits, of fixed size, reach the driver."""
    size = (1 << bits) // _PARTS

    def part(key: tuple, table: pa.Table) -> pa.Table:
        found = np.zeros(size, bool)
        found[np.asarray(table.column("slot")) % size] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(found, bitorder="little").tobytes()])})

    made = slots.select(F.expr(f"cast(slot div {size} as int)").alias("part"), "slot").groupBy("part").applyInArrow(part, "part int, bits binary")
    return Bitmap(bits, [(r.part, r.bits) for r in made.collect()])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    for batch in in_order(batches):
        langs = batch.column(0).to_pylist()
        yield Words(batch.column(1), langs), langs


def _mining(lengths: tuple[int, ...], parts, shard_bits: int):
    """Counts of the phrases of these lengths whose parts (of length `parts[0]`) are in a bitmap, as (key, c); a key is hash and shard."""

    def counted(held: list[np.ndarray], shard: int) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held)
        held.clear()
        x.sort()
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        counts, x = np.diff(first, append=len(x)), x[first]
        del first
        for at in range(0, len(x), _ROWS):
            keys = (x[at : at + _ROWS] << U64(shard_bits)) | U64(shard)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts[at : at + _ROWS].astype(np.int64))], ["key", "c"])
        del x, counts
        trimmed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard = [], 0, None

        def noted():
            nonlocal shard
            for batch in batches:
                if shard is None and batch.num_rows:
                    shard = batch.column(2)[0].as_py()
                yield batch

        for words, _ in _chunks(noted()):
            known = None
            if parts:
                of, bitmap = parts[0], parts[1].value
                x, inside = words.phrases(of)
                known = inside & bitmap.has(x)
            for n in lengths:
                x, inside = words.phrases(n)
                if parts and len(x):
                    for k in range(n - parts[0] + 1):
                        inside = inside & known[k : k + len(x)]
                held.append(x[inside] >> U64(64 - _KEY))
                size += len(held[-1])
            if size >= _HOLD:
                yield from counted(held, shard)
                size = 0
        if size:
            yield from counted(held, shard)

    return run


def _exact(lengths: dict[int, object]):
    """Counts of all phrases in the bitmaps, as (lang, phrase, c), and of all words, as (lang, null, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(words: Words):
            total: dict[str, int] = {}
            for k, n in zip(*np.unique(words.text, return_counts=True)):
                total[words.langs[k]] = total.get(words.langs[k], 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "phrase", "c"])
            for n, bitmap in lengths.items():
                x, inside = words.phrases(n)
                at = np.flatnonzero(inside)
                at = at[bitmap.value.has(x[at])]
                if not len(at):
                    continue
                _, first, counts = np.unique(x[at], return_index=True, return_counts=True)
                at = at[first]
                del x, first
                for a in range(0, len(at), _ROWS):
                    some = at[a : a + _ROWS]
                    spans = (some[:, None] + np.arange(n)).ravel()
                    phrases = joined_words(words.data, words.starts[spans], words.ends[spans], np.full(len(some), n))
                    names = pa.array(words.langs, pa.string()).take(pa.array(words.text[some]))
                    yield pa.RecordBatch.from_arrays([names, phrases, pa.array(counts[a : a + _ROWS].astype(np.int64))], ["lang", "phrase", "c"])

        held, size = [], 0
        for words, _ in _chunks(batches):
            held.append(words)
            size += len(words.data)
            if size >= _TEXT:
                merged, held, size = Words.merged(held), [], 0
                yield from counted(merged)
                del merged
                trimmed()
        if held:
            yield from counted(Words.merged(held))

    return run


def phrase_counts(docs: DataFrame, support: int = 30, bits: int = 27) -> DataFrame:
    """(lang, phrase, f): exact counts of all phrases of one to LONGEST words with at least `support` occurrences; phrase null: all words."""
    spark, shard_bits = docs.sparkSession, (SHARDS - 1).bit_length()
    local = -(-support // SHARDS)
    rows = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.col("text").alias("text"), F.pmod(F.spark_partition_id(), F.lit(SHARDS)).alias("shard"))

    def mined(lengths, parts):
        found = rows.mapInArrow(_mining(lengths, parts, shard_bits), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter(f"c >= {local}")
        slots, path = stored(found.select(F.shiftrightunsigned("key", shard_bits + _KEY - bits).alias("slot")).distinct(), "frequent")
        bitmap = spark.sparkContext.broadcast(_bitmap(slots, bits))
        discard(spark, path)
        return bitmap

    words = mined((1,), None)
    pairs = mined((2,), (1, words))
    longer = mined(tuple(range(3, LONGEST + 1)), (2, pairs))
    passing = {1: words, 2: pairs} | {n: longer for n in range(3, LONGEST + 1)}
    return rows.select("lang", "text").mapInArrow(_exact(passing), "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("f")).filter(f"f >= {support} or phrase is null")


def collocations(docs: DataFrame, support: int = 30, top: int = 2000, inside: int = 80, bits: int = 27) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two to LONGEST words, by the worst of their cuts.

    A null lang is `und`, a null or empty text has no words; ties go to the lowest cut, then to the phrase least in UTF-8 bytes; repeated rows
    count as often as they stand; an empty table, or one without frequent phrases, gives no rows; other columns aren't read.
    """
    counted, _ = stored(phrase_counts(docs, support, bits), "phrases")
    known = counted.filter("phrase is not null")
    found = known.filter("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    longer = found.filter("size(words) > 2").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), k -> array_join(slice(words, k, m), ' '))))")).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    left = found.join(around, ["lang", "phrase"], "left").filter(f"longest is null or 100 * longest < {inside} * a")
    cuts = left.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("front"), F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("back"))
    scored = cuts.join(known.select("lang", F.col("phrase").alias("front"), F.col("f").alias("l")), ["lang", "front"]).join(known.select("lang", F.col("phrase").alias("back"), F.col("f").alias("r")), ["lang", "back"])
    scored = scored.withColumn("score", F.expr(SCORE.format(a="a", parts="l + r")))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = worst.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).filter(f"rank <= {top}")
    total = counted.filter("phrase is null").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
