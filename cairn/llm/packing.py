"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` ids; whole pieces are sequences already, the others are dealt by hash into
groups of bounded size. Each group is packed on several islands: individuals start as best-fit packings of perturbed
descending orders; a crossover injects well-filled bins of one parent into the other, removes the bins that hold duplicates
of their items and a few of the emptiest ones, lets displaced items take the place of smaller ones where they fill a bin better,
and best-fits the rest; after each epoch every island's elite moves to the next island. A group stops at once when it meets the
lower bound ceil(ids / capacity), and small groups get more generations than large ones. Groups cost less than one sequence
each against a packing of everything at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import in_order, stored
from .encoding import encoder

CAPACITY, GROUP, ISLANDS, EPOCHS, POPULATION, EFFORT = 2048, 8192, 3, 2, 4, 1 << 16  # EFFORT: items times generations
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each encoded document; the first piece takes what whole pieces leave."""

    def run(batches):
        codec, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in in_order(batches, 1 << 22):
            out = []
            for k, x in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1)), strict=True):
                x = x + end
                n = len(x) // 4
                cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                out += [(k, i, a, b - a, zlib.crc32(x[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE)


def best_fit(lengths: list[int], items: list[int], free: list[int], out: np.ndarray, capacity: int) -> list[int]:
    """Puts items, in the given order, each into the bin with the least room that suffices; out gets the bins."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, room in enumerate(free):
        if room:
            by_room.setdefault(room, []).append(b)
            mask |= 1 << room
    for i in items:
        n = lengths[i]
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(0)
        out[i], free[b] = b, room - n
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)
    return free


def fresh(sizes: np.ndarray, rng: np.random.Generator, noise: float, capacity: int) -> np.ndarray:
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(-(sizes + noise * rng.random(len(sizes))), kind="stable")
    best_fit(sizes.tolist(), order.tolist(), [], out, capacity)
    return out


def exchanged(out: np.ndarray, gone: np.ndarray, sizes: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Each displaced item takes the place of the smallest item that makes room for it, if any; returns what is displaced then."""
    inside = np.flatnonzero(out >= 0)
    for k, item in enumerate(gone.tolist()):
        more = sizes[item] - sizes[inside]
        fits = np.flatnonzero((more > 0) & (more <= free[out[inside]]))
        if len(fits):
            at = fits[np.argmax(more[fits])]
            old = inside[at]
            out[item], out[old] = out[old], -1
            free[out[item]] -= more[at]
            inside[at], gone[k] = item, old
    return gone


def crossed(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, capacity: int, most: int = 16) -> np.ndarray:
    """A child of a: some of b's best-filled bins, `most` at most, go in whole."""
    fill, own = np.bincount(b, weights=sizes), np.bincount(a, weights=sizes)
    best = np.argsort(-(fill + capacity * 0.02 * rng.random(len(fill))))[: max(1, len(fill) // 2)]
    inside = np.isin(b, rng.permutation(best)[:most])
    hit = np.zeros(len(own), bool)
    hit[a[inside]] = True
    hit[np.argsort(own + capacity * 0.2 * rng.random(len(own)))[:2]] = True
    displaced = np.flatnonzero(hit[a] & ~inside)
    stay = ~hit[a] & ~inside
    old, kept = np.unique(a[stay], return_inverse=True)
    new, put = np.unique(b[inside], return_inverse=True)
    out = np.full(len(a), -1, np.int64)
    out[stay], out[inside] = kept, put + len(old)
    free = capacity - np.bincount(out[out >= 0], weights=sizes[out >= 0], minlength=len(old) + len(new)).astype(np.int64)
    displaced = exchanged(out, displaced[np.argsort(-sizes[displaced], kind="stable")], sizes, free)
    best_fit(sizes.tolist(), displaced[np.argsort(-sizes[displaced], kind="stable")].tolist(), free.tolist(), out, capacity)
    return out


def fitness(x: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(x, weights=sizes) / capacity
    return -len(fill), float((fill**2).mean())


def evolved(sizes: np.ndarray, start: list[np.ndarray], seed: int, capacity: int, population: int, effort: int) -> np.ndarray:
    """The best packing of one island after its generations, from the given individuals or from best fit by descending size."""
    rng = np.random.default_rng(seed)
    bound = -int(-(-sizes.sum() // capacity))
    key = lambda x: fitness(x, sizes, capacity)
    pool = start or [fresh(sizes, rng, 0, capacity)]
    if key(max(pool, key=key))[0] == bound:
        return max(pool, key=key)
    pool = pool + [fresh(sizes, rng, capacity * 0.05 * (i + 1), capacity) for i in range(population - len(pool))]
    pool.sort(key=key, reverse=True)
    for _ in range(max(8, effort // len(sizes))):
        if key(pool[0])[0] == bound:
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        pool = sorted([*pool, crossed(pool[a], pool[b], sizes, rng, capacity)], key=key, reverse=True)[:population]
    return pool[0]


def packed(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, effort: int = EFFORT) -> DataFrame:
    """sequence_id and offset for rows of (doc_id, piece, start, length, ids_crc32) that no later read changes."""
    small = parts.filter(F.col("length") < capacity)
    n = small.count()
    groups = max(1, -(-n // group))
    small = small.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    lengths = small.groupBy("g", "length").agg(F.count("*").alias("n")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("length", "n")), asc=False).alias("h"))
    world = lengths.select("g", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("h.length").alias("length"), F.col("h.n").alias("n"), F.lit(None).cast("binary").alias("elite"))

    def epoch(number: int):
        def run(table: pa.Table) -> pa.Table:
            g, island = table.column("g")[0].as_py(), table.column("island")[0].as_py()
            lengths, counts = (table.column(c)[0].values.to_numpy() for c in ("length", "n"))
            sizes = np.repeat(lengths, counts)
            start = [np.frombuffer(x, np.int32).astype(np.int64) for x in sorted(x for x in table.column("elite").to_pylist() if x)]
            best = evolved(sizes, start, (number * 7919 + g) * 1000 + island, capacity, population, effort)
            row = (g, island, lengths.tolist(), counts.tolist(), best.astype(np.int32).tobytes(), int(best.max()) + 1)
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32())
            return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[*names, "bins"])

        return run

    names = ["g", "island", "length", "n", "elite"]
    tasks = min(groups * islands, 10_000)  # given, so that small rows don't end up in one task
    for e in range(epochs):
        if e:
            world = world.select(*names, F.explode(F.array(F.lit(0), F.lit(1))).alias("step")).withColumn("island", (F.col("island") + F.col("step")) % islands).select(*names)
        world, _ = stored(world.repartition(tasks, "g", "island").groupBy("g", "island").applyInArrow(epoch(e), "g long, island int, length array<long>, n array<long>, elite binary, bins int"), f"islands-{e}")
    best = world.groupBy("g").agg(F.min_by("elite", F.struct("bins", "island")).alias("elite"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins = np.frombuffer(right.column("elite")[0].as_py(), np.int32).astype(np.int64)
        size = left.column("length").to_numpy()
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(size[order])
        first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
        base = (ends - size[order])[first]
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - size[order] - base[np.cumsum(first) - 1]
        out = left.append_column("sequence_id", pa.array(left.column("g").to_numpy() * (1 << 20) + bins, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return out.drop_columns(["g"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = small.select("g", *columns).groupBy("g").cogroup(best.groupBy("g")).applyInArrow(place, f"{_PIECE}, sequence_id long, offset long")
    whole = parts.filter(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionAll(whole)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text, ...).

    Null and empty texts are one piece of the end id; very long ones are cut into pieces. Repeated rows are packed each; a null
    doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    parts, _ = stored(pieces(docs, path, capacity, end_id), "pieces")
    return packed(parts, capacity, **how)
