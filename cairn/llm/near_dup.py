"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

The sketch follows Dahlgaard, Knudsen and Thorup (2017): in round i < t every element goes to a hashed bin with value
i + fraction, in round t + j every element goes to bin j; a bin keeps its least value and the rounds end as soon as all bins
are filled. So each of the t coordinates is always filled, and the share of equal coordinates concentrates about the Jaccard
similarity as fully random sampling without replacement would.

Documents with equal shingle sets are one class first. Per band, each class is paired with the centre of its bucket, the class that
meets most others in all its buckets: of an original and its copies that is the original, which each copy is nearest to. Then
each class verifies its most frequent such partner, components are formed, and only pairs that still lie in different
components go on: first the other partners, then every pair inside buckets that still mix components whose sketches agree
in at least `estimate` of the coordinates. A bucket whose members all have one component costs one row, however many
near copies it holds, and no pair is ever capped. Pairs whose set sizes alone rule out the threshold stop before any text moves.

What is shuffled: keys and ids, buckets (a hash with the band's number in its six low bits), the sketches of members of mixed
buckets, and the texts of pairs to verify. A sketch keeps eight bits a coordinate, of which the buckets are made as well. Only joins
that would move sketches or texts broadcast their other side, behind a count; tables of a few numbers a row are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import MIX_A, U64, components, discard, distinct, grams, in_order, mixed, released, small, stored, word_hashes

BANDS, ROWS, BITS, BLOCK = 42, 6, 9, 4096
ESTIMATE = 0.71  # over five standard deviations below 0.8 for 512 coordinates; star pairs are verified whatever they agree in


_ROUNDS = mixed(np.arange(1, 1025, dtype=U64) * MIX_A) | U64(1)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    h, at = word_hashes(column)
    return [distinct(grams(h[a:b], size)) for a, b in zip(at[:-1], at[1:], strict=True)]


def sketch(x: np.ndarray, bits: int) -> np.ndarray:
    """The 2 ** bits coordinates of a set that isn't empty: hashed values with the round in the high bits."""
    t = 1 << bits
    out = np.full(t, np.iinfo(np.uint64).max, dtype=U64)
    for i in range(2 * t):
        h = x * _ROUNDS[i]
        if i < t:
            np.minimum.at(out, (h >> U64(64 - bits)).view(np.int64), ((h << U64(bits)) >> U64(10)) | U64(i << 54))
        else:
            out[i - t] = min(out[i - t], (h >> U64(10)).min() | U64(i << 54))
        if int(out.max()) >> 54 < 1023:
            break
    return out


def sketched(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id (of the row), doc_id, h (hash of the text), n_shingles, key (of the set) and low (the sketch's coordinates, eight bits each)."""

    def run(batches):
        bits = max(BITS, (bands * rows - 1).bit_length())
        for batch in in_order(batches):
            n, key, low = [], [], []
            for x in shingle_sets(batch.column(1), size):
                n.append(len(x))
                key.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                low.append(mixed(sketch(x, bits)).astype(np.uint8).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "h", "n_shingles", "key", "low"])

    made = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, n_shingles long, key binary, low binary")
    return made.withColumn("id", F.monotonically_increasing_id())


def buckets_of(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each sketch a hash of each band's coordinates, with the band in its six low bits."""
    part = np.zeros((len(low), bands, -(-rows // 8) * 8), np.uint8)
    part[:, :, :rows] = low[:, : bands * rows].reshape(len(low), bands, rows)
    words, out = part.view(U64), np.zeros((len(low), bands), U64)
    for k in range(words.shape[2]):
        out = mixed(out + words[:, :, k] + U64(1))
    return (out & ~U64(63)) | np.arange(bands, dtype=U64)


def bucketed(rows_: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, bucket) for every band of the sketches (id, low)."""

    def run(batches):
        for batch in in_order(batches, 1 << 20):
            low = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(buckets_of(low, bands, rows).view(np.int64).ravel())], names=["id", "bucket"])

    return rows_.select("id", "low").mapInArrow(run, "id long, bucket long")


def alike(a: str, b: str, threshold: int):
    """Whether sets of sizes a and b can reach the threshold."""
    return F.expr(f"100 * least({a}, {b}) >= {threshold} * greatest({a}, {b})")


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The stored pairs (u, v) whose full shingle sets have 100 * intersection >= threshold * union; texts has one text a class (id)."""

    def run(batches):
        last, kept = None, None
        for batch in in_order(batches):
            us, vs, good, bs = batch.column("u").to_pylist(), batch.column("v").to_pylist(), [], batch.column("b")
            for i, x in enumerate(shingle_sets(batch.column("a"), size)):
                if vs[i] != last:
                    last, kept = vs[i], shingle_sets(bs.slice(i, 1), size)[0]
                both = len(np.intersect1d(x, kept, assume_unique=True))
                if 100 * both >= threshold * (len(x) + len(kept) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([us[i] for i in good], pa.int64()), pa.array([vs[i] for i in good], pa.int64())], names=["u", "v"])

    left = texts.select(F.col("id").alias("u"), F.col("text").alias("a")).join(small(pairs.select("u", "v")), "u")
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("b")).join(small(pairs.select("v").distinct()), "v", "left_semi")
    return left.join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def mixed_pairs(members: DataFrame, estimate: float, threshold: int = 80, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """Pairs of different components in one bucket whose sketches agree in `estimate` of the coordinates.

    Members (bucket, id, comp, low, n_shingles). A pair is given by the bucket of the first band that its documents share, so
    once in all. Members may carry the size n of their bucket: one of more than `block` is cut into blocks by hash and compared
    block against block, so no group is larger than about two blocks. A member is copied once for each block of its bucket: rows grow
    with the square of a bucket's members over `block`, where it still mixes components after the stars' links.
    """
    blocks = F.ceil((F.col("n") if "n" in members.columns else F.lit(1)) / block).cast("int")
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("n", "other")

    def run(group: pa.Table) -> pa.Table:
        ids, comp, own, n = (group.column(c).to_numpy() for c in ("id", "comp", "own", "n_shingles"))
        apart = group.column("a")[0].as_py() != group.column("b")[0].as_py()
        low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(len(ids), -1)
        band = group.column("bucket")[0].as_py() & 63
        us, vs = [], []
        for i in range(len(ids) - 1):
            sizes = 100 * np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i])
            other = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & ((own[i + 1 :] != own[i]) | (not apart)) & sizes)
            if len(other):
                same = low[other] == low[i]
                first = same[:, : bands * rows].reshape(len(other), bands, rows).all(axis=2).argmax(axis=1)
                other = other[(same.mean(axis=1) >= estimate) & (first == band)]
                us.append(np.maximum(ids[other], ids[i])), vs.append(np.minimum(ids[other], ids[i]))
        join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.table([join(us), join(vs)], names=["u", "v"])

    return members.groupBy("bucket", "a", "b").applyInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, size: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, estimate: float = ESTIMATE
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text, ...).

    A null or blank text has no shingles and is linked with nothing. A null doc_id takes part in no link and keeps a null
    component_id and kept = true. Rows that repeat a doc_id are one document, whose texts are compared each and linked with each
    other. Inside, a class goes by the row of its least doc_id; rows become doc_ids at the end. Very long texts are compared whole.
    Columns other than doc_id and text are ignored. An empty table gives an empty result. There are 64 bands at most.
    """
    if bands > 64:
        raise ValueError("64 bands at most")
    spark, paths = docs.sparkSession, []

    def keep(df: DataFrame, label: str) -> DataFrame:
        out, path = stored(df, label)
        paths.append(path)
        return out

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows_ = keep(sketched(docs, size, bands, rows), "sketches")
    known = rows_.filter("doc_id is not null and key is not null")
    each = known.groupBy("key", "doc_id", "h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles"))
    classes = keep(each.groupBy("key").agg(F.min(F.struct("doc_id", "h", "id", "copies", "n_shingles")).alias("c")).select("key", "c.*"), "classes")
    buckets = bucketed(rows_.select("id", "low").join(small(classes.select("id")), "id", "left_semi"), bands, rows)
    crowded = keep(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "crowded")
    places = keep(buckets.join(small(crowded), "bucket"), "places")  # only buckets that classes share go on
    degree = places.groupBy("id").agg(F.sum("n").alias("degree"))
    centre = places.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("c"))
    shared = keep(places.drop("n").join(centre.select("bucket", (-F.col("c.minus")).alias("v")), "bucket"), "shared")
    sizes = classes.select("id", "n_shingles")

    def sized(pairs: DataFrame) -> DataFrame:
        for end in "uv":
            pairs = pairs.join(sizes.withColumnsRenamed({"id": end, "n_shingles": f"n{end}"}), end)
        return pairs.filter(alike("nu", "nv", threshold)).drop("nu", "nv")

    released(spark)
    stars = keep(sized(shared.filter("id <> v").groupBy(F.col("id").alias("u"), "v").agg(F.count("*").alias("votes"))), "stars")
    some = keep(classes.select("id", "doc_id", "h", "copies").join(shared.select("id").distinct(), "id", "left_semi"), "members")
    met = docs.withColumn("h", F.xxhash64("text")).join(small(some), ["doc_id", "h"]).select("id", "copies", "text")
    texts = keep(met.filter("copies = 1").select("id", "text").unionAll(met.filter("copies > 1").groupBy("id").agg(F.min("text").alias("text"))), "texts")
    best = keep(stars.groupBy("u").agg(F.max_by("v", F.struct("votes", -F.col("v"))).alias("v")), "best")
    several = known.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("doc_id")
    several = keep(known.select("doc_id", "key").join(several, "doc_id").distinct().join(classes.select("key", "id"), "key").select("doc_id", "id"), "several-classes")
    same = several.join(several.groupBy("doc_id").agg(F.min("id").alias("v")), "doc_id").filter("id <> v").select(F.col("id").alias("u"), "v")
    labels, at = components(keep(verified(best, texts, size, threshold).unionAll(same), "links"))

    def across(pairs: DataFrame) -> DataFrame:
        for end in "uv":
            pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        return pairs.filter("cu <> cv").select("u", "v")

    def more(pairs: DataFrame, label: str) -> None:
        """Verifies pairs and joins the components that they link, as one node each."""
        nonlocal labels, at
        paths.append(at)
        found = keep(verified(keep(pairs, f"{label}-pairs"), texts, size, threshold), label)
        for end in "uv":
            found = found.join(labels.select(F.col("node").alias(end), "comp"), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
        over, over_at = components(keep(found.filter("u <> v").distinct(), f"{label}-over"))
        paths.append(over_at)
        moved = labels.join(over.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels, at = stored(moved.unionAll(over.join(labels, "node", "left_anti").select("node", "comp")), "labels")
        released(spark)

    more(across(stars.join(best.select("u", "v"), ["u", "v"], "left_anti")), "stars-left")
    placed = shared.select("id", "bucket").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_ = keep(placed.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).filter("a < b").select("bucket", "n"), "open")
    sketches = rows_.select("id", "low", "n_shingles")
    members = keep(placed.join(open_, "bucket"), "open-members")
    needed = keep(members.select("id").distinct(), "open-ids")
    members = members.join(sketches.join(small(needed), "id", "left_semi"), "id")
    tried = stars.select("u", "v")
    more(mixed_pairs(members, estimate, threshold, rows, bands).join(tried, ["u", "v"], "left_anti"), "cross")

    named = labels.join(classes.select(F.col("id").alias("node"), "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("c"))
    ends = classes.select("key", "doc_id", F.col("id").alias("node")).join(labels.join(named, "comp").select("node", "c"), "node", "left").select("key", F.coalesce("c", "doc_id").alias("c"))
    own = rows_.select("doc_id", "n_shingles", "key").join(ends, "key", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    final, _ = stored(own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "near-dup")
    discard(spark, at, *paths)
    released(spark)
    return final
