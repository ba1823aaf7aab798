"""Vectors by inverted lists: coarse centroids, a list of vectors for each, and exact similarities inside the lists that are probed.

Centroids are fitted on a bounded sample; every vector is listed. Probing all lists is the exact search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20_000  # vectors that centroids are fitted on
BLOCK = 20_000  # vectors of a list that one task holds


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles, of length one; zero vectors stay zero."""
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """At most `lists` unit vectors by k-means on `sample` vectors, those with the least hashes of their ids, so a sample is the same each time."""
    some = vectors.select("id", "vector").filter("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    x = _matrix(some.column("vector"))
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(0)
    at = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))]
    for _ in range(rounds):
        near = (x @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        at = np.where(size > 0, sums / np.where(size > 0, size, 1), at)  # an empty list keeps its centroid
    return at


def listed(vectors: DataFrame, at: np.ndarray, probes: int = 1) -> DataFrame:
    """(id, vector, list): each vector in the lists of its `probes` nearest centroids."""
    given = vectors.sparkSession.sparkContext.broadcast(at)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _matrix(batch.column(1)) @ given.value.T
            n = min(probes, near.shape[1])
            best = np.argsort(-near, axis=1, kind="stable")[:, :n]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(best.ravel().astype(np.int32))], ["id", "vector", "list"])

    return vectors.select("id", "vector").filter("vector is not null").mapInArrow(run, f"id {kind}, vector {vectors.schema['vector'].dataType.simpleString()}, list int")


def nearest(index: DataFrame, queries: DataFrame, at: np.ndarray, k: int, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query, id, near): for each query (id, vector) the k vectors of the probed lists with the greatest cosine; ties go to the greater id.

    All lists with probes=None. A list of more than `block` vectors is split, and its queries go to each part, so no task holds a whole
    one; each part gives its own k best.
    """
    kind = index.schema["id"].dataType.simpleString()
    parts = index.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("parts"))  # a row a list
    own = index.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    again = parts.select(*[F.col(c).alias(c) for c in parts.columns])
    asked = listed(queries, at, probes or max(1, len(at))).join(F.broadcast(again), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, q = mine.column("id").combine_chunks(), theirs.column("id").combine_chunks()
        out: list[tuple] = []
        if len(ids) and len(q):
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")[::-1].copy()
            ids, x, y = ids.take(pa.array(order)), _matrix(mine.column("vector"))[order], _matrix(theirs.column("vector"))
            for begun in range(0, len(y), 256):
                near = y[begun : begun + 256] @ x.T
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(begun, begun + len(near)), top.shape[1])
                out.append((q.take(pa.array(rows)), ids.take(pa.array(top.ravel())), pa.array(np.take_along_axis(near, top, 1).ravel())))
        columns = [pa.concat_arrays([o[c] for o in out]) for c in range(3)] if out else [q.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())]
        return pa.table(dict(zip(("query", "id", "near"), columns)))

    met = own.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(best, f"query {queries.schema['id'].dataType.simpleString()}, id {kind}, near double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), F.desc("id"))))
    return ranked.filter(F.col("rank") <= k).select("query", "rank", "id", "near")
