"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased terms, hashed; beside its bias and linear weights the model holds a short vector for
each term, and the dot products of pairs score what only occurs together. It is fitted on a bounded sample of labelled documents
(the least by hash), by Adagrad on the log loss, with the hashed terms whose document rates differ most between the classes and
those of pairs that interact: whose joint rate isn't what the two terms' own rates add up to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import U64, distinct, in_order, remainder5, word_hashes


@dataclass(frozen=True)
class Machine:
    """index: a feature for each hash bucket, or -1. score = sigmoid(bias + sum w + sum of pairs v.v)."""

    bits: int
    index: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(row, weights=self.w[feature], minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f]
            z += (np.bincount(row, weights=x, minlength=n) ** 2 - np.bincount(row, weights=x * x, minlength=n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def terms(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of each text's terms, as two arrays."""
    h, at = word_hashes(column, terms=True)
    row = np.repeat(np.arange(len(column), dtype=U64), np.diff(at))
    both = distinct((row << U64(bits)) | (h >> U64(64 - bits)))
    return (both >> U64(bits)).astype(np.int64), (both & U64((1 << bits) - 1)).astype(np.int64)


def interacting(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, common: np.ndarray, least: int, z: float) -> np.ndarray:
    """The buckets among `common` that are in a pair (a, b) with |p11 - p10 - p01 + p00| over z standard errors, strongest first;
    p11 is the rate of label 1 where both occur, p10 where only a does, and so on. Each of the four cases needs `least` documents."""
    at = np.full(int(bucket.max()) + 1 if len(bucket) else 1, -1, np.int64)
    at[common] = np.arange(len(common))
    mine = at[bucket] >= 0
    x = np.zeros((len(y), len(common)), np.float32)
    x[row[mine], at[bucket[mine]]] = 1
    toxic = x[y > 0]
    n11, t11 = x.T @ x, toxic.T @ toxic
    n1, t1, n, t = x.sum(axis=0), toxic.sum(axis=0), len(y), y.sum()
    counts = n11, n1[:, None] - n11, n1[None] - n11, n - n1[:, None] - n1[None] + n11
    ones = t11, t1[:, None] - t11, t1[None] - t11, t - t1[:, None] - t1[None] + t11
    rate = [(b + 0.5) / (c + 1) for b, c in zip(ones, counts, strict=True)]
    error = np.sqrt(sum(p * (1 - p) / np.maximum(c, 1) for p, c in zip(rate, counts, strict=True)))
    score = np.abs(rate[0] - rate[1] - rate[2] + rate[3]) / error
    score[np.minimum.reduce(counts) < least] = 0
    np.fill_diagonal(score, 0)
    best = score.max(axis=1) if len(common) else np.empty(0)
    order = np.argsort(-best, kind="stable")
    return common[order[best[order] > z]]


def fit(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, bits: int = 18, features: int = 1024, factors: int = 4, epochs: int = 20, rate: float = 0.1, l2: float = 1e-4, least: int = 3, batch: int = 64, seed: int = 7, pairs: int = 512, pair_features: int = 128, pair_z: float = 6.0) -> Machine:
    """The machine for documents given as sorted rows of buckets and their 0/1 labels. Interactions are sought among the `pairs` most
    common terms that the class rates didn't choose, and the chosen ones before them; `pair_features` terms at most are added."""
    n, index = len(y), np.full(1 << bits, -1, np.int32)
    share = float(y.mean()) if n else 0.0
    if not 0 < share < 1:
        return Machine(bits, index, 30.0 if share else -30.0, np.zeros(1), np.zeros((1, factors)))
    ones, all_ = np.bincount(bucket, weights=y[row], minlength=1 << bits), np.bincount(bucket, minlength=1 << bits)
    p1, p0 = ones / y.sum(), (all_ - ones) / (n - y.sum())
    p = all_ / n
    z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (n - y.sum())) + 1e-12)
    z[(all_ < least) | (all_ == n)] = 0
    chosen = np.argsort(-z, kind="stable")[:features]
    chosen = chosen[z[chosen] > 3]
    often = np.where((all_ >= 10 * least) & (all_ <= n - 10 * least), np.minimum(all_, n - all_), 0)
    often = np.argsort(-often, kind="stable")[: min(pairs, int((often > 0).sum()))]
    added = interacting(row, bucket, y, often, 5 * least, pair_z)
    chosen = np.concatenate([chosen, added[~np.isin(added, chosen)][:pair_features]])
    index[chosen] = np.arange(len(chosen))
    feature = index[bucket].astype(np.int64)
    row, feature = row[feature >= 0], feature[feature >= 0]
    at = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    m = len(chosen) + 1
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.02, (m, factors))
    gb, gw, gv = 1e-8, np.full(m, 1e-8), np.full((m, factors), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            docs = order[k : k + batch]
            local = np.repeat(np.arange(len(docs)), at[docs + 1] - at[docs])
            f = np.concatenate([feature[at[d] : at[d + 1]] for d in docs])
            sums = np.zeros((len(docs), factors))
            np.add.at(sums, local, v[f])
            squares = np.zeros((len(docs), factors))
            np.add.at(squares, local, v[f] ** 2)
            score = bias + np.bincount(local, weights=w[f], minlength=len(docs)) + ((sums**2 - squares) / 2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[docs]) / len(docs)
            dw, dv = np.zeros(m), np.zeros((m, factors))
            np.add.at(dw, f, g[local])
            np.add.at(dv, f, g[local, None] * (sums[local] - v[f]))
            dw, dv, db = dw + l2 * w, dv + l2 * v, g.sum()
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            bias, w, v = bias - rate * db / np.sqrt(gb), w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv)
    return Machine(bits, index, bias, w, v)


def learned(docs: DataFrame, labels: DataFrame, sample: int = 30_000, bits: int = 18, **how) -> Machine:
    """A machine from at most `sample` labelled documents whose crc32(doc_id) mod 5 isn't 0; the driver holds that sample only.

    Several labels of one document count as their largest, of several texts the one whose hashed terms come first as bytes (an empty one before
    all); null labels don't.
    """
    y = labels.filter("doc_id is not null and toxic is not null").filter(remainder5() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(remainder5() != 0)
    some = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in in_order(batches):
            row, bucket = terms(batch.column(2), bits)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "buckets"])

    each = known.join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, buckets binary")
    one = each.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("buckets").alias("buckets"))  # of texts no more than this moves
    rows = sorted((r.doc_id, bytes(r.buckets), r.toxic) for r in one.toLocalIterator())
    buckets = [np.frombuffer(b, "<i4") for _, b, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in buckets])
    return fit(row, np.concatenate(buckets).astype(np.int64) if buckets else np.empty(0, np.int64), np.array([t for *_, t in rows], float), bits, **how)


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text, ...), learned from labels (doc_id, toxic, ...).

    Null and empty texts have no term and score the bias alone. Without labels, or with one class only, every score is that
    class (0 without labels). Repeated rows score alike; a null doc_id counts as the empty text in the fold. Very long texts are scored
    whole, an empty table gives no rows, other columns are ignored. Only texts are inputs of a score.
    """
    machine = learned(docs, labels, **how)

    def run(batches):
        for batch in in_order(batches):
            row, bucket = terms(batch.column(2), machine.bits)
            feature = machine.index[bucket].astype(np.int64)
            score = machine.scores(row[feature >= 0], feature[feature >= 0], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder5() == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the machine doesn't reject, with their own columns."""
    machine = learned(docs, labels, **how)
    at = docs.columns.index("text")

    def run(batches):
        for batch in in_order(batches):
            row, bucket = terms(batch.column(at), machine.bits)
            feature = machine.index[bucket].astype(np.int64)
            yield batch.filter(pa.array(machine.scores(row[feature >= 0], feature[feature >= 0], batch.num_rows) < 0.5))

    return docs.mapInArrow(run, docs.schema)
