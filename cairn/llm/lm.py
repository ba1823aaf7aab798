"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform share.

p(w | h) = a * c(h w) / c(h) + b * c(w) / N + c * 1 / (V + 1), with weights (a, b, c) for each bucket of c(h), the power of
two that it reaches. The weights come from expectation-maximisation on a fifth of the training documents against counts of the
rest; the final counts are of all training documents. Unknown words share the class that V + 1 leaves for them, so the
probabilities after any context sum to one.

Shape: texts are read in chunks of bounded size. A chunk sends its distinct word and bigram hashes with their counts, cut by
ranges of the hash, as a few binary rows; each range sums all chunks' counts and answers every chunk with the totals of its own
keys; a chunk joins the answers with its own words. Rows that cross the network are blobs, so neither a frequent word nor a
bigram is a hot key, and what is held in one place is one range or one chunk. EM sees the held-out counts as a histogram of
(context bucket, log ratio, log count), whose size is bounded by the bins.

The number of ranges follows the bytes of text, so that a range's counts fit in memory whatever the input; the number of rows
that cross the network is then chunks times ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import U64, discard, in_order, mixed, planes, stored, trimmed, unplanes, word_hashes

CHUNK = 1 << 18  # tokens
RANGE_BYTES = 8 << 20  # of text, whose counts one range sums
END = U64(0x5BD1E995A4F1C3D7)  # stands for the end of a text, and as the context of its first word
FINE = 8  # bins an octave
BUCKETS = 32


def _chunks(batches, tokens: int):
    """(chunk id, doc ids, fold, token hashes, starts) for runs of whole documents of about `tokens` tokens.

    The id holds the number of the scan's partition, a column, since a task of a union counts the other side's partitions too.
    """
    made = 0
    ids, fold, h, n = [], [], [], [0]

    def whole():
        nonlocal made
        made += 1
        return (part << 24) + made - 1, ids, np.array(fold, np.int8), np.concatenate(h), np.cumsum(n)

    for batch in in_order(batches, 1 << 20):
        part = batch.column(3)[0].as_py()
        words, at = word_hashes(batch.column(2))
        size = np.diff(at)
        full = np.insert(words, at[1:], END)
        ids += batch.column(0).to_pylist()
        fold += batch.column(1).to_pylist()
        h.append(full)
        n += (size + 1).tolist()
        if sum(map(len, h)) >= tokens:
            yield whole()
            ids, fold, h, n = [], [], [], [0]
            trimmed()
    if ids:
        yield whole()


def _keys(h: np.ndarray, starts: np.ndarray):
    """Distinct token hashes with each token's place among them; distinct bigram hashes with theirs."""
    words, word = np.unique(h, return_inverse=True)
    before = np.empty(len(word), np.int64)
    before[1:] = word[:-1]
    before[starts[:-1]] = np.searchsorted(words, END)
    pair, bigram = np.unique(before * len(words) + word, return_inverse=True)
    keys = mixed(words[pair // len(words)] + U64(1)) * U64(0x9E3779B97F4A7C15) + words[pair % len(words)]
    keys = mixed(keys)
    order = np.argsort(keys)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return words, word, before, keys[order], back[bigram]


def _delta(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U64(0)))


def _undelta(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, U64), dtype=U64)


_SENT = "range int, chunk long, kind int, keys binary, early binary, late binary, own binary, mark long"
_COUNTS = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("early", pa.binary()), ("late", pa.binary()), ("own", pa.binary()), ("mark", pa.int64())])


def _mark(h: np.ndarray, starts: np.ndarray, ids: list) -> int:
    """A digest of a chunk's tokens, documents and their order: both reads of a chunk must have the same."""
    return xxhash.xxh3_64_intdigest(h.tobytes() + starts.tobytes() + repr(ids).encode()) >> 1


def _sent(docs: DataFrame, ranges: int, tokens: int) -> DataFrame:
    """A chunk's distinct keys and its counts in the two training parts, for each range of hashes."""

    def run(batches):
        for chunk, ids, fold, h, starts in _chunks(batches, tokens):
            words, word, _, bigrams, bigram = _keys(h, starts)
            mark = _mark(h, starts, ids)
            fold = np.repeat(fold, np.diff(starts))
            for kind, keys, place in ((1, words, word), (2, bigrams, bigram)):
                early, late = (np.bincount(place[fold == k], minlength=len(keys)).astype(np.uint32) for k in (0, 1))
                cut = np.searchsorted(keys, np.array([(k << 64) // ranges for k in range(ranges)], U64)).tolist() + [len(keys)]
                out = [(r, chunk, kind, _delta(keys[a:b]), planes(early[a:b]), planes(late[a:b]), None, mark) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _COUNTS, strict=True)], schema=_COUNTS)

    return docs.mapInArrow(run, _SENT)


def _packed(x: np.ndarray) -> bytes:
    """Counts as byte planes, of four bytes each where they fit and eight where they don't; the first byte says which."""
    wide = len(x) and int(x.max()) >> 32
    return (b"\x08" if wide else b"\x04") + planes(x.astype(U64 if wide else np.uint32))


def _unpacked(data: bytes) -> np.ndarray:
    return unplanes(data[1:], U64 if data[0] == 8 else np.uint32).astype(np.int64)


def _totals(group: pa.Table) -> pa.Table:
    """For one range and kind: every chunk's keys with the counts of all chunks; and, as chunk -1, the tokens and distinct words."""
    keys = [_undelta(x.as_py()) for x in group.column("keys")]
    size = list(map(len, keys))
    x = np.concatenate(keys)
    del keys
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.concatenate((np.ones(1, bool), x[1:] != x[:-1]))
    del x
    back = np.empty(len(order), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    distinct, sums = int(new.sum()), []
    del order, new
    cuts = np.concatenate(([0], np.cumsum(size))).tolist()
    for name in ("early", "late"):
        total = np.zeros(distinct, np.int64)
        for a, b, counts in zip(cuts[:-1], cuts[1:], group.column(name), strict=True):
            total[back[a:b]] += unplanes(counts.as_py(), np.uint32)  # a chunk has each key once
        sums.append(total)
    kind, r = group.column("kind")[0].as_py(), group.column("range")[0].as_py()
    out = []
    for a, b, chunk, mark in zip(cuts[:-1], cuts[1:], group.column("chunk").to_pylist(), group.column("mark").to_pylist(), strict=True):
        out.append((r, chunk, kind, None, _packed(sums[0][back[a:b]]), _packed(sums[1][back[a:b]]), None, mark))
    del back
    trimmed()
    if kind == 1:
        stats = np.array([sums[0].sum(), sums[1].sum(), (sums[0] > 0).sum(), ((sums[0] + sums[1]) > 0).sum()], np.int64)
        out.append((r, -1, 0, None, None, None, stats.tobytes(), 0))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _COUNTS, strict=True)], schema=_COUNTS)


def _own(docs: DataFrame, tokens: int) -> DataFrame:
    """A chunk's documents and words, made again from the same rows rather than kept beside the keys."""

    def run(batches):
        for chunk, ids, fold, h, starts in _chunks(batches, tokens):
            words, word = np.unique(h, return_inverse=True)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _OWN) as w:
                w.write_batch(pa.record_batch([[ids], [fold.tobytes()], [np.diff(starts).astype(np.uint32).tobytes()], [_delta(words)], [planes(word.astype(np.uint32))]], schema=_OWN))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((-1, chunk, 3, None, None, None, sink.getvalue().to_pybytes(), _mark(h, starts, ids)), _COUNTS, strict=True)], schema=_COUNTS)

    return docs.mapInArrow(run, _SENT)


_OWN = pa.schema([("ids", pa.list_(pa.int64())), ("fold", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("word", pa.binary())])
_CHUNK = pa.schema([("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("fold", pa.binary()), ("sizes", pa.binary()), ("word", pa.binary()), ("counts", pa.binary()), ("pairs", pa.binary()), ("codes", pa.binary()), ("weights", pa.binary())])


def _bin(x: np.ndarray) -> np.ndarray:
    """Bins of logarithms: 0 for none, 1 and on for x from 2 ** -40."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.clip(np.rint((np.log2(x) + 40) * FINE) + 1, 1, 1023), 0).astype(np.int64)


def _octave(x: np.ndarray) -> np.ndarray:
    """Bucket of a context count: 0 for none, then by powers of two."""
    return np.minimum(np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _met(group: pa.Table) -> pa.Table:
    """One chunk: its words with all counts, for scoring; and its held-out training counts in bins, for EM."""
    kinds, ranges = group.column("kind").to_numpy(), group.column("range").to_numpy()
    if (kinds == 3).sum() != 1 or len(set(group.column("mark").to_pylist())) != 1:
        raise RuntimeError("docs gave other rows, or another order, when read again: write it as a table first")
    own = pa.ipc.open_stream(group.column("own")[int(np.flatnonzero(kinds == 3)[0])].as_py()).read_all().to_pylist()[0]

    def counts(kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(kinds == kind)
        rows = rows[np.argsort(ranges[rows])]
        return tuple(np.concatenate([_unpacked(group.column(c)[int(i)].as_py()) for i in rows]) for c in ("early", "late"))

    sizes = np.frombuffer(own["sizes"], np.uint32).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    words, word = _undelta(own["words"]), unplanes(own["word"], np.uint32).astype(np.int64)
    _, _, before, _, bigram = _keys(words[word], starts)
    (early, late), (early2, late2) = counts(1), counts(2)
    test = np.repeat(np.frombuffer(own["fold"], np.int8) == 1, sizes)
    h, w, hw = early[before[test]], early[word[test]], early2[bigram[test]]
    code = (_octave(h) << 20) | (_bin(hw / np.maximum(h, 1)) << 10) | _bin(w / 2.0**30)
    codes, weights = np.unique(code, return_counts=True)
    trimmed()
    row = (1, own["ids"], own["fold"], own["sizes"], own["word"], _packed(early + late), _packed((early2 + late2)[bigram]), codes.astype(np.int64).tobytes(), weights.astype(np.int64).tobytes())
    return pa.table([pa.array([x], f.type) for x, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)


def learned_weights(codes: np.ndarray, weights: np.ndarray, n: int, v: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each context bucket, by EM on held-out counts in bins."""
    out = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    out[0] = [0.0, 0.8, 0.2]
    if not len(codes):
        return out
    bucket, b2, b1 = codes >> 20, (codes >> 10) & 1023, codes & 1023
    value = lambda b: np.where(b > 0, 2.0 ** ((b - 1) / FINE - 40), 0.0)
    p = np.stack([np.minimum(value(b2), 1), np.minimum(value(b1) * 2.0**30 / max(n, 1), 1), np.full(len(codes), 1 / (v + 1))], axis=1)
    p[bucket == 0, 0] = 0
    prior = np.array([0.4, 0.5, 0.1]) * 3  # so that a bucket that held-out text never meets has weights too
    for _ in range(rounds):
        share = p * out[bucket]
        share *= (weights / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + prior
        new[0, 0] = 0
        out = new / new.sum(axis=1, keepdims=True)
    return out


def lm_scores(docs: DataFrame, ranges: int | None = None, tokens: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text, ...).

    Rows whose crc32(doc_id) mod 5 is 1 are held out; those of 2 estimate the weights. Null and empty texts are one end token.
    Repeated rows are scored and, in training, counted each; a null doc_id counts as the empty text in the fold. Without any
    training row every probability comes from the uniform share. Very long texts are scored whole, an empty table gives no rows and
    other columns are ignored. docs is read twice and must give the same rows in the same order, as a table does; it is an error
    if it doesn't.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(fold == 1, 2).when(fold == 2, 1).otherwise(0).cast("int").alias("fold"), "text", F.spark_partition_id().alias("part"))
    ranges = ranges or max(32, -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    answers, answers_path = stored(_sent(rows, ranges, tokens).groupBy("range", "kind").applyInArrow(_totals, _SENT), "lm-answers")
    stats = np.sum([np.frombuffer(bytes(r.own), np.int64) for r in answers.filter("chunk = -1").select("own").collect()] or [np.zeros(4, np.int64)], axis=0)
    n_early, n, v_early, v = int(stats[0]), int(stats[0] + stats[1]), int(stats[2]), int(stats[3])
    chunk_schema = "kind int, ids array<long>, fold binary, sizes binary, word binary, counts binary, pairs binary, codes binary, weights binary"
    met, met_path = stored(answers.filter("chunk >= 0").unionByName(_own(rows, tokens)).groupBy("chunk").applyInArrow(_met, chunk_schema), "lm-chunks")
    discard(spark, answers_path)

    def bins(batches):
        sums: dict[int, int] = {}
        for batch in batches:
            for c, w in zip(batch.column(0), batch.column(1), strict=True):
                for code, weight in zip(np.frombuffer(c.as_py(), np.int64).tolist(), np.frombuffer(w.as_py(), np.int64).tolist(), strict=True):
                    sums[code] = sums.get(code, 0) + weight
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], names=["code", "weight"])

    held = met.select("codes", "weights").mapInArrow(bins, "code long, weight long").groupBy("code").agg(F.sum("weight").alias("weight")).toPandas()
    mix = learned_weights(held.code.to_numpy(), held.weight.to_numpy(), n_early, v_early)

    def score(batches):
        zero = math.log10(n + 0.5 * (v + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                trimmed()
                r = batch.slice(i, 1).to_pylist()[0]  # a batch has many chunks
                sizes = np.frombuffer(r["sizes"], np.uint32).astype(np.int64)
                starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                word, count = unplanes(r["word"], np.uint32).astype(np.int64), _unpacked(r["counts"])
                c = count[word]
                end = c[starts[0] + sizes[0] - 1]
                h = np.empty(len(c), np.int64)
                h[1:] = c[:-1]
                h[starts] = end
                share = mix[_octave(h)]
                p = share[:, 0] * _unpacked(r["pairs"]) / np.maximum(h, 1) + share[:, 1] * c / max(n, 1) + share[:, 2] / (v + 1)
                total = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                del h, share
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["ids"], pa.int64()), pa.array(np.frombuffer(r["fold"], np.int8) == 2), pa.array(sizes), pa.array(total((c > 0).astype(np.int64))),
                        pa.array(np.full(len(sizes), n, np.int64)), pa.array(total(np.log10(c + 0.5)) - sizes * zero), pa.array(total(np.log10(p))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return met.select("ids", "fold", "sizes", "word", "counts", "pairs").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
