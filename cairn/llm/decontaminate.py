"""Benchmark decontamination by the q-gram lemma.

Every stretch of w characters of an item is a window, whatever its start. A region of a text within e edits of a window shares at
least w + 1 - q * (e + 1) of its q-grams, all on diagonals that differ by at most e. So q-grams that a text shares with an item
are put in overlapping bands of diagonals, windows that hold enough of a band's q-grams are kept, and a banded alignment of all of
them at once decides. Counting of a text starts only where enough of its q-grams belong to any item, which the lemma needs as well,
and goes on in slices of bounded size. Items of less than SHORT characters have indexes of their own with q-grams so short that the
lemma leaves enough of them at all their edits. Items of fewer characters than Q are searched for directly, as whole words. Of windows that
an item repeats only the first is indexed, so a long run of one letter is as short as a window.

Items are dealt into blocks of bounded size by hash; a task for each block writes its index to the shared folder. Workers read
the indexes from there and hold a few at a time, so neither the driver nor a plan ever carries items.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import U64, in_order, mixed, put, scratch, take

Q, WINDOW, EDIT_SHARE, BLOCK_BYTES, RESIDENT, ROWS = 10, 100, 0.07, 4 << 20, 4, 1 << 20
SHORT, SHORT_Q = 60, 6
_BASE = U64(0x100000001B3)


def folded(text: str | None) -> bytes:
    """Code points in lower case, with white space as single spaces."""
    return " ".join((text or "").lower().split()).encode("utf-32-le")


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer(folded(text), "<u4")


def qgrams(x: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of a sequence of code points."""
    n = len(x) - q + 1
    if n <= 0:
        return np.empty(0, U64)
    x = x.astype(U64)
    h, power, have = np.zeros(n, U64), [x], [1]  # by doubling: hashes of 1, 2, 4, ... characters
    while 2 * have[-1] <= q:
        a, k = power[-1], have[-1]
        power.append(a[: len(a) - k] * U64(pow(int(_BASE), k, 1 << 64)) + a[k:])
        have.append(2 * k)
    at = 0
    for p, k in zip(reversed(power), reversed(have), strict=True):
        if q - at >= k:
            h = h * U64(pow(int(_BASE), k, 1 << 64)) + p[at : at + n]
            at += k
    return mixed(h)


def _unrepeated(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The stretches of an item that its windows of `size` characters cover, each distinct window once."""
    if len(x) <= size:
        return [x]
    h = qgrams(x, size)
    _, first = np.unique(h, return_index=True)
    if len(first) == len(h):
        return [x]
    edge = np.zeros(len(x) + 1, np.int64)
    np.add.at(edge, first, 1), np.add.at(edge, first + size, -1)
    held = np.diff(np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0])))
    return [x[a:b] for a, b in zip(np.flatnonzero(held == 1).tolist(), np.flatnonzero(held == -1).tolist(), strict=True)]


@dataclass(frozen=True)
class Index:
    """Items, one after the other in codes from their starts on, and their q-grams: those of key i begin at the places
    place[first[i] : first[i + 1]] of codes. size, edits and need are those of an item's windows. brief: (item, text) of items
    shorter than a q-gram."""

    q: int
    items: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    brief: dict[int, dict[int, list[int]]]

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], q: int = Q, size: int = WINDOW, share: float = EDIT_SHARE) -> Index:
        ids, codes, brief = [], [], []
        for item, text in items:
            x = _codes(text)
            if len(x) >= q:
                for part in _unrepeated(x, size):
                    ids.append(item), codes.append(part)
            elif len(x):
                brief.append((item, x))
        sizes = np.array([min(len(x), size) for x in codes], np.int64)
        edits = np.array([min(int(n * share), n // q - 1) for n in sizes.tolist()], np.int64).clip(0)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in codes], dtype=np.int64))).astype(np.int64)
        grams = [qgrams(x, q) for x in codes]
        all_ = np.concatenate(grams) if grams else np.empty(0, U64)
        place = np.concatenate([np.arange(len(g)) + at for g, at in zip(grams, starts, strict=False)]) if grams else np.empty(0, np.int64)
        order = np.argsort(all_, kind="stable")
        keys, first = np.unique(all_[order], return_index=True)
        flat = np.concatenate(codes) if codes else np.empty(0, "<u4")
        return cls._made(q, np.array(ids, np.int64), flat, starts, sizes, edits, keys, np.append(first, len(all_)), place[order].astype(np.uint32), brief)

    @classmethod
    def _made(cls, q, ids, flat, starts, sizes, edits, keys, first, place, brief) -> Index:
        seen = np.zeros(1 << 22, bool)
        seen[(keys >> U64(42)).astype(np.int64)] = True
        short: dict[int, dict[int, list[int]]] = {}
        for item, x in brief:
            short.setdefault(len(x), {}).setdefault(int(qgrams(x, len(x))[0]), []).append(int(item))
        return cls(q, ids, flat, starts, sizes, edits, sizes + 1 - q * (edits + 1), keys, first, place, seen, short)

    @staticmethod
    def packed(items: list[tuple[int, str | None]], q: int = Q, **how) -> bytes:
        """The index of items as bytes."""
        x = Index.of(items, q, **how)
        few = [(i, _codes(t)) for i, t in items if 0 < len(_codes(t)) < q]
        out = io.BytesIO()
        np.savez(out, q=q, ids=x.items, flat=x.codes, starts=x.starts, sizes=x.size, edits=x.edits, keys=x.keys, first=x.first, place=x.place, brief_ids=np.array([i for i, _ in few], np.int64), brief_sizes=np.array([len(t) for _, t in few], np.int64), brief=np.concatenate([np.empty(0, "<u4"), *(t for _, t in few)]))
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Index:
        z = np.load(io.BytesIO(data))
        ends = np.cumsum(z["brief_sizes"])
        few = [(i, z["brief"][b - n : b].astype("<u4")) for i, b, n in zip(z["brief_ids"].tolist(), ends.tolist(), z["brief_sizes"].tolist(), strict=True)]
        return cls._made(int(z["q"]), z["ids"], z["flat"], z["starts"], z["sizes"], z["edits"], z["keys"], z["first"], z["place"], few)

    def found(self, x: np.ndarray) -> list[int]:
        """Items of which a window lies within its edits in the text."""
        out = self._whole_words(x) if self.brief else set()
        if not len(self.keys) or len(x) < self.q:
            return sorted(out)
        h = qgrams(x, self.q)
        at = np.flatnonzero(self.seen[(h >> U64(42)).view(np.int64)])
        k = int(self.need.min())
        if len(at) < k:
            return sorted(out)
        key = np.searchsorted(self.keys, h[at]).clip(max=len(self.keys) - 1)
        right = self.keys[key] == h[at]
        at, key = at[right], key[right]
        span = int(self.size.max() + self.edits.max())
        dense = np.flatnonzero(at[k - 1 :] - at[: len(at) - k + 1] < span) if len(at) >= k else []
        if not len(dense):
            return sorted(out)
        inside = np.zeros(len(at) + 1, np.int64)
        np.add.at(inside, dense, 1), np.add.at(inside, dense + k, -1)
        inside = np.cumsum(inside[:-1]) > 0
        at, key = at[inside], key[inside]
        n = self.first[key + 1] - self.first[key]
        for a, b in slices(at, n, span):
            self._count(x, at[a:b], key[a:b], n[a:b], out)
        return sorted(out)

    def _whole_words(self, x: np.ndarray) -> set[int]:
        """Items shorter than a q-gram that stand in the text between other characters than letters and digits."""
        out: set[int] = set()
        edge = None
        for size, known in self.brief.items():
            h = qgrams(x, size)
            hit = np.flatnonzero(np.isin(h, np.array(list(known), U64)))
            if len(hit):
                if edge is None:
                    edge = np.array([True, *(not chr(c).isalnum() for c in x.tolist()), True])
                for key in set(h[hit[edge[hit] & edge[hit + size + 1]]].tolist()):
                    out.update(known[key])
        return out

    def _count(self, x: np.ndarray, at: np.ndarray, key: np.ndarray, n: np.ndarray, out: set[int]) -> None:
        """Adds the items found by the q-grams `key` at the places `at` of the text."""
        rows = np.repeat(self.first[key] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        place = self.place[rows].astype(np.int64)
        item = np.searchsorted(self.starts, place, "right") - 1
        at = np.repeat(at, n)
        if out:  # an item is found once
            left = ~np.isin(self.items[item], np.fromiter(out, np.int64, len(out)))
            place, item, at = place[left], item[left], at[left]
        place -= self.starts[item]
        base = int(np.diff(self.starts).max())
        diagonal = at - place + base
        step = int(self.edits.max()) + 1
        for shift in (0, step):  # bands of 2 * step diagonals, the second set half a band on
            group = item * (1 << 40) + (diagonal + shift) // (2 * step)
            order = np.lexsort((place, group))
            group, row = group[order], place[order]
            last = np.arange(len(group)) + self.need[group >> 40] - 1
            ok = np.flatnonzero(last < len(group))
            last = last[ok]
            ok, last = (y[(group[ok] == group[last]) & (row[last] - row[ok] <= self.size[group[ok] >> 40] - self.q)] for y in (ok, last))
            found, begin = np.unique(group[ok], return_index=True)
            for g, b, e in zip(found.tolist(), begin.tolist(), np.append(begin, len(ok))[1:].tolist(), strict=True):  # windows that hold q-grams ok to last of their band
                w, low = g >> 40, (g & ((1 << 40) - 1)) * 2 * step - shift - base
                if int(self.items[w]) in out:
                    continue
                size, code = int(self.size[w]), self.codes[self.starts[w] : self.starts[w + 1]]
                first, final = (row[last[b:e]] + self.q - size).clip(0), row[ok[b:e]].clip(max=len(code) - size)
                starts = np.zeros(len(code) + 2, np.int64)
                np.add.at(starts, first, 1), np.add.at(starts, final + 1, -1)
                starts = np.flatnonzero(np.cumsum(starts) > 0)
                one = starts[len(starts) // 2 :][:1]  # most leaks show in any window
                if any(aligned(code, y, size, x, low, low + 2 * step - 1, int(self.edits[w])) for y in (one, starts)):
                    out.add(int(self.items[w]))


def slices(at: np.ndarray, n: np.ndarray, span: int, most: int = ROWS):
    """(from, to) of runs of places with about `most` rows each, so that any stretch of `span` characters lies in one of them."""
    ends, a = np.cumsum(n), 0
    while a < len(at):
        b = int(max(np.searchsorted(ends, ends[a] - n[a] + most, "right"), np.searchsorted(at, at[a] + 2 * span)))
        yield a, b
        if b >= len(at):
            return
        a = int(np.searchsorted(at, at[b] - span))


def within(a: np.ndarray, x: np.ndarray, low: int, high: int, edits: int) -> bool:
    """Whether all of a aligns with some stretch of x at most `edits` away, starting on diagonals low to high."""
    return aligned(a, np.zeros(1, np.int64), len(a), x, low, high, edits)


def aligned(a: np.ndarray, starts: np.ndarray, size: int, x: np.ndarray, low: int, high: int, edits: int, step: int = 512) -> bool:
    """Whether a window of `size` characters of a, from one of the starts, aligns with some stretch of x at most `edits` away.

    The stretch begins on diagonals (place in x less place in a) low to high, or up to `edits` beside them.
    """
    if len(starts) > step:
        return any(aligned(a, starts[k : k + step], size, x, low, high, edits, step) for k in range(0, len(starts), step))
    low, high = low - edits, high + edits
    place = np.arange(high - low + 1)
    from_ = starts[:, None] + low + place  # cost[s, j]: row i of window s ends before x[from_[s, j] + i]
    cost = np.where((from_ >= 0) & (from_ <= len(x)), 0, 1 << 20)
    first = int(from_[0, 0])
    padded = np.full(int(from_[-1, -1]) - first + size + 1, -1, np.int64)  # what x holds there
    b, e = max(0, first), min(len(x), first + len(padded))
    if b >= e:
        return False
    padded[b - first : e - first] = x[b:e]
    from_ -= first
    for i in range(size):
        here = padded[from_ + i]
        new = cost + (here != a[starts + i][:, None])
        new[here < 0] = 1 << 20
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a's character left out
        cost = np.minimum.accumulate(new - place, axis=1) + place  # characters of x left out
        good = cost.min(axis=1) <= edits
        if not good.all():
            if not good.any():
                return False
            cost, from_, starts = cost[good], from_[good], starts[good]
    return True


def write_indexes(benchmark: DataFrame, uri: str, limit: int = BLOCK_BYTES, **how) -> list[str]:
    """Writes the indexes of blocks of about `limit` bytes of items each under uri, one of long and one of short items a block; returns their names."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // limit))

    def run(group: pa.Table) -> pa.Table:
        block, attempt = group.column("block")[0].as_py(), str(TaskContext.get().taskAttemptId())
        items = list(zip(group.column("item_id").to_pylist(), group.column("text").to_pylist(), strict=True))
        short = [Q <= len(_codes(text)) < SHORT for _, text in items]
        names = []
        for kind, q, some in (("long", Q, [x for x, s in zip(items, short, strict=True) if not s]), ("short", SHORT_Q, [x for x, s in zip(items, short, strict=True) if s])):
            if some:
                names.append(f"{kind}-{block:07d}.npz")
                put(uri, names[-1], Index.packed(some, q, **how), attempt)
        return pa.table([pa.array(names, pa.string())], names=["name"])

    dealt = rows.filter("item_id is not null").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return sorted(r.name for r in dealt.groupBy("block").applyInArrow(run, "name string").collect())


_LOADED: dict[tuple[str, str], Index] = {}


def loaded(uri: str, name: str) -> Index:
    """An index of this worker, which holds the last few."""
    found = _LOADED.pop((uri, name), None) or Index.unpacked(take(uri, name))
    _LOADED[uri, name] = found
    while len(_LOADED) > RESIDENT:
        del _LOADED[next(iter(_LOADED))]
    return found


def judged(docs: DataFrame, benchmark: DataFrame, schema, emit: Callable[[pa.RecordBatch, list[list[int]]], pa.RecordBatch], **how) -> DataFrame:
    """Each batch of docs together with the sorted item_ids of which a passage stands in each text, as `emit` turns them into rows."""
    uri = scratch(docs.sparkSession, "items")
    names = write_indexes(benchmark, uri, **how)
    at = docs.columns.index("text")

    def run(batches):
        for batch in in_order(batches, 2 << 20 if len(names) <= RESIDENT else 16 << 20):
            codes = [_codes(x) for x in batch.column(at).to_pylist()]
            found: list[set[int]] = [set() for _ in codes]
            for name in names:
                index = loaded(uri, name)
                for x, into in zip(codes, found, strict=True):
                    into.update(index.found(x))
            yield emit(batch, [sorted(x) for x in found])

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (joined by commas) for every row of docs (doc_id, text, ...).

    Null and empty texts, items and tables are clean; items without an item_id are left out. Items shorter than Q characters count
    where they stand as whole words. Very long texts are searched whole, in slices. Repeated rows and rows without a doc_id are
    judged each. Other columns of docs and of benchmark (item_id, text, ...) are ignored.
    """

    def emit(batch: pa.RecordBatch, found: list[list[int]]) -> pa.RecordBatch:
        columns = [batch.column(0), pa.array([bool(x) for x in found], pa.bool_()), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(map(str, x)) for x in found], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "contaminated", "n_items", "item_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(rows, benchmark, "doc_id long, contaminated boolean, n_items long, item_ids string", emit, **how)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs in which no item stands, with their own columns, whatever they are called."""
    return judged(docs, benchmark, docs.schema, lambda batch, found: batch.filter(pa.array([not x for x in found], pa.bool_())), **how)
