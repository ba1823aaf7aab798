"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and the acceptor again.

Words are dealt out by initial states. A pair of words one edit apart has a length M of its longer word and a place d where the words
part (the length of what they share at the front). For a range lo <= d < hi both begin with the same lo code points and end with the same
M - hi, so the state that the vocabulary acceptor reaches after the first part, and the state that accepts the last part alone, name a
partition: (M, lo, hi, front, back). Each pair lies in exactly one partition of the halves 0 to M / 2 and M / 2 to M. A partition with
more words than `limit` is cut in two in the same manner, until it fits or has one place left, which no more words than the
alphabet has letters can share; so no front, however common, is held by one task, and no pair is lost or found twice.

In a partition the middles of the words of length M and of M - 1 become two minimised acceptors, A and B, over shared states. A composed
with the replacing arcs and A, and A composed with the deleting arcs and B, are walked state pair by state pair. The transducer is
unambiguous: after a deleted symbol the next one must differ, so the place of the edit is d. What comes out is added up by word before
it leaves the task: how many near words, and the most frequent of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, in_order, raw, small, stored

LEAST, TIMES, DAMAGE = 7, 10, 31
_HOLD = 200_000


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (word, n), added up over many texts."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST).findall
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in in_order(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            begun = zlib.crc32(("" if doc_id is None else f"{doc_id}").encode() + b":")
            for run, times in Counter(runs(text.lower().decode())).items():
                h = zlib.crc32(run.encode(), begun)
                if h % DAMAGE == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST:
                        continue
                held[run] += times
        if len(held) > _HOLD:
            yield out()
            held.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of LEAST and more code points that occur twice or more, spelling damage included."""
    counted = docs.select(F.col("doc_id").alias("doc_id"), "text").mapInArrow(_tally, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")


class Acceptors:
    """Minimised acyclic acceptors of lists of equally long strings, all over one register of states.

    A state is a number; `arcs` gives its (symbol, state) in order of symbols, `sizes` how many strings it accepts. State 0 accepts the empty
    string. Strings are known by their rank in the sorted list, which is the sum of the sizes of the arcs passed over on their path.
    """

    def __init__(self) -> None:
        self.arcs: list[tuple] = [()]
        self.sizes: list[int] = [1]
        self.register: dict[tuple, int] = {(): 0}
        self._same: dict[tuple[int, int], list] = {}
        self._replaced: dict[int, list] = {0: []}

    def add(self, words: list[str]) -> int:
        """The initial state of the acceptor of sorted distinct words of one length."""
        if not words:
            return -1
        length, last = len(words[0]), ""
        path: list[list] = [[]]
        for word in [*words, None]:
            shared = 0
            if word is not None and last:
                while word[shared] == last[shared]:
                    shared += 1
            if last:
                for k in range(length - 1, shared - 1, -1):
                    path[k].append((last[k], self._state(tuple(path.pop()))))
            if word is None:
                break
            path.extend([] for _ in range(length - shared))
            last = word
        return self._state(tuple(path[0]))

    def _state(self, arcs: tuple) -> int:
        found = self.register.get(arcs)
        if found is None:
            found = self.register[arcs] = len(self.arcs)
            self.arcs.append(arcs)
            self.sizes.append(sum([self.sizes[s] for _, s in arcs]))
        return found

    def same(self, p: int, q: int) -> list[tuple[int, int]]:
        """Ranks of the strings that both states accept."""
        if p == q:
            return [(i, i) for i in range(self.sizes[p])]
        if not p or not q:
            return []
        found = self._same.get((p, q))
        if found is None:
            found, at, there = [], 0, {}
            for symbol, state in self.arcs[q]:
                there[symbol] = at, state
                at += self.sizes[state]
            at = 0
            for symbol, state in self.arcs[p]:
                if symbol in there:
                    off, other = there[symbol]
                    found += [(at + i, off + j) for i, j in self.same(state, other)]
                at += self.sizes[state]
            self._same[p, q] = found
        return found

    def replaced(self, q: int) -> list[tuple[int, int]]:
        """Ranks, the less one first, of accepted strings that differ in one replaced symbol."""
        found = self._replaced.get(q)
        if found is None:
            found, at, before = [], 0, []
            for _, state in self.arcs[q]:
                found += [(at + i, at + j) for i, j in self.replaced(state)]
                for off, other in before:
                    found += [(off + i, at + j) for i, j in self.same(other, state)]
                before.append((at, state))
                at += self.sizes[state]
            self._replaced[q] = found
        return found

    def deleted(self, p: int, q: int, sealed: bool) -> list[tuple[int, int]]:
        """Ranks of a string of p and one of q that remains of it without one symbol, which the next one doesn't repeat.

        The last symbol of sealed strings stays.
        """
        if sealed and not q:
            return []
        found, at, there = [], 0, {}
        for symbol, state in self.arcs[q]:
            there[symbol] = at, state
            at += self.sizes[state]
        at = 0
        for symbol, state in self.arcs[p]:
            if symbol in there:
                off, other = there[symbol]
                found += [(at + i, off + j) for i, j in self.deleted(state, other, sealed)]
                skip, upto = off, off + self.sizes[other]
                found += [(at + i, j) for i, j in self.same(state, q) if not skip <= j < upto]
            else:
                found += [(at + i, j) for i, j in self.same(state, q)]
            at += self.sizes[state]
        return found


def partition_pairs(words: list[str], most: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Places of near words of one partition: the longer is `most` long, both part at lo or later and before hi."""
    back = most - hi
    kept: tuple[dict, dict] = {}, {}
    for k, word in enumerate(words):
        # the first symbol of the shared back stands for what follows a symbol deleted last
        kept[most - len(word)][word[lo : len(word) - back + (back > 0)]] = k
    machine = Acceptors()
    (a, whole), (b, short) = ((machine.add(found := sorted(x)), [x[w] for w in found]) for x in kept)
    if a < 0:
        return
    for i, j in machine.replaced(a):
        yield whole[i], whole[j]
    if b >= 0:
        for i, j in machine.deleted(a, b, back > 0):
            yield whole[i], short[j]


def near_words(words: list[str]) -> list[tuple[str, str]]:
    """All pairs of distinct words that differ by one edit; for small lists and tests."""
    out = []
    for most in {n for w in words for n in (len(w), len(w) + 1)}:
        some = [w for w in set(words) if most - 1 <= len(w) <= most]
        out += [(some[i], some[j]) for i, j in partition_pairs(some, most, 0, most)]
    return out


def _partitions(table: pa.Table) -> pa.Table:
    """Rows (word, n, most, lo, hi) of some partitions to (word, n_near, near_n, near): what each word meets in each."""
    columns = [table.column(c).to_pylist() for c in ("word", "n", "most", "lo", "hi")]
    groups = defaultdict(list)
    for k, (word, _, most, lo, hi) in enumerate(zip(*columns)):
        groups[most, lo, hi, word[:lo], word[len(word) - most + hi :]].append(k)
    words, ns = columns[0], columns[1]
    count: Counter = Counter()
    best: dict[str, tuple[int, str]] = {}
    for (most, lo, hi, _, _), rows in groups.items():
        if len(rows) < 2:
            continue
        for i, j in partition_pairs([words[k] for k in rows], most, lo, hi):
            for one, other in ((rows[i], rows[j]), (rows[j], rows[i])):
                word, found = words[one], (-ns[other], words[other])
                count[word] += 1
                if word not in best or found < best[word]:
                    best[word] = found
    names = list(best)
    return pa.table({"word": pa.array(names, pa.string()), "n_near": pa.array([count[w] for w in names], pa.int64()), "near_n": pa.array([-best[w][0] for w in names], pa.int64()), "near": pa.array([best[w][1] for w in names], pa.string())})


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key of their partition; two partitions may share one, which only puts them in one task."""
    back = F.expr("substring(word, char_length(word) - most + hi + 1)")
    return rows.withColumn("key", F.xxhash64("most", "lo", "hi", F.expr("substring(word, 1, lo)"), F.when(F.expr("most > hi"), back)))


def _halves(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each row for both halves of its range of places."""
    middle = F.expr(f"({lo} + {hi}) div 2").cast("int")
    spans = F.array(F.struct(F.expr(lo).cast("int").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.expr(hi).cast("int").alias("hi")))
    return _keyed(rows.withColumn("span", F.explode(spans)).select("word", "n", "most", "span.lo", "span.hi"))


def near_counts(words: DataFrame, limit: int = 2000, width: int = 200, per_task: int = 40_000) -> tuple[DataFrame, list[str]]:
    """(word, n_near, near_n, near) for parts of the near words of (word, n), to be added up by word; and paths of tables it reads.

    `words` is a stored table. Partitions of more than `limit` words, or with middles of more than `width` code points, are cut again;
    at most log2 of the longest word's length times.
    """
    lengths = words.withColumn("most", F.explode(F.expr("array(char_length(word), char_length(word) + 1)")))
    rows, done, paths = _halves(lengths, "0", "most"), [], []
    while True:
        crowded = rows.groupBy("key").agg(F.count("*").alias("m"), F.max(F.expr("hi - lo")).alias("width"))
        crowded, path = stored(crowded.filter(f"width > 1 and (m > {limit} or m > 1 and width > {width})").select("key"), "crowded")
        if crowded.isEmpty():
            discard(words.sparkSession, path)
            done.append(rows)
            break
        paths.append(path)
        done.append(rows.join(small(crowded), "key", "left_anti"))
        rows, path = stored(_halves(rows.join(small(crowded), "key", "left_semi").drop("key"), "lo", "hi"), "halves")
        paths.append(path)
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, words.count() * 4 // per_task)
    dealt = done[0]
    for more in done[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.select("word", "n", "most", "lo", "hi", F.pmod("key", F.lit(tasks)).alias("part"))
    return dealt.groupBy("part").applyInArrow(_partitions, "word string, n_near long, near_n long, near string"), paths


def roots(forms: DataFrame, rounds: int = 40) -> tuple[DataFrame, str]:
    """(word, root) for each row (word, form): where following forms ends. n grows by `TIMES` with each form, so paths are short."""
    spark = forms.sparkSession
    found, path = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new, new_path = stored(found.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        moved = not new.filter("moved").isEmpty()
        discard(spark, path)
        found, path = new.select("word", "root"), new_path
        if not moved:
            return found, path
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of `vocabulary`.

    form is the near word of largest n (ties: least in code-point order) where that n is TIMES the word's or more, else null; root is where
    forms lead, the word itself without one. A null doc_id counts as the empty text before the colon, a null text has no words, each repeated row
    counts, runs of any length are words; an empty table, or one without words, gives no rows. Other columns aren't read.
    """
    words, _ = stored(vocabulary(docs), "vocabulary")
    near, _ = near_counts(words)
    both = near.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("near_n")).alias("by"), F.col("near").alias("word"), F.col("near_n").alias("n")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<by: bigint, word: string, n: bigint>").alias("best"))
    known = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    formed = F.expr(f"best.n >= {TIMES} * n")
    known, _ = stored(known.select("word", "n", "n_near", F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n")), "forms")
    ends, _ = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
