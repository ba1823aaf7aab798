"""Substring dedup: documents are factored against indexed reference blocks, and long factors are what repeats.

A window is `WINDOW` consecutive words. Documents are cut into segments at places that the text itself chooses: each window belongs to the
least hash of the `GRAM`-word grams inside it, its anchor, and consecutive windows of one anchor are a segment. Equal passages are cut alike,
so all occurrences of a window lie in segments of one anchor. A reference block is a range of anchors with its segments in document
order; ranges are by (anchor, document), so an anchor that a third of all segments share fills as many blocks as it needs.

A block is read in order and indexed as it is read. Each segment is parsed greedily against what stands before it (relative Lempel-Ziv):
from the earliest place of its next window a factor goes on as long as the reference does. A factor of k windows is one of
k + WINDOW - 1 words, so none is too short. Where a factor ends, the windows that begin in it and reach over its end are looked up by
themselves, as all windows are, so none that repeats elsewhere is missed. The first and last anchor of a block may go on in other blocks: their
windows that are new there are compared once more over all blocks, after each block has left one row a window.

Windows are compared within an anchor by 64-bit hashes over 64-bit hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import U64, content, grams, in_order, joined_words, stored, word_hashes, word_spans

WINDOW, GRAM = 20, 8
_SEGMENT = "anchor long, doc long, tie long, start int, windows binary"
_FACTOR = "doc long, tie long, start int, n int, ref_doc long, ref_start int, anchor long, window long"


def _windows(h: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of several texts: hashes of all windows, whether one lies inside a text, and whether the text had it before."""
    if len(h) < WINDOW:
        return np.empty(0, U64), np.empty(0, bool), np.empty(0, bool)
    hashes = grams(h, WINDOW)
    text = np.repeat(np.arange(len(where) - 1), np.diff(where))
    inside = text[: len(hashes)] == text[WINDOW - 1 :]
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(hashes), bool)
    equal = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    again[order[1:][equal]] = True
    return hashes, inside, again


def _anchors(h: np.ndarray) -> np.ndarray:
    """For each window the least hash of its grams."""
    x = grams(h, GRAM)
    width, reach = WINDOW - GRAM + 1, 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - width + reach], x[width - reach :]) if width > reach else x


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) to segments of the windows that a text has for the first time."""
    for batch in in_order(batches):
        h, where = word_hashes(batch.column(2), lower=False)
        hashes, inside, again = _windows(h, where)
        at = np.flatnonzero(inside & ~again)
        if not len(at):
            continue
        anchors = _anchors(h)[at]
        begins = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchors[1:] != anchors[:-1]))))
        text = np.searchsorted(where, at[begins], "right") - 1
        data = np.ascontiguousarray(hashes[at])
        offsets = np.concatenate((begins, [len(at)])).astype(np.int32) * 8
        windows = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        doc, tie = (np.asarray(batch.column(k)).astype(np.int64)[text] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(anchors[begins].view(np.int64)), pa.array(doc), pa.array(tie), pa.array((at[begins] - where[text]).astype(np.int32)), windows], ["anchor", "doc", "tie", "start", "windows"])


class Block:
    """The index of one reference block, filled in order of (anchor, doc, tie, start), which parses what is put in."""

    def __init__(self) -> None:
        self.first: int | None = None  # the block's first anchor
        self.anchor: int | None = None  # the one read last, of which all new windows are kept
        self.kept = [np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]

    def parse(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Factors of the segments, and the windows that are new in the block's first anchor."""
        anchor, doc, tie, start = (np.asarray(batch.column(k)).astype(np.int64) for k in range(4))
        data, offsets = content(batch.column(4))
        counts = np.diff(offsets) // 8
        row = np.repeat(np.arange(len(anchor)), counts)
        place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        # what is kept of the anchor read last stands before the batch, as rows of group 0
        if self.first is None:
            self.first = int(anchor[0])
        held = len(self.kept[0]) if self.anchor == anchor[0] else 0
        group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))[row]
        window = np.concatenate((self.kept[0][:held], np.frombuffer(data.tobytes(), U64)))
        docs, ties, places = (np.concatenate((k[:held], x)) for k, x in zip(self.kept[1:], (doc[row], tie[row], place)))
        group = np.concatenate((np.zeros(held, np.int64), group))
        segment = np.concatenate((np.full(held, -1), row))
        order = np.argsort(window, kind="stable")
        new = np.concatenate(([True], (window[order[1:]] != window[order[:-1]]) | (group[order[1:]] != group[order[:-1]])))
        first = np.empty(len(order), np.int64)
        first[order] = order[new][np.cumsum(new) - 1]
        own = (docs[first] == docs) & (ties[first] == ties) & (places[first] == places)
        yield from self._factors(np.flatnonzero(~own), first, segment, docs, ties, places)
        mine = first == np.arange(len(first))
        if self.first == anchor[0]:
            yield self._open(np.flatnonzero(mine[held:] & (group[held:] == 0)) + held, self.first, window, docs, ties, places)
        last = np.flatnonzero(mine & (group == group[-1]))
        self.anchor, self.kept = int(anchor[-1]), [x[last] for x in (window, docs, ties, places)]

    def close(self) -> Iterator[pa.RecordBatch]:
        """The windows that are new in the block's last anchor."""
        if self.anchor is not None and self.anchor != self.first:
            yield self._open(np.arange(len(self.kept[0])), self.anchor, *self.kept)

    @staticmethod
    def _factors(found, first, segment, docs, ties, places) -> Iterator[pa.RecordBatch]:
        """Greedy parse: a factor goes on while the next window stands next in the reference too."""
        if not len(found):
            return
        goes_on = (found[1:] == found[:-1] + 1) & (segment[found[1:]] == segment[found[:-1]]) & (docs[first[found[1:]]] == docs[first[found[:-1]]]) & (places[first[found[1:]]] == places[first[found[:-1]]] + 1)
        begins = np.flatnonzero(np.concatenate(([True], ~goes_on)))
        n, at = np.diff(np.concatenate((begins, [len(found)]))), found[begins]
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(ties[at]), pa.array(places[at].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(docs[first[at]]), pa.array(places[first[at]].astype(np.int32)), none, none], [x.split()[0] for x in _FACTOR.split(", ")])

    @staticmethod
    def _open(at, anchor: int, window, docs, ties, places) -> pa.RecordBatch:
        one = pa.array(np.ones(len(at), np.int32))
        return pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(ties[at]), pa.array(places[at].astype(np.int32)), one, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), pa.array(np.full(len(at), anchor)), pa.array(window[at].view(np.int64))], [x.split()[0] for x in _FACTOR.split(", ")])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = Block()
    for batch in batches:
        if batch.num_rows:
            yield from block.parse(batch)
    yield from block.close()


def _identified(docs: DataFrame, *more) -> DataFrame:
    """Order of documents: by doc_id, null before all; of equal ones by a hash of the text, so equal rows are one document."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.col("text").alias("text"), *more)


def factors(docs: DataFrame) -> DataFrame:
    """(doc, tie, start, n, ref_doc, ref_start): n windows of a document from word `start` on that stand earlier, in ref_doc from ref_start on.

    doc and tie are those of `_identified`. Factors of one document may overlap; windows that a document repeats itself aren't among them.
    """
    dealt = _identified(docs).mapInArrow(_segments, _SEGMENT).repartitionByRange("anchor", "doc", "tie", "start").sortWithinPartitions("anchor", "doc", "tie", "start")
    parsed, _ = stored(dealt.mapInArrow(_parsed, _FACTOR), "factors")
    left = parsed.filter("window is not null")
    earliest = left.groupBy("anchor", "window").agg(F.min(F.struct("doc", "tie", "start")).alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    later = left.join(earliest, ["anchor", "window"]).filter(F.struct("doc", "tie", "start") > F.col("first"))
    known = ["doc", "tie", "start", "n", "ref_doc", "ref_start"]
    return parsed.filter("window is null").select(*known).unionByName(later.select("doc", "tie", "start", "n", F.col("first.doc").alias("ref_doc"), F.col("first.start").alias("ref_start")))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to (doc_id, n_words, n_removed, kept): spans alternate starts and numbers of windows."""
    for batch in in_order(batches):
        h, where = word_hashes(batch.column(1), lower=False)
        data, at = content(batch.column(1))
        starts, ends, _ = word_spans(data, at)
        _, inside, again = _windows(h, where)
        gone = np.zeros(len(h) + WINDOW + 1, np.int64)
        own = np.flatnonzero(inside & again)
        np.add.at(gone, own, 1)
        np.add.at(gone, own + WINDOW, -1)
        spans = batch.column(2)
        if len(spans) > spans.null_count:
            sizes = np.asarray(spans.value_lengths().fill_null(0)).astype(np.int64)
            pairs = np.asarray(spans.flatten()).reshape(-1, 2).astype(np.int64)
            begun = np.repeat(where[:-1], sizes // 2) + pairs[:, 0]
            np.add.at(gone, begun, 1)
            np.add.at(gone, begun + pairs[:, 1] + WINDOW - 1, -1)
        kept = np.cumsum(gone)[: len(h)] == 0
        n_words = np.diff(where)
        sums = np.concatenate(([0], np.cumsum(kept)))
        n_kept = sums[where[1:]] - sums[where[:-1]]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64)), joined_words(data, starts[kept], ends[kept], n_kept)], ["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each document's words that no earlier window covers, joined by single spaces; one row a row.

    Windows are judged on the input. Documents are in order of doc_id, null first, then of a hash of the text; repeated rows are one document and
    get the same result. Null and empty texts, and those of fewer than WINDOW words, have nothing removed; an empty table gives no rows;
    other columns aren't read. Spans are a stored table, so Spark knows its size when it chooses how to join it.
    """
    found = factors(docs)
    spans, _ = stored(found.groupBy("doc", "tie").agg(F.flatten(F.collect_list(F.array("start", "n"))).alias("spans")), "spans")
    joined = _identified(docs, F.col("doc_id").cast("long").alias("doc_id")).join(spans, ["doc", "tie"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
