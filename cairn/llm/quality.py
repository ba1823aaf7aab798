"""Quality rules: counts over whole texts, and bands of zstandard ratios over documents and fixed chunks.

A document's ratio is its UTF-8 bytes over its compressed bytes. Repetitive text compresses far better than prose, random
text hardly at all; how well prose compresses grows with its length, so the band depends on it. The same holds for chunks of
a fixed size: a document is rejected too if more than a share of its chunks lie outside the band of their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import content, grams, in_order, word_hashes, word_spans

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


# About 2 % above the largest ratio of clean labelled documents of each length, more where these are few. Under 112
# bytes clean prose is as incompressible as noise, so there is no least ratio. Tests keep a text of 3,111 bytes and ratio 2.501.
_SHORT = (
    (64, 0.0, 1.25), (96, 0.0, 1.35), (112, 0.94, 1.35), (128, 1.0, 1.5), (192, 1.06, 1.62), (256, 1.15, 1.7), (384, 1.15, 1.76),
    (512, 1.15, 1.94), (768, 1.15, 2.01), (1024, 1.35, 2.09), (1536, 1.35, 2.19), (2048, 1.35, 2.21),
)
_LONG = ((3072, 1.35, 2.52), (4096, 1.4, 2.34), (6144, 1.4, 2.39), (8192, 1.4, 2.43), (12288, 1.4, 2.47), (16384, 1.5, 2.51), (24576, 1.5, 2.55), (65536, 1.5, 2.65))


@dataclass(frozen=True)
class Bands:
    """(from bytes, least ratio, most ratio) by length, for documents and for chunks; shorter texts are judged by no ratio."""

    limits: tuple[tuple[int, float, float], ...] = _SHORT + _LONG
    chunk: int = 4096
    chunk_limits: tuple[tuple[int, float, float], ...] = (*_SHORT, (3072, 1.35, 2.26), (4096, 1.4, 2.31))
    bad_share: float = 0.5
    level: int = 3

    def verdict(self, n: int, ratio: float, chunk: bool = False) -> int:
        """-1: incompressible; 1: repetitive; 0: inside the band."""
        for least, low, high in reversed(self.chunk_limits if chunk else self.limits):
            if n >= least:
                return -1 if ratio < low else 1 if ratio > high else 0
        return 0


def repeated_words(h: np.ndarray, window: int = 5) -> int:
    """Words inside windows that the text has twice or more."""
    if len(h) <= window:
        return 0
    g = grams(h, window)
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    flags = np.isin(g, twice)
    edge = np.zeros(len(h) + 1, np.int64)
    edge[:-window][flags] += 1
    edge[window:][flags] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def quality_rules(docs: DataFrame, bands: Bands = Bands(), min_words: int = 10, repeat_percent: int = 20) -> DataFrame:  # noqa: B008
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunks.

    Null, empty and blank texts have no words, so they fail; every row of docs (doc_id, text, ...) gives a row, repeated ones and
    those without a doc_id too. Very long texts are judged whole, in time that grows with their length only. An empty table gives
    no rows. Other columns are ignored.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks"]
    blank = b" \t\n\x0b\x0c\r"

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in in_order(batches):
            text = batch.column(1)
            data, at = content(text)
            h, words = word_hashes(text, lower=False)
            starts, ends, _ = word_spans(data, at)
            head = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            chars = np.concatenate(([0], np.cumsum(head[ends] - head[starts])))
            symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
            rows = []
            for i in range(batch.num_rows):
                a, b = int(at[i]), int(at[i + 1])
                raw = data[a:b].tobytes()
                w0, w1 = int(words[i]), int(words[i + 1])
                n = w1 - w0
                lines = [x for x in raw.split(b"\n") if x.strip(blank)]
                again = repeated_words(h[w0:w1])
                failed = n < min_words or 100 * again > repeat_percent * n
                ratio = len(raw) / len(press.compress(raw)) if raw else 0.0
                parts = [raw[k : k + bands.chunk] for k in range(0, len(raw), bands.chunk)] if len(raw) > bands.chunk else []
                bad = sum(bands.verdict(len(x), len(x) / len(press.compress(x)), chunk=True) != 0 for x in parts)
                kept = not failed and bands.verdict(len(raw), ratio) == 0 and bad <= bands.bad_share * len(parts)
                rows.append((n, int(chars[w1] - chars[w0]), int(symbols[b] - symbols[a]), len(lines) - len(set(lines)), again, failed, kept, ratio, bad))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
