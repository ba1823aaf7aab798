"""An inverted index of trigrams: which chunks can hold a term, so that only those are read and looked through.

A posting is (gram, chunk_id): three characters in a row of a chunk's content. Contents are folded both by ASCII letters alone and by all
letters, and both foldings are posted, so postings serve terms of either. A term leads to the chunks that have all trigrams of its parts
without wildcards; the caller's own expression then settles what really matches, so rows are those of a scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cairn.functions import text as T

GRAM = 3
PIECE = 1 << 20  # characters whose trigrams are sought at a time
ROWS = 100_000  # postings that leave a task at a time
LISTED, SENT = 2000, 1_000_000  # most chunks that are named in a filter, and that are broadcast


def _distinct(texts: list[bytes]) -> np.ndarray:
    """The distinct trigrams of some texts, each as a number of three code points."""
    found = [np.empty(0, np.int64)]
    for text in texts:
        codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        for at in range(0, len(codes) - GRAM + 1, PIECE):
            x = codes[at : at + PIECE + GRAM - 1].astype(np.int64)
            found.append(pd.unique((x[:-2] << 42) | (x[1:-1] << 21) | x[2:]))
    return found[-1] if len(found) <= 2 else pd.unique(np.concatenate(found))


def _strings(grams: np.ndarray) -> pa.Array:
    """Trigrams as texts, each made once."""
    codes, distinct = pd.factorize(grams)
    text = np.stack([distinct >> 42, (distinct >> 21) & 0x1FFFFF, distinct & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string()).take(pa.array(codes))


def postings(chunks: DataFrame, *more: str) -> DataFrame:
    """(gram, chunk_id, *more) of all contents, each gram of a chunk once; a null content has none.

    Letters are folded by Spark, those of ASCII by bytes, since no other byte of UTF-8 is one; rows leave a task some 100,000 at a time.
    """
    other = F.when(F.octet_length("content") != F.length("content"), F.lower("content"))
    rows = chunks.filter("content is not null").select("chunk_id", *more, F.col("content").cast("binary").alias("_c"), other.cast("binary").alias("_o"))
    schema = StructType([StructField("gram", StringType()), *[rows.schema[x] for x in ("chunk_id", *more)]])

    def run(batches):
        for batch in batches:
            at, found, size = [], [], 0
            for i, (plain, low) in enumerate(zip(batch.column("_c"), batch.column("_o"), strict=True)):
                plain, low = plain.as_py().lower(), low.as_py()
                found.append(_distinct([plain] if low is None or low == plain else [plain, low]))
                at.append(i)
                size += len(found[-1])
                if size >= ROWS or i + 1 == batch.num_rows:
                    which = pa.array(np.repeat(at, list(map(len, found))))
                    own = [batch.column(x).take(which) for x in schema.names[1:]]
                    yield pa.RecordBatch.from_arrays([_strings(np.concatenate(found)), *own], schema.names)
                    at, found, size = [], [], 0

    return rows.mapInArrow(run, schema)


def term_grams(term: str, wild: bool = False) -> list[str]:
    """The trigrams that every text with this folded term has; with `wild`, % and _ in it stand for anything."""
    parts = re.split("[%_]", term) if wild else [term]
    return list(dict.fromkeys(p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)))


def candidates(posted: DataFrame, terms: list[str], wild: bool = False) -> DataFrame | None:
    """(chunk_id) of chunks that have all trigrams of one of the terms; None where some term has none, so that only a scan will do.

    Reads the postings of the terms' trigrams only.
    """
    wanted = [term_grams(t, wild) for t in dict.fromkeys(terms)]
    if not all(wanted):
        return None
    flat = sorted({g for some in wanted for g in some})
    if not flat:
        return posted.select("chunk_id").filter("false")
    has = posted.filter(F.col("gram").isin(flat)).groupBy("chunk_id").agg(F.collect_set("gram").alias("has"))  # no more than the terms' own
    every = [F.size(F.array_intersect("has", F.array(*map(F.lit, some)))) == len(some) for some in wanted]
    return has.filter(reduce(lambda a, b: a | b, every)).select("chunk_id")


def among(chunks: DataFrame, found: DataFrame, most: int = LISTED, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The chunks (with chunk_id) that are found: up to `most` of them by a list of ids, which a scan skips files by; else by a join.

    `keep` writes the ids once, for postings that are made on the way and not read from a table: else the join makes them again.
    """
    found = keep(found) if keep else found
    ids = [r.chunk_id for r in found.limit(most + 1).collect()]
    if len(ids) <= most:
        return chunks.filter(F.col("chunk_id").isin(ids))
    return chunks.join(F.broadcast(found) if keep and found.count() <= SENT else found, "chunk_id", "left_semi")


def like(chunks: DataFrame, posted: DataFrame, term: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The chunks whose content holds a term, by SQLite's LIKE: letters of ASCII in any case, % and _ as wildcards."""
    found = candidates(posted, [term.translate(str.maketrans(T.UPPER, T.LOWER))], wild=True)
    some = chunks if found is None else among(chunks, found, keep=keep)
    return some.filter(T.contains_like(F.col("content"), F.lit(term)))
