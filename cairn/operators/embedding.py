"""Vectors of texts. An embedder is a function of rows (chunk_id, content) to rows (chunk_id, vector); the default needs no model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T

Embedder = Callable[[DataFrame], DataFrame]
DIM = 256


def bag_of_tokens(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """Counts of the tokens' FNV buckets, of length one; all zero for a text without tokens."""
    tokens = rows.select("chunk_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("t"))
    counts = tokens.select("chunk_id", (T.fnv1a(F.col("t")) % dim).cast("int").alias("b")).groupBy("chunk_id", "b").agg(F.count("*").cast("double").alias("n"))
    sums = counts.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i) / F.col("norm"), F.lit(0.0)))
    return rows.select("chunk_id").join(sums, "chunk_id", "left").select("chunk_id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(value).alias("vector"))


#: Embedders by name; an unknown name means the default.
EMBEDDERS: dict[str, Embedder] = {"bag_of_tokens": bag_of_tokens}


def embedder(name: str) -> Embedder:
    return EMBEDDERS.get(name, bag_of_tokens)
