"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import in_order, stored
from .encoding import encoder

BLOCK = 1024  # lengths a block of the two-level suffix sums


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every whole text (null: 0)."""

    def run(batches):
        codec = encoder(path)
        for batch in in_order(batches):
            ids = codec.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs: documents of it, above it, their tokens, and tokens kept when all are cut to L.

    Sums run in two levels (within blocks of lengths, then over the blocks), so no task sees the whole histogram but one that
    has a row for each block.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    mass = hist.withColumn("block", block).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = mass.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    part = mass.withColumns({"di": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "ti": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    total = mass.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    # the totals are one row
    out = part.join(blocks, "block").crossJoin(F.broadcast(total)).withColumns({"n_longer": F.col("di") + F.col("d"), "tokens_longer": F.col("ti") + F.col("t")})
    return out.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "n_longer",
        (F.col("all_tokens") - F.col("tokens_longer")).cast("long").alias("tokens_within"),
        "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_longer") * F.col("n_tokens")).cast("long").alias("tokens_truncated"),
        (F.col("all_docs") - F.col("n_longer")).cast("long").alias("rank"),
        ((F.col("all_docs") - F.col("n_longer")) / F.col("all_docs")).alias("quantile"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Totals for any limit, from the least length at or above it: the suffix sums hold for every limit between lengths."""
    total = F.max(F.col("tokens_within") + F.col("tokens_longer"))
    longer = F.coalesce(F.sum(F.when(F.col("context_limit") > limit, F.col("n_docs"))), F.lit(0))
    above = F.coalesce(F.sum(F.when(F.col("context_limit") > limit, F.col("n_docs") * F.col("context_limit"))), F.lit(0))
    return sums.agg(F.lit(limit).alias("context_limit"), longer.alias("n_longer"), (total - above + longer * limit).alias("tokens_truncated"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The least length whose rank reaches the share q of the documents."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("context_limit").alias("length"))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Suffix sums over the encoded lengths of docs (doc_id, text, ...).

    Null and empty texts have length 0 and count; very long ones are encoded whole. Repeated rows count each, whatever their
    doc_id. An empty table gives no rows. Other columns are ignored. The histogram, a row for each length, is written to the
    shared folder once, so that the sums over it don't encode the texts again.
    """
    return suffix_sums(stored(histogram(encoded_lengths(docs, path)), "lengths")[0])
