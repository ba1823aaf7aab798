"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents, extra ones included, whatever they are called.

In every stage an empty table gives no rows, a null text counts as empty and stays null, a null doc_id is a document of its own,
ties are settled by the least doc_id, rows that repeat stay or go together, and very long texts are worked on whole. The stage
tables stay in the shared folder until whoever set it clears it: the last one is what `run` returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, near_dup, packing, pii, toxicity
from cairn.llm._base import small, stored, table
from cairn.llm.encoding import public_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; without labels, or with one class of them only, it rejects none or all."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays; of rows that repeat a doc_id and its text, each stays with it.

    The ids that go are broadcast up to a checked number of rows, so that no text is shuffled; beyond it the join shuffles.
    """
    found = near_dup.near_duplicates(docs, size=5, threshold=80)
    gone = small(found.filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, docs.doc_id.cast("long") == gone.gone_id, "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; an empty benchmark, or one of nulls, takes none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets, and n_chars is counted anew."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences; null and empty texts are one piece of the end id."""
    return packing.best_fit_packing(docs, public_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Neither a fitted machine, tokenizers nor a genetic algorithm can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs.select(*[F.col(c) for c in docs.columns])
