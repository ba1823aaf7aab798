"""The change queue as a stream: landed events, compacted by path in each micro-batch, and debounced bursts."""

from __future__ import annotations

import contextlib

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import relational as R
from cairn.plans.engine import Engine
from cairn.sources import git_stream
from cairn.streaming import trees

EVENT = "id long, path string, event_type string, priority int, created_at timestamp"


def source(spark: SparkSession, landing: str, files_a_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_batch).json(landing)


def debounced(events: DataFrame, gap: str = "2500 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row a path and burst, given once no event of it can come any more."""
    at = F.session_window("created_at", gap)
    return events.withWatermark("created_at", late).groupBy("path", at.alias("burst")).agg(F.max_by("event_type", F.struct("created_at", "id")).alias("event_type"), F.max("priority").alias("priority"), F.count("*").alias("n")).select("path", F.col("burst.start").alias("first_at"), "event_type", "priority", "n")


def drain(events: DataFrame, table: str, checkpoint: str):
    """Keeps the queue under `table`, one version a micro-batch, so that a repeated batch writes the same version again.

    The version before the last goes: only the last batch can repeat, and it reads the one before.
    """
    spark = events.sparkSession
    store, top = fs.FileSystem.from_uri(table if "://" in table else f"file://{table}")

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("id", "path", "event_type", "priority", "created_at")
        if number:
            old = spark.read.parquet(f"{table}/v{number - 1}").select(F.lit(-1).cast("long").alias("id"), "path", "event_type", "priority", "created_at")
            new = old.unionByName(new)
        R.queue_compacted(new).write.mode("overwrite").parquet(f"{table}/v{number}")
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(f"{top}/v{number - 2}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land(spark: SparkSession, landing: str, rows: list[tuple[int, str, str, int]], at: str) -> None:
    """Appends events (id, path, event_type, priority) of one time to the landing folder that `source` reads."""
    spark.createDataFrame([(*r, at) for r in rows], "id long, path string, event_type string, priority int, created_at string").coalesce(1).write.mode("append").json(landing)


def moved(old: str, new: str, first_id: int, priority: int) -> list[tuple[int, str, str, int]]:
    """A move as two events."""
    return [(first_id, old, "deleted", priority), (first_id + 1, new, "renamed", priority)]


def _indexed(engine: Engine, root: str):
    """What a stream does with a batch of events: into the queue, one row a path, and the queue is drained."""

    def run(batch: DataFrame, number: int) -> None:
        engine.enqueue_rows(batch.select("id", "path", "event_type", "priority", "created_at"))
        while engine.drain(root, engine.settings["indexing"]["stream_files"])["processed"]:
            pass

    return run


def follow(events: DataFrame, engine: Engine, root: str, checkpoint: str, every: str | None = None):
    """Keeps an index up to date with a stream of events.

    With `every` (as "10 seconds") it runs until stopped, else over what has landed. A repeated batch indexes the same files again.
    """
    writer = events.writeStream.foreachBatch(_indexed(engine, root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def follow_git(engine: Engine, root: str, checkpoint: str, every: str | None = None, **options):
    """Keeps an index up to date with the commits of a repository; options as of `git_stream.GitChanges`."""
    return follow(git_stream.commits(engine.spark, root, **options), engine, root, checkpoint, every)


def follow_tree(engine: Engine, root: str, home: str, checkpoint: str, every: str | None = None):
    """Keeps an index up to date with a tree, by snapshots below `home`; files that it holds already pass its hash gate."""
    return trees.watch(engine.spark, root, home, _indexed(engine, root), checkpoint, every)
