"""A tree that is watched: each tick compares a listing with the one before, so deleted and moved files are seen too."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources import files

SNAPSHOT = "path string, size_bytes long, last_modified_at timestamp"


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, event_type, moved_from) of two snapshots (path, size_bytes, last_modified_at).

    A file is modified if size or time differ. A new file is renamed, and not created, where it is the only new one and one lost file is
    the only lost one with its size and time; the lost path is deleted all the same. Paths are unique in a snapshot; null sizes and
    times equal each other but prove no move. Both joins are of keys; no order and no window needs all rows in one task.
    """
    state = F.struct("size_bytes", "last_modified_at")
    both = old.select("path", state.alias("was")).join(new.select("path", state.alias("is")), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("is")), "modified")
    found = both.select("path", kind.alias("event_type"), F.coalesce("is", "was").alias("state")).filter("event_type is not null")
    one = lambda event, name: F.when(F.count_if(F.col("event_type") == event) == 1, F.max(F.when(F.col("event_type") == event, F.col("path")))).alias(name)
    whole = F.col("state.size_bytes").isNotNull() & F.col("state.last_modified_at").isNotNull()
    moves = found.filter(whole & (F.col("event_type") != "modified")).groupBy("state").agg(one("created", "path"), one("deleted", "moved_from"))
    moves = moves.filter("path is not null and moved_from is not null").select("path", "moved_from")
    return found.join(moves, "path", "left").select("path", F.when(F.col("moved_from").isNotNull(), "renamed").otherwise(F.col("event_type")).alias("event_type"), "moved_from")


def watch(spark: SparkSession, root: str, home: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, priority: int = 20):
    """Gives `handle` the events (id, path, event_type, priority, created_at) of each tick with its number; all files are created at the first.

    A tick writes its snapshot below `home` and compares it with the one before. A tick that is repeated after a crash finds its snapshot
    and gives the same rows for the same number, and what has changed since comes with the next one. With `every` (as "10 seconds")
    it runs until stopped, else for one tick. `home` lies outside of root, where all executors see it.
    """
    store, top = fs.FileSystem.from_uri(home if "://" in home else f"file://{home}")

    def snapshot(number: int) -> DataFrame:
        return spark.read.schema(SNAPSHOT).parquet(f"{home}/v{number}")

    def there(number: int) -> bool:
        return store.get_file_info(f"{top}/v{number}/_SUCCESS").type == fs.FileType.File

    def tick(_: DataFrame, number: int) -> None:
        if not there(number):
            files.scan(spark, root, content=False).select("path", "size_bytes", "last_modified_at").write.mode("overwrite").parquet(f"{home}/v{number}")
        now = snapshot(number)
        before = snapshot(number - 1) if number and there(number - 1) else spark.createDataFrame([], SNAPSHOT)
        seen = compared(before, now).join(now.select("path", "last_modified_at"), "path", "left")
        order = F.when(F.col("event_type") == "deleted", 0).otherwise(1).cast("long")
        handle(seen.select(order.alias("id"), "path", "event_type", F.lit(priority).alias("priority"), F.coalesce("last_modified_at", F.current_timestamp()).alias("created_at")), number)
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(f"{top}/v{number - 2}")

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(once=True)).start()
