"""How long changes wait for the index: a join of two streams, of changes and of index runs, on path and time.

Both sides carry a watermark, so state holds the changes and runs of the last `within_s` seconds and `late` only; what comes later than that is
dropped, and counted by `late_rows`. On batches the same join gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGE, RUN = "change_id long, path string, changed_at timestamp", "path string, ran_at timestamp"


def served(changes: DataFrame, runs: DataFrame, within_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """A row a change (change_id, path, changed_at) with the first run of its path from its time on, at most `within_s` seconds later, and the whole seconds
    between; nulls where there is none. A stream gives a change once, when no such run can come any more.

    Time is cut into stretches of that length and a run copied to its own and the one before, so one path's rows lie in many tasks.

    A change without a path has no run; rows that repeat a change count once; a change without a time is dropped, as no watermark can pass it.
    """
    micros = lambda at: F.unix_micros(F.col(at).cast("timestamp"))
    stretch = lambda at: F.floor(micros(at) / F.lit(within_s * 1_000_000))
    left = changes.select("change_id", "path", "changed_at").filter("changed_at is not null").withWatermark("changed_at", late).withColumn("stretch", stretch("changed_at"))
    right = runs.select(F.col("path").alias("run_path"), "ran_at").filter("ran_at is not null").withWatermark("ran_at", late)
    right = right.withColumn("run_stretch", F.explode(F.array(stretch("ran_at"), stretch("ran_at") - 1)))
    near = F.expr(f"path = run_path AND stretch = run_stretch AND ran_at >= changed_at AND ran_at <= changed_at + INTERVAL {int(within_s)} SECONDS")
    first = left.join(right, near, "left_outer").groupBy("change_id", "path", "changed_at").agg(F.min("ran_at").alias("ran_at"))
    return first.withColumn("delay_s", F.floor((micros("ran_at") - micros("changed_at")) / 1_000_000))


def late_rows(query) -> int:
    """Rows that a running or ended stream has dropped as too late, as far as its recent progress goes."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
