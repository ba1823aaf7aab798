"""Parquet tables in buckets of paths behind one manifest: readers see all of a commit or none of it, and a commit writes what it touches."""

from __future__ import annotations

import contextlib
import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = 2


class Store:
    """Tables under `home`, a path or address that driver and executors share.

    Each row lies in the bucket of its `path`. The manifest names a folder for each bucket of each table; folders are never changed, so a
    commit writes new folders for the buckets that it is given and leaves the others. Folders that a commit replaced stay until the next
    but one, for running readers. Of two writers the later one fails and has to begin again.
    """

    def __init__(self, spark: SparkSession, home: str, buckets: int = 64):
        self.spark, self.home, self.default = spark, home.rstrip("/"), buckets
        self._fs, self._top = fs.FileSystem.from_uri(self.home)
        self._staged: list[str] = []

    def _manifest(self) -> dict:
        try:
            with self._fs.open_input_stream(f"{self._top}/manifest.json") as f:
                found = json.loads(f.read())
        except FileNotFoundError:
            found = {}
        if found.get("format") == FORMAT:
            return found
        # an index of another layout is made anew
        return {"format": FORMAT, "commit": 0, "buckets": self.default, "tables": {}, "replaced": [], "state": {}}

    @property
    def state(self) -> dict:
        """What was noted with the last commit."""
        return self._manifest()["state"]

    def has(self, name: str) -> bool:
        return name in self._manifest()["tables"]

    def bucket(self, path: str = "path") -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self._manifest()["buckets"])).cast("int")

    def buckets_of(self, paths: DataFrame) -> list[int]:
        """The buckets of a column `path`; no more numbers than there are buckets."""
        return sorted(r.b for r in paths.select(self.bucket().alias("b")).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some buckets of it. Columns that older folders don't have are null."""
        table = self._manifest()["tables"][name]
        schema = StructType.fromJson(table["schema"])
        some = [f"{self.home}/{at}" for b, at in table["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*some) if some else self.spark.createDataFrame([], schema)

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """df written once and read back, so that what follows doesn't compute it again; in a folder of its own until `release`."""
        return self.counted(name, df)[0]

    def counted(self, name: str, df: DataFrame) -> tuple[DataFrame, int]:
        """As `stage`, with the number of rows that the write itself has counted."""
        at, seen = f"_stage/{name}-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.home}/{at}")
        self._staged.append(at)
        return self.spark.read.schema(df.schema).parquet(f"{self.home}/{at}"), seen.get["n"]

    def staged(self) -> int:
        """A mark for `release`."""
        return len(self._staged)

    def release(self, since: int = 0) -> None:
        """Deletes this store's stages from a mark on; what reads them is over."""
        for at in self._staged[since:]:
            self._gone(at)
        del self._staged[since:]

    def _gone(self, at: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            self._fs.delete_dir(f"{self._top}/{at}")

    def commit(self, tables: dict[str, DataFrame], buckets: list[int] | None = None, order: dict[str, str] | None = None, **state) -> None:
        """Writes tables, or the given buckets of them, and moves a new manifest into place.

        The given rows replace all rows of those buckets, and must lie in them. Large buckets become several files, in the `order` of a
        column for tables that have one, so that readers skip what lies outside of a filter on it.
        """
        now = self._manifest()
        number, replaced = now["commit"] + 1, []
        for name, df in tables.items():
            at = f"{name}/c{number}-{uuid.uuid4().hex[:8]}"
            dealt = df.withColumn("bucket", self.bucket()).hint("rebalance", F.col("bucket"))
            dealt = dealt.sortWithinPartitions("bucket", order[name]) if name in (order or {}) else dealt
            dealt.write.partitionBy("bucket").parquet(f"{self.home}/{at}")
            made = [x.base_name.removeprefix("bucket=") for x in self._fs.get_file_info(fs.FileSelector(f"{self._top}/{at}")) if x.base_name.startswith("bucket=")]
            table = now["tables"].setdefault(name, {"folders": {}, "schema": None})
            hit = [b for b in table["folders"] if buckets is None or int(b) in buckets]
            replaced += [table["folders"].pop(b) for b in hit]
            table["folders"] |= {b: f"{at}/bucket={b}" for b in made}
            known = {f["name"]: f for f in (table["schema"] or {"fields": []})["fields"]} if buckets is not None else {}
            table["schema"] = {"type": "struct", "fields": list((known | {f["name"]: f for f in json.loads(df.schema.json())["fields"]}).values())}
        over, now["replaced"], now["commit"] = now["replaced"], replaced, number
        now["state"] |= state
        self._fs.create_dir(self._top, recursive=True)
        if self._manifest()["commit"] != number - 1:
            raise RuntimeError("another writer has committed meanwhile")
        new = f"{self._top}/manifest.{uuid.uuid4().hex}"
        with self._fs.open_output_stream(new) as f:
            f.write(json.dumps(now, indent=1).encode())
        self._fs.move(new, f"{self._top}/manifest.json")
        for at in over:
            self._gone(at)
