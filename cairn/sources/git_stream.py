"""Commits as a streaming source: what a branch has changed since the last offset, whoever committed it."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cairn.functions import text as T

CHANGE = "id long, path string, event_type string, priority int, created_at timestamp, commit string"
# Letters of git's name-status and what they are called.
KINDS = {"A": "created", "C": "created", "M": "modified", "T": "modified", "D": "deleted"}


def _git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=600, check=True).stdout


def _has(root: str, commit: str) -> bool:
    return bool(commit) and subprocess.run(["git", "-C", root, "cat-file", "-e", f"{commit}^{{commit}}"], capture_output=True).returncode == 0


def changed_between(root: str, old: str, new: str) -> Iterator[tuple[str, str]]:
    """(path, event) of what `new` has other than `old`; a move is a deletion and a renaming, in that order.

    An `old` that is empty or that the repository has lost stands for an empty tree, so all of `new` counts as created.
    """
    if not new:
        return
    base = old if _has(root, old) else _git(root, "hash-object", "-t", "tree", "/dev/null").decode().strip()
    fields = iter(_git(root, "diff", "--name-status", "-z", "-M", base, new).decode("utf-8", "replace").split("\0"))
    for status in fields:
        if not status:
            continue
        path = next(fields)
        if status[0] == "R":
            yield path, "deleted"
            yield next(fields), "renamed"
        else:
            yield path, KINDS.get(status[0], "modified")


class _Span(InputPartition):
    def __init__(self, old: str, new: str, part: int, parts: int):
        super().__init__((old, new, part, parts))
        self.old, self.new, self.part, self.parts = old, new, part, parts


class GitReader(DataSourceStreamReader):
    """Offsets are commits. A range of two commits gives the same rows whenever it is read, so a repeated batch repeats its rows."""

    def __init__(self, options):
        self.root, self.branch, self.since = options["path"], options.get("branch", "HEAD"), options.get("since")
        self.parts, self.priority = int(options.get("parts", 1)), int(options.get("priority", 50))

    def _tip(self) -> str:
        """The commit of the branch; empty before the first one. No repository is an error, so that a stream stops and loses nothing."""
        _git(self.root, "rev-parse", "--git-dir")
        tip = subprocess.run(["git", "-C", self.root, "rev-parse", "--verify", "-q", f"{self.branch}^{{commit}}"], capture_output=True, text=True, timeout=60)
        return tip.stdout.strip()

    def initialOffset(self) -> dict:
        return {"commit": self._tip() if self.since is None else self.since}

    def latestOffset(self) -> dict:
        return {"commit": self._tip()}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [] if start["commit"] == end["commit"] else [_Span(start["commit"], end["commit"], i, self.parts) for i in range(self.parts)]

    def read(self, partition: _Span):
        if not partition.new:
            return
        at = datetime.fromtimestamp(int(_git(self.root, "show", "-s", "--format=%ct", partition.new)), UTC)
        for i, (path, event) in enumerate(changed_between(self.root, partition.old, partition.new)):
            if crc32(path.encode()) % partition.parts == partition.part:
                yield i, path, event, self.priority, at, partition.new


class GitChanges(DataSource):
    """Options: path; branch (HEAD); since, the commit to begin after (empty: from the first one; without it what comes from now on);
    parts, tasks a batch; priority. The repository is read where a task runs, so it lies where all executors see it."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> GitReader:
        return GitReader(self.options)


def commits(spark: SparkSession, root: str, **options) -> DataFrame:
    """The stream of changes of supported files outside ignored folders; options as of GitChanges."""
    spark.dataSource.register(GitChanges)
    reader = spark.readStream.format("git_changes").option("path", root)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().filter(T.detect_language(F.col("path")).isNotNull() & ~T.ignored(F.col("path")))
