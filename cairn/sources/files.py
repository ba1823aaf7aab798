"""Source trees as tables, the git repository around them, and settings."""

from __future__ import annotations

import json
import os
import subprocess
from copy import deepcopy

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T

# What marks the root of a repository, and the defaults of the settings.
ROOT_MARKS = [".git", "pom.xml", "build.gradle", "settings.gradle", "package.json", "pyproject.toml", "go.mod"]
DEFAULTS = {
    "indexing": {"debounce_ms": 2500, "batch_files": 10, "stream_files": 1000, "reclaim_s": 600, "buckets": 64}, "hash_scan": {"every_s": 600, "files": 200},
    "embedding": {"provider": "bag_of_tokens", "max_chunk_tokens": 800},
    "retrieval": {"max_context_tokens": 25_000, "lexical_top_k": 20, "vector_top_k": 30, "symbol_top_k": 20, "rerank_top_k": 12, "include_git_diff": True},
    "verifier": {"max_attempts": 3, "min_confidence": 0.75},
}


def _top(root: str) -> str:
    return (root if "://" in root else "file://" + os.path.abspath(root.removeprefix("file:"))).rstrip("/")


def _store(address: str):
    """The file system of an address and the place there; names aren't escaped in addresses."""
    from pyarrow import fs

    scheme, _, rest = address.partition("://")
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    host, _, below_ = rest.partition("/")
    store, at = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store, f"{at.rstrip('/')}/{below_}"


def _unfolded(rows: DataFrame, deep: bool) -> DataFrame:
    """Rows (address, path, size_bytes, last_modified_at, folder) with what is in each folder in its place; all below it if `deep`.

    Ignored folders aren't entered, nor are links to folders, which may lead back. A folder that vanishes meanwhile is empty; the
    root, whose path is empty, has to be there.
    """
    schema, skip = rows.schema, frozenset(T.IGNORED_DIRS)

    def run(batches):
        from pyarrow import fs

        def packed(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()), strict=True)], schema.names)

        for batch in batches:
            yield batch.filter(pa.compute.invert(batch.column(4)))
            todo, found = batch.filter(batch.column(4)).select([0, 1]).to_pylist(), []
            while todo:
                at = todo.pop()
                store, place = _store(at["address"])
                for x in store.get_file_info(fs.FileSelector(place, allow_not_found=at["path"] != "")):
                    one = {"address": f"{at['address']}/{x.base_name}", "path": f"{at['path']}/{x.base_name}".lstrip("/")}
                    folder = x.type == fs.FileType.Directory
                    if folder and (x.base_name in skip or (store.type_name == "local" and os.path.islink(x.path))):
                        continue
                    if folder and deep:
                        todo.append(one)
                    elif folder or x.type == fs.FileType.File:
                        found.append((*one.values(), 0 if folder else x.size, None if folder else x.mtime, folder))
                    if len(found) == 10_000:
                        yield packed(found)
                        found = []
            if found:
                yield packed(found)

    return rows.mapInArrow(run, schema)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """address, path (below root), language, size_bytes and last_modified_at of supported files outside ignored folders; no content is read.

    Empty files and names with a leading underscore count, which Spark's own readers pass by. Two levels of folders are listed one after
    the other and spread, then each task walks what lies below its folders.
    """
    rows = spark.createDataFrame([(_top(root), "", 0, None, True)], "address string, path string, size_bytes long, last_modified_at timestamp, folder boolean")
    for deep in (False, False, True):
        rows = _unfolded(rows, deep)
        rows = rows if deep else rows.repartition("path")
    return _supported(rows.drop("folder"))


def _supported(rows: DataFrame) -> DataFrame:
    """Times as exact as a stored snapshot's, and languages; other files go."""
    rows = rows.withColumn("last_modified_at", F.date_trunc("millisecond", "last_modified_at"))
    return rows.withColumn("language", T.detect_language(F.col("path"))).filter(F.col("language").isNotNull() & ~T.ignored(F.col("path")))


def named(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """As `listing`, of given paths below root; each is looked up where its row is, and the tree isn't listed."""
    top = _top(root)

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            store, at = _store(top)
            found = [(p, x) for p in batch.column(0).to_pylist() if (x := store.get_file_info(f"{at}/{p}")).type == fs.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array([f"{top}/{p}" for p, _ in found], pa.string()), pa.array([p for p, _ in found], pa.string()), pa.array([x.size for _, x in found], pa.int64()), pa.array([x.mtime for _, x in found], pa.timestamp("us", "UTC"))], ["address", "path", "size_bytes", "last_modified_at"])

    given = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    rows = given.mapInArrow(run, "address string, path string, size_bytes long, last_modified_at timestamp")
    return _supported(rows)


def with_content(files: DataFrame) -> DataFrame:
    """Adds the bytes at `address`, read where the row is; files that can't be read go."""
    schema = files.schema

    def run(batches):
        for batch in batches:
            at, data, kept = batch.schema.get_field_index("address"), [], []
            for i, address in enumerate(batch.column(at).to_pylist()):
                try:
                    store, path = _store(address)
                    with store.open_input_stream(path) as f:
                        data.append(f.read())
                    kept.append(i)
                except OSError:
                    continue
                if sum(map(len, data)) > 16 << 20:
                    yield batch.take(pa.array(kept)).append_column("content", pa.array(data, pa.binary()))
                    data, kept = [], []
            if kept:
                yield batch.take(pa.array(kept)).append_column("content", pa.array(data, pa.binary()))

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", content binary")


def scan(spark: SparkSession, root: str, content: bool = True, paths: list[str] | None = None) -> DataFrame:
    """path (below root), language, size_bytes, file_hash, last_modified_at and text of supported files outside ignored folders.

    Texts decode as UTF-8 with replacement. The listing is filtered first, so ignored files are never opened; with `paths` only they
    are looked up. Without content only the listing is read.
    """
    found = listing(spark, root) if paths is None else named(spark, root, paths)
    if not content:
        return found.drop("address").select("path", "language", "size_bytes", "last_modified_at")
    rows = with_content(found.repartition("path"))
    return rows.select("path", "language", "size_bytes", "last_modified_at", F.sha2("content", 256).alias("file_hash"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def _git(root: str, *args: str, timeout: int = 15) -> str:
    """What git says; nothing where it fails."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def git_paths(root: str) -> list[str]:
    """Sorted distinct paths that the work tree, the index or no commit holds differently."""
    given = (("diff", "--name-only"), ("diff", "--name-only", "--cached"), ("ls-files", "--others", "--exclude-standard"))
    return sorted({x for args in given for x in _git(root, *args).split("\n")} - {""})


def git_changes(spark: SparkSession, root: str) -> DataFrame:
    """The changed paths as a table."""
    return spark.createDataFrame([(x,) for x in git_paths(root)], "path string")


def git_branch(root: str) -> str:
    return _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()


def git_diff(root: str, stat: bool = False) -> str:
    return _git(root, "diff", *(["--stat"] if stat else []))


def git_between(root: str, old: str, new: str) -> list[str]:
    """Sorted paths that differ between two commits."""
    return sorted({*_git(root, "diff", "--name-only", old, new).split("\n")} - {""})


def repository_root(path: str) -> str:
    """The nearest folder at or above a path that holds a mark of a repository; the path itself where none does."""
    at = os.path.abspath(path)
    here = at if os.path.isdir(at) else os.path.dirname(at)
    while not any(os.path.exists(os.path.join(here, m)) for m in ROOT_MARKS):
        if os.path.dirname(here) == here:
            return at
        here = os.path.dirname(here)
    return here


def merged_settings(base: dict, over: dict) -> dict:
    """base with the values of over; inner tables merge likewise."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def settings(path: str | None = None) -> dict:
    """The defaults, with what a JSON file says over them; an absent file says nothing."""
    if path is None or not os.path.exists(path):
        return deepcopy(DEFAULTS)
    with open(path) as f:
        return merged_settings(DEFAULTS, json.load(f))


def save_settings(path: str, values: dict) -> None:
    with open(path, "w") as f:
        json.dump(values, f, indent=2)


def below(root: str, path: str) -> str | None:
    """A path as one below root with plain slashes; None outside of it."""
    given = path.replace("\\", "/")
    full = os.path.normpath(given if os.path.isabs(given) else os.path.join(root, given))
    inside = os.path.relpath(full, os.path.abspath(root)).replace("\\", "/")
    return None if inside.startswith("..") or inside == "." else inside
