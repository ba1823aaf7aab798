"""Scan, parse, tag, edges, chunks, routing and the change stream."""

import json

import pytest

from cairn.operators import code
from cairn.plans import planner
from cairn.sources import files
from cairn.streaming import changes

API = '''import os
from app.db import session

class OrderService:
    """Orders."""
    limit = 5

    def load(self, key):
        return session(key)


class OrderView(APIView):
    pass


@router.post("/orders/{id}")
async def create(id: int):
    return OrderService().load(id)


def test_create():
    create(1)
'''


def tree(tmp_path):
    for name, text in (("app/api.py", API), ("app/bad.py", "def ("), ("node_modules/x.py", "x = 1"), ("notes.md", "no"), ("pom.xml", "<a/>")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


def test_index(spark, tmp_path):
    found = files.scan(spark, tree(tmp_path)).cache()
    assert {(r.path, r.language) for r in found.collect()} == {("app/api.py", "python"), ("app/bad.py", "python"), ("pom.xml", "xml")}
    symbols = code.tagged(code.symbols(found)).cache()
    got = {r.name: r for r in symbols.collect()}
    assert {n: r.kind for n, r in got.items()} == {"OrderService": "class", "load": "method", "OrderView": "class", "create": "function", "test_create": "test"}
    assert got["create"].route == "POST /orders/{id}" and got["create"].tags == ["route", "api", "controller"]
    assert got["OrderService"].tags[-2:] == ["service", "api"] or "service" in got["OrderService"].tags
    edges = {(r.source, r.target, r.edge_type) for r in code.edges(symbols).collect()}
    assert {("OrderView", "APIView", "extends"), ("load", "session", "calls"), ("test_create", "create", "tested_by"), ("create", "POST /orders/{id}", "routes_to"), ("OrderService", "app.db", "imports")} <= edges
    chunks = {(r.path, r.symbol): r for r in code.chunks(found, symbols).collect()}
    assert set(chunks) == {("app/api.py", n) for n in got} | {("app/bad.py", None), ("pom.xml", None)}
    assert chunks["app/api.py", "load"].content.startswith("    def load") and chunks["app/api.py", "OrderService"].content.count("\n") == 5


def test_split_tokens(spark):
    df = spark.createDataFrame([(["a" * 8, "b" * 8, "c" * 40, "d"],)], "l array<string>")
    assert [r.text for r in df.select(code.split_tokens(df.l, 4).alias("p")).first().p] == ["a" * 8 + "\n" + "b" * 8, "c" * 40, "d"]


def test_routing():
    assert planner.route("How many controllers are there?") == "controllers"
    assert planner.route("Explain the controllers") == planner.route("hello") == planner.route("list the controller 'A'") == "ai_required"
    assert planner.route("where is OrderController") == "where_is"


def test_change_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    events = [(1, "a", "modified", 30, "2024-01-01 00:00:00"), (2, "b", "created", 10, "2024-01-01 00:00:01"), (3, "a", "deleted", 10, "2024-01-01 00:00:02")]
    for e in events:
        (landing / f"{e[0]}.json").write_text(json.dumps(dict(zip(("id", "path", "event_type", "priority", "created_at"), e, strict=True))))
    changes.drain(changes.source(spark, str(landing), 1), str(tmp_path / "queue"), str(tmp_path / "cp")).awaitTermination(90)
    got = {(r.path, r.event_type, r.priority) for r in spark.read.parquet(str(tmp_path / "queue/v2")).collect()}
    assert got == {("a", "deleted", 30), ("b", "created", 10)}


def test_scan_sees_every_supported_file(spark, tmp_path):
    """Empty files, names with underscores, spaces and signs, deep folders; ignored folders aren't entered and links don't lead back."""
    given = {"pkg/__init__.py": "", "_top.py": "t = 1\n", "a b#1%20?.py": "s = 1\n", "_private/x.py": "x = 1\n", ".hidden/h.py": "h = 1\n", "a/b/c/d/e/deep.py": "d = 1\n", "é.py": "e = 1\n"}
    passed = {"node_modules/n.py": "n", "a/b/c/target/t.py": "t", "note.bin": "", "build/b.py": ""}
    for path, text in (given | passed).items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "a" / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "a" / "b" / "c" / "target").chmod(0)
    found = files.scan(spark, str(tmp_path))
    assert {r.path: r.text for r in found.collect()} == given
    (tmp_path / "a" / "b" / "c" / "target").chmod(0o755)
    whole, some = files.scan(spark, str(tmp_path), content=False), files.scan(spark, str(tmp_path), paths=[*given, "none.py", "a"])
    assert whole.columns == ["path", "language", "size_bytes", "last_modified_at"] and sorted(whole.collect()) == sorted(some.select(whole.columns).collect())
    (tmp_path / "empty").mkdir()
    assert files.scan(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="none"):
        files.scan(spark, str(tmp_path / "none")).count()
