"""Index, local answers and packed context over a small tree."""

import test_braces
import test_code

from cairn.plans import engine, prompts


def test_subject_and_keywords():
    assert prompts.subject("where is 'load order'?") == "load order" and prompts.subject("Where is OrderService?") == "OrderService" and prompts.subject("") == ""
    assert prompts.subject("find 'a' or 'b'") == "b" and prompts.subject("imports of app/api.py") == "/api" and prompts.subject("where is the loader") == "loader"
    assert "Order" in prompts.keywords("Where is the order Order of x") and "order" not in prompts.keywords("Where is the order Order of x")


def test_engine(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    test_code.tree(tree)
    (tree / "OrderController.java").write_text(test_braces.JAVA)
    e = engine.Engine(spark, str(tmp_path / "home"))
    e.index(str(tree))
    counts = {r["name"]: r.n for r in e.status().collect()}
    assert set(counts) == {*engine.TABLES, "repo_tokens", "pending"} and counts["files"] == 4 and counts["embeddings"] == counts["chunks"] and counts["pending"] == 0
    name, rows = e.ask("where is OrderService")
    assert name == "where_is" and [r["name"] for r in rows.collect()] == ["OrderService"]
    assert {r["name"] for r in e.ask("where is Order")[1].collect()} >= {"OrderService", "OrderController"}
    assert {r["name"] for r in e.ask("list all controllers")[1].collect()} == {"OrderController", "OrderView", "OrderService", "create"}  # a class of a handler module counts
    assert {r.target for r in e.ask("list all endpoints")[1].collect()} == {"POST /orders/{id}", "GET /orders/{id}", "POST /orders/all"}
    assert {r["name"] for r in e.ask("show tests")[1].collect()} == {"loads", "test_create"}
    assert sum(r.n for r in e.answer("counts_by_kind", "").collect()) == e.table("symbols").count()
    assert e.ask("explain the design") == ("ai_required", None)
    top = e.context("change load").first()
    assert top.symbol == "load" and top.base == 2.0
    assert e.context("?").count() == 0 and len(e.context("load order", budget=1).collect()) == 1
    assert "### app/api.py:" in e.markdown("change load")
    e.register("tests", lambda own, question: own.table("files").select("path"))
    assert "path" in e.ask("show tests")[1].columns


def test_commands(spark, tmp_path):
    from cairn.__main__ import parser, run

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("class PayService:\n    def pay(self):\n        pass\n")
    say = lambda *words: run(spark, parser().parse_args([str(tmp_path / "home"), *words]))
    assert '"indexed": 1' in say("index", str(tmp_path / "src"))
    assert "symbols: 2" in say("status") and "PayService" in say("ask", "list all services") and "# Context Chunks" in say("ask", "explain", "pay")
    assert say("enqueue", str(tmp_path / "src"), "a.py") == "1" and '"processed": 1' in say("drain", str(tmp_path / "src")) and "lexical_top_k" in say("settings")


def test_one_changed_file_rewrites_its_buckets_only(spark, tmp_path):
    root, names = tmp_path / "src", [f"m{i}.py" for i in range(40)]
    root.mkdir()
    for n in names:
        (root / n).write_text(f"class {n[:-3].title()}Service:\n    def run(self):\n        return other()\n")
    e = engine.Engine(spark, str(tmp_path / "home"), {"indexing": {"buckets": 16}})
    e.index(str(root))
    files = lambda: {p for p in (tmp_path / "home").rglob("part-*") if "_stage" not in str(p)}
    before, stages = files(), list((tmp_path / "home" / "_stage").iterdir())
    assert not stages  # an index leaves no stage behind
    (root / "m7.py").write_text("class SevenService:\n    def walk(self):\n        return other()\n")
    assert e.reindex(str(root), ["m7.py"], [])["indexed"] == 1
    new = files() - before
    assert {p.parent.name for p in new} == {f"bucket={b}" for b in e.store.buckets_of(spark.createDataFrame([("m7.py",)], "path string"))}
    assert len({p.parent.parent.parent.name for p in new}) == 6 and len(new) <= 12
    (root / "m9.py").unlink()
    e.index(str(root))
    fresh = engine.Engine(spark, str(tmp_path / "fresh"))
    fresh.index(str(root))
    for name, drop in (("files", ["indexed_at"]), ("symbols", []), ("edges", []), ("chunks", []), ("embeddings", [])):
        columns = sorted(set(fresh.table(name).columns) - set(drop))
        show = lambda x: sorted(map(str, x.table(name).select(*columns).collect()))  # noqa: B023, E731
        assert show(e) == show(fresh), name


def test_contexts_are_read_in_any_order(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def pay_order():\n    pass\n"), (root / "b.py").write_text("def ship_goods():\n    pass\n")
    e, other = engine.Engine(spark, str(tmp_path / "home")), engine.Engine(spark, str(tmp_path / "home"))
    e.index(str(root))
    a, b, c = e.context("change pay_order"), e.context("change ship_goods"), other.context("change pay_order")
    assert b.first().symbol == "ship_goods" and a.first().symbol == "pay_order" and c.first().symbol == "pay_order"
    e.release()
    assert c.first().symbol == "pay_order"  # another caller's stages stay
    other.store.commit({}, note=1)
    e.store.commit({}, note=2)
    held = e.store._manifest
    e.store._manifest = lambda seen=held(): seen  # a writer that doesn't see what another one commits
    other.store.commit({}, note=3)
    e.store._manifest = iter([held() | {"commit": held()["commit"] - 1}, held()]).__next__
    try:
        e.store.commit({}, note=4)
        raise AssertionError("the later writer must fail")
    except RuntimeError:
        assert other.store.state["note"] == 3


def test_what_a_dead_drain_claimed_is_claimed_again(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    pass\n")
    e = engine.Engine(spark, str(tmp_path / "home"))
    e.index(str(root))
    e.enqueue(str(root), ["a.py"])

    class Killed(BaseException):
        pass

    def die(*_):
        raise Killed

    monkeypatch.setattr(engine.Engine, "reindex", die)
    try:
        e.drain(str(root))
    except Killed:
        pass
    monkeypatch.undo()
    later = engine.Engine(spark, str(tmp_path / "home"))
    assert later.drain(str(root))["processed"] == 0 and later.pending() == 1  # it may be alive still
    later.settings["indexing"]["reclaim_s"] = 0
    assert later.drain(str(root))["processed"] == 1 and later.pending() == 0


def test_rounding_is_that_of_the_binary_value(spark):
    import random

    from pyspark.sql import functions as F

    from cairn.functions import text as T

    rng = random.Random(4)
    values = [k / 1000 for k in range(1001)] + [0.35 + 0.25 + 0.2 + 0.1 + 0.1 * k / 8 for k in range(9)] + [rng.random() * 100 for _ in range(2000)] + [k / 20 for k in range(2001)] + [(1 - k / 5000) * 100 for k in range(5001)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.rounded(F.col("v"), 2).alias("two"), T.rounded(F.col("v"), 1).alias("one")).collect()
    assert all(r.two == round(r.v, 2) and r.one == round(r.v, 1) for r in got)
