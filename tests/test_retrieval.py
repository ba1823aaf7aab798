"""Retrieval operators, grouped routes, the incremental index, the queue and the verifier over small trees and tables."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import embedding as E
from cairn.operators import relational as R
from cairn.operators import retrieval as H
from cairn.plans import engine, prompts, verifier
from cairn.streaming import changes

TREE = {
    "orders/controller/order_api.py": '''from orders.service.order_service import OrderService

class OrderController:
    @router.get("/orders/{id}")
    def read_order(self, id):
        return self.service.fetch_order(id)

    @router.post("/orders")
    def create_order(self, body):
        return self.service.store_order(body)
''',
    "orders/service/order_service.py": '''class OrderService:
    def fetch_order(self, id):
        return Repo().load(id)

    def store_order(self, body):
        return Repo().save(body)
''',
    "orders/dto/order_dto.py": "class OrderDto:\n    total = 0\n",
    "other/dto/unrelated_dto.py": "class UnrelatedDto:\n    x = 0\n",
    "security/mfa_setup.py": "class MfaSetup:\n    def enroll(self, user):\n        return send_code(user)\n",
    "security/format_date.py": "def format_date(x):\n    return str(x)\n",
    "tests/test_orders.py": "def test_read_order():\n    assert read_order(1)\n",
    "ledger/notes.java": "class Ledger { int total; int getTotal() { return total; } }",
}


def plant(root, tree=TREE):
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    root = plant(at / "src")
    e = engine.Engine(spark, str(at / "home"))
    assert e.index(root) == {"scanned": 8, "indexed": 8, "deleted": 0, "symbols": e.table("symbols").count(), "chunks": e.table("chunks").count()}
    return e, root


def test_exact_route_brings_its_feature(indexed):
    e, _ = indexed
    rows = [(r.path, r.source) for r in e.context("What does GET /orders/:id do?").collect()]
    assert ("orders/controller/order_api.py", "route_exact") in rows[:2]
    assert ("orders/service/order_service.py", "call_target") in rows and ("orders/dto/order_dto.py", "feature_context") in rows
    assert not any(p.startswith("other/") for p, _ in rows)


def test_file_hint_and_alias(indexed):
    e, _ = indexed
    assert {r.path for r in e.context("look into Mfa_Setup.py").collect() if r.source == "file_hint"} == {"security/mfa_setup.py"}
    found = e.context("multi factor authentication").collect()
    assert found[0].path == "security/mfa_setup.py" and all(r.path != "security/format_date.py" for r in found if r.source == "query_alias")


def test_words_vectors_graph_and_confidence(indexed):
    e, _ = indexed
    a = e.retrieve("which code calls fetch_order")
    assert a.chunks[0]["symbol"] == "fetch_order" and a.chunks[0]["score"] >= 5 + 2 + 6 and "read_order" in a.dependencies["callers"] and "load" in a.dependencies["callees"]
    assert a.confidence >= 0.6 and "a symbol has a word's name" in a.confidence_reason and a.reduction <= 100 and not a.warnings
    assert {c["source"] for c in a.chunks} >= {"symbol", "graph"}
    none = e.retrieve("zzqx.py", budget=10)
    assert none.warnings and any("zzqx.py" in w for w in none.warnings)
    page = engine.page(a)
    assert all(f"# {s}" in page for s in ("User Task", "Confidence", "Token Savings", "Relevant Files", "Target Symbols", "Context Chunks", "Dependency Context", "Missing Context Warnings", "Instructions"))
    assert json.loads(a.to_json())["confidenceReason"] == a.confidence_reason


def test_grouped_routes(indexed, spark):
    e, _ = indexed
    name, rows = e.ask("show all routes grouped by controller")
    got = [(r.owner, r["name"], r.owner_kind) for r in rows.collect()]
    assert name == "grouped_routes" and ("OrderController", "read_order", "class") in got and ("OrderController", "GET /orders/{id}", "class") in got
    symbols = spark.createDataFrame([
        ("f", 0, "Big", "class", None, 1, 100, ["view"]), ("f", 1, "Small", "function", None, 10, 20, []), ("f", 2, "r1", "route", None, 12, 12, ["route"]), ("f", 3, "r2", "route", "gone", 30, 30, ["route"]),
        ("f", 4, "r3", "route", "inner", 40, 40, []), ("g", 5, "inner", "method", "Outer", 1, 2, []), ("g", 6, "r4", "route", "", 5, 5, []),
    ], "path string, ordinal int, name string, kind string, parent string, start_line int, end_line int, tags array<string>")
    edges = spark.createDataFrame([], "path string, source string, start_line int, end_line int, target string, edge_type string")
    owners = {r["name"]: (r.owner, r.owner_kind, r.owner_file) for r in H.owned(H.route_items(symbols, edges), symbols).collect()}
    assert owners == {"r1": ("Big", "class", "f"), "r2": ("gone", "", "f"), "r3": ("Outer", "", "f"), "r4": ("g", "", "g")}


def test_incremental_index(spark, tmp_path):
    root = tmp_path / "src"
    plant(root, {"a.py": "def one():\n    pass\n", "b.py": "def two():\n    pass\n", ".tmp/no.py": "x = 1\n", "c.py": "def three():\n    one()\n"})
    e = engine.Engine(spark, str(tmp_path / "home"))
    assert e.index(str(root))["indexed"] == 3 and e.index(str(root))["indexed"] == 0
    before = {r.chunk_id: r.vector for r in e.table("embeddings").collect()}
    (root / "a.py").write_text("def one():\n    return 2\n"), (root / "b.py").unlink()
    got = e.index(str(root))
    assert (got["indexed"], got["deleted"]) == (1, 1) and {r.path for r in e.table("files").collect()} == {"a.py", "c.py"}
    assert {r["name"] for r in e.table("symbols").collect()} == {"one", "three"} and e.table("edges").count() == 1
    after = {r.chunk_id: r.vector for r in e.table("embeddings").collect()}
    assert len(after) == 2 and sum(before.get(k) == v for k, v in after.items()) == 1
    assert e.store.read("files").filter("is_deleted").count() == 1
    e.store.commit({}, versions=engine.VERSIONS | {"parser": 0})
    assert e.stale() == ["parser"] and "parser" in e.warning("controllers") and e.warning("tests") is None
    assert e.index(str(root))["indexed"] == 2 and e.stale() == []
    (root / "b.py").write_text("def two():\n    pass\n")
    assert e.index(str(root))["indexed"] == 1 and e.table("files").filter("path = 'b.py'").count() == 1


def test_queue_and_stream(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    plant(root, {"a.py": "def one():\n    pass\n", "b.py": "def two():\n    pass\n"})
    e = engine.Engine(spark, str(tmp_path / "home"))
    e.index(str(root))
    (root / "a.py").write_text("def uno():\n    pass\n")
    assert e.hash_scan(str(root)) == 1 and e.pending() == 1
    assert e.enqueue(str(root), ["a.py", str(root / "b.py"), "/etc/x.py", "x.md", "venv/y.py"], "modified", engine.USER) == 2
    assert sorted((r.path, r.priority, r.status) for r in e._queue().collect()) == [("a.py", 30, "pending"), ("b.py", 30, "pending")]
    real = engine.Engine.reindex
    monkeypatch.setattr(engine.Engine, "reindex", lambda *a: 1 / 0)
    assert e.drain(str(root)) == {"processed": 0, "failed": 2} and e.pending() == 2
    monkeypatch.setattr(engine.Engine, "reindex", real)
    assert e.drain(str(root), 1) == {"processed": 1, "failed": 0} and e.pending() == 1
    assert {r["name"] for r in e.table("symbols").collect()} == {"uno", "two"}
    e.clear()
    assert [r.path for r in e._queue().collect()] == ["b.py"]
    (root / "b.py").unlink(), (root / "c.py").write_text("def three():\n    pass\n")
    changes.land(spark, str(tmp_path / "landing"), changes.moved("b.py", "c.py", 1, 30), "2024-01-01 00:00:00")
    changes.follow(changes.source(spark, str(tmp_path / "landing")), e, str(root), str(tmp_path / "cp")).awaitTermination(200)
    assert {r["name"] for r in e.table("symbols").collect()} == {"uno", "three"} and e.pending() == 0


class Fake:
    def __init__(self, replies):
        self.replies, self.seen = replies, []

    def analyse(self, question):
        return '{"rewrittenQueries": ["OrderService", " "], "questionType": "explanation", "intensity": "low", "needsMainAI": false}'

    def verify(self, question, intent, chunks, graph, attempt):
        self.seen.append((len(chunks), {(g["type"], g["evidence"]) for g in graph}, chunks))
        return self.replies[attempt - 1](chunks)


def test_verifier(indexed):
    e, _ = indexed
    fake = Fake([
        lambda c: {"answerable": "partial", "confidence": 0.5, "removeChunkIds": [c[-1]["id"], "unknown"], "followupQueries": ["unrelated_dto.py"]},
        lambda c: "```json\n" + json.dumps({"answerable": "yes", "confidence": 3, "keepChunkIds": [c[0]["id"], "none"], "missingSymbols": ["Repo"], "explanation": "so"}) + "\n```",
    ])
    a = e.verified("what does fetch_order do", fake)
    assert len(fake.seen) == 2 and fake.seen[1][0] > fake.seen[0][0] - 1 and len(a.chunks) == 1 and a.confidence == 1.0
    assert "missing symbol: Repo" in a.warnings and a.explanation == "so" and len(a.logs) == 2 and "# Context Verifier" in engine.page(a)
    broken = Fake([lambda c: "nothing"])
    plain = e.verified("what does fetch_order do", broken)
    assert plain.chunks and "failed" in plain.logs[-1]


def test_chunk_graph(spark):
    chunks = spark.createDataFrame([
        ("1", "app/main.ts", "main", "import { load } from './loader';\nimport x from 'nowhere.lib';\napp.get('/x', load)", 0), ("2", "app/loader", "load", "function load() {}", 1),
        ("3", "tests/a_test.py", "test_it", "def test_it(): load(); reload()", 2), ("4", "old/loader", "load", "load again", -1), ("5", "r.js", "GET /users", "// GET /users and GET /users2", 4), ("6", "s.js", None, "see GET /users", 5),
    ], "id string, path string, symbol string, content string, ordinal long")
    edges, missing = H.chunk_graph(chunks)
    got = {tuple(r) for r in edges.collect()}
    assert {("1", "2", "route", "load"), ("1", "2", "reference", "load"), ("3", "2", "test", "load"), ("4", "2", "reference", "load"), ("6", "5", "reference", "GET /users")} == got
    assert {r.name for r in missing.collect()} == {"./loader", "nowhere.lib"}
    py = spark.createDataFrame([("1", "a.py", "f", "from pkg.util import g\nimport os", 0), ("2", "pkg/util.py", "g", "x", 1), ("3", "t.py", "util", "y", 2)], "id string, path string, symbol string, content string, ordinal long")
    assert {tuple(r) for r in H.import_edges(py)[0].collect()} == {("1", "3", "import", "pkg.util")}  # the bare tail goes before tail.py


def test_pieces(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    keep = lambda *x: spark.createDataFrame([(i,) for i in x], "k string")
    assert {r.k for r in R.kept_or_all(rows, keep("a", "z"), "k").collect()} == {"a"} and R.kept_or_all(rows, keep("z"), "k").count() == 3
    lines = spark.createDataFrame([("f", s, i, d) for s in (1, 3) for i, d in enumerate((0, 1, 1, -1, -1, 0, 0), 1)], "p string, start int, n int, d int")
    assert {(r.start, r.end) for r in R.block_ends(lines, "p", "n", F.col("d")).collect()} == {(1, 5), (3, 4)}
    code = spark.createDataFrame([("f", 1, "@A"), ("f", 2, ""), ("f", 3, "@B"), ("f", 4, "class X")], "p string, n int, t string")
    assert [r.next for r in R.next_marked(code, "p", "n", (F.col("t") != "") & ~F.col("t").startswith("@")).orderBy("n").collect()] == [4, 4, 4, None]
    assert [r.frame for r in R.framed(code, "p", "n", "t", 1, 2).orderBy("n").collect()] == [["@A", "", "@B"], ["@A", "", "@B", "class X"], ["", "@B", "class X"], ["@B", "class X"]]
    assert R.unique(rows, ["k"]).count() == 0 and {r.k for r in R.unique(rows.unionAll(rows.limit(1)), ["k"]).collect()} == {"a"}
    v = {r.chunk_id: r.vector for r in E.bag_of_tokens(spark.createDataFrame([("x", "a b a"), ("y", "--"), ("z", None)], "chunk_id string, content string")).collect()}
    assert sum(x * x for x in v["x"]) == pytest.approx(1) and sorted(v["x"])[-2:] == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and not any(v["y"]) and not any(v["z"])
    tokens = spark.createDataFrame([("MfaController setupMfa formatDate image 2FA",)], "t string").select(T.alias_tokens(F.col("t")).alias("a")).first().a
    assert {"mfa", "controller", "setup", "setupmfa", "2fa", "date"} <= set(tokens) and not {"mat", "mag"} & set(tokens)
    e = spark.createDataFrame([("p", 1, 2, "x"), ("p", None, None, "x")], "p string, a int, b int, c string").select(T.evidence_id(*[F.col(c) for c in "pabc"]).alias("i"))
    assert [r.i for r in e.collect()] == ["p:1-2:11f6ad8ec52a", "p:0-0:11f6ad8ec52a"]


def test_scores_of_every_term(spark):
    schema = "chunk_id string, path string, symbol string, kind string, content string, source string, base double, reasons array<string>, ordinal int"
    rows = spark.createDataFrame([
        ("1", "a/order.py", "OrderService", "class", "the order", "symbol", 2.0, [], 1), ("2", "t.py", "x", "test", "", "odd", 0.5, [], 2), ("3", "r.py", "y", "route", "nothing", "graph", 0.4, [], 3), ("4", None, None, None, None, "vector", 0.1, [], 4),
    ], schema)
    p = prompts.Prompt("", "test_creation", ["OrderService", "order"], ["order.py"])
    got = {r.chunk_id: r for r in H.scored(rows, p, ["r.py"]).collect()}
    assert {k: round(r.score, 6) for k, r in got.items()} == {"1": 5 + 2 + 6 + 3 + 3 + 4, "2": 1 + 0.5 + 2.5, "3": 2.5 + 0.4 + 3 + 1.5, "4": 1.1}
    assert "exact symbol match" in got["1"].reasons and "file path match" in got["1"].reasons and got["4"].reasons == []
    sure = H.confidence(H.scored(rows, p).filter("chunk_id = '1'"), p).first()
    assert sure.confidence == 0.95 and sure.coverage == 0.5 and sure.reason.startswith("good: best score 8 or more")
    assert H.confidence(H.scored(rows.filter("false"), p), p).first().confidence == 0.1


def test_budget_pack_equals_the_fold(spark):
    """Groups of one row to a third of all rows, zeros, nulls, first rows over the budget, null groups, a clashing column."""
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "hot", "a", "b", None]), i, rnd.choice([0, None, 1, 1, 2, 3, 7, 20, 60, 99, 100, 101, 500]), f"t{i}") for i in range(3000)]
    rows += [("burst", -3, 500, "x"), ("burst", -2, 0, "y"), ("burst", -1, 1, "z"), ("zeros", -2, 0, "p"), ("zeros", -1, None, "q"), ("one", -1, 7, "r"), ("late", -2, 99, "s"), ("late", -1, 500, "t")]
    rows += [("hot", 10_000 + i, 1, "u") for i in range(1500)]
    got = R.budget_packed(spark.createDataFrame(rows, "g string, at int, n int, kept string").repartition(7), ["g"], ["at"], "n", 100)
    used, want = {}, set()
    for g, at, n, text in sorted(rows, key=lambda r: r[1]):
        n = n or 0
        if g not in used or used[g] + n <= 100:
            used[g] = used.get(g, 0) + n
            want.add((g, at, n, text))
    assert got.columns == ["g", "at", "n", "kept"] and {(r.g, r.at, r.n or 0, r.kept) for r in got.collect()} == want and got.count() == len(want)
    assert R.budget_packed(spark.createDataFrame([], "g string, at int, n int"), ["g"], ["at"], "n", 100).count() == 0


def test_budget_pack_cuts_before_a_group_meets(spark):
    """200,000 rows of one group: the task that packs it sees at most budget / cost rows of each cost, and one over the budget."""
    items = spark.range(200_000).select(F.lit("g").alias("g"), "id", (F.col("id") % 50).alias("n"))
    got = [r.n for r in R.budget_packed(items, ["g"], ["id"], "n", 40).collect()]
    assert got.count(0) == 4000 and sorted(x for x in got if x) == [1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8]
    plan = R.budget_packed(items, ["g"], ["id"], "n", 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("row_number")


def test_enclosing_equals_brute_force(spark):
    rng = random.Random(8)
    spans = [(rng.choice("ab"), s, s + rng.choice([-1, 0, 1, 3, 8, 40, 3000]), rng.choice(["x", "y", "z", None]), rng.choice(["f", "g"]), rng.choice([0, 1])) for s in (rng.randint(-40, 40) for _ in range(250))] + [("a", None, 4, "x", "f", 1), (None, 0, 9, "x", "f", 1)]
    points = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-45, 60), 2900]), rng.choice(["x", "y", "w", None])) for i in range(400)] + [(1, "a", 0, "w"), (1, "b", 5, "w")]
    p = spark.createDataFrame(points, "id long, f string, at int, own string").repartition(3)
    s = spark.createDataFrame(spans, "f string, start int, end int, n string, kind string, first int").repartition(2).select("f", "start", "end", F.struct("n", "kind").alias("name"), "first")

    def brute(named, after):
        best = {}
        for i, f, at, own in points:
            for g, a, b, n, kind, first in spans:
                if f is not None and f == g and None not in (at, a) and a + after <= at <= b and (not named or (None not in (n, own) and n != own)):
                    best.setdefault(i, []).append((-first, b - a, a, n is not None, n or "", kind))
        return {i: (x[4] if x[3] else None, x[5]) for i, x in ((i, min(v)) for i, v in best.items())}

    for named in (False, True):
        for after in (False, True):
            how = {"own": "own", "key": F.col("name.n")} if named else {}
            got = {r.id: tuple(r.owner) for r in R.enclosing(p, s, "f", after=after, prefer=F.col("first"), **how).collect()}
            assert got == brute(named, after), how
    assert R.enclosing(p, s.filter("false"), "f").count() == 0


def test_enclosing_of_one_crowded_key_makes_no_pairs(spark):
    n = 60_000
    points = spark.range(n).select("id", F.lit("a").alias("f"), (F.col("id") % 500 + 250).alias("at"))
    spans = spark.range(n).select(F.lit("a").alias("f"), (F.col("id") % 499).alias("start"), (500 + F.col("id") % 487).alias("end"), F.col("id").alias("name"))
    begun = time.monotonic()
    assert R.enclosing(points, spans, "f").agg(F.count("owner")).first()[0] == n
    assert time.monotonic() - begun < 25
