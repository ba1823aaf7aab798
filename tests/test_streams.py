"""Git and trees as streams: each change arrives once, over restarts and repeated batches."""

import os
import shutil
import subprocess

import pytest

from cairn.plans import engine
from cairn.sources import git_stream
from cairn.streaming import changes, delays, trees


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b.c", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    return root, run


def test_changes_between_commits(repo):
    root, run = repo
    (root / "a.py").write_text("a = 1\n" * 20), (root / "b b.py").write_text("b = 2\n"), (root / "é.py").write_text("c = 3\n")
    run("add", "."), run("commit", "-m", "one")
    run("mv", "a.py", "m.py"), (root / "b b.py").write_text("b = 3\n"), run("rm", "-q", "é.py"), (root / "n.py").write_text("n = 1\n")
    run("add", "."), run("commit", "-m", "two")
    between = lambda old, new: list(git_stream.changed_between(str(root), old, new))
    assert between("HEAD~1", "HEAD") == [("b b.py", "modified"), ("a.py", "deleted"), ("m.py", "renamed"), ("n.py", "created"), ("é.py", "deleted")]
    assert sorted(between("", "HEAD~1")) == sorted((p, "created") for p in ("a.py", "b b.py", "é.py")) == sorted(between("0" * 40, "HEAD~1"))
    assert between("HEAD", "HEAD") == [] == between("", "")
    with pytest.raises(subprocess.CalledProcessError):
        git_stream.GitReader({"path": str(root.parent / "none")}).latestOffset()


def test_commits_arrive_once_over_restarts(spark, repo, tmp_path):
    root, run = repo
    got = []

    def go():
        got.clear()
        keep = lambda batch, n: got.extend((r.path, r.event_type, r.commit) for r in batch.orderBy("id").collect())
        git_stream.commits(spark, str(root), since="", parts=3).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        return [x[:2] for x in got]

    assert go() == []  # no commit yet
    (root / "a.py").write_text("a = 1\n" * 20), (root / "x.bin").write_text(""), (root / "build").mkdir(), (root / "build" / "b.py").write_text("")
    run("add", "-f", "."), run("commit", "-m", "one")
    assert go() == [("a.py", "created")] and go() == []
    run("mv", "a.py", "m.py"), run("commit", "-m", "two")
    (root / "n.py").write_text("n = 1\n"), run("add", "."), run("commit", "-m", "three")
    assert go() == [("a.py", "deleted"), ("m.py", "renamed"), ("n.py", "created")] and len({x[2] for x in got}) == 1 and go() == []
    run("reset", "-q", "--hard", "HEAD~2")  # rewritten history: the way back
    assert sorted(go()) == [("a.py", "renamed"), ("m.py", "deleted"), ("n.py", "deleted")]


def test_compared(spark):
    from datetime import datetime

    at = [datetime(2026, 1, d) for d in range(1, 9)]
    old = spark.createDataFrame([("same", 1, at[0]), ("mod", 1, at[1]), ("gone", 9, at[2]), ("from", 5, at[3]), ("twin1", 7, at[4]), ("twin2", 7, at[4]), ("dim", None, None), ("lost", None, at[6])], trees.SNAPSHOT)
    new = spark.createDataFrame([("same", 1, at[0]), ("mod", 1, at[5]), ("to", 5, at[3]), ("twin3", 7, at[4]), ("dim", None, None), ("found", None, at[6])], trees.SNAPSHOT)
    want = {("mod", "modified", None), ("gone", "deleted", None), ("from", "deleted", None), ("to", "renamed", "from"), ("twin1", "deleted", None), ("twin2", "deleted", None), ("twin3", "created", None), ("lost", "deleted", None), ("found", "created", None)}
    assert {tuple(r) for r in trees.compared(old, new).collect()} == want
    assert trees.compared(old.limit(0), new.limit(0)).count() == 0 and {r.event_type for r in trees.compared(old, new.limit(0)).collect()} == {"deleted"}


def test_watched_tree_over_restarts_and_repeats(spark, tmp_path):
    root, home, at = tmp_path / "tree", tmp_path / "home", tmp_path / "at"
    root.mkdir()
    got = []

    def go():
        got.clear()
        trees.watch(spark, str(root), str(home), lambda events, n: got.extend((n, r.path, r.event_type) for r in events.orderBy("id", "path").collect()), str(at)).awaitTermination()
        return list(got)

    (root / "a.py").write_text("a = 1\n"), (root / "b.py").write_text("bb = 1\n"), (root / "x.bin").write_text("")
    assert go() == [(0, "a.py", "created"), (0, "b.py", "created")]
    os.rename(root / "a.py", root / "m.py"), (root / "b.py").write_text("bbb = 1\n"), (root / "n.py").write_text("")
    assert go() == [(1, "a.py", "deleted"), (1, "b.py", "modified"), (1, "m.py", "renamed"), (1, "n.py", "created")]
    os.remove(at / "commits" / "1"), (at / "commits" / ".1.crc").unlink(missing_ok=True)  # as if it had died before the commit
    (root / "n.py").unlink()
    assert go()[:4] == [(1, "a.py", "deleted"), (1, "b.py", "modified"), (1, "m.py", "renamed"), (1, "n.py", "created")]
    rest = list(got[4:]) or go()
    assert rest == [(2, "n.py", "deleted")]
    shutil.rmtree(home)
    assert [x[1:] for x in go()] == [("b.py", "created"), ("m.py", "created")]


def test_an_index_follows_commits_and_a_tree(spark, repo, tmp_path):
    root, run = repo
    (root / "a.py").write_text("def one():\n    pass\n"), (root / "__init__.py").write_text("")
    run("add", "."), run("commit", "-m", "one")
    e = engine.Engine(spark, str(tmp_path / "home"))
    e.index(str(root))
    first = run("rev-parse", "HEAD").stdout.decode().strip()
    names = lambda: {r["name"] for r in e.table("symbols").collect()}
    run("mv", "a.py", "m.py"), (root / "b.py").write_text("def two():\n    pass\n")
    run("add", "."), run("commit", "-m", "two")
    changes.follow_git(e, str(root), str(tmp_path / "git-at"), since=first).awaitTermination()
    assert names() == {"one", "two"} and {r.path for r in e.table("files").collect()} == {"m.py", "b.py", "__init__.py"} and e.pending() == 0
    (root / "b.py").unlink(), (root / "c.py").write_text("def three():\n    pass\n")
    changes.follow_tree(e, str(root), str(tmp_path / "snapshots"), str(tmp_path / "tree-at")).awaitTermination()
    assert "three" in names() and e.pending() == 0
    (root / "c.py").unlink()
    changes.follow_tree(e, str(root), str(tmp_path / "snapshots"), str(tmp_path / "tree-at")).awaitTermination()
    assert "three" not in names()


def test_delays_of_changes(spark, tmp_path):
    """Changes meet their first run over a restart; unserved ones come once their time is over; late ones are dropped and counted; state is bounded."""
    for side in ("changes", "runs"):
        (tmp_path / side).mkdir()
    placed = iter(range(100))

    def land(side, rows):
        at = tmp_path / side / f"{next(placed):03}.json"
        at.write_text("\n".join(rows))
        os.utime(at, (1e9 + int(at.stem), 1e9 + int(at.stem)))

    change = lambda i, path, at: f'{{"change_id": {i}, "path": "{path}", "changed_at": "2024-01-01T{at}Z"}}'
    ran = lambda path, at: f'{{"path": "{path}", "ran_at": "2024-01-01T{at}Z"}}'
    seen, state = [], []

    def once():
        read = lambda side, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / side))
        rows = delays.served(read("changes", delays.CHANGE), read("runs", delays.RUN))
        query = rows.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        state.append(query.lastProgress["stateOperators"])
        return delays.late_rows(query)

    land("changes", [change(1, "a", "10:00:00"), change(2, "b", "10:00:00"), change(3, "a", "10:04:00"), change(4, "c", "10:00:00")])
    land("runs", [ran("a", "10:06:00"), ran("a", "10:05:00"), ran("b", "09:59:59"), ran("c", "11:00:01")])
    assert once() == 0 and seen == []
    for hour in (13, 15, 17):
        land("changes", [change(hour, "d", f"{hour}:00:00")])
        land("runs", [ran("d", f"{hour}:00:30")])
        once()
    land("changes", [change(99, "a", "10:01:00")])
    assert once() == 1
    got = {r.change_id: (r.path, r.delay_s) for r in seen}
    assert len(got) == len(seen) and {i: got[i] for i in (1, 2, 3, 4)} == {1: ("a", 300), 2: ("b", None), 3: ("a", 60), 4: ("c", None)} and got[13] == ("d", 30) and 99 not in got
    assert sum(o["numRowsTotal"] for o in state[-1]) <= 12


def test_delays_of_a_batch(spark):
    changes_ = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (1, "a", "2024-01-01 10:00:00"), (2, None, "2024-01-01 10:00:00"), (3, "b", None), (4, "a", "2024-01-01 10:00:01")], "change_id long, path string, at string").selectExpr("change_id", "path", "to_timestamp(at) changed_at", "'x' extra")
    runs = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:00:01"), (None, "2024-01-01 10:00:00")], "path string, at string").selectExpr("path", "to_timestamp(at) ran_at", "'y' extra")
    assert {(r.change_id, r.delay_s) for r in delays.served(changes_, runs).collect()} == {(1, 0), (2, None), (4, 3600)}
    assert delays.served(changes_.limit(0), runs).count() == 0
