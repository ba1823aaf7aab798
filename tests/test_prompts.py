"""Prompts, patches, settings and routing: strings in, strings out."""

import pytest

from cairn.functions import patches
from cairn.plans import planner, prompts, verifier
from cairn.sources import files


@pytest.mark.parametrize("prompt, alias", [("role based access control", "rbac"), ("know your customer verification", "kyc"), ("one time password verification", "otp"), ("two-factor authentication", "mfa"), ("enable 2fa", "2fa"), ("the RBAC rules", "rbac")])
def test_aliases(prompt, alias):
    assert alias in prompts.aliases(prompt)


def test_aliases_need_words_of_sense():
    assert prompts.aliases("show me all the files") == [] and prompts.aliases("") == [] and "123" not in prompts.aliases("1 2 3 4")


def test_noise_and_parts():
    assert all(map(prompts.noise, "get api route controller service dto jpa two multi factor".split())) and not any(map(prompts.noise, ["kafka", "verifications"]))
    assert prompts.names_part("kafka") and not any(map(prompts.names_part, ["ab", "get", "a/bc", "abc.py", " "]))


def test_prompt():
    p = prompts.Prompt.read("Fix the bug in GET /api/users/:id, see src/users.routes.js and `loadUser`")
    assert p.intent == "bug_fix" and p.route == "GET /api/users/:id"
    assert "src/users.routes.js" in p.files and "src/users.routes.js" in p.hints and "loadUser" in p.keywords
    assert prompts.Prompt.read("prefix of names").intent == "question" and prompts.Prompt.read("").keywords == []


@pytest.mark.parametrize("question, handler", [
    ("show all routes grouped by controller", "grouped_routes"), ("list endpoints for each module", "grouped_routes"), ("group the routes by owner", "grouped_routes"), ("list all controllers", "controllers"),
    ("how many tests are in this repository", "repositories"), ("show routes grouped by 'UserController'", "ai_required"), ("list methods per class", "ai_required"), ("where is the handler per user", "where_is"),
])
def test_grouped_routes_go_before_controllers(spark, question, handler):
    assert planner.route(question) == handler
    assert spark.createDataFrame([(question,)], "q string").select(planner.route_column(planner.F.col("q"))).first()[0] == handler


def test_patches(spark):
    diff = "diff --git a/app/x.py b/app/x.py\n--- a/app/x.py\n+++ b/app/x.py\n@@ -1 +1 @@\n-a\n+b\n"
    assert patches.patch_in(f"Here:\n```diff\n{diff}```\nDone") == diff and patches.patch_in("Sure. \n" + diff) == diff and patches.patch_in("no diff") is None
    assert patches.patched_paths(diff) == ["app/x.py"] and patches.safe(diff)
    for bad in ("/etc/passwd", "../../x", "a/../../x", "C:/x"):
        assert not patches.safe(f"--- {bad}\n+++ {bad}\n@@ -1 +1 @@\n")
    assert not patches.safe("")
    rows = spark.createDataFrame([(x,) for x in diff.split("\n")], "l string").select(patches.line_kind(planner.F.col("l")).alias("k"))
    assert sorted(str(r.k) for r in rows.collect()).count("+") == 1


def test_object_in_a_reply():
    for text in ('{"a": 1}', 'Sure:\n```json\n{"a": 1}\n```', 'well {"a": 1} ok', '{"a": 1} trailing'):
        assert verifier.object_in(text) == {"a": 1}
    for text in ("", "no", "[1]", "{broken"):
        with pytest.raises(ValueError):
            verifier.object_in(text)


def test_retries():
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 7

    assert verifier.retried(call, wait=0) == 7 and len(tries) == 3
    with pytest.raises(OSError):
        verifier.retried(lambda: (_ for _ in ()).throw(OSError()), wait=0)


def test_settings_and_roots(tmp_path):
    path = str(tmp_path / "s.json")
    files.save_settings(path, {"retrieval": {"lexical_top_k": 5}, "own": 1})
    s = files.settings(path)
    assert s["retrieval"]["lexical_top_k"] == 5 and s["retrieval"]["vector_top_k"] == 30 and s["own"] == 1 and files.settings(None) == files.DEFAULTS
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "a" / "pyproject.toml").write_text("")
    assert files.repository_root(str(deep)) == str(tmp_path / "a")
    assert files.below("/r", "/r/a\\b.py") == "a/b.py" and files.below("/r", "x/../y.py") == "y.py" and files.below("/r", "/other/x.py") is None


def test_git(tmp_path):
    import subprocess

    root = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.email=a@b.c", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "."), run("commit", "-m", "one")
    (tmp_path / "a.py").write_text("x = 2\n"), (tmp_path / "b.py").write_text("")
    assert files.git_branch(root) == "main" and files.git_paths(root) == ["a.py", "b.py"] and "+x = 2" in files.git_diff(root) and "a.py" in files.git_diff(root, stat=True)
    run("add", "."), run("commit", "-m", "two")
    assert files.git_between(root, "HEAD~1", "HEAD") == ["a.py", "b.py"] and files.git_paths(str(tmp_path / "none")) == []


def test_answer_lines():
    from cairn.__main__ import answer_lines

    rows = [{"name": "Pay", "path": "a.py", "start_line": 3}, {"name": "Bare", "path": "b.py", "start_line": None}, {"name": "No", "path": None}, {"kind": "class", "n": 2}]
    assert answer_lines("services", rows) == ["services: 4", "", "- Pay (a.py:3)", "- Bare (b.py)", "- No", '- {"kind": "class", "n": 2}']
    assert answer_lines("tests", [], "old") == ["! old", "", "tests: 0", "", "(no results)"]
    grouped = [{"owner": o, "owner_kind": k, "name": n, "path": "c.py", "start_line": 1} for o, k, n in (("A", "class", "x"), ("A", "class", "y"), ("B", None, "z"))]
    assert answer_lines("grouped_routes", grouped, most=2) == ["grouped_routes: more than 2, the first 2", "", "A [class]", "  - x (c.py:1)", "  - y (c.py:1)"]
    assert answer_lines("grouped_routes", grouped)[-2:] == ["B", "  - z (c.py:1)"]
