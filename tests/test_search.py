"""Trigram postings, inverted lists of vectors, mentions and token parts against scans and loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import code, search, vectors
from cairn.operators import retrieval as H


def test_postings_give_the_rows_of_a_scan(spark):
    rng = random.Random(2)
    rows = [(str(i), f"p{i}", rng.choice([None, "loadOrder", "x"]), rng.choice(["", " ", "_", "%"]).join(rng.choice(["Load", "ÉCOLE", "order", "a_b", "50%", "İx", "ab", "Kelvin", "ﬁn"]) for _ in range(rng.randint(0, 6)))) for i in range(300)] + [("n", "p", None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, path string, symbol string, content string").withColumns({"start_line": F.lit(1), "end_line": F.lit(2)}).repartition(3)
    posted = search.postings(chunks)
    for term in ("load", "ORDER", "école", "d_o", "l%d", "a_b", "ab", "%", "", "50%", "elvin", "_______", "ÉCOLE", "nowhere"):
        want = {r.chunk_id for r in chunks.filter(T.contains_like(F.col("content"), F.lit(term))).collect()}
        assert {r.chunk_id for r in search.like(chunks, posted, term).collect()} == want, term
    for words in (["load"], ["Order", "école"], ["kelvin"], ["ab"], ["get"], ["loadorder", "fin"], []):
        plain, fast = H.word_hits(chunks, words), H.word_hits(chunks, words, postings=posted)
        assert sorted(map(str, plain.collect())) == sorted(map(str, fast.collect())), words
    assert search.term_grams("a_bcd%ef", wild=True) == ["bcd"] and search.candidates(posted, ["ab"]) is None


def test_the_scan_of_postings_is_filtered(spark, tmp_path):
    chunks = spark.createDataFrame([(str(i), f"content number {i}") for i in range(50)], "chunk_id string, content string")
    search.postings(chunks).write.parquet(f"{tmp_path}/p")
    plan = search.candidates(spark.read.parquet(f"{tmp_path}/p"), ["number 7"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def brute(x, queries, k):
    out = {}
    norm = {i: np.array(v, float) / (np.linalg.norm(v) or 1) for i, v in x}
    for q in queries:
        out[q] = [i for i, _ in sorted(((i, float(norm[q] @ v)) for i, v in norm.items()), key=lambda r: (-round(r[1], 9), -r[0]))[:k]]
    return out


def test_all_lists_are_exact_and_some_are_near(spark):
    found = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    x = [(r.id, r.vector) for r in found.collect()]
    asked = [i for i, _ in x if i % 50 == 0]
    at = vectors.centroids(found, 32)
    index, q = vectors.listed(found, at), found.filter("id % 50 = 0")
    assert index.count() == len(x)
    want = brute(x, asked, 10)

    def got(**how):
        out = {}
        for r in vectors.nearest(index, q, at, 10, **how).orderBy("query", "rank").collect():
            out.setdefault(r["query"], []).append(r["id"])
        return out

    assert got() == want and got(block=100) == want  # lists split into parts too
    some = got(probes=20)
    recall = sum(len({*some[i]} & {*want[i]}) for i in asked) / sum(map(len, want.values()))
    assert recall >= 0.9, recall


def test_vectors_of_odd_tables(spark):
    schema = "id long, vector array<float>"
    empty = spark.createDataFrame([], schema)
    assert len(vectors.centroids(empty, 4)) == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], schema)
    at = vectors.centroids(rows, 8)
    got = vectors.nearest(vectors.listed(rows, at), rows.filter("id = 1"), at, 3).orderBy("rank").collect()
    assert [(r.id, round(r.near, 9)) for r in got] == [(2, 1.0), (2, 1.0), (1, 1.0)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_mentions_by_automaton_and_by_join(spark, most):
    rows = [
        ("1", "app/a.py", "load", "def load(): GET /users; load_all(x)", 0), ("2", "app/b.py", "GET /users", "load() and GET /users2", 1), ("3", "tests/c.py", None, "xload load.GET /users", 2), ("4", "d.py", "load_all", "@app.get('/x')\nload_all()", 3),
        ("5", "e.py", "a b", "a b c", 4), ("6", "f.py", "b c", "a b c a b", 5), ("7", "g.py", "--", "a -- b", 6), ("8", "h.py", "load", "", 7), ("9", "i.py", "é load", "é load", 8), ("10", "j.py", None, None, 9), ("11", "k.py", "load", None, -1),
    ]
    chunks = spark.createDataFrame(rows, "id string, path string, symbol string, content string, ordinal long")
    got = {tuple(r) for r in H.mention_edges(chunks, most=most).collect()}
    assert got == {
        ("1", "8", "reference", "load"), ("1", "2", "reference", "GET /users"), ("1", "4", "reference", "load_all"), ("2", "8", "reference", "load"), ("3", "8", "test", "load"), ("3", "2", "test", "GET /users"), ("6", "5", "reference", "a b"), ("5", "6", "reference", "b c"), ("9", "8", "reference", "load"),
    }


def test_token_parts_equal_a_loop(spark):
    rng = random.Random(6)
    rows = [["x" * rng.choice([0, 1, 3, 9, 40]) for _ in range(rng.randint(0, 60))] for _ in range(80)] + [None, [""], ["é" * 400, "a"], ["a"] * 3000]

    def loop(lines, most):
        done, open_ = [], None
        for x in lines:
            both = x if open_ is None else f"{open_}\n{x}"
            if open_ is not None and len(both) // 4 > most:
                done.append(open_)
                open_ = x
            else:
                open_ = both
        return [*done, open_ or ""]

    for most in (0, 1, 10, 800):
        got = spark.createDataFrame([(r,) for r in rows], "lines array<string>").select("lines", code.split_tokens(F.col("lines"), most).alias("parts")).collect()
        assert all((r.parts is None) if r.lines is None else [p.text for p in r.parts] == loop(r.lines, most) and [p.i for p in r.parts] == list(range(len(r.parts))) for r in got)


def test_postings_of_long_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 7)
    rows = [(1, "a😀bc😀"), (2, "ÀbÀb" * 50), (3, "ab"), (4, ""), (5, None), (6, "x\x00y\n%"), (7, "İSTANBUL Straße ΣΑΣ")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").withColumn("path", F.lit("p")).coalesce(1)
    got = search.postings(chunks, "path")
    assert got.columns == ["gram", "chunk_id", "path"] and got.schema["chunk_id"].dataType.typeName() == "long"
    lows = {r.chunk_id: r.low for r in chunks.select("chunk_id", F.lower("content").alias("low")).collect()}
    ascii_ = lambda x: "".join(c.lower() if c < "\x80" else c for c in x)
    want = sorted({(t[k : k + 3], i, "p") for i, x in rows for t in (ascii_(x or ""), lows[i] or "") for k in range(len(t) - 2)})
    assert sorted(map(tuple, got.collect())) == want


def test_pieces_of_a_text_share_no_posting(monkeypatch):
    whole = search._distinct([b"abcdefgabcdefg" * 9, "éab".encode()])
    monkeypatch.setattr(search, "PIECE", 5)
    assert sorted(search._distinct([b"abcdefgabcdefg" * 9, "éab".encode()])) == sorted(whole) and len(set(whole.tolist())) == len(whole)


def test_postings_made_on_the_way_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("some Text "), "id").alias("content"))
    posted = search.postings(chunks).mapInArrow(noted, "gram string, chunk_id long")
    n = posted.count()
    before = made.value
    found = search.like(chunks, posted, "me_tEX", keep=lambda ids: ids.localCheckpoint())
    assert found.count() == 3000 and made.value - before == n
