"""Every registered query that has SQL, against DuckDB on the smoke tables."""

import os

import duckdb
import pytest

from cairn.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(found):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(registry.oracle_sql()[name]).columns)
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_mention_words_equals_brute_force(spark, tmp_path):
    items = [(1, "the cat  sat"), (2, "a containment of it"), (3, None), (4, ""), (1, "again dog")]
    docs = [(5, "the the cat"), (6, "it is a containment"), (7, ""), (8, None), (9, "  ")] + [(i, "the dog") for i in range(20, 60)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, a in items:
        for d, b in docs:
            if n := len({*(a or "").split(" ")} & {*(b or "").split(" ")} - {""}):
                want[i, d] = want.get((i, d), 0) + n
    got = {(r.item_id, r.doc_id): r.n_shared for r in registry.queries()["mention_words"](spark, str(tmp_path)).collect()}
    assert got == want and got[1, 5] == 2 and got[1, 20] == 2 and got[2, 6] == 3


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
