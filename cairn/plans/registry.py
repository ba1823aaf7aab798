"""The registered queries: each operator over the whole driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import patches
from cairn.operators import code
from cairn.operators import embedding as E
from cairn.operators import relational as R
from cairn.operators import retrieval as H
from cairn.operators import search as S
from cairn.operators import vectors as V
from cairn.plans import planner, prompts
from cairn.streaming import delays, trees

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader as a query of (spark, sf_dir)."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _files(t) -> DataFrame:
    """documents as files."""
    return t("documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), "lang", "n_chars", "text")


_L = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  CASE lower(regexp_extract(url, '(\\.[a-z]+)$', 1)) WHEN '.com' THEN NULL WHEN '.py' THEN 'python' WHEN '.xml' THEN 'xml' WHEN '.js' THEN 'javascript' END AS language FROM pages""")
def scan_language_map(t):
    return t("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), T.detect_language(F.col("url")).alias("language"))


@query("""SELECT doc_id, sha256(text) AS file_hash, substr(sha256(source || '/' || doc_id || '::file::1::0'), 1, 24) AS chunk_id FROM documents""")
def content_hash(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), T.chunk_id(F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.lit(None).cast("string"), F.lit(1), F.lit(0)).alias("chunk_id"))


@query("""SELECT d.doc_id, sha256(d.text) AS h FROM documents d LEFT JOIN (SELECT item_id AS doc_id, sha256(text) AS old FROM benchmark) b USING (doc_id) WHERE sha256(d.text) IS DISTINCT FROM old""")
def hash_gate_changed(t):
    new = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return R.changed(new, t("benchmark").select(F.col("item_id").alias("doc_id"), F.sha2("text", 256).alias("h")), "doc_id", "h")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_latest_wins(t):
    return R.latest(t("events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


_PRIORITY = "CASE event_type WHEN 'purchase' THEN 30 WHEN 'signup' THEN 20 ELSE 10 END"
_QUEUE = f"SELECT user_id AS path, arg_max(event_type, (ts, event_id)) AS event_type, max({_PRIORITY}) AS priority, max(ts) AS created_at, 'pending' AS status FROM events GROUP BY user_id"


def _queue(t):
    return R.queue_compacted(t("events").select(F.col("user_id").alias("path"), "event_type", F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.expr(_PRIORITY).alias("priority")))


@query(_QUEUE)
def queue_upsert_max_priority(t):
    return _queue(t)


@query(f"SELECT path, event_type, priority, created_at, status FROM ({_QUEUE}) ORDER BY priority DESC, created_at, path LIMIT 10")
def queue_claim_topn(t):
    return R.claim(_queue(t), 10)


@query("""SELECT d.doc_id, d.source, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)""")
def soft_delete_cascade(t):
    return R.without(t("documents").select("doc_id", "source", "n_chars"), t("labels").filter("quality = 0").select("doc_id"), "doc_id")


@query("""SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13' ORDER BY p_partkey LIMIT 20""")
def find_exact(t):
    return t("part").filter("p_brand = 'Brand#13'").select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


@query(f"""SELECT doc_id, source FROM documents WHERE {_L.format("text")} LIKE {_L.format("'%TH_Re%'")}""")
def find_like(t):
    return t("documents").filter(T.contains_like(F.col("text"), F.lit("TH_Re"))).select("doc_id", "source")


@query("""SELECT doc_id FROM (SELECT doc_id, string_split(lower(text), ' ') AS tags FROM documents) WHERE list_contains(tags, 'the') AND NOT list_contains(tags, 'idiot')""")
def tag_contains(t):
    tags = F.split(F.lower("text"), " ")
    return t("documents").filter(F.array_contains(tags, "the") & ~F.array_contains(tags, "idiot")).select("doc_id")


@query("""SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def join_symbols_files(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("""SELECT c.c_custkey, count(*) AS n_lines, count(DISTINCT l.l_suppkey) AS n_suppliers FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def edges_3way(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer""")
def changed_flag(t):
    marks = t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("m", F.lit(True))
    return t("customer").join(marks, "c_custkey", "left").select("c_custkey", F.col("m").isNotNull().alias("has_orders"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def changed_semi(t):
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 1)""")
def orphan_anti(t):
    """Customers without an order of one kind, as live files without a scanned one."""
    return R.without(t("customer").select("c_custkey"), t("orders").filter("o_orderkey % 10 = 1").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH spans AS (SELECT user_id, event_id AS name, event_id AS b, event_id + 400 AS e FROM events WHERE event_type = 'signup'),
points AS (SELECT event_id AS id, user_id, event_id AS x FROM events WHERE event_type = 'click')
SELECT id, arg_min(s.name, (e - b, b, s.name)) AS owner FROM points p JOIN spans s ON p.user_id = s.user_id AND b <= x AND x <= e GROUP BY id""")
def enclosing_interval(t):
    e = t("events")
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("name"), F.col("event_id").alias("start"), (F.col("event_id") + 400).alias("end"))
    return R.enclosing(e.filter("event_type = 'click'").select(F.col("event_id").alias("id"), "user_id", F.col("event_id").alias("at")), spans, "user_id")


@query("""WITH s AS (SELECT DISTINCT user_id, event_id AS start FROM events) SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS next_start FROM s""")
def next_code_line_asof(t):
    return R.next_start(t("events").select("user_id", F.col("event_id").alias("start")), "user_id", "start")


@query("""WITH b AS (SELECT item_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM benchmark), k AS (SELECT item_id, w FROM b WHERE length(w) >= 9),
d AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents)
SELECT k.item_id, d.doc_id, count(*) AS n_shared FROM k JOIN d USING (w) GROUP BY ALL""")
def mention_theta(t):
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    return words(t("benchmark"), "item_id").filter(F.length("w") >= 9).join(words(t("documents"), "doc_id"), "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("n_shared"))


@query()
def mention_words(t):
    """As mention_theta with words of every length; frequent ones are spread by document, so no word is one task."""
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split("text", " "))).alias("w")).filter("w <> ''")
    items = words(t("benchmark"), "item_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    docs = words(t("documents"), "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    return items.join(docs, ["w", "salt"]).groupBy("item_id", "doc_id").agg(F.count("*").alias("n_shared"))


@query(f"""WITH e AS (SELECT p_partkey, p_name FROM part WHERE p_name = 'no such part'), l AS (SELECT p_partkey, p_name FROM part WHERE {_L.format("p_name")} LIKE '%re%')
SELECT * FROM e UNION ALL SELECT * FROM (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM e) ORDER BY p_partkey LIMIT 50)""")
def fallback_exact_else_like(t):
    return R.exact_else(t("part").select("p_partkey", "p_name"), F.col("p_name") == "no such part", T.contains_like(F.col("p_name"), F.lit("re")), 50, ["p_partkey"])


@query(f"""WITH e AS (SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13') SELECT * FROM (SELECT * FROM e ORDER BY p_partkey LIMIT 50)""")
def fallback_exact(t):
    """The branch where exact rows exist: rows that match in part don't come."""
    p = t("part").select("p_partkey", "p_name", "p_brand")
    return R.exact_else(p, F.col("p_brand") == "Brand#13", T.contains_like(F.col("p_brand"), F.lit("brand#1")), 50, ["p_partkey"]).select("p_partkey", "p_name")


@query("""SELECT c_custkey, coalesce(r_name, n_name, '?') AS owner FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'""")
def parent_chain(t):
    up = t("region").filter("r_name <> 'ASIA'")
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(up, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", F.coalesce("r_name", "n_name", F.lit("?")).alias("owner"))


@query("""SELECT coalesce(event_type, '(unknown)') AS kind, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, kind""")
def counts_by_kind(t):
    return t("events").groupBy(F.coalesce("event_type", F.lit("(unknown)")).alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@query("""SELECT count(*) AS n_files, count(*) FILTER (lang = 'en') AS n_en, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS size_bytes, CAST(coalesce(sum(n_chars), 0) // 4 AS BIGINT) AS repo_tokens,
CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) AS BIGINT) AS context_tokens FROM documents""")
def repo_tokens(t):
    return t("documents").agg(F.count("*").alias("n_files"), F.count_if(F.col("lang") == "en").alias("n_en"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size_bytes"), F.expr("coalesce(sum(n_chars), 0) div 4").alias("repo_tokens"), F.sum(T.context_tokens(F.col("text"))).alias("context_tokens"))


@query("""SELECT doc_id, CAST(format('{:.1f}', greatest(0.0, least(100.0, (1 - (length(text) // 4) / 5000.0::DOUBLE) * 100))::DOUBLE) AS DOUBLE) AS reduction FROM documents""")
def token_reduction(t):
    return t("documents").select("doc_id", T.reduction(F.lit(5000.0), F.expr("length(text) div 4").cast("double")).alias("reduction"))


_SOURCES = "CASE event_type WHEN 'click' THEN 'lexical' WHEN 'purchase' THEN 'symbol' WHEN 'signup' THEN 'graph' WHEN 'error' THEN 'vector' ELSE 'symbol_partial' END"
_WEIGHT_SQL = "CASE source WHEN 'lexical' THEN 2.0 WHEN 'symbol' THEN 5.0 WHEN 'graph' THEN 2.5 WHEN 'vector' THEN 1.0 ELSE 3.5 END"


@query(f"""WITH c AS (SELECT user_id AS chunk_id, event_id AS ordinal, {_SOURCES} AS source, value AS base, event_type AS reason FROM events),
f AS (SELECT chunk_id, reason, min(ordinal) AS o FROM c GROUP BY ALL)
SELECT c.chunk_id, min(ordinal) AS ordinal, arg_max(source, ({_WEIGHT_SQL}, -ordinal)) AS source, max(base) AS base, any_value(g.reasons) AS reasons
FROM c JOIN (SELECT chunk_id, string_agg(reason, ',' ORDER BY o) AS reasons FROM f GROUP BY chunk_id) g USING (chunk_id) GROUP BY c.chunk_id""")
def dedup_merge_candidates(t):
    c = t("events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("ordinal"), F.expr(_SOURCES).alias("source"), F.col("value").alias("base"), F.col("event_type").alias("reason"))
    return R.merged(c, H.WEIGHTS).withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS owner, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS items FROM pages GROUP BY 1 ORDER BY owner""")
def group_by_owner(t):
    p = t("pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("owner"), "page_id")
    return p.groupBy("owner").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("items")).orderBy("owner")


@query("""WITH s AS (SELECT doc_id, n_chars, source, lang, (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'und') AS INT) + CAST(contains(lower(text), 'scum') AS INT) + CAST(contains(lower(text), 'de la') AS INT)) / 4.0::DOUBLE AS coverage FROM documents)
SELECT doc_id, coverage, CAST(format('{:.2f}', 0.35::DOUBLE + CASE WHEN n_chars / 500.0::DOUBLE >= 8 THEN 0.25::DOUBLE WHEN n_chars / 500.0::DOUBLE >= 4 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN source = 'src1' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN lang = 'en' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE * coverage) AS DOUBLE) AS confidence FROM s""")
def coverage_confidence(t):
    """Each document as a result of its own: its length for the top score, its source for the exact symbol, its language for the file."""
    low = F.lower("text")
    coverage = sum((low.contains(k).cast("int") for k in ("the", "und", "scum", "de la")), F.lit(0)) / 4.0
    d = t("documents").withColumn("coverage", coverage)
    return d.select("doc_id", "coverage", H.confidence_value(F.lit(1), F.col("n_chars") / 500.0, F.col("source") == "src1", F.col("lang") == "en", F.col("coverage")).alias("confidence"))


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark),
h AS (SELECT item_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(w, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) % 256 AS bucket FROM w)
SELECT item_id, bucket, count(*) AS n FROM h GROUP BY ALL""")
def bow_embedding(t):
    w = t("benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("w"))
    return w.select("item_id", (T.fnv1a(F.col("w")) % 256).alias("bucket")).groupBy("item_id", "bucket").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 6) AS sim FROM embeddings, q WHERE vec_id % 3 <> 1)
SELECT vec_id, sim FROM (SELECT * FROM s ORDER BY sim DESC, vec_id DESC LIMIT 30) WHERE sim > 0""")
def vector_topk(t):
    """The operator's search, with vectors of chunks that are gone (a third of them)."""
    e = t("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    chunks = e.filter("chunk_id % 3 <> 1").select("chunk_id", F.lit("f").alias("path"), F.lit(1).alias("start_line"))
    return H.vector_hits(chunks, e, e.filter("chunk_id = 0")).select(F.col("chunk_id").alias("vec_id"), F.round("base", 6).alias("sim"))


@query("""WITH c AS (SELECT page_id, i, substr(html, i, 1) AS c FROM (SELECT page_id, html, unnest(range(1, length(html) + 1)) AS i FROM pages)), m AS (SELECT * FROM c WHERE c IN ('<', '>'))
SELECT page_id, max(d) AS max_depth, min(d) AS min_depth, count(*) AS n_marks FROM (SELECT page_id, sum(CASE c WHEN '<' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM m) GROUP BY page_id""")
def brace_depth(t):
    marks = t("pages").select("page_id", F.posexplode(F.split(F.regexp_replace("html", "[^<>]", ""), "")).alias("i", "c")).filter("c in ('<', '>')")
    deep = R.running_depth(marks, ["page_id"], "i", F.when(F.col("c") == "<", 1).otherwise(-1))
    return deep.groupBy("page_id").agg(F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"), F.count("*").alias("n_marks"))


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations), n AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i][1] || w[i + 1][1] || w[i + 2][1])) AS alias FROM w WHERE len(w) >= 3)
SELECT conv_id, turn, count(*) AS n_aliases, count(DISTINCT alias) AS n_distinct FROM n GROUP BY ALL""")
def ngram_acronyms(t):
    w = t("conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)).alias("w")).filter("size(w) >= 3")
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.transform(F.slice("w", i, 3), lambda x: F.left(x, F.lit(1))), ""))
    return w.select("conv_id", "turn", F.explode(grams).alias("alias")).groupBy("conv_id", "turn").agg(F.count("*").alias("n_aliases"), F.countDistinct("alias").alias("n_distinct"))


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, n_chars // 4 AS cost, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
p(source, k, used, took) AS (SELECT source, k, CAST(cost AS BIGINT), true FROM r WHERE k = 1 UNION ALL SELECT r.source, r.k, p.used + CASE WHEN p.used + r.cost <= 25000 THEN r.cost ELSE 0 END, p.used + r.cost <= 25000 FROM p JOIN r ON r.source = p.source AND r.k = p.k + 1)
SELECT r.source, r.doc_id, r.cost FROM p JOIN r ON p.source = r.source AND p.k = r.k WHERE took""")
def budget_pack(t):
    d = t("documents").select("source", "doc_id", F.expr("n_chars div 4").alias("cost"), (-F.col("n_chars")).alias("o"))
    return R.budget_packed(d, ["source"], ["o", "doc_id"], "cost", 25_000).select("source", "doc_id", "cost")


@query("""WITH c AS (SELECT d.doc_id, 'app/' || d.source || '/' || d.lang || '.py' AS path, d.source AS symbol, CASE WHEN l.toxic = 1 THEN 'test' WHEN l.quality = 1 THEN 'route' WHEN l.quality = 0 THEN 'config' ELSE 'class' END AS kind, lower(d.text) AS body,
  CASE d.lang WHEN 'en' THEN 'symbol' WHEN 'de' THEN 'lexical' WHEN 'fr' THEN 'graph' ELSE 'other' END AS src FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE src WHEN 'symbol' THEN 5.0::DOUBLE WHEN 'lexical' THEN 2.0 WHEN 'graph' THEN 2.5 ELSE 1.0 END + 0.5::DOUBLE + CASE WHEN symbol = 'src1' THEN 6.0 ELSE 0.0 END + CASE WHEN symbol <> 'src1' AND (contains(symbol, 'src1') OR contains('src1', symbol)) THEN 3.0 ELSE 0.0 END
  + CASE WHEN contains(body, 'idiot') OR contains(body, 'src1') OR contains(body, 'src2/fr.py') THEN 3.0 ELSE 0.0 END + CASE WHEN contains(path, 'src2/fr.py') THEN 4.0 ELSE 0.0 END + CASE WHEN path = 'app/src3/en.py' THEN 3.0 ELSE 0.0 END
  + CASE kind WHEN 'test' THEN 2.5 WHEN 'route' THEN 1.5 WHEN 'config' THEN 1.0 ELSE 0.0 END AS score FROM c ORDER BY score DESC, doc_id LIMIT 20""")
def rerank_score(t):
    """Every term of the score, over documents as candidates."""
    marks = t("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    kind = F.when(F.col("toxic") == 1, "test").when(F.col("quality") == 1, "route").when(F.col("quality") == 0, "config").otherwise("class")
    source = F.when(F.col("lang") == "en", "symbol").when(F.col("lang") == "de", "lexical").when(F.col("lang") == "fr", "graph").otherwise("other")
    c = t("documents").join(marks, "doc_id", "left").select("doc_id", F.concat(F.lit("app/"), "source", F.lit("/"), "lang", F.lit(".py")).alias("path"), F.col("source").alias("symbol"), kind.alias("kind"), F.col("text").alias("content"), source.alias("source"), F.lit(0.5).alias("base"), F.array().cast("array<string>").alias("reasons"), F.col("doc_id").alias("ordinal"))
    prompt = prompts.Prompt("", "test_creation", ["src1", "idiot"], ["src2/fr.py"])
    return H.reranked(H.scored(c, prompt, ["app/src3/en.py"])).select("doc_id", "score")


@query(f"""SELECT doc_id, CASE WHEN source = 'src1' THEN 'src1' WHEN contains(source, 'src1') THEN 'src1' WHEN contains({_L.format("text")}, 'src1') THEN 'src1' ELSE 'idiot' END AS keyword,
CASE WHEN source = 'src1' THEN 2.0::DOUBLE WHEN contains(source, 'src1') THEN 1.5 ELSE 1.0 END AS base FROM documents WHERE contains(source, 'src1') OR contains({_L.format("text")}, 'src1') OR contains({_L.format("text")}, 'idiot')
ORDER BY base DESC, doc_id LIMIT 20""")
def lexical_search(t):
    d = t("documents").select("doc_id", "source", "text")
    low = T.ascii_lower(F.col("text"))
    hits = R.lexical(d, ["src1", "idiot"], lambda k: F.col("source") == k, lambda k: F.col("source").contains(k), lambda k: low.contains(k))
    return hits.select("doc_id", "keyword", "base").orderBy(F.desc("base"), "doc_id").limit(20)


@query("""SELECT page_id, lower('GET ' || CASE WHEN p = '' THEN '/' ELSE p END) AS route FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ':([A-Za-z_][A-Za-z0-9_]*)', '{\\1}', 'g'), '/+$', '') AS p FROM pages)""")
def route_normalize(t):
    return t("pages").select("page_id", T.normalize_route(F.lit("GET"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)).alias("route"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'app/' || source ELSE 'app/' || source || '/' || lang END AS root FROM documents""")
def feature_root(t):
    path = F.concat_ws("/", F.lit("app"), "source", F.when(F.col("doc_id") % 2 == 0, "controllers").otherwise(F.col("lang")), F.concat(F.col("doc_id").cast("string"), F.lit(".py")))
    return t("documents").select("doc_id", T.feature_root(path).alias("root"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(p_name, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)))), ',') AS tokens FROM part""")
def ident_tokens(t):
    return t("part").select("p_partkey", F.array_join(F.array_sort(T.identifier_tokens(F.col("p_name"))), ",").alias("tokens"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, l_suppkey + 1000000 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT DISTINCT l_suppkey + 1000000, s_nationkey + 2000000 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
r(node, depth) AS (SELECT 1, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2) SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def khop_calls(t):
    supplier = (F.col("l_suppkey") + 1_000_000).cast("long")
    calls = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").cast("long").alias("src"), supplier.alias("dst")).distinct()
    home = t("supplier").select((F.col("s_suppkey") + 1_000_000).cast("long").alias("src"), (F.col("s_nationkey") + 2_000_000).cast("long").alias("dst"))
    seeds = t("orders").sparkSession.createDataFrame([(1,)], "node long")
    return R.k_hops(calls.unionByName(home), seeds, 2)


_EDGE_KIND = "CASE (o_orderkey % 5) WHEN 0 THEN 'calls' WHEN 1 THEN 'extends' WHEN 2 THEN 'tested_by' WHEN 3 THEN 'routes_to' ELSE 'imports' END"


@query(f"""WITH e AS (SELECT 'c' || o_custkey AS source, 'c' || (o_orderkey % 150) AS target, {_EDGE_KIND} AS edge_type FROM orders), n AS (SELECT 'c' || c_custkey AS name, CAST(c_custkey AS INT) AS ordinal FROM customer WHERE c_custkey <= 20),
r AS (SELECT CASE edge_type WHEN 'calls' THEN 'callees' WHEN 'extends' THEN 'implementations' WHEN 'routes_to' THEN 'routes' END AS role, ordinal, target AS name FROM e JOIN n ON source = n.name
  UNION ALL SELECT CASE edge_type WHEN 'calls' THEN 'callers' WHEN 'tested_by' THEN 'tests' END, ordinal, source FROM e JOIN n ON target = n.name),
d AS (SELECT role, name, min(ordinal) AS o FROM r WHERE role IS NOT NULL GROUP BY ALL) SELECT role, string_agg(name, ',' ORDER BY o, name) AS names FROM d GROUP BY role""")
def dep_context(t):
    """Orders as edges between customers."""
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    edges = t("orders").select(name(F.col("o_custkey")).alias("source"), name(F.col("o_orderkey") % 150).alias("target"), F.expr(_EDGE_KIND).alias("edge_type"))
    names = t("customer").filter("c_custkey <= 20").select(name(F.col("c_custkey")).alias("name"), F.col("c_custkey").cast("int").alias("ordinal"))
    return H.dependency_context(edges, names).withColumn("names", F.array_join("names", ","))


_SYMBOLS = """s AS (SELECT c_custkey AS ordinal, 'n' || c_nationkey AS path, 's' || (c_custkey % 97) AS name, CASE c_custkey % 4 WHEN 0 THEN 'class' ELSE 'method' END AS kind,
  CASE WHEN c_custkey % 4 IN (2, 3) THEN 's' || ((c_custkey + 7) % 113) END AS parent, CAST(c_custkey % 50 * 10 AS INT) AS start_line, CAST(c_custkey % 50 * 10 + c_custkey % 7 * 30 AS INT) AS end_line, c_custkey % 5 = 0 AS tagged FROM customer)"""


@query(f"""WITH {_SYMBOLS}, last AS (SELECT name, arg_max(kind, (path, start_line, ordinal)) AS kind, arg_max(path, (path, start_line, ordinal)) AS file, arg_max(coalesce(parent, ''), (path, start_line, ordinal)) AS up FROM s GROUP BY name),
i AS (SELECT ordinal, name, path, start_line, parent FROM s WHERE kind = 'method'),
e AS (SELECT i.ordinal, arg_min(s.name, (CASE WHEN tagged THEN -1 ELSE 0 END, s.end_line - s.start_line, s.start_line, s.name, s.kind)) AS name FROM i JOIN s ON s.path = i.path AND i.parent IS NULL AND s.start_line <= i.start_line AND i.start_line <= s.end_line AND s.name <> i.name AND s.start_line <> i.start_line GROUP BY i.ordinal)
SELECT i.ordinal, coalesce(nullif(p.up, ''), i.parent, e.name, i.path) AS owner FROM i LEFT JOIN last p ON p.name = i.parent LEFT JOIN e ON e.ordinal = i.ordinal""")
def route_owners(t):
    """Customers as symbols of nations: the owner of each method."""
    s = t("customer").select(
        F.col("c_custkey").alias("ordinal"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), F.concat(F.lit("s"), (F.col("c_custkey") % 97).cast("string")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, "class").otherwise("method").alias("kind"),
        F.when((F.col("c_custkey") % 4).isin(2, 3), F.concat(F.lit("s"), ((F.col("c_custkey") + 7) % 113).cast("string"))).alias("parent"), (F.col("c_custkey") % 50 * 10).cast("int").alias("start_line"), (F.col("c_custkey") % 50 * 10 + F.col("c_custkey") % 7 * 30).cast("int").alias("end_line"),
        F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("controller"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    items = s.filter("kind = 'method'").select("name", "path", "start_line", "end_line", "parent", "ordinal")
    return H.owned(items, s).select("ordinal", "owner")


@query("""WITH c AS (SELECT event_id, user_id, event_type, value FROM events), k AS (SELECT min(event_id) AS event_id FROM c GROUP BY user_id, event_type, sha1(CAST(floor(value) AS BIGINT)::VARCHAR)) SELECT event_id FROM k""")
def chunk_dedup(t):
    c = t("events").withColumn("content", F.floor("value").cast("string"))
    return R.first_of(c, [F.col("user_id"), F.col("event_type"), F.sha1("content")], ["event_id"]).select("event_id")


@query("""SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id + 1000000000 FROM documents""")
def keep_else_all(t):
    """Kept rows; and, with keys that no row has, all of them."""
    d = t("documents").select("doc_id")
    none = t("labels").select((F.col("doc_id") - 1_000_000_000).alias("doc_id"))
    return R.kept_or_all(d, t("labels").filter("toxic = 1").select("doc_id"), "doc_id").unionAll(R.kept_or_all(d, none, "doc_id").select(F.col("doc_id") + 1_000_000_000))


@query("""WITH w AS (SELECT doc_id, lower(text) AS x FROM documents), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(x, '[a-z0-9_]+'))) AS word FROM w) SELECT doc_id, count(*) AS n_words, min(word) AS first_word, max(word) AS last_word FROM t
WHERE length(word) > 2 AND NOT list_contains(string_split('""" + " ".join(sorted(prompts.NOISE)) + """', ' '), word) GROUP BY doc_id""")
def keyword_extract(t):
    """The plain words of the keyword bag of every document."""
    words = t("documents").select("doc_id", F.explode(F.array_distinct(T.plain_keywords(F.col("text"), sorted(prompts.NOISE)))).alias("word"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))


@query("""WITH RECURSIVE w AS (SELECT doc_id, k, word, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS ends FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM documents)),
p(doc_id, part, first, begun) AS (SELECT doc_id, 0, CAST(1 AS BIGINT), CAST(0 AS HUGEINT) FROM w WHERE k = 1
  UNION ALL SELECT doc_id, part + 1, k, ends - length(word) - 1 FROM (SELECT p.doc_id, p.part, w.k, w.ends, w.word, row_number() OVER (PARTITION BY p.doc_id ORDER BY w.k) AS rn FROM p JOIN w ON w.doc_id = p.doc_id AND w.k > p.first AND (w.ends - p.begun - 1) // 4 > 200) WHERE rn = 1),
s AS (SELECT doc_id, part, first, lead(first) OVER (PARTITION BY doc_id ORDER BY part) AS next FROM p),
t AS (SELECT s.doc_id, s.part, string_agg(word, chr(10) ORDER BY k) AS x FROM s JOIN w ON w.doc_id = s.doc_id AND w.k >= first AND (next IS NULL OR w.k < next) GROUP BY ALL)
SELECT doc_id, CAST(part AS INT) AS part, CAST(length(x) AS INT) AS n_chars, sha256(x) AS hash FROM t""")
def token_split(t):
    """Documents cut at their spaces into parts of 200 tokens."""
    parts = t("documents").select("doc_id", F.explode(code.split_tokens(F.split("text", " "), 200)).alias("part"))
    return parts.select("doc_id", F.col("part.i").alias("part"), F.length("part.text").alias("n_chars"), F.sha2("part.text", 256).alias("hash"))


_TWO = "[A-Za-z0-9_]{4,} [A-Za-z0-9_]{4,}"


@query(f"""WITH s AS (SELECT 'm' || item_id AS "to", item_id, CASE WHEN item_id % 3 = 0 THEN regexp_extract(text, '{_TWO}') ELSE regexp_extract(text, '[A-Za-z0-9_]{{6,}}') END AS symbol FROM benchmark),
l AS (SELECT symbol, arg_max("to", (item_id, "to")) AS "to" FROM s WHERE symbol <> '' GROUP BY symbol),
c AS (SELECT 'd' || doc_id AS "from", source, text FROM documents UNION ALL SELECT 'm' || item_id, 'bench', text FROM benchmark),
w AS (SELECT "from", source, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS word FROM c),
m AS (SELECT "from", source, "to", symbol FROM w JOIN l ON word = symbol
  UNION ALL SELECT "from", source, "to", symbol FROM c JOIN l ON contains(symbol, ' ') AND contains(text, symbol) AND regexp_matches(text, '(^|[^A-Za-z0-9_])' || symbol || '($|[^A-Za-z0-9_])'))
SELECT "from" AS src, "to" AS dst, CASE WHEN source = 'src7' THEN 'test' ELSE 'reference' END AS kind, symbol AS evidence FROM m WHERE "from" <> "to" """)
def chunk_graph_edges(t):
    """Documents and benchmark items as chunks, each item's first long word, or first two words, as its symbol; source 7 as tests."""
    docs = t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("source") == "src7", "tests/src7").otherwise(F.col("source")).alias("path"), F.lit(None).cast("string").alias("symbol"), F.col("text").alias("content"), F.col("doc_id").alias("ordinal"))
    symbol = F.when(F.col("item_id") % 3 == 0, F.regexp_extract("text", _TWO, 0)).otherwise(F.regexp_extract("text", "[A-Za-z0-9_]{6,}", 0))
    items = t("benchmark").select(F.concat(F.lit("m"), F.col("item_id").cast("string")).alias("id"), F.lit("bench").alias("path"), symbol.alias("symbol"), F.col("text").alias("content"), F.col("item_id").alias("ordinal"))
    found = H.mention_edges(docs.unionByName(items)).filter("type <> 'route'")
    return found.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.col("type").alias("kind"), "evidence")


@query("""WITH c AS (SELECT doc_id, 'm' || doc_id % 70 || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.java' END AS leaf, source FROM documents),
files AS (SELECT leaf, arg_max(doc_id, (doc_id, CAST(doc_id AS VARCHAR))) AS "to" FROM c GROUP BY leaf), names AS (SELECT source, max(doc_id) AS "to" FROM c GROUP BY source),
i AS (SELECT doc_id, 'pkg.m' || doc_id % 90 AS name, 'm' || doc_id % 90 AS tail FROM c UNION ALL SELECT doc_id, 'src' || doc_id % 23, 'src' || doc_id % 23 FROM c),
t AS (SELECT i.doc_id, name, coalesce(s."to", ts."to", py."to", jv."to") AS "to" FROM i LEFT JOIN names s ON s.source = tail LEFT JOIN files ts ON ts.leaf = tail || '.ts' LEFT JOIN files py ON py.leaf = tail || '.py' LEFT JOIN files jv ON jv.leaf = tail || '.java')
SELECT CAST(doc_id AS VARCHAR) AS src, CAST("to" AS VARCHAR) AS dst, name AS evidence FROM t WHERE "to" IS NOT NULL AND "to" <> doc_id""")
def import_edges(t):
    """Documents as modules, each of which imports two others by name: as files, or by the last symbol of a name."""
    n = F.col("doc_id")
    path = F.concat(F.lit("lib/m"), (n % 70).cast("string"), F.when(n % 3 == 0, ".py").when(n % 3 == 1, ".ts").otherwise(".java"))
    content = F.concat(F.lit("import pkg.m"), (n % 90).cast("string"), F.lit("\nimport src"), (n % 23).cast("string"), F.lit("\n"))
    chunks = t("documents").select(n.cast("string").alias("id"), path.alias("path"), F.col("source").alias("symbol"), content.alias("content"), n.alias("ordinal"))
    return H.import_edges(chunks)[0].select(F.col("from").alias("src"), F.col("to").alias("dst"), "evidence")


_TERMS = ("Idi_T%", "ía")


@query(" UNION ALL ".join(f"SELECT '{x}' AS term, doc_id FROM documents WHERE {_L.format('text')} LIKE {_L.format(repr('%' + x + '%'))}" for x in _TERMS))
def find_by_postings(t):
    """Terms with wildcards, and one too short for them, through an inverted index of trigrams; the rows are a scan's."""
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    posted = S.postings(chunks)
    keep = lambda ids: ids.checkpoint() if ids.sparkSession.sparkContext.getCheckpointDir() else ids.localCheckpoint()
    return reduce(DataFrame.unionByName, [S.like(chunks, posted, x, keep).select(F.lit(x).alias("term"), F.col("chunk_id").alias("doc_id")) for x in _TERMS])


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS near FROM v q, v WHERE q.vec_id % 50 = 0)
SELECT query, CAST(rank AS INT) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY near DESC, id DESC) AS rank FROM s) WHERE rank <= 10""")
def vector_all_lists(t):
    """Every fiftieth vector against all, by inverted lists that are all probed: the exact search."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    at = V.centroids(e, 32)
    return V.nearest(V.listed(e, at), e.filter("id % 50 = 0"), at, 10).select("query", "rank", "id")


@query()
def vector_lists(t):
    """As vector_all_lists with 20 of 32 lists probed: these vectors hardly form clusters. Tests measure how many true neighbours it finds."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    at = V.centroids(e, 32)
    return V.nearest(V.listed(e, at), e.filter("id % 50 = 0"), at, 10, probes=20).select("query", "rank", "id")


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark),
h AS (SELECT item_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(w, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) % 256 AS b FROM w), n AS (SELECT item_id, b, count(*)::DOUBLE AS n FROM h GROUP BY ALL)
SELECT item_id, count(*) AS n_buckets, round(max(n) / sqrt(sum(n * n)), 6) AS top, round(sum(n * (b + 1)) / sqrt(sum(n * n)), 4) AS moment FROM n GROUP BY item_id""")
def embed_bag_of_tokens(t):
    v = E.bag_of_tokens(t("benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content")))
    x = v.select(F.col("chunk_id").alias("item_id"), F.posexplode("vector").alias("b", "x")).filter("x > 0")
    return x.groupBy("item_id").agg(F.count("*").alias("n_buckets"), F.round(F.max("x"), 6).alias("top"), F.round(F.sum(F.col("x") * (F.col("b") + 1)), 4).alias("moment"))


@query("""WITH p AS (SELECT page_id, 'app/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/x/' || page_id || '_' || CASE page_id % 3 WHEN 0 THEN 'dto' WHEN 1 THEN 'router' ELSE 'userservice' END || '.py' AS path FROM pages)
SELECT page_id, len(string_split(path, '/')) - 1 AS n_folders, page_id % 3 <> 1 AS supports FROM p""")
def feature_support(t):
    role = F.when(F.col("page_id") % 3 == 0, "dto").when(F.col("page_id") % 3 == 1, "router").otherwise("userservice")
    path = F.concat(F.lit("app/"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.lit("/x/"), F.col("page_id").cast("string"), F.lit("_"), role, F.lit(".py"))
    return t("pages").select("page_id", F.size(H.ancestors(path)).cast("long").alias("n_folders"), H.support_file(path).alias("supports"))


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("""SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels""")
def set_except(t):
    return t("documents").select(F.col("doc_id").alias("k")).subtract(t("labels").select("doc_id"))


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def set_intersect(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM f) SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM g GROUP BY user_id, s""")
def debounce_sessions(t):
    return R.sessions(t("events"), "user_id", "ts", "1 hour")


@query("""SELECT c.event_id AS change_id, CAST(c.user_id AS VARCHAR) AS path, c.ts AS changed_at, min(r.ts) AS ran_at, CAST(floor((epoch_us(min(r.ts)) - epoch_us(c.ts)) / 1000000) AS BIGINT) AS delay_s
FROM events c LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') r ON r.user_id = c.user_id AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 12 HOUR WHERE c.event_type = 'error' GROUP BY c.event_id, c.user_id, c.ts""")
def change_delays(t):
    """Each error as a change, each purchase as a run of its user: the join that `streaming.delays` makes of two streams."""
    events = t("events").select("event_id", F.col("user_id").cast("string").alias("path"), "ts", "event_type")
    changes = events.filter("event_type = 'error'").select(F.col("event_id").alias("change_id"), "path", F.col("ts").alias("changed_at"))
    return delays.served(changes, events.filter("event_type = 'purchase'").select("path", F.col("ts").alias("ran_at")), 12 * 3600)


def _case(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in pairs) + f" ELSE '{default}' END"


_PLAIN = "NOT regexp_matches(text, '[\"''`][^\"''`]+[\"''`]|/[A-Za-z0-9_{}/-]+')"
# written out apart from the router's own tables
_ROUTE = f"""CASE WHEN regexp_matches(q, 'explain|describe|architecture|why|refactor|suggest|compare|generate|implement|fix|should i|walk me through|overview|how does|how do|design|trade-off|tradeoff|pros and cons') THEN 'ai_required'
WHEN NOT regexp_matches(q, 'how many|count|list|show|find|which|all |number of|what are|get all|display|where|group') THEN 'ai_required'
WHEN regexp_matches(q, '^where(''s| is)') THEN 'where_is' WHEN regexp_matches(q, '(which|what) package|package contains') THEN 'which_package' WHEN regexp_matches(q, '^find |symbol by name|methods named') THEN 'find_symbol'
WHEN regexp_matches(q, 'count symbols|symbols by type|count by type|symbol counts') AND {_PLAIN} THEN 'counts_by_kind'
WHEN (regexp_matches(q, 'grouped by|for each|under each|per ') OR (contains(q, 'group') AND contains(q, ' by '))) AND regexp_matches(q, 'route|endpoint|handler') AND {_PLAIN} THEN 'grouped_routes'
WHEN contains(q, 'controller') AND {_PLAIN} THEN 'controllers' WHEN contains(q, 'service') AND {_PLAIN} THEN 'services' WHEN contains(q, 'repositor') AND {_PLAIN} THEN 'repositories'
WHEN regexp_matches(q, '@component|components|spring component') AND {_PLAIN} THEN 'components' WHEN regexp_matches(q, 'route|endpoint|rest api') AND {_PLAIN} THEN 'routes'
WHEN regexp_matches(q, 'test class|test method|test cases|tests|@test') AND {_PLAIN} THEN 'tests' WHEN regexp_matches(q, 'extend|subclass|inherit') AND {_PLAIN} THEN 'extends' WHEN contains(q, 'import') THEN 'imports' ELSE 'ai_required' END"""
_INTENT = _case(
    [(n, "regexp_matches(p, '[^a-z0-9_](" + "|".join(c for c in cues if c.isalnum()) + ")[^a-z0-9_]')" + "".join(f" OR contains(p, '{c}')" for c in cues if not c.isalnum())) for n, cues in planner.INTENTS], "question")


@query(f"SELECT conv_id, turn, {_ROUTE} AS handler FROM (SELECT *, lower(trim(text)) AS q FROM conversations)")
def local_planner_route(t):
    return t("conversations").select("conv_id", "turn", planner.route_column(F.col("text")).alias("handler"))


_QUESTION = "'list the ' || CASE (conv_id + turn) % 7 WHEN 0 THEN 'routes grouped by controller' WHEN 1 THEN 'controllers' WHEN 2 THEN 'tests' WHEN 3 THEN 'endpoints for each service' WHEN 4 THEN 'imports' WHEN 5 THEN 'routes under each \"x\"' ELSE 'handlers per module' END || ' of ' || role"


@query(f"SELECT conv_id, turn, {_ROUTE} AS handler FROM (SELECT conv_id, turn, {_QUESTION} AS text, lower({_QUESTION}) AS q FROM conversations)")
def grouped_planner_route(t):
    """Questions of every kind of grouping, one for each turn."""
    return t("conversations").select("conv_id", "turn", planner.route_column(F.expr(_QUESTION)).alias("handler"))


@query(f"SELECT conv_id, turn, {_INTENT} AS intent FROM (SELECT *, ' ' || lower(text) || ' ' AS p FROM conversations)")
def intent_classify(t):
    return t("conversations").select("conv_id", "turn", planner.intent_column(F.col("text")).alias("intent"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(translate(text, 'TE', '+-'), chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++ ')) AS n_added, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '--- ')) AS n_removed FROM l GROUP BY doc_id""")
def patch_stats(t):
    """Added and removed lines, with the texts' capital T and E read as plus and minus."""
    line = t("documents").select("doc_id", F.explode(F.split(F.translate("text", "TE", "+-"), "\n")).alias("line")).withColumn("kind", patches.line_kind(F.col("line")))
    return line.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("kind") == "+").alias("n_added"), F.count_if(F.col("kind") == "-").alias("n_removed"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, len(json_keys(props)) AS n_keys FROM events""")
def json_columns(t):
    m = F.from_json("props", "map<string,string>")
    return t("events").select("event_id", F.coalesce(F.element_at(m, "k"), F.lit("")).alias("k"), F.size(m).cast("long").alias("n_keys"))


@query("""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def ordered_distinct(t):
    w = Window.partitionBy(F.lower(F.trim("source"))).orderBy("doc_id")
    return t("documents").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("doc_id", "lang")


@query("""WITH o AS (SELECT o_custkey, max(o_totalprice) AS top, count(*) FILTER (o_orderstatus = 'F') AS n_f FROM orders GROUP BY o_custkey),
old AS (SELECT 'c/' || c_custkey AS path, c_nationkey::BIGINT AS size, c_acctbal AS mt FROM customer),
new AS (SELECT CASE WHEN top > 460000 THEN 'moved/' ELSE 'c/' END || c_custkey AS path, c_nationkey + CASE WHEN n_f > 5 THEN 1::BIGINT ELSE 0 END AS size, c_acctbal AS mt FROM customer JOIN o ON c_custkey = o_custkey),
b AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN n.size IS DISTINCT FROM o.size OR n.mt IS DISTINCT FROM o.mt THEN 'modified' END AS event_type,
  coalesce(n.size, o.size) AS size, coalesce(n.mt, o.mt) AS mt FROM old o FULL JOIN new n ON o.path = n.path),
m AS (SELECT min(path) FILTER (event_type = 'created') AS path, min(path) FILTER (event_type = 'deleted') AS moved_from FROM b WHERE event_type IN ('created', 'deleted') GROUP BY size, mt
  HAVING count(*) FILTER (event_type = 'created') = 1 AND count(*) FILTER (event_type = 'deleted') = 1)
SELECT b.path, CASE WHEN m.path IS NULL THEN event_type ELSE 'renamed' END AS event_type, moved_from FROM b LEFT JOIN m ON b.path = m.path WHERE event_type IS NOT NULL""")
def snapshot_changes(t):
    """Customers as a tree before and after their orders: those with dear ones have moved, those without any are gone."""
    o = t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))
    size, key = F.col("c_nationkey").cast("long"), F.col("c_custkey").cast("string")
    snap = lambda rows, folder, n: rows.select(F.concat(folder, key).alias("path"), n.alias("size_bytes"), F.col("c_acctbal").alias("last_modified_at"))
    now = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    new = snap(now, F.when(F.col("top") > 460000, "moved/").otherwise("c/"), size + F.when(F.col("n_f") > 5, 1).otherwise(0))
    return trees.compared(snap(t("customer"), F.lit("c/"), size), new)
