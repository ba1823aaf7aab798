"""The registered queries of the training-data operators, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, lm, near_dup, packing, pii, quality, substring_dedup, token_counts, token_files, toxicity, variants, warc
from ._base import table
from .encoding import public_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=80)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_token_counts, op3_lm_scores, op4_near_duplicates, op5_quality_rules, op6_toxicity, op7_decontamination, op8_warc, op9_token_files, op10_packing, op11_spelling_variants, op12_substring_dedup, op13_collocations)}


_WARC = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), digests AS (
  SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS d FROM rows
), firsts AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS f FROM digests
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN f IS NOT NULL AND f IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f IS DISTINCT FROM page_id THEN f END AS refers_to
FROM firsts
"""


# crc32 a byte at a time: a table of 256 remainders, then a fold over the bytes of '<doc_id>:<run>'
_VARIANTS = r"""
WITH RECURSIVE bits AS (
  SELECT i AS k, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY k) AS t FROM bits WHERE step = 8
), lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(x, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM lowered
), counted AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS keyed, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(keyed))), lambda i: CAST(('0x' || substr(hex(encode(keyed)), 2 * i + 1, 2)) AS BIGINT))),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) AS h
  FROM counted, crc
), damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), vocab AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS len FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), holes AS MATERIALIZED (
  SELECT word, len, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM vocab, range(40) p(i) WHERE i < len
), pairs AS (
  SELECT a.word AS u, b.word AS v FROM holes a JOIN holes b ON a.i = b.i AND a.len = b.len AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT word, rest FROM holes JOIN (SELECT word AS w FROM vocab) ON rest = w
  UNION
  SELECT rest, word FROM holes JOIN (SELECT word AS w FROM vocab) ON rest = w
), near AS (
  SELECT u, count(*) AS n_near, min({'by': -n, 'word': v}) AS best FROM pairs JOIN vocab ON v = word GROUP BY u
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best.by >= 10 * n THEN best.word END AS form, CASE WHEN -best.by >= 10 * n THEN -best.by END AS form_n
  FROM vocab LEFT JOIN near ON word = u
), walked AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL
  SELECT walked.word, formed.form, step + 1 FROM walked JOIN formed ON root = formed.word WHERE formed.form IS NOT NULL
), ends AS (
  SELECT word AS w, max_by(root, step) AS root FROM walked GROUP BY word
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed JOIN ends ON word = w
"""

_REPEATS = r"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS h, md5(array_to_string(w[i:i + 19], ' ')) AS m
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h, m ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id AS d, unnest(range(i, i + 20)) AS j FROM later
), lists AS (
  SELECT d, list(j) AS js FROM gone GROUP BY d
), kept AS (
  SELECT doc_id, w, CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(js, x[2])), lambda x: x[1]) END AS k
  FROM texts LEFT JOIN lists ON doc_id = d
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

_COLLOCATIONS = r"""
WITH lowered AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_extract_all(x, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS w FROM lowered
), phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 5) s(m))
), counted AS MATERIALIZED (
  SELECT lang, phrase, m, count(*) AS f FROM phrases GROUP BY ALL
), candidates AS MATERIALIZED (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m >= 2 AND f >= 30
), inner_phrases AS (
  SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, a, w, k, unnest(range(1, m - k + 2)) AS i FROM candidates, range(2, 4) s(k) WHERE k < m)
), around AS (
  SELECT lang, phrase, max(a) AS longest FROM inner_phrases GROUP BY ALL
), alone AS (
  SELECT c.* FROM candidates c LEFT JOIN around o ON c.lang = o.lang AND c.phrase = o.phrase WHERE longest IS NULL OR 100 * longest < 80 * a
), cuts AS (
  SELECT c.lang, c.phrase, a, k, p.f AS l, q.f AS r, CAST(2000000 AS HUGEINT) * a // (p.f + q.f) AS score
  FROM (SELECT *, unnest(range(1, alone.m)) AS k FROM alone) c
  JOIN counted p ON p.lang = c.lang AND p.phrase = array_to_string(w[1:k], ' ')
  JOIN counted q ON q.lang = c.lang AND q.phrase = array_to_string(w[k + 1:c.m], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst QUALIFY rank <= 2000
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": _WARC, "op11_spelling_variants": _VARIANTS, "op12_substring_dedup": _REPEATS, "op13_collocations": _COLLOCATIONS}
