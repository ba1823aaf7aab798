"""Spelling variants, substring dedup and phrase collocations against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import collocations, substring_dedup, variants

SCHEMA = "doc_id long, text string, lang string, n long, anchor long, word string"


def rows(texts, langs=("en", None, "de")):
    return [(i, t, langs[i % len(langs)], 1, 2, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_every_near_pair_lies_in_one_partition():
    rng = random.Random(3)
    for _ in range(150):
        words = sorted({"".join(rng.choice("abt") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(0, 60))})
        want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))
        assert sorted(tuple(sorted(p)) for p in variants.near_words(words)) == want
        found = []
        for most in range(3, 10):
            cuts = sorted({0, most, *(rng.randint(0, most) for _ in range(2))})
            for lo, hi in zip(cuts, cuts[1:]):
                groups = {}
                for w in words:
                    if most - 1 <= len(w) <= most and len(w) >= max(lo, most - hi):
                        groups.setdefault((w[:lo], w[len(w) - most + hi :]), []).append(w)
                for some in groups.values():
                    found += [tuple(sorted((some[i], some[j]))) for i, j in variants.partition_pairs(some, most, lo, hi)]
        assert sorted(found) == want


def brute_variants(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    partners = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, some in partners.items():
        if some and n[best := min(some, key=lambda x: (-n[x], x))] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(partners[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("limit, width", [(2000, 200), (3, 2)])
def test_variants_equal_brute_force(spark, monkeypatch, limit, width):
    rng = random.Random(7)
    stems = ["receive", "separate", "Überraschung", "accommodate", "occurrence", "aaaaaaaaa", "necessary÷"]
    words = []
    for s in stems:
        words += [s] * 300
        for _ in range(12):
            k = rng.randrange(len(s))
            words += [s[:k] + rng.choice(["", "x", s[k] * 2]) + s[k + 1 :]] * rng.choice([1, 2, 4, 25])
    long = "z" * 3000
    words += [long, long, long[:1500] + "y" + long[1501:], long[:1500] + "y" + long[1501:], "short", "short"]
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)] + [None, "", "a1b2"]
    table = [*rows(texts), (None, texts[0], "en", 1, 2, "x"), (3, texts[3], "en", 1, 2, "x")]
    counts = variants.near_counts
    monkeypatch.setattr(variants, "near_counts", lambda w: counts(w, limit, width, per_task=20))
    found = variants.spelling_variants(spark.createDataFrame(table, SCHEMA))
    assert {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants([r[:2] for r in table])


def test_variants_follow_chains(spark):
    words = ["abcdefgh"] * 2 + ["abcdefgx"] * 40 + ["abcdefyx"] * 900
    found = variants.roots(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("p", "e")], "word string, form string"))[0]
    assert {tuple(r) for r in found.collect()} == {("a", "e"), ("b", "e"), ("c", "e"), ("d", "e"), ("p", "e")}
    table = spark.createDataFrame([(k, w, "en", 1, 2, "x") for k, w in enumerate(words)], SCHEMA)
    assert {tuple(r) for r in variants.spelling_variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(enumerate(words))


def brute_repeats(docs):
    """By (doc_id, text): n_words, n_removed and the kept text."""
    seen, out = {}, {}
    for doc_id, tie, text in sorted({((-(2**63)) if d is None else d, tie, t or "") for d, tie, t in docs}):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            else:
                seen[key] = True
        out[doc_id, text] = len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)
    return out


def check_repeats(spark, table):
    docs = spark.createDataFrame(table, SCHEMA).repartition(5)
    tied = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text").collect()
    want = brute_repeats([tuple(r) for r in tied])
    got = substring_dedup.without_repeats(docs)
    want_rows = sorted((-(2**63) if r[0] is None else r[0], *want[-(2**63) if r[0] is None else r[0], r[2] or ""]) for r in tied)
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == want_rows


def test_repeats_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "the", "The"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 21, 35, 60, 300]))] for _ in range(12)]
    texts = []
    for _ in range(90):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            words += p[a : a + rng.choice([10, 20, 40, 400])] if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 50))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    texts += [None, "", "  ", "a " * 19, "a " * 20, "a " * 21, "ab " * 700, " ".join(vocabulary) * 3, texts[0], texts[1] + " x"]
    check_repeats(spark, [*rows(texts), (None, texts[2], "en", 1, 2, "x"), (None, texts[5], "en", 1, 2, "x"), (3, texts[3], "en", 1, 2, "x"), (3, texts[4] + " and more", "en", 1, 2, "x")])


def test_one_passage_in_most_documents_spans_blocks(spark):
    """The anchors of a passage that all share fill several blocks, whose new windows are compared over all blocks."""
    passage = " ".join(f"p{k}" for k in range(60))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_repeats(spark, rows([f"a{i} {passage} b{i}" if i % 4 else f"only {i} " * 15 for i in range(200)]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)


def brute_collocations(docs, support, top, share):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= support}
    out = []
    for (lang, p), a in found.items():
        around = [b for (x, q), b in found.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= share * a for b in around):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], k + 1, *x[1:]) for k, x in enumerate(mine)]
    return ranked


@pytest.mark.parametrize("support, top", [(30, 2000), (5, 25), (1, 2000)])
def test_collocations_equal_brute_force(spark, support, top):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)] + ["New", "York", "É", "und"]
    phrases = ["New York City hall", "strong Tea", "in order to", "a a a a a", "ab. cd"]
    texts = []
    for _ in range(60 if support > 1 else 6):
        words = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", " \x0b", "\xa0"]) for w in words))
    table = [*rows(texts), *rows([None, "", " .,; ", "one", "long " * 5000]), (None, texts[0], "fr", 1, 2, "x"), (0, texts[0], "en", 1, 2, "x")]
    found = collocations.collocations(spark.createDataFrame(table, SCHEMA).repartition(6), support, top)
    got = sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(brute_collocations([(r[2], r[1]) for r in table], support, top, 80)) and got


def test_a_crowded_bitmap_loses_nothing(spark):
    texts = [f"alpha beta w{i % 7} gamma delta x{i}" for i in range(200)]
    found = collocations.collocations(spark.createDataFrame(rows(texts), SCHEMA).repartition(3), 10, bits=9)
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == sorted(brute_collocations([(r[2], r[1]) for r in rows(texts)], 10, 2000, 80))


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 9_000_000_000_000, 9_000_000_000_001, 9_100_000_000_000
    got = spark.range(1).select(F.expr(collocations.SCORE.format(a=f"{a}L", parts=f"{l}L + {r}L")).alias("s")).first().s
    assert got == 2000000 * a // (l + r)


def test_empty_tables(spark, empty):
    assert not variants.spelling_variants(empty).collect()
    assert not substring_dedup.without_repeats(empty).collect()
    assert not collocations.collocations(empty).collect()


def test_registered_queries_agree_with_their_digests(spark):
    from cairn.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.op12_substring_dedup(spark, sf)
    kept = {r.doc_id: r.kept for r in substring_dedup.without_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert {r.doc_id: r.kept_sha256 for r in got.collect()} == {d: hashlib.sha256(k.encode()).hexdigest() for d, k in kept.items()}


def test_collocations_leave_a_task_in_small_batches():
    text = " ".join(f"w{i}" for i in range(300_000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text]), pa.array([3])], ["lang", "text", "shard"])
    made = list(collocations._mining((1,), None, 2)(iter([batch])))
    assert sum(b.num_rows for b in made) == 300_000 and max(b.num_rows for b in made) <= 100_000
    whole = collocations.Bitmap(9, [(i, b"\xff") for i in range(64)])
    exact = list(collocations._exact({2: type("B", (), {"value": whole})})(iter([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])])))
    found = [x for b in exact for x in b.column(1).to_pylist() if x]
    assert found and len(found) == len(set(found)) == 299_999 and max(b.num_rows for b in exact) <= 100_000
