"""The training-data operators against brute force, with nulls, empty texts, repeated rows, empty tables and extra columns."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import decontaminate, lm, near_dup, packing, pii, quality, token_counts, token_files, toxicity, warc
from cairn.llm.encoding import Encoder, public_path

SCHEMA = "doc_id long, text string, lang string, n_tokens long, u long"
FEW = "a the of to in is on it as be at by or an we he she they was are for with this that from".split()


def words(rng, n):
    return " ".join(rng.choice(FEW) + rng.choice(["", "", "ing", "er", "ly", "tion", "s."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    out = [words(rng, int(rng.integers(1, 120))) for _ in range(60)]
    out += [out[0], out[0].upper(), out[1] + " tail", " ".join(out[2].split()[:-1] + ["x"]), None, "", " \t\n", "one", "two words", "a b\tc\r\nd", "long " * 3000, "é ü ﬁn   nb", "a\nb\na\n\nb", words(rng, 4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 1, 2) for i, t in enumerate(texts)] + [(None, "no id here", "en", 1, 2), (3, texts[3], "en", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def test_pii_base_equals_the_patterns():
    rng = np.random.default_rng(1)
    alphabet = list("ab1.@-+_ (9)25\n")
    for _ in range(4000):
        x = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(k) <= 255 for k in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
            d = re.sub(r"\D", "", m[0])
            if 13 <= len(d) <= 19 and pii.luhn(d):
                want.append(("card", m.start(), m.end()))
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert pii.plain(x) == want, x


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail jo.hn (at) example (dot) com now", "email", "jo.hn (at) example (dot) com"),
        ("x john at example dot com y", "email", "john at example dot com"),
        ("x jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("a j​ohn@ex.com", "email", "j​ohn@ex.com"),
        ("to ｊ＠ｘ．ｃｏｍ", "email", "ｊ＠ｘ．ｃｏｍ"),
        ("call plus one five five five two three four five six seven eight", "phone", "plus one five five five two three four five six seven eight"),
        ("card four one one one 1111 1111 one one one one", "card", "four one one one 1111 1111 one one one one"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("no 4111‑1111‑1111‑1111", "card", "4111‑1111‑1111‑1111"),
    ],
)
def test_pii_disguises_map_back(text, kind, span):
    assert (kind, text.index(span), text.index(span) + len(span)) in pii.found(text)[1]
    assert span not in pii.masked(text)


def disguised(rng):
    """An identifier, and a disguise of it."""
    name = lambda: "".join(rng.choice(list("bcdfglmnprstv"), 2)) + rng.choice(["anna", "olaf", "ines", "ute"])
    digit = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    mail = (name(), name(), rng.choice(["com", "org", "de", "fr", "es"]))
    kind = int(rng.integers(7))
    if kind == 0:
        return "email", f"{mail[0]} {rng.choice(['(at)', '[at]', '{at}', '(AT)'])} {mail[1]} {rng.choice(['(dot)', '[dot]'])} {mail[2]}"
    if kind == 1:
        return "email", "{} at {} dot {}".format(*mail)
    if kind == 2:
        return "email", "{}@{}.{}".format(*mail).translate(str.maketrans("aeo", "аео"))
    if kind == 3:
        return "email", "{}@{}.{}".format(*mail)[:3] + "\u200b" + "{}@{}.{}".format(*mail)[3:]
    if kind == 4:
        return "phone", "plus " + " ".join(digit[x] for x in rng.integers(0, 10, 11))
    if kind == 5:
        return "ip", " dot ".join(" ".join(digit[int(c)] for c in str(rng.integers(1, 255))) for _ in range(4))
    body = [int(x) for x in rng.integers(0, 10, 15)]
    last = next(x for x in range(10) if pii.luhn("".join(map(str, [*body, x]))))
    return "card", " ".join(digit[x] for x in [*body, last])


def test_pii_recall_of_planted_disguises_and_clean_text():
    rng, missed, wrong, n = np.random.default_rng(23), [], [], 600
    for _ in range(n):
        before, (kind, text), after = words(rng, 12).replace("at ", "on "), disguised(rng), words(rng, 12)
        whole = f"{before} : {text} ; {after}"
        a = whole.index(text)
        if (kind, a, a + len(text)) not in pii.found(whole)[1]:
            missed.append((kind, text, pii.found(whole)))
        if pii.found(f"{before} : {after}")[1]:
            wrong.append(before)
    assert len(missed) <= 0.02 * n, missed[:5]
    assert not wrong


def test_pii_leaves_clean_text_alone():
    for x in ("the cat sat at home. dot and point", "one two three blind mice", "Was kostet das? Fünf Euro.", "а это кириллица"):
        assert pii.found(x) == ([], []) and pii.masked(x) == x


@pytest.mark.parametrize(
    "text, span",
    [
        ("write to anna at example.org", "anna at example.org"),
        ("Write to ANNA AT EXAMPLE.ORG!", "ANNA AT EXAMPLE.ORG"),
        ("(anna.berg_2 at mail.example.co.uk).", "anna.berg_2 at mail.example.co.uk"),
        ("correo: ana arroba ejemplo.es, o llame", "ana arroba ejemplo.es"),
        ("à luc arobase exemple.fr.", "luc arobase exemple.fr"),
        ("12345678 at qq.com", "12345678 at qq.com"),
        ("anna_at_example.org", "anna_at_example.org"),
    ],
)
def test_pii_at_in_words_needs_no_other_disguise(text, span):
    want = ("email", text.index(span), text.index(span) + len(span))
    for more in ("", " Call bob (at) example.com", " Аnна"):  # whatever else the text holds
        assert want in pii.found(text + more)[1]
    assert span not in pii.masked(text)


def test_pii_at_in_sentences_is_no_email():
    for x in ("look at example.com", "find us at www.example.org now", "we met at home.Then we left", "it stood at 3.5 percent", "seen at 10.20.30.x", "he ran version 2 at example.com", "stay at foo.barbaz", "error at main.py"):
        for more in ("", " bob (at) example.com"):
            assert all(a >= len(x) for _, a, _ in pii.found(x + more)[1]) and pii.masked(x) == x


def test_pii_long_runs_are_linear():
    pii.found("a" * 300_000), pii.found("1" * 200_000), pii.found("+1" + "(" * 200_000), pii.found("1." * 100_000), pii.found("one " * 40_000)


def test_pii_query(spark, docs, texts, empty):
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(texts):
        base = pii.plain(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert pii.find_pii(empty).count() == 0
    assert pii.mask_pii(docs).columns == docs.columns and pii.mask_pii(docs).filter("text is null").count() == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(texts, name):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(public_path(name)), Encoder(public_path(name), bound=50)
    more = ["a  b", " a", "a ", "a\n b", "it's don't 12 34\n\n5 a\tb", "IİΣ Σ é", "<|endoftext|> x<|endoftext|>y", "'s 't a 's", "\n"]
    for batch in (texts, more, texts):
        for t, x in zip(batch, own.encode(batch), strict=True):
            assert np.frombuffer(x, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library_on_odd_white_space(name):
    """Tabs, line ends, no-break, wide and invisible spaces beside each other, marks from lower-casing, special tokens."""
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(public_path(name)), Encoder(public_path(name), bound=5000), np.random.default_rng(17)
    parts = [*" \n\n", *"   \t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u200b\u2028", "a", "b", "word", "GELDİ", "İ", "é", "ẞ", "Σ", "ı̇", "\u0301", ".", ",", "'s", "1", "_", "<|endoftext|>", "[UNK]", "中", "😀", "ﬁ", "µ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(30_000)] + ["a \tb", "col1 \tcol2", "mot \xa0: x", "a \u3000b", "GELDİ."]
    got = own.encode(texts)
    want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert not [t for t, a, b in zip(texts, got, want, strict=True) if np.frombuffer(a, "<u4").tolist() != b]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_learns_words_apart_from_what_follows_them(name):
    """Punctuation and line feeds beside a word are no new words to encode; a slice of a column has its own texts only."""
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(public_path(name)), Encoder(public_path(name)), np.random.default_rng(23)
    known = ["".join(rng.choice([*"abcdefgéß"], 9)) for _ in range(100)]
    marks = ["", ",", ".", "!)", ":", "'s", "7", "-"]
    texts = ["".join(f"{w}{m}{e}" for w, m, e in zip(rng.choice(known, 400), rng.choice(marks, 400), rng.choice([*"  \n"], 400), strict=True)) + "end" for _ in range(40)]
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.used <= 2 * len(known) + 20  # each word with a space before it and without, what follows words, the line feed
    assert own.encode(pa.array(["before", *texts, None]).slice(1)) == [*got, b""]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library_behind_letters(name):
    """Letters beyond Latin-1, signs among its letters, marks, digits, apostrophes and special tokens behind a word's first letters."""
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(public_path(name)), Encoder(public_path(name), bound=2000), np.random.default_rng(24)
    parts = [*"abcXÉéßÿÀ", *"abcéß", *"×÷ªºµœŁ’«»—中\u0301\u0307İ", *"0¹'.,-<>\x00\x1c", "'s", "'re", "<|endoftext|>", "<|startoftext|>", "ﬁ", "😀", *"  \n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(20_000)]
    want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 1000):
        got = own.encode(texts[k : k + 1000])
        assert not [t for t, a, b in zip(texts[k:], got, want[k:], strict=False) if np.frombuffer(a, "<u4").tolist() != b]


def test_token_counts(docs, texts, empty):
    path = public_path("byte_bpe_50k.json")
    n = sorted(len(x) // 4 for x in Encoder(path).encode([*texts, "no id here", texts[3]]))
    sums = token_counts.token_counts(docs, path).cache()
    got = {r.context_limit: r for r in sums.collect()}
    assert sorted(got) == sorted(set(n))
    for k, r in got.items():
        assert (r.n_docs, r.n_longer, r.tokens_truncated, r.tokens_within) == (n.count(k), sum(x > k for x in n), sum(min(x, k) for x in n), sum(x for x in n if x <= k))
    for limit in (0, 3, 50, 4000, 10**6):
        r = token_counts.at_limit(sums, limit).first()
        assert (r.n_longer, r.tokens_truncated) == (sum(x > limit for x in n), sum(min(x, limit) for x in n))
    assert token_counts.quantile(sums, 0.5).first().length == n[math.ceil(len(n) / 2) - 1]
    assert token_counts.token_counts(empty, path).count() == 0


def test_lm_totals_pass_32_bits():
    """Two chunks with three thousand million of one word each."""
    big, one = np.array([3_000_000_000], np.uint32), np.array([5], np.uint64)
    rows = [(0, chunk, 1, lm._delta(one), lm.planes(big), lm.planes(np.array([1], np.uint32)), None, 0) for chunk in (0, 1)]
    group = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), lm._COUNTS, strict=True)], schema=lm._COUNTS)
    out = lm._totals(group).to_pylist()
    assert [lm._unpacked(r["early"]).tolist() for r in out if r["chunk"] >= 0] == [[6_000_000_000]] * 2
    assert np.frombuffer(out[-1]["own"], np.int64).tolist() == [6_000_000_000, 2, 1, 1]


def test_lm_scores(spark, docs, texts, empty):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (3, texts[3])]
    tokens = [(i, [w.encode().lower() for w in split(t)] + [None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if fold(i) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for size in (50, 1 << 20):  # many chunks, and one
        got = {}
        for r in lm.lm_scores(docs, ranges=5, tokens=size).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, ws in tokens:
            for r in got[i]:
                assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
                assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
                assert r.score < 0
    held = [r for rs in got.values() for r in rs if r.held_out and r.n_tokens > 20 and r.n_known > 0.5 * r.n_tokens]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.lm_scores(empty).count() == 0


def test_lm_score_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(18)
    rows = [(i, words(rng, int(rng.integers(0, 60)))) for i in range(300)]
    tokens = [(fold(i), i, [w.encode().lower() for w in split(t)] + [None]) for i, t in rows]
    uni, bi, early, early_bi = Counter(), Counter(), Counter(), Counter()
    for f, _, ws in tokens:
        if f != 1:
            uni.update(ws), bi.update(zip([None, *ws[:-1]], ws, strict=True))
            if f != 2:
                early.update(ws), early_bi.update(zip([None, *ws[:-1]], ws, strict=True))
    n, v, n_early, v_early = sum(uni.values()), len(uni), sum(early.values()), len(early)
    octave = lambda x: 0 if not x else min(int(math.log2(x)) + 1, 31)
    mix = np.tile([0.4, 0.5, 0.1], (32, 1))
    mix[0] = [0, 0.8, 0.2]
    held = [(w, h) for f, _, ws in tokens if f == 2 for h, w in zip([None, *ws[:-1]], ws, strict=True)]
    for _ in range(60):  # expectation-maximisation over single events, without bins
        new = np.tile(np.array([0.4, 0.5, 0.1]) * 3, (32, 1))
        for w, h in held:
            b = octave(early[h])
            p = np.array([early_bi[h, w] / early[h] if early[h] else 0, early[w] / n_early, 1 / (v_early + 1)]) * mix[b]
            new[b] += p / p.sum()
        new[0, 0] = 0
        mix = new / new.sum(axis=1, keepdims=True)
    want = {}
    for _, i, ws in tokens:
        want[i] = 0.0
        for h, w in zip([None, *ws[:-1]], ws, strict=True):
            a, b, c = mix[octave(uni[h])]
            want[i] += math.log10(a * bi[h, w] / max(uni[h], 1) + b * uni[w] / n + c / (v + 1))
    got = {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ranges=4, tokens=500).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=0.01, abs=0.01) for i in want)  # the bins are an eighth of an octave wide


def test_lm_says_so_if_a_second_read_differs():
    h, starts = np.array([3, 4], np.uint64), np.array([0, 2])
    assert lm._mark(h, starts, [1]) == lm._mark(h.copy(), starts, [1]) != lm._mark(h[::-1].copy(), starts, [1])
    assert lm._mark(h, starts, [1]) != lm._mark(h, starts, [2])


def test_lm_weights_sum_to_one_and_probabilities_too():
    mix = lm.learned_weights(np.array([(3 << 20) | (300 << 10) | 200, (1 << 20) | 100]), np.array([50, 7]), 1000, 50)
    assert np.allclose(mix.sum(axis=1), 1) and mix[0, 0] == 0


def brute_components(rows, size, threshold):
    sets = []
    for i, t in rows:
        w = [x.encode().lower() for x in split(t)]
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    label = {i: i for i, _ in sets}
    find = lambda x: x if label[x] == x else find(label[x])
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(i), find(j)))
                label[q] = p
    return {i: (len(x), find(i)) for i, x in sets}


def test_near_duplicates(spark, empty):
    rng = np.random.default_rng(9)
    base = [words(rng, int(rng.integers(3, 200))).split() for _ in range(40)]
    rows = [" ".join(b) for b in base]
    for b in base[:25]:
        for share in (0.01, 0.02, 0.04, 0.08, 0.2):
            c = list(b)
            for k in rng.integers(0, len(c), max(1, int(share * len(c)))):
                c[k] = "zz" + str(rng.integers(1000))
            rows.append(" ".join(c))
    rows += [rows[0].upper(), None, "", " ", "a b", "A  b", "a"]
    docs = spark.createDataFrame([(int(i), t, 1, 2) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)], "doc_id long, text string, u long, bands long")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 4, 80)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, size=4).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    odd = spark.createDataFrame([(None, rows[0], 1, 2), (1, rows[0], 1, 2), (1, rows[0], 1, 2)], docs.schema)
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect()), key=str) == [(1, 1, True), (1, 1, True), (None, None, True)]
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_compares_every_text_of_a_repeated_id(spark):
    rng = np.random.default_rng(15)
    a, b, c = (words(rng, 150) for _ in range(3))
    rows = [(1, "a " + a), (1, "b " + b), (5, "b " + b + " tail"), (6, "a " + a + " tail"), (7, c), (8, "d " + c), (9, "a " + words(rng, 150))]
    got = [(r.doc_id, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (5, 1), (6, 1), (7, 7), (8, 7), (9, 9)]


def test_near_duplicates_of_rows_that_repeat_and_long_texts(spark):
    rng = np.random.default_rng(16)
    a, long = words(rng, 150), words(rng, 40_000)
    rows = [(1, a)] * 60 + [(2, "x " + a)] * 60 + [(3, long), (4, long + " x"), (None, a), (None, "x " + a)]
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1, True)] * 60 + [(2, 1, False)] * 60 + [(3, 3, True), (4, 3, False)] + [(None, None, True)] * 2))


def test_sketch_fills_every_coordinate_and_concentrates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 10, 300, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        s = near_dup.sketch(x, 8)
        assert (s < np.uint64(2**64 - 1)).all()
    x = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = near_dup.sketch(x[:1000], 8), near_dup.sketch(x[200:], 8)
    assert abs((a == b).mean() - 800 / 1200) < 0.12


def test_estimate_loses_fewer_pairs_than_the_bands():
    n = 1 << near_dup.BITS
    lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(math.ceil(near_dup.ESTIMATE * n)))
    assert lost < 1e-6 < (1 - 0.8**near_dup.ROWS) ** near_dup.BANDS


def test_mixed_buckets_find_links_the_stars_miss(spark):
    import cairn.llm._base as base

    low = bytes(range(252)), bytes([255, *range(1, 252)]), bytes(range(1, 253))  # the second differs in band 0 only
    first, second, lone = 6 << 6, (7 << 6) | 1, 8 << 6  # buckets of bands 0, 1 and 0
    rows = [(second, 1, 1, low[0], 9), (second, 2, 2, low[0], 9), (first, 1, 1, low[0], 9), (first, 2, 2, low[0], 9), (second, 3, 1, low[1], 9), (second, 4, 4, low[2], 9), (lone, 5, 5, low[0], 9), (second, 6, 6, low[0], 5)]
    columns = "bucket long, id long, comp long, low binary, n_shingles long"
    got = near_dup.mixed_pairs(spark.createDataFrame(rows, columns), 0.66).collect()
    assert sorted((r.u, r.v) for r in got) == [(2, 1), (3, 2)]
    cut = spark.createDataFrame([(*r, 4) for r in rows], f"{columns}, n long")
    assert sorted((r.u, r.v) for r in near_dup.mixed_pairs(cut, 0.66, block=1).collect()) == [(2, 1), (3, 2)]  # blocks lose and repeat nothing
    chain = spark.createDataFrame([(i + 1, i) for i in range(0, 30)] + [(51, 50)], "u long, v long")
    found, _ = base.components(chain)
    assert {(r.node, r.comp) for r in found.collect()} == {(i, 0) for i in range(31)} | {(50, 50), (51, 50)}


def test_quality(docs, texts, empty):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        w = split(t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_rules(empty).count() == 0


def test_quality_ends_on_long_white_space(spark):
    rows = [(1, " " * 1_000_000), (2, "\n" * 300_000 + "a b\n \t\r\na b"), (None, "x " + "\t" * 500_000)]
    got = {r.doc_id: (r.n_words, r.n_dup_lines, r.kept) for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0, False), 2: (4, 1, False), None: (1, 0, False)}


def test_quality_bands(spark):
    rng = np.random.default_rng(2)
    noise = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 6000))
    rows = [(0, " ".join("w%06d" % rng.integers(10**6) + rng.choice(["ing", "er", "en"]) for _ in range(300))), (1, " ".join(f"{i} same old words" for i in range(2000))), (2, " ".join(noise[i : i + 9] for i in range(0, 6000, 9)))]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_quality_bands_reject_what_is_above_clean_text_of_its_length():
    bands = quality.Bands()
    clean = [(70, 1.13), (120, 1.24), (200, 1.56), (400, 1.71), (700, 1.89), (1500, 2.04), (2500, 2.15), (5000, 2.29), (10000, 2.38), (30000, 2.48)]
    for n, ratio in clean:  # the largest clean ratios of labelled documents
        assert bands.verdict(n, ratio) == 0 and bands.verdict(n, 1.07 * ratio + 0.05) == 1
    assert bands.verdict(130, 0.93) == bands.verdict(200, 1.04) == -1  # random letters and digits
    assert bands.verdict(4096, 2.25, chunk=True) == 0 and bands.verdict(4096, 2.4, chunk=True) == 1


def test_quality_rejects_repeats_that_the_base_rules_pass(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), 5)) for _ in range(60)]
    text = " ".join(x for _ in range(1500) for x in [" ".join(rng.choice(vocabulary, 2)) + str(rng.integers(10))])
    got = quality.quality_rules(spark.createDataFrame([(0, text)], "doc_id long, text string")).first()
    assert not got.base_failed and 2.7 < got.ratio < 4 and not got.kept and got.bad_chunks >= 2


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1500):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        rows.append((i, words(rng, 30) + (" dolt" if insult else "") + (" martians" if group else "")))
        labels.append((i, int(insult and group), None))  # neither word alone is toxic
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, score double")
    got = toxicity.toxicity(frame, marks, epochs=30).collect()
    y = {i: t for i, t, _ in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 for r in got) and len(held) > 200
    assert sum(r.predicted == y[r.doc_id] for r in held) / len(held) > 0.97
    assert toxicity.drop_toxic(frame, marks, epochs=30).count() < 1500
    none = spark.createDataFrame([], marks.schema)
    assert {r.score < 0.01 for r in toxicity.toxicity(docs, none).collect()} == {True}
    assert toxicity.toxicity(empty, marks).count() == 0


def test_toxicity_learns_pairs_that_linear_weights_cannot(spark):
    rng = np.random.default_rng(19)
    rows, y = [], {}
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, words(rng, 30) + (" dolt" if a else "") + (" martians" if b else "")))
        y[i] = int(a != b)  # neither word has an effect of its own
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(list(y.items()), "doc_id long, toxic int")
    for factors, low, high in ((4, 0.95, 1.0), (0, 0.3, 0.8)):  # without factors it is linear, right in three of the four cases at best
        held = [r for r in toxicity.toxicity(frame, marks, epochs=40, factors=factors).collect() if r.held_out]
        assert low <= sum(r.predicted == y[r.doc_id] for r in held) / len(held) <= high


def test_toxicity_of_nulls_and_repeated_rows(spark):
    rng = np.random.default_rng(20)
    rows = [(i, words(rng, 20) + (" dolt" if i % 3 == 0 else "")) for i in range(300)]
    rows += [(1, "dolt " * 5)] * 500 + [(None, None), (None, "dolt"), (400, ""), (401, None), (402, "dolt " * 50_000)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(300)] + [(1, 0, "x"), (None, 1, "x"), (2, None, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()
    assert len(got) == len(rows)
    odd = {(r.doc_id, r.predicted) for r in got if r.doc_id is None or r.doc_id >= 400}
    assert odd == {(None, 0), (None, 1), (400, 0), (401, 0), (402, 1)}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) > 0.95 * len(held)


def test_decontamination(spark, empty):
    rng = np.random.default_rng(6)
    items = [(i, words(rng, 40)) for i in range(12)] + [(50, None), (51, ""), (52, "short")]
    rows, want = [(0, None), (1, ""), (2, words(rng, 300))], {0: "", 1: "", 2: ""}
    for i, text in items[:12]:
        for k, edits in enumerate((0, 3, len(text) // 2)):
            s = list(text)
            for at in rng.choice(len(s), edits, replace=False):
                s[at] = rng.choice(list("qxz"))
            doc = 10 + 3 * i + k
            rows.append((doc, words(rng, 50) + "\n" + "".join(s).upper() + " " + words(rng, 50)))
            want[doc] = str(i) if k < 2 else ""
    docs = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id long, text string, leaked string, found long")
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, bench).collect()}
    assert got == want
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, x in want.items() if not x)
    assert {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, bench, limit=300).collect()} == want  # many blocks
    odd = spark.createDataFrame([(None, items[0][1]), (7, items[1][1]), (7, items[1][1]), (8, "a Short one"), (9, "shorter")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.item_ids) for r in decontaminate.contamination(odd, bench.unionByName(bench)).collect())
    assert got == [("7", "1"), ("7", "1"), ("8", "52"), ("9", ""), ("None", "0")]
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_decontamination_finds_passages_at_any_start():
    rng = np.random.default_rng(13)
    item = words(rng, 90)[:300].replace("  ", " ")
    index = decontaminate.Index.of([(7, item)])
    found = lambda x: index.found(np.frombuffer(decontaminate.folded(x), "<u4"))
    before, after = words(rng, 40) + " #", "# " + words(rng, 40)
    for at in (0, 1, 13, 25, 26, 49, 77, 125, 163, len(item) - 101, len(item) - 100):
        passage = item[at : at + 100]
        if passage != passage.strip():
            passage = item[at - 1 : at + 101].strip()
        assert found(before + passage + after) == [7], at
        for edits, want in ((6, [7]), (40, [])):
            s = list(passage)
            for k in rng.choice(np.arange(1, len(s) - 1), edits, replace=False):
                s[k] = "q"
            assert found(before + "".join(s) + after) == want, (at, edits)
        assert found(before + passage[:80] + after) == []


def test_decontamination_equals_brute_force_over_all_windows():
    rng = np.random.default_rng(14)

    def near(a, x):
        row = [0] * (len(x) + 1)
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(x):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    seen = set()
    for n in range(60):
        item = rng.integers(97, 105, 45)
        index = decontaminate.Index.of([(1, "".join(map(chr, item)))], q=4, size=30, share=0.1)
        at, length = int(rng.integers(0, 15)), int(rng.integers(26, 34))
        x = list(item[at : at + length])
        for k in rng.integers(0, len(x), int(rng.integers(0, 5))):
            kind = rng.integers(3)
            x[k : k + (kind != 0)] = [] if kind == 1 else [int(rng.integers(97, 105))]
        x = np.array([*rng.integers(97, 105, 20), *x, *rng.integers(97, 105, 20)], "<u4")
        want = any(near(item[s : s + 30].tolist(), x.tolist()) <= 3 for s in range(16))
        seen.add(want)
        assert (index.found(x) == [1]) == want, n
    assert seen == {True, False}


def test_decontamination_edits_at_every_length(spark):
    """int(0.07 n) substitutions in an item of every length from 10 to 120 are found, one more than that isn't."""
    rng = np.random.default_rng(23)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    items, texts = [], []
    for n in range(10, 121):
        item = rng.choice(letters, n).tolist()
        size = min(n, decontaminate.WINDOW)
        for extra, want in ((0, True), (1, False)):
            x = list(item)
            for k in np.linspace(0, size - 1, int(0.07 * size) + extra + 2)[1:-1].astype(int) if extra == 0 else np.arange(0, n, max(1, size // (int(0.07 * size) + 2)))[: n]:
                x[k] = "x"
            texts.append((len(texts), f"{'ab ' * int(rng.integers(0, 5))}{''.join(x)} cd", n, want))
        items.append((n, "".join(item)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), bench).collect()}
    assert [(n, want) for i, _, n, want in texts if (got[i] == str(n)) != want] == []


def test_decontamination_of_repetitive_items_is_quick():
    import time

    codes = lambda x: np.frombuffer(decontaminate.folded(x), "<u4")
    index = decontaminate.Index.of([(1, "a" * 100_000), (2, "ab" * 30_000 + "c" * 50_000)])
    begun = time.time()
    assert index.found(codes("a" * 100_000)) == [1] and index.found(codes("x " + "ba" * 2000)) == [2] and index.found(codes("d" * 50 + "c" * 99 + "e")) == [2] and index.found(codes("b" * 100_000)) == []
    assert time.time() - begun < 5 and len(index.codes) < 1000


def test_decontamination_counts_long_runs_in_slices(monkeypatch):
    codes = lambda x: np.frombuffer(decontaminate.folded(x), "<u4")
    rng = np.random.default_rng(17)
    item = words(rng, 60)
    index = decontaminate.Index.unpacked(decontaminate.Index.packed([(1, "a" * 100), (2, item), (3, "ab"), (4, "é!")]))
    assert index.found(codes("a" * 100_000)) == [1]
    assert index.found(codes("x ab.y é! " + "b" * 5000)) == [3, 4] and index.found(codes("xab é!x")) == []
    monkeypatch.setattr(decontaminate.slices, "__defaults__", (50,))  # cuts that could fall anywhere
    for at in range(0, 200, 23):
        assert index.found(codes("b" * at + " " + item * 2)) == [2]
    places, n = np.arange(0, 3000, 2), np.full(1500, 3)
    cuts = list(decontaminate.slices(places, n, 107, 300))
    for k in range(0, len(places) - 54):
        assert any(a <= k and k + 54 <= b for a, b in cuts)


def test_alignment_equals_edit_distance():
    rng = np.random.default_rng(8)

    def distance(a, x):  # least edits of a against any stretch of x
        row = [0] * (len(x) + 1)
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(x):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(200):
        a, x = rng.integers(0, 3, 12), rng.integers(0, 3, 30)
        assert decontaminate.within(a, x, -12, 30, 3) == (distance(a.tolist(), x.tolist()) <= 3)


def test_warc(spark):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a", big), (3, "http://b\r\nX: y", big), (9, None, big), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (None, "u", big), (8, "u", ""), (3, "again", big), (11, "u", "x" * 100), (10, "u", "x" * 100)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archived(pages).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        revisit = len(data) >= 100 and page != min(same)
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    got = warc.archived(pages, few=0, file_bytes=1).collect()  # nothing broadcast, a file for each record
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_archives_are_standard_members_and_give_the_pages_back(spark, tmp_path):
    long = "é" * 3_000_000
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, None), (4, "u", "x\r\n\r\ny")]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w").collect()
    assert sum(r.records for r in files) == 4 and all(r.name.endswith(".warc.gz") for r in files)
    heads = [h for r in files for one in warc.members((tmp_path / "w" / r.name).read_bytes()) for h, _ in warc.parsed(one)]
    assert len({h["WARC-Record-ID"] for h in heads}) == 4
    refers = {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"}
    assert refers <= {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"} and len(refers) == 1
    got = {r.page_id: (r.url, r.payload_bytes, r.html) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got == {1: ("http://a", 6_000_000, long.encode()), 2: ("http://b", 6_000_000, None), 3: (None, 0, b""), 4: ("u", 6, b"x\r\n\r\ny")}
    with pytest.raises(ValueError):
        warc.checked({"WARC-Payload-Digest": "sha256:00", "WARC-Record-ID": "x"}, b"other")
    with pytest.raises(ValueError):
        list(warc.members((tmp_path / "w" / files[0].name).read_bytes()[:-9]))


def test_token_file_round_trip():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60000, n).astype("<u4") for n in (0, 1, 5, 5000, 1023, 1024, 1)] + [np.array([0, 2**32 - 1, 7], "<u4"), np.full(3000, 9, "<u4")]
    data = token_files.pack_file([1, None, *range(3, 3 + len(docs) - 2)], [x.tobytes() for x in docs])
    f = token_files.TokenFile(data)
    ends = np.cumsum(f.lengths)
    assert f.doc_ids[:3] == [1, None, 3]
    for x, b in zip(docs, ends, strict=True):
        assert np.array_equal(f.ids(b - len(x), b), x)
    with pytest.raises(ValueError):
        token_files.TokenFile(b"x" * 60)


def test_token_files(docs, texts, empty, monkeypatch):
    path = public_path("word_bpe_49k.json")
    rows = sorted([*enumerate(texts), (None, "no id here"), (3, texts[3])], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for (i, _), x in zip(rows, Encoder(path).encode([t for _, t in rows]), strict=True):
        x += b"\1\0\0\0"
        want.append((i, at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert sorted(map(str, map(tuple, token_files.token_files(docs, path).collect()))) == sorted(map(str, want))
    assert token_files.token_files(empty, path).count() == 0


def test_packing(docs, texts, empty):
    path = public_path("byte_bpe_50k.json")
    got = packing.best_fit_packing(docs, path, capacity=100, group=40).collect()
    ids = dict(enumerate(Encoder(path).encode(texts)))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        x += bytes(4)
        parts = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]})
        assert [p[0] for p in parts] == list(range(-(-len(x) // 400))) and all(p[2] == 100 for p in parts[1:])
        assert [p[1] for p in parts] == np.cumsum([0, *(p[2] for p in parts)])[:-1].tolist() and sum(p[2] for p in parts) == len(x) // 4
        assert all(zlib.crc32(x[4 * s : 4 * (s + n)]) == c for _, s, n, c in parts)
    assert len(by_doc[3]) == 2 * len({r.piece for r in by_doc[3]})  # its row stands twice
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 100
    assert len(by_sequence) <= 1.06 * sum(r.length for r in got) / 100 + 2
    assert packing.best_fit_packing(empty, path).count() == 0


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 100, 300))[::-1].copy()
    a, b = packing.fresh(sizes, rng, 0, 100), packing.fresh(sizes, rng, 30, 100)
    child = packing.crossed(a, b, sizes, rng, 100)
    fill = np.bincount(child, weights=sizes)
    assert len(child) == 300 and child.min() == 0 and fill.max() <= 100 and (fill > 0).all()


def test_genetic_algorithm_beats_best_fit_on_triplets():
    for n in (20, 40, 83):  # items in threes that fill a bin exactly
        rng = np.random.default_rng(n)
        first = rng.integers(380, 490, n)
        second = (rng.uniform(0.42, 0.5, n) * (1000 - first)).astype(int)
        sizes = np.sort(np.concatenate([first, second, 1000 - first - second]))[::-1].copy()
        plain = packing.fresh(sizes, rng, 0, 1000).max() + 1
        best = packing.evolved(sizes, [], 0, 1000, packing.POPULATION, packing.EFFORT)
        fill = np.bincount(best, weights=sizes)
        assert fill.max() <= 1000 and n <= len(fill) <= n + 2 and len(fill) <= plain - 2, (n, len(fill), plain)


def test_packing_over_many_small_groups(spark):
    rng = np.random.default_rng(21)
    parts = spark.createDataFrame([(i, 0, 0, int(x), 0) for i, x in enumerate(rng.integers(300, 700, 400))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.packed(parts, 1000, group=40).collect()
    assert len(got) == 400
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    total = sum(r.length for r in got)
    assert max(used.values()) <= 1000 and len(used) <= total / 1000 + 45


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    docs, labels = [], []
    for i in range(260):
        bad = i % 7 == 0
        docs.append((i, words(rng, 60) + (" dolt numbskull" if bad else "")))
        labels.append((i, 1, int(bad)))
    bench = [(0, words(rng, 40))]
    docs += [(900, docs[3][1]), (901, words(rng, 20) + " " + bench[0][1]), (902, words(rng, 30) + " me@example.com"), (903, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    clean = {i for i in range(260) if i % 7} | {900, 901, 902, 903}
    assert kept[0] == clean and kept[1] == clean - {900} and kept[2] == clean - {900, 901} and kept[3] == kept[2] == kept[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_nulls_repeats_clashing_names_and_nothing(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(22)
    long = words(rng, 30_000)
    rows = [(i, words(rng, 40) + (" dolt numbskull" if i % 5 == 0 else "")) for i in range(300)]
    rows += [(1, rows[1][1])] * 5 + [(None, rows[2][1]), (None, None), (400, None), (400, None), (401, ""), (402, long), (403, long)]
    names = "doc_id long, text string, lang string, leaked long, gone_id long, comp long, kept boolean, h long, item_id long"
    odd = (None, 1, None, 3, False, 4, 5)
    spark.createDataFrame([(*r, *odd) for r in rows], names).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), "t") for i in range(300)] + [(1, 0, "t"), (None, 1, "t"), (3, None, "t")], "doc_id long, toxic int, text string").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(None, "x"), (1, None), (2, ""), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, f"{tmp_path}/a")
        if name != "packing":
            assert at.columns == columns, name
    got = sorted(str(r.doc_id) for r in at.filter("piece = 0").collect())
    assert got == sorted(map(str, [i for i in range(300) if i % 5 and i != 1] + [1] * 6 + [None, None, 400, 400, 401, 402]))
    empty = spark.createDataFrame([], names)
    for some in ("labels", "benchmark", "documents"):
        table = empty if some == "documents" else spark.read.parquet(f"{tmp_path}/a/{some}.parquet").filter("false")
        table.write.parquet(f"{tmp_path}/b/{some}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    assert corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/a/documents.parquet"), f"{tmp_path}/b").count() == len(rows)


def test_lm_totals_hold_little_beside_the_counts():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 63, 400_000, dtype=np.uint64))
    rows, want = [], {}
    for chunk in range(40):
        keys = np.sort(rng.choice(pool, 50_000, replace=False))
        n = rng.integers(0, 9, len(keys)).astype(np.uint32)
        rows.append((0, chunk, 2, lm._delta(keys), lm.planes(n), lm.planes(n), None, 5))
        want[chunk] = (keys, n)
    group = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), lm._COUNTS, strict=True)], schema=lm._COUNTS)
    tracemalloc.start()
    out = lm._totals(group).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = np.zeros(len(pool), np.int64)
    for keys, n in want.values():
        total[np.searchsorted(pool, keys)] += n
    assert all((lm._unpacked(r["early"]) == total[np.searchsorted(pool, want[r["chunk"]][0])]).all() for r in out) and len(out) == 40
    assert peak < 40 * 2_000_000, peak  # 40 bytes a key; 117 MB before
