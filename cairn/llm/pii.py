"""Personal data in whole texts, disguised too, with spans of the source.

Plain identifiers are found on the text itself. Then a chain of transducers rewrites disguises (look-alike letters and digits,
invisible characters, spelled digits, at and dot in words or brackets), each piece of output keeping the span of source it
came from; identifiers found on the result whose spans the plain ones don't hold are mapped back and added.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import in_order
from .tlds import TLDS

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL_ENDS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_LONG_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def emails(text: str) -> list[Span]:
    """Linear: each @ looks back over its local part, up to the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_ENDS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def _octet(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) <= 3 and (not x or int(x) <= 255)


def ips(text: str) -> list[Span]:
    """A chain of dotted numbers splits into fours from its left; a rest of fewer is none."""
    out = []
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(map(_octet, parts[k : k + 4])):
                out.append(("ip", at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[Span]:
    if not _CARD.search(text):
        return []
    out = []
    for m in _LONG_DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(x.isdigit() for x in m[0]) <= 15]


def plain(text: str) -> list[Span]:
    """Leftmost non-overlapping identifiers of each kind, by kind and then start."""
    return emails(text) + ips(text) + cards(text) + phones(text)


# Letters that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "\u2024": ".", "\u3002": ".", "\uff61": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits in words.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "arobase", "ät"), ("dot", "punkt", "punto", "point"), ("plus",)


class Traced:
    """A text and, for runs of it, the source they came from; rewrites compose."""

    def __init__(self, text: str):
        self.text = text
        self.at, self.source = [0], [(0, len(text), False)]  # starts of runs; their source and whether they are rewritten

    def span(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source of text[start:end], and whether any of it is rewritten."""
        i, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_left(self.at, end) - 1
        a, b = self.source[i], self.source[j]
        start_, end_ = a[0] if a[2] else a[0] + start - self.at[i], b[1] if b[2] else b[0] + end - self.at[j]
        return start_, end_, end_ - start_ != end - start or any(x[2] for x in self.source[i : j + 1])

    def rewritten(self, pattern: re.Pattern, to) -> Traced:
        """With each match for which to(match) isn't None replaced by it."""
        out, parts, size, last = Traced(""), [], 0, 0
        out.at, out.source = [], []

        def copy(a: int, b: int) -> None:
            nonlocal size
            while a < b:
                i = bisect.bisect_right(self.at, a) - 1
                end = min(b, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                s = self.source[i]
                out.at.append(size)
                out.source.append(s if s[2] else (s[0] + a - self.at[i], s[0] + end - self.at[i], False))
                parts.append(self.text[a:end])
                size += end - a
                a = end

        for m in pattern.finditer(self.text):
            if (new := to(m)) is None:
                continue
            copy(last, m.start())
            last = m.end()
            if new:
                s = self.span(m.start(), m.end())
                out.at.append(size), out.source.append((s[0], s[1], True)), parts.append(new)
                size += len(new)
        if not last:
            return self
        copy(last, len(self.text))
        out.text = "".join(parts)
        if not out.at:
            out.at, out.source = [0], [(0, 0, False)]
        return out


def _folded(x: str) -> str | None:
    if x in INVISIBLE:
        return ""
    if x in LOOKALIKES:
        return LOOKALIKES[x]
    if (n := unicodedata.decimal(x, None)) is not None:
        return str(n)
    y = unicodedata.normalize("NFKC", x)
    return y if y != x and len(y) == 1 and " " <= y <= "~" else None


_words = lambda xs: "|".join(sorted(map(re.escape, xs), key=len, reverse=True))
#: Characters that folding may change: invisible ones, Greek, Cyrillic, number forms, punctuation, styled and wide ASCII, digits.
_STRANGE = re.compile(
    "[\u00ad\ufeff\u00a0\u00b2\u00b3\u00b9\u0131\u0251\u0261\u0370-\u03ff\u0400-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f"
    "\u2000-\u206f\u2070-\u209f\u2100-\u218f\u2212\u2460-\u2468\u3000\u3002\uff01-\uff65\U0001d400-\U0001d7ff]"
)
_DIGIT = rf"(?:{_words(DIGIT_WORDS)})"
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:(?:{_words(PLUS_WORDS)})[ -]+)?{_DIGIT}(?:[ ,-]+(?:{_DIGIT}|[0-9]+|{_words(DOT_WORDS)}|double[ -]+{_DIGIT}|triple[ -]+{_DIGIT}))+(?![^\W_])")
_PAIR = re.compile(rf"(?:^|[^\w])(?:{_words(DIGIT_WORDS)})[ ,-]+(?:{_DIGIT}|[0-9]|{_words(DOT_WORDS)}|double|triple)")
_TOKEN = re.compile(r"[^\W_]+")
_MARK_AT = re.compile(rf"(?i)(?<=[a-z0-9])\s*[\[({{<]\s*(?:{_words(AT_WORDS)}|@)\s*[\])}}>]\s*(?=[a-z0-9])")
_MARK_DOT = re.compile(rf"(?i)(?<=[a-z0-9])\s*[\[({{<]\s*(?:{_words(DOT_WORDS)}|\.)\s*[\])}}>]\s*(?=[a-z0-9])")
_SAID_DOT = re.compile(rf"(?i)(?<=[a-z0-9])[ _]+(?:{_words(DOT_WORDS)})[ _]+(?=[a-z0-9])")
_SAID_AT = re.compile(rf"(?i)(?<=[a-z0-9])[ _]+({_words(AT_WORDS)}|@)[ _]+(?=([a-z0-9-]++(?:\.[a-z0-9-]++)++)(?!@))")
_NEAR_AT = re.compile(rf"[ _](?:{_words(AT_WORDS)}|@)[ _]+[a-z0-9-]++\.[a-z0-9-]")
# Words before " at " that are a sentence's and hardly a mailbox's.
_NO_MAILBOX = frozenset(
    """a an and any anyone are arrive arrived as available be been being based best better both bought buy but by call can check chat download
    downloads each else error errors even everyone fetch find for found from get glance go had has have he her here him his hosted how if in is it its
    just laugh like listed listen listening live lived lives located look looked looking looks may meet meeting more my no not now of on online only or
    order our out pointed pointing posted published reach read register released running said see seen sell she shop shown sign sit so sold stare
    started stay stop stored than that the their them then there these they this those to today try up us visit visited visiting was watch we were what
    when where which while who will with work worked working works would yes yet you your""".split()
)
_LOOSE_DOT = re.compile(r"(?<=[A-Za-z0-9]) \. (?=[a-z]{2})")
_LOOSE_AT = re.compile(r"(?<=[A-Za-z0-9])(?: +@ *| *@ +)(?=[A-Za-z0-9])")


def _spelled(m: re.Match) -> str | None:
    out, times = [], 1
    for x in _TOKEN.findall(m[0].lower()):
        if x in ("double", "triple"):
            times = 2 if x == "double" else 3
            continue
        out.append("+" if x in PLUS_WORDS else "." if x in DOT_WORDS else DIGIT_WORDS.get(x, x) * times)
        times = 1
    x = "".join(out)
    return x if sum(c.isdigit() for c in x) >= 4 else None


def _said_at(t: Traced):
    """Replaces an at before a dotted domain: always where the address has a disguise of its own or the at can mean nothing else,
    a lone "at" only between what can be a mailbox and a known top-level domain."""

    def to(m: re.Match) -> str | None:
        text, start = t.text, m.start()
        while start > 0 and text[start - 1] in _LOCAL_ENDS and m.start() - start < 64:
            start -= 1
        local, domain = text[start : m.start()], m[2]
        last = domain.rpartition(".")[2]
        if not last.isalpha():
            return None
        if t.span(start, m.start())[2] or t.span(*m.span(2))[2]:
            return "@"
        if last.lower() not in TLDS or not (last.islower() or domain.isupper()):
            return None
        mailbox = any(x.isalpha() for x in local) or sum(x.isdigit() for x in local) >= 5
        return "@" if mailbox and (m[1].lower() != "at" or local.strip("._").lower() not in _NO_MAILBOX) else None

    return to


def normalised(text: str) -> Traced | None:
    """The text without disguises; None if it has none."""
    t = base = Traced(text)
    if not text.isascii() and _STRANGE.search(text):
        t = t.rewritten(_STRANGE, lambda m: _folded(m[0]))
    low = t.text.lower()
    if _PAIR.search(low):
        t = t.rewritten(_SPELLED, _spelled)
    low = t.text.lower()
    if "(" in low or "[" in low or "{" in low or "<" in low:
        t = t.rewritten(_MARK_AT, lambda m: "@").rewritten(_MARK_DOT, lambda m: ".")
    if any(x in low for x in DOT_WORDS):
        t = t.rewritten(_SAID_DOT, lambda m: ".")
    if "@" in t.text:
        loose = t
        t = t.rewritten(_LOOSE_AT, lambda m: "@")
        if t is not loose:
            t = t.rewritten(_LOOSE_DOT, lambda m: ".")
    if _NEAR_AT.search(t.text.lower()):
        t = t.rewritten(_SAID_AT, _said_at(t))
    return None if t is base else t


def found(text: str) -> tuple[list[Span], list[Span]]:
    """Plain identifiers of a text, and those that only the normalised text shows; spans are code points of the source."""
    base = plain(text)
    t = normalised(text)
    if t is None:
        return base, []
    added, held = [], {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    for kind, start, end in plain(t.text):
        a, b, new = t.span(start, end)
        if new and not any(x <= a and b <= y for x, y in held[kind]):
            added.append((kind, a, b))
    return base, added


def _by_kind(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the plain spans, all spans, and the number that only the transducers show.

    Null texts count as empty and have no span; every row of docs (doc_id, text, ...) gives a row, repeated ones and those without a
    doc_id too. Very long texts are searched whole, in time that grows with their length. An empty table gives no rows. Other
    columns are ignored.
    """

    def run(batches):
        for batch in in_order(batches):
            n, sha, spans, extra = {k: [] for k in KINDS}, [], [], []
            for text in batch.column(1).to_pylist():
                base, added = found(text or "")
                for k in KINDS:
                    n[k].append(sum(x[0] == k for x in base))
                sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(_by_kind(base + added)) if added else _joined(base))
                extra.append(len(added))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str) -> str:
    """The text with every span, overlapping ones merged, replaced by its kind in angle brackets."""
    base, added = found(text)
    out, last, ends = [], 0, []
    for kind, a, b in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if ends and a < ends[-1][2]:
            ends[-1][2] = max(ends[-1][2], b)
        else:
            ends.append([kind, a, b])
    for kind, a, b in ends:
        out += [text[last:a], f"<{kind.upper()}>"]
        last = b
    return "".join([*out, text[last:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with its personal data masked in text and n_chars (if it has that column) counted anew; null texts stay null.

    Every row stays, with its other columns as they are.
    """
    columns = docs.columns

    def run(batches):
        for batch in in_order(batches):
            at = columns.index("text")
            text = [x if x is None else masked(x) for x in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))
            if "n_chars" in columns:
                at = columns.index("n_chars")
                batch = batch.set_column(at, batch.schema.field(at), pa.array([x if x is None else len(x) for x in text], batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
