"""Column functions of the repository index: tokens, hashes, names, routes, patterns. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# File suffixes and their languages.
LANGUAGES = {
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rb": "ruby", ".rs": "rust", ".cs": "csharp", ".cpp": "cpp",
    ".cc": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".php": "php", ".scala": "scala", ".xml": "xml", ".yml": "yaml", ".yaml": "yaml", ".properties": "properties", ".gradle": "gradle", ".sql": "sql",
}
# Folders that a scan passes by.
IGNORED_DIRS = [
    "node_modules", "target", "build", "dist", "out", ".git", ".idea", ".vscode", ".vs", "coverage", ".gradle", ".mvn", "bin", "obj",
    "__pycache__", ".pytest_cache", ".tmp", ".mypy_cache", ".venv", "venv", ".next", ".nuxt", ".cache", "vendor", "generated", "gen",
]
# Folders that hold one layer of a feature.
LAYER_DIRS = [
    "component", "components", "controller", "controllers", "dto", "dtos", "entity", "entities", "handler", "handlers", "hook", "hooks", "model", "models", "page", "pages",
    "repository", "repositories", "route", "routes", "service", "services", "store", "stores", "view", "views",
]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_like(c: Column, term: Column) -> Column:
    """c LIKE '%term%' with ASCII case folded, % and _ of the term live, and no escape character."""
    pattern = F.regexp_replace(F.concat(F.lit("%"), ascii_lower(term), F.lit("%")), "%+", "%")
    return F.call_function("like", ascii_lower(c), pattern, F.lit("\x01"))


def detect_language(path: Column) -> Column:
    """Language by lower-cased suffix of the file name, else null."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1)))


def ignored(path: Column) -> Column:
    """Whether a component of the path is an ignored folder."""
    return F.exists(F.split(path, "/"), lambda x: x.isin(IGNORED_DIRS))


def chunk_tokens(c: Column) -> Column:
    """Characters over four, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def context_tokens(c: Column) -> Column:
    """As chunk_tokens, but none for the empty text."""
    return F.when(F.length(c) == 0, 0).otherwise(chunk_tokens(c))


def word_tokens(c: Column) -> Column:
    return F.floor(F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")) * 1.3).cast("int")


def chunk_id(path: Column, symbol: Column, start: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", path, F.coalesce(symbol, F.lit("file")), start.cast("string"), index.cast("string")), 256), 1, 24)


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a of an ASCII token, as a fold over its characters."""
    codes = F.transform(F.filter(F.split(token, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: h.bitwiseXOR(x) * F.lit(16777619) % F.lit(4294967296))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the shorter of two arrays; norms over each whole one; zero for an empty or zero side."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.filter(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x.isNotNull()))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def normalize_annotation(c: Column) -> Column:
    return F.element_at(F.split(F.trim(F.regexp_replace(c, "^@+", "")), r"\."), -1)


def normalize_route(method: Column, path: Column) -> Column:
    """METHOD /path in lower case, :id as {id}, without a closing slash."""
    p = F.regexp_replace(F.regexp_replace(path, r":([A-Za-z_][A-Za-z0-9_]*)", r"{$1}"), "/+$", "")
    return F.lower(F.concat_ws(" ", method, F.when(p == "", "/").otherwise(p)))


def feature_root(path: Column) -> Column:
    """The path up to its first layer folder, else its folder."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    marks = F.transform(parts, lambda x: F.lower(x).isin(LAYER_DIRS))
    at = F.array_position(marks, True)
    return F.array_join(F.when(at > 0, F.slice(parts, 1, (at - 1).cast("int"))).otherwise(parts), "/")


def identifier_tokens(c: Column) -> Column:
    """Distinct lower-case words of camel, Pascal, snake and digit parts of an identifier."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1)), F.lower))


def alias_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, and the parts of camel-case ones."""
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z][A-Za-z0-9]*|[0-9]+[A-Za-z]*)"), F.lit(1))
    parts = F.regexp_extract_all(c, F.lit("([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|(?![A-Za-z0-9]))|[0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(runs, parts), F.lower))


def plain_keywords(c: Column, noise: list[str]) -> Column:
    """Lower-cased words of over two characters that aren't noise, in order."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(noise))


def evidence_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    """path:start-end: and twelve digits of the content's SHA-1."""
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("string")
    return F.concat(path, F.lit(":"), zero(start), F.lit("-"), zero(end), F.lit(":"), F.left(F.sha1(content), F.lit(12)))


def java_bean_field(c: Column) -> Column:
    """The field behind a getter or setter, else null."""
    rest = F.regexp_extract(c, r"^(?:get|set|is)([A-Z].*)$", 1)
    return F.when(rest != "", F.concat(F.lower(F.left(rest, F.lit(1))), F.substring(rest, 2, 1 << 20)))


def rounded(c: Column, places: int) -> Column:
    """A number from 0 up to some thousands, rounded by its exact binary value, halves to the even one; as IEEE-exact rounding elsewhere.

    The fraction times 2 ** 60 is a whole number, which is multiplied and divided in two halves of 30 bits, so nothing is lost.
    """
    scale, half = 10**places, (1 << 30) - 1
    f = ((c - F.floor(c)) * float(1 << 60)).cast("long")
    low = f.bitwiseAND(half) * scale
    high = F.shiftright(f, 30) * scale + F.shiftright(low, 30)
    rest = F.shiftleft(high.bitwiseAND(half), 30) + low.bitwiseAND(half)
    whole = F.floor(c) * scale + F.shiftright(high, 30)
    middle = F.lit(1 << 59)
    return (whole + F.when((rest > middle) | ((rest == middle) & (whole % 2 == 1)), 1).otherwise(0)).cast("double") / float(scale)


def reduction(repo: Column, context: Column) -> Column:
    """Share of tokens saved, in per cent between 0 and 100, to one place."""
    return F.when(repo <= 0, 0.0).otherwise(rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - context / repo) * 100)), 1))


def string_list(c: Column) -> Column:
    """A JSON list as an array of strings; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
