"""Symbols, tags, edges and chunks of sources; the parsers run in Arrow batches, all else on columns."""

from __future__ import annotations

import ast
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import braces, scripts

SYMBOL = (
    "path string, ordinal int, name string, kind string, parent string, start_line int, end_line int, signature string, visibility string, "
    "annotations array<string>, extends array<string>, calls array<string>, route string, decorator string, package string, imports array<string>, implements array<string>"
)
_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
# Base classes of web views, and modules that hold handlers.
WEB_VIEW_BASES = [
    "APIView", "ViewSet", "ViewSetMixin", "GenericViewSet", "ModelViewSet", "ReadOnlyModelViewSet", "GenericAPIView", "ListAPIView", "CreateAPIView", "RetrieveAPIView", "UpdateAPIView", "DestroyAPIView", "ListCreateAPIView",
    "RetrieveUpdateAPIView", "RetrieveDestroyAPIView", "RetrieveUpdateDestroyAPIView", "View", "TemplateView", "ListView", "DetailView", "CreateView", "UpdateView", "DeleteView", "FormView", "RedirectView",
]
# Annotations of Spring types and their tags.
STEREOTYPES = {"RestController": "controller", "Controller": "controller", "Service": "service", "Repository": "repository", "Component": "component", "Configuration": "config"}
CONTROLLER_MODULES = ["controllers.py", "views.py", "routes.py", "router.py", "api.py"]


def _name(node: ast.expr) -> str:
    """a.b.c of a name, attribute, call or subscript; empty for others."""
    while isinstance(node, (ast.Call, ast.Subscript)):
        node = node.func if isinstance(node, ast.Call) else node.value
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ".".join(reversed(parts))


def _route(decorators: list[ast.expr]) -> tuple[str | None, str]:
    for d in decorators:
        last = _name(d).rpartition(".")[2]
        if not isinstance(d, ast.Call) or last not in (*_VERBS, "route"):
            continue
        path = next((x.value for x in d.args[:1] if isinstance(x, ast.Constant) and isinstance(x.value, str)), None)
        if path is None:
            continue
        method = last.upper()
        if last == "route":
            given = next((k.value for k in d.keywords if k.arg == "methods"), None)
            method = next((x.value.upper() for x in getattr(given, "elts", [])[:1] if isinstance(x, ast.Constant)), "GET")
        return f"{method} {path}", _name(d)
    return None, ""


def python_symbols(path: str, source: str) -> list[tuple]:
    """Classes, functions and methods of a source in order; none where it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    parts = path.removesuffix(".py").split("/")
    package = ".".join(parts[:-1] if parts[-1] == "__init__" else parts)
    imports = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append("." * node.level + (node.module or ""))
    out: list[tuple] = []

    def visit(body: list[ast.stmt], parent: str | None) -> None:
        for node in body:
            if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            is_class = isinstance(node, ast.ClassDef)
            calls = [] if is_class else list(dict.fromkeys(x for c in ast.walk(node) if isinstance(c, ast.Call) and (x := _name(c.func).rpartition(".")[2])))
            route, decorator = (None, "") if is_class else _route(node.decorator_list)
            test = node.name.startswith("Test") if is_class else node.name.startswith("test_")
            kind = "class" if is_class else "test" if test else "method" if parent else "function"
            bases = [ast.unparse(b) for b in node.bases] if is_class else []
            head = f"class {node.name}({', '.join(bases)})" if is_class else f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})"
            visibility = "public" if not node.name.startswith("_") or node.name.endswith("__") else "private"
            out.append((path, len(out), node.name, kind, parent, node.lineno, node.end_lineno, head, visibility, [_name(d) for d in node.decorator_list], bases, calls, route, decorator, package, imports, []))
            if is_class:
                visit(node.body, node.name)

    visit(tree.body, None)
    return out


Parser = Callable[[str, str], list[tuple]]
Tagger = Callable[[], Column]
PARSERS: dict[str, Parser] = {"python": python_symbols, "java": braces.java_symbols, "typescript": scripts.typescript_symbols, "javascript": scripts.typescript_symbols}


def register_parser(language: str, parser: Parser) -> None:
    """A parser gives rows as in SYMBOL for a path and a text; it replaces the language's own."""
    PARSERS[language] = parser


def register_tagger(language: str, tagger: Tagger) -> None:
    """A tagger gives the tags as an array column over the columns of SYMBOL; it replaces the language's own."""
    TAGGERS[language] = tagger


def symbols(files: DataFrame) -> DataFrame:
    """A row for each symbol of the files (path, language, text); none for a null text or a language without a parser."""
    parsers = dict(PARSERS)

    def run(batches):
        for batch in batches:
            columns = (c.to_pylist() for c in batch.columns)
            rows = [s for p, k, t in zip(*columns, strict=True) for s in parsers[k](p, t or "")]
            strings = pa.list_(pa.string())
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), strings, strings, strings, pa.string(), pa.string(), pa.string(), strings, strings]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[f.split()[0] for f in SYMBOL.split(", ")])

    return files.filter(F.col("language").isin(list(parsers)) & F.col("path").isNotNull()).select("path", "language", "text").mapInArrow(run, SYMBOL)


def _mark(test: Column, *tags: str) -> Column:
    return F.when(test, F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>"))


def python_tags() -> Column:
    """By base class, name, module and decorator."""
    name, file = F.col("name"), F.lower(F.element_at(F.split("path", "/"), -1))
    module = file.isin(CONTROLLER_MODULES) | file.rlike("_(controller|router)(\\.py)?$")
    bases = F.transform("extends", lambda b: F.element_at(F.split(F.trim(F.element_at(F.split(b, r"\["), 1)), r"\."), -1))
    is_class, has_route = F.col("kind") == "class", F.col("route").isNotNull()
    web = F.exists(bases, lambda b: b.isin(WEB_VIEW_BASES)) | name.rlike("(Controller|ViewSet)$") | (name.endswith("View") & (name != "View")) | module
    controller = (is_class & web) | (~is_class & has_route & (F.col("decorator").rlike(r"(^|\.)route$") | module))
    return F.concat(_mark(controller, "controller"), _mark(is_class & name.endswith("Service"), "service"), _mark(is_class & name.rlike("Repo(sitory)?$"), "repository"), _mark(controller, "api"))


def java_tags() -> Column:
    """By stereotype annotation, in the order of the annotations."""
    table = F.create_map(*[F.lit(x) for kv in STEREOTYPES.items() for x in kv])
    found = F.filter(F.transform("annotations", lambda a: F.element_at(table, a)), lambda t: t.isNotNull())
    return F.concat(found, _mark(F.array_contains(found, "controller"), "api"))


def typescript_tags() -> Column:
    """By decorator, path and name; a capitalised function or class counts as a component."""
    name, path, notes = F.lower("name"), F.lower("path"), F.transform("annotations", lambda a: F.lower(a))
    has = lambda note: F.array_contains(notes, note)
    react = F.col("kind").isin("function", "class") & F.col("name").rlike(r"^\p{Lu}")
    return F.concat(
        _mark(has("component") | path.contains("component") | react, "component", "ui"),
        _mark(has("injectable") | path.contains("/service") | name.endswith("service"), "service"),
        _mark(path.contains("/store") | name.endswith("store"), "store"),
        _mark(path.contains("/hook") | name.startswith("use"), "hook"),
        _mark(path.contains("/page") | path.contains("/view"), "page"),
        _mark(path.contains("/api") | path.contains("/route") | (F.col("kind") == "route"), "api"),
        _mark(has("controller") | name.endswith("controller"), "controller"),
    )


TAGGERS: dict[str, Tagger] = {"python": python_tags, "java": java_tags, "typescript": typescript_tags, "javascript": typescript_tags}


def tagged(df: DataFrame) -> DataFrame:
    """Tags of symbols, each once: structural ones, then those of the language's tagger."""
    own = F.array().cast("array<string>")
    for language, tagger in TAGGERS.items():
        own = F.when(T.detect_language(F.col("path")) == language, tagger()).otherwise(own)
    return df.withColumn("tags", F.array_distinct(F.concat(_mark(F.col("route").isNotNull(), "route", "api"), _mark(F.col("kind") == "test", "test"), own)))


def edges(df: DataFrame) -> DataFrame:
    """(path, source, start_line, end_line, target, edge_type), the lines being the source's: extends, implements, configures, calls, tested_by, routes_to, and imports from a file's first class."""
    lines = ["start_line", "end_line"]
    one = lambda kind, target: df.select("path", F.col("name").alias("source"), *lines, target.alias("target"), F.lit(kind).alias("edge_type"))
    parts = [one("extends", F.explode("extends")), one("implements", F.explode("implements")), one("calls", F.explode("calls")), one("routes_to", F.col("route")).filter("target is not null")]
    parts.append(df.filter("kind = 'test'").select("path", F.col("name").alias("source"), *lines, F.explode("calls").alias("target"), F.lit("tested_by").alias("edge_type")))
    holders = df.filter(F.array_contains("annotations", "Configuration")).groupBy("path", F.col("name").alias("source")).agg(F.min("start_line").alias("start_line"), F.min_by("end_line", "start_line").alias("end_line"))
    beans = df.filter(F.array_contains("annotations", "Bean")).select("path", F.col("parent").alias("source"), F.col("name").alias("target"))
    parts.append(beans.join(holders, ["path", "source"]).select("path", "source", *lines, "target", F.lit("configures").alias("edge_type")))
    first = df.filter("kind = 'class'").groupBy("path").agg(F.min_by("name", "ordinal").alias("source"), F.min_by("imports", "ordinal").alias("i"), F.min_by("start_line", "ordinal").alias("start_line"), F.min_by("end_line", "ordinal").alias("end_line"))
    parts.append(first.select("path", "source", *lines, F.explode("i").alias("target"), F.lit("imports").alias("edge_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def chunks(files: DataFrame, found: DataFrame, header: int = 6, most: int = 800) -> DataFrame:
    """Functions and methods whole, classes with methods by their header, other classes whole, files without symbols as one chunk."""
    inner = found.filter("parent is not null").select("path", F.col("parent").alias("name")).distinct().withColumn("has", F.lit(True))
    own = found.join(inner, ["path", "name"], "left")
    end = F.when((F.col("kind") == "class") & F.col("has"), F.least("end_line", F.col("start_line") + header - 1)).otherwise(F.col("end_line"))
    spans = own.select("path", F.col("name").alias("symbol"), "kind", "start_line", end.alias("end_line"))
    rest = files.select("path").join(found.select("path").distinct(), "path", "left_anti").select("path", F.lit(None).cast("string").alias("symbol"), F.lit("file").alias("kind"), F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    lines = files.select("path", F.split("text", "\n").alias("lines"))
    whole = spans.unionByName(rest).join(lines, "path").withColumn("end_line", F.coalesce("end_line", F.size("lines")))
    cut = whole.withColumn("content", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")).drop("lines")
    parts = cut.withColumn("part", F.explode(split_tokens(F.split("content", "\n"), most)))
    out = parts.select("path", "symbol", "kind", "start_line", "end_line", F.col("part.i").alias("index"), F.col("part.text").alias("content"))
    return out.withColumns({"chunk_id": T.chunk_id(F.col("path"), F.col("symbol"), F.col("start_line"), F.col("index")), "content_hash": F.sha2("content", 256)})


def _parts(lines: pa.Array, most: pa.Array) -> pa.Array:
    """Parts of each list of lines: sums of lengths once, then a binary search for the end of each part."""
    out = []
    for row, n in zip(lines.to_pylist(), most.to_pylist()):
        if row is None:
            out.append(None)
            continue
        sums, found, at = [0, *accumulate(len(x) + 1 for x in row)], [], 0
        while at < len(row):
            # the last end whose text, of sums[end] - sums[at] - 1 code points, is within the tokens
            end = max(at + 1, bisect_right(sums, sums[at] + 4 * n + 4, at + 1) - 1)
            found.append({"i": len(found), "text": "\n".join(row[at:end])})
            at = end
        out.append(found or [{"i": 0, "text": ""}])
    return pa.array(out, pa.list_(pa.struct([("i", pa.int32()), ("text", pa.string())])))


def split_tokens(lines, most: int):
    """Greedy parts: a new one starts where the next line would pass `most` tokens; one long line stays whole."""
    return F.arrow_udf(_parts, "array<struct<i: int, text: string>>")(lines, F.lit(most))
