"""Routing of questions: reasoning goes on to retrieval, enumeration to the first local handler that matches.

Works on a string on the driver, or on a column of questions as one CASE expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues of reasoning and of enumeration.
REASONING = ["explain", "describe", "architecture", "why", "refactor", "suggest", "compare", "generate", "implement", "fix", "should i", "walk me through", "overview", "how does", "how do", "design", "trade-off", "tradeoff", "pros and cons"]
ENUMERATION = ["how many", "count", "list", "show", "find", "which", "all ", "number of", "what are", "get all", "display", "where", "group"]
# Handlers in order, with their cues; "^" marks the start of the question; broad ones enumerate a category.
HANDLERS: list[tuple[str, list[str], bool]] = [
    ("where_is", ["^where is", "^where's"], False),
    ("which_package", ["which package", "what package", "package contains"], False),
    ("find_symbol", ["^find ", "symbol by name", "methods named"], False),
    ("counts_by_kind", ["count symbols", "symbols by type", "count by type", "symbol counts"], True),
    ("grouped_routes", [], True),
    ("controllers", ["controller"], True),
    ("services", ["service"], True),
    ("repositories", ["repositor"], True),
    ("components", ["@component", "components", "spring component"], True),
    ("routes", ["route", "endpoint", "rest api", "rest endpoint"], True),
    ("tests", ["test class", "test method", "test cases", "tests", "@test"], True),
    ("implements", ["implement"], True),
    ("extends", ["extend", "subclass", "inherit"], True),
    ("imports", ["import"], False),
]
# Cues of a grouped answer, and of what is grouped.
GROUPING, GROUPED = ["grouped by", "for each", "under each", "per "], ["route", "endpoint", "handler"]
# Intents in order, with their cues.
INTENTS: list[tuple[str, list[str]]] = [
    ("review", ["review", "code review", "risk", "looks good", "feedback on"]),
    ("bug_fix", ["bug", "fix", "error", "exception", "npe", "fails", "broken", "crash", "stack trace"]),
    ("test_creation", ["test", "unit test", "junit", "coverage", "write a test", "add tests"]),
    ("refactor", ["refactor", "clean up", "rename", "extract", "simplify", "restructure"]),
    ("code_edit", ["add", "implement", "create", "change", "update", "modify", "validation", "endpoint"]),
    ("architecture_explanation", ["architecture", "overview", "how does", "explain the flow", "design", "structure"]),
]
# A quoted text or a path, which names one thing rather than a category.
_ENTITY = re.compile(r"[\"'`][^\"'`]+[\"'`]|/[A-Za-z0-9_{}/-]+")


def _any(q: Column, cues: list[str]) -> Column:
    tests = [q.startswith(c[1:]) if c[0] == "^" else q.contains(c) for c in cues]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def route_column(question: Column) -> Column:
    """Name of the handler, or ai_required."""
    q = F.lower(F.trim(question))
    entity = question.rlike(_ENTITY.pattern)
    out = F.when(_any(q, REASONING) | ~_any(q, ENUMERATION), "ai_required")
    grouped = (_any(q, GROUPING) | (q.contains("group") & q.contains(" by "))) & _any(q, GROUPED)
    for name, cues, broad in HANDLERS:
        out = out.when((_any(q, cues) if cues else grouped) & (~entity if broad else F.lit(True)), name)
    return out.otherwise("ai_required")


def route(question: str) -> str:
    q = question.strip().lower()
    hit = lambda cues: any(q.startswith(c[1:]) if c[0] == "^" else c in q for c in cues)
    if hit(REASONING) or not hit(ENUMERATION):
        return "ai_required"
    entity = bool(_ENTITY.search(question))
    grouped = (hit(GROUPING) or ("group" in q and " by " in q)) and hit(GROUPED)
    return next((name for name, cues, broad in HANDLERS if (hit(cues) if cues else grouped) and not (broad and entity)), "ai_required")


def intent_column(prompt: Column) -> Column:
    """First intent with a cue: single words between other characters than letters and digits, phrases anywhere."""
    p = F.concat(F.lit(" "), F.lower(prompt), F.lit(" "))
    out = None
    for name, cues in INTENTS:
        words = [c for c in cues if c.isalnum()]
        test = p.rlike("[^a-z0-9_](" + "|".join(words) + ")[^a-z0-9_]")
        for phrase in (c for c in cues if not c.isalnum()):
            test = test | p.contains(phrase)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("question")
