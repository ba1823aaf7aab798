"""Unified diffs in replies: finding one, what it touches and whether it may be applied. Strings only, on the driver."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def patch_in(reply: str) -> str | None:
    """The diff that a reply fences or begins with a header of; None where there is none."""
    for body in re.findall(r"```(?:diff|patch)?[ \t]*\n(.*?)```", reply, re.DOTALL):
        if re.search(r"^(diff --git |--- )", body, re.M):
            return body.strip() + "\n"
    raw = re.search(r"^(diff --git |--- [^\n]*\n\+\+\+ ).*", reply, re.M | re.DOTALL)
    return raw[0].strip() + "\n" if raw else None


def patched_paths(patch: str) -> list[str]:
    """Paths that a diff names, each once, without its a/ and b/."""
    found = re.findall(r"^(?:---|\+\+\+) (?:[ab]/)?([^\t\n]+)", patch, re.M)
    found += [x for pair in re.findall(r"^diff --git a/(\S+) b/(\S+)", patch, re.M) for x in pair]
    return list(dict.fromkeys(x.strip() for x in found if x.strip() != "/dev/null"))


def safe(patch: str) -> bool:
    """Whether a diff names at least one path, and only relative ones that stay below the root."""
    paths = [p.replace("\\", "/") for p in patched_paths(patch)]
    inside = lambda p: p and not p.startswith("/") and not re.match("[A-Za-z]:", p) and not posixpath.normpath(p).startswith("..")
    return bool(paths) and all(map(inside, paths))


def line_kind(line: Column) -> Column:
    """'+', '-' or 'file' for an added or removed line or a file header of a diff; null for others."""
    return F.when(line.startswith("+++ "), "file").when(line.startswith("--- "), None).when(line.startswith("+"), "+").when(line.startswith("-"), "-")
