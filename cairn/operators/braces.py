"""Symbols of Java: one pass over blocks, then each head is classified.

Comments and strings are blanked first, so that braces and names in them don't count. A head is the text before a `{` or `;`
outside round brackets; its annotations are cut out of it. In a source whose brackets don't balance the pass takes its bearings
anew from each line that can only begin a member or a type, so that a lost bracket costs the method it is lost in.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

_NOISE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_STRING = re.compile(r"[\"'`]([^\"'`\n]*)[\"'`]")
_ANNOTATION = re.compile(r"@(?!interface\b)([A-Za-z_][\w.]*)")
_CALL = re.compile(r"(?<![\w@])([A-Za-z_$][\w$]*)\s*\(")
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "new", "synchronized", "try", "throw", "super", "this", "function", "await", "typeof", "constructor", "assert", "else", "do", "in", "of", "import"}
_TYPE = re.compile(r"\b(class|interface|@interface|enum|record)\s+([A-Za-z_$][\w$]*)([^=]*)$", re.S)

_JAVA_METHOD = re.compile(r"(?P<before>(?:[\w.<>\[\],?&]+\s+)*)(?P<name>[A-Za-z_$][\w$]*)\s*\((?P<args>.*)\)\s*(?:throws\s[\w.,\s]+)?$", re.S)
_JAVA_FIELD = re.compile(r"(?P<before>(?:[\w.<>\[\],?&]+\s+)+)(?P<name>[A-Za-z_$][\w$]*)\s*(?:\[\s*\])*\s*(?:=.*)?$", re.S)
_JAVA_LINE = re.compile(r"^[ \t]*(?:(?:(?:public|protected|private|static|final|abstract|sealed)[ \t]+)*(?P<type>class|interface|enum|record)[ \t]+\w|(?:public|protected|private|static)[ \t]+[\w<]|(?!(?:return|throw|new|else)\b)[\w.]+(?:<[^;(){}=\n]*>)?(?:\[\])*[ \t]+(?P<name>\w+)[ \t]*\([^(){};]*\)\s*(?:throws\s[\w.,\s]+)?\{)", re.M)
_JAVA_IMPORT = re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M)
_JAVA_PACKAGE = re.compile(r"^[ \t]*package\s+([\w.]+)\s*;", re.M)


@dataclass
class Block:
    head: str
    start: int  # of the head's first character that isn't white space
    marked: int | None  # of the first annotation
    opened: int  # place of the brace, or of the semicolon
    end: int
    parent: Block | None
    annotations: list[tuple[str, str]]  # name and arguments as in the source
    braced: bool
    type_name: str | None = None
    route_base: str = ""


def blanked(source: str) -> str:
    """The source with comments and strings as spaces; offsets and lines stay."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def _closing(text: str, at: int) -> int:
    """Place after the bracket that closes the one at `at`; the end of its line where none does before a semicolon."""
    depth = 0
    for m in re.compile(r"[();]").finditer(text, at):
        if m.group() == ";":
            break
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return m.end()
    found = text.find("\n", at)
    return len(text) if found < 0 else found


def _balanced(text: str) -> bool:
    open_ = []
    for c in re.findall(r"[(){}]", text):
        if c in "({":
            open_.append(c)
        elif not open_ or open_.pop() + c not in ("()", "{}"):
            return False
    return not open_


class _Bearings:
    """Lines of a source out of balance that can only begin a member or a type, and what they say about the blocks around them.

    A block ends before such a line that is indented no deeper, but a type goes on where the line begins a member. A member outside
    of all types belongs to the type that was opened last.
    """

    def __init__(self, text: str, marks: list[tuple[int, int, str, str]]):
        self.text, self.marks, self.types = text, marks, []
        self.lines = [] if _balanced(text) else [m for m in _JAVA_LINE.finditer(text) if m["name"] not in NOT_CALLS]
        self.next = 0

    def opened(self, block: Block) -> None:
        if self.lines and _TYPE.search(block.head):
            while self.types and self.indent(self.types[-1].start) >= self.indent(block.start):
                self.types.pop()
            self.types.append(block)

    def take(self, until: int, stack: list[Block]) -> int | None:
        """Where the head begins of the last such line before a place, its annotations included; None if there is none."""
        begun = None
        while self.next < len(self.lines) and self.lines[self.next].start() <= until:
            line = self.lines[self.next]
            self.next += 1
            begun, own = line.start(), self.indent(line.start() + len(line.group()) - len(line.group().lstrip()))
            i = bisect_left(self.marks, (begun,))
            while i and not self.text[self.marks[i - 1][1] : begun].strip():
                i -= 1
                begun = self.marks[i][0]
            while stack and self.indent(stack[-1].start) >= own and (line["type"] or not _TYPE.search(stack[-1].head)):
                closed = stack.pop()
                closed.end = closed.opened + len(self.text[closed.opened : begun].rstrip())
            if not stack and not line["type"]:
                stack += self.types[-1:]
        return begun

    def indent(self, at: int) -> int:
        """Columns of white space before what stands at a place, or before its line's first character."""
        line = self.text[self.text.rfind("\n", 0, at) + 1 : at].expandtabs(4)
        return len(line) - len(line.lstrip())


def blocks(source: str) -> tuple[str, list[Block]]:
    """The text without noise and annotations, and its heads in source order."""
    text, marks = blanked(source), []
    for m in _ANNOTATION.finditer(text):
        if marks and m.start() < marks[-1][1]:
            continue
        opening = re.compile(r"\s*\(").match(text, m.end())
        end = _closing(text, opening.end() - 1) if opening else m.end()
        marks.append((m.start(), end, m.group(1), source[m.end() : end]))
    pieces, last = [], 0
    for a, b, _, _ in marks:
        pieces += [text[last:a], re.sub(r"[^\n]", " ", text[a:b])]
        last = b
    text = "".join([*pieces, text[last:]])
    out: list[Block] = []
    stack: list[Block] = []
    begun, round_, mark = 0, 0, 0
    bearings = _Bearings(text, marks)
    for m in re.compile(r"[(){};]").finditer(text):
        c = m.group()
        if (taken := bearings.take(m.start(), stack)) is not None:
            begun, round_ = max(begun, taken), 0
            mark = min(mark, bisect_left(marks, (begun,)))
        if c in "()":
            round_ = max(0, round_ + (1 if c == "(" else -1))
        elif not round_:
            if c != "}":
                own = []
                while mark < len(marks) and marks[mark][0] < m.start():
                    before = text[begun : marks[mark][0]]
                    if marks[mark][0] >= begun and before.count("(") == before.count(")"):  # those of parameters are not the head's
                        own.append(marks[mark])
                    mark += 1
                head = text[begun : m.start()]
                start = begun + len(head) - len(head.lstrip())
                block = Block(head, min([start, *(a for a, _, _, _ in own)]), own[0][0] if own else None, m.start(), m.end() if c == ";" else len(source), stack[-1] if stack else None, [(n, args) for _, _, n, args in own], c == "{")
                out.append(block)
                if c == "{":
                    stack.append(block)
                    bearings.opened(block)
            elif stack:
                stack.pop().end = m.end()
            begun = m.end()
    return text, out


def _names(text: str) -> list[str]:
    """Names in a comma-separated list of types, without their arguments."""
    while (less := re.sub(r"<[^<>]*>", "", text)) != text:
        text = less
    return [n for x in text.split(",") if (n := x.strip())]


def parents(rest: str, word: str) -> list[str]:
    found = re.findall(rf"\b{word}\s+(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", rest, re.S)
    return [n for part in found for n in _names(part)]


def first_text(args: str) -> str:
    found = _STRING.search(args)
    return found.group(1) if found else ""


def route_path(*parts: str) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p.strip("/"))


class Calls:
    """The calls of a text, found once, for any stretch of it."""

    def __init__(self, text: str):
        found = [m for m in _CALL.finditer(text) if m[1] not in NOT_CALLS]
        self.names, self.places = [m[1] for m in found], [m.start() for m in found]

    def within(self, begun: int, end: int) -> list[str]:
        return list(dict.fromkeys(self.names[bisect_left(self.places, begun) : bisect_left(self.places, end)]))


class Rows:
    def __init__(self, path: str, source: str, package: str, imports: list[str]):
        self.path, self.source, self.package, self.imports, self.out = path, source, package, imports, []
        self.ends = [m.start() for m in re.finditer("\n", source)]

    def line(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1

    def add(self, name, kind, block, *, parent=None, visibility="public", bases=(), faces=(), calls=(), route=None, decorator="", signature=None, start=None, end=None) -> None:
        notes = [n.rpartition(".")[2] for n, _ in block.annotations]
        head = " ".join((block.head if signature is None else signature).split())
        start, end = block.start if start is None else start, block.end if end is None else end
        self.out.append((self.path, len(self.out), name, kind, parent, self.line(start), self.line(max(start, end - 1)), head, visibility, notes, list(bases), list(calls), route, decorator, self.package, self.imports, list(faces)))


def visibility(head: str, default: str) -> str:
    return next((v for v in ("public", "protected", "private") if re.search(rf"\b{v}\b", head)), default)


def java_symbols(path: str, source: str) -> list[tuple]:
    """Types, methods, constructors and fields; routes of the web mappings under the type's own mapping."""
    text, found = blocks(source)
    package, calls = _JAVA_PACKAGE.search(text), Calls(text)
    rows = Rows(path, source, package.group(1) if package else "", _JAVA_IMPORT.findall(text))
    for b in found:
        owner = b.parent.type_name if b.parent else None
        kind = _TYPE.search(b.head) if b.braced and (b.parent is None or owner) else None
        if kind and "(" not in b.head[: kind.start()]:
            b.type_name = kind.group(2)
            b.route_base = next((first_text(args) for n, args in b.annotations if n == "RequestMapping"), "")
            rows.add(b.type_name, kind.group(1).lstrip("@"), b, parent=owner, visibility=visibility(b.head, "package"), bases=parents(kind.group(3), "extends"), faces=parents(kind.group(3), "implements"))
        elif owner and (m := _JAVA_METHOD.fullmatch(b.head.strip())) and m["name"] not in NOT_CALLS and (m["before"].strip() or m["name"] == owner):
            route = None
            for n, args in b.annotations:
                verb = n.removesuffix("Mapping").upper() if re.fullmatch("(Get|Post|Put|Delete|Patch)Mapping", n) else None
                if n == "RequestMapping":
                    given = re.search(r"RequestMethod\.(\w+)|method\s*=\s*\{?\s*([A-Z]+)\b", args)
                    verb = next(g for g in given.groups() if g) if given else "GET"
                if verb:
                    route = (f"{verb} {route_path(b.parent.route_base, first_text(args))}", n)
                    break
            test = any(n in ("Test", "ParameterizedTest") for n, _ in b.annotations)
            what = "constructor" if m["name"] == owner and not _types(m["before"]) else "test" if test else "method"
            rows.add(m["name"], what, b, parent=owner, visibility=visibility(m["before"], "package"), calls=calls.within(b.opened, b.end) if b.braced else [], route=route[0] if route else None, decorator=route[1] if route else "")
        elif owner and not b.braced and (m := _JAVA_FIELD.fullmatch(b.head.strip())) and _types(m["before"]):
            constant = {"static", "final"} <= set(m["before"].split())
            rows.add(m["name"], "constant" if constant else "field", b, parent=owner, visibility=visibility(m["before"], "package"))
    return rows.out


def _types(before: str) -> list[str]:
    """The words before a name that aren't modifiers."""
    return [w for w in before.split() if w not in {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "default", "transient", "volatile", "strictfp", "return", "throw", "package", "import"}]
