"""Symbols of TypeScript and JavaScript: a lexer with a stack of contexts, then declarations by their pairs of brackets.

The lexer knows templates and their holes, regular expressions, and JSX with its texts, attributes and holes, so that a brace or a
quote in one of them hides nothing. Declarations count wherever a statement may begin, in callbacks and other functions too.
Brackets that lack their partner end with the bracket around them, or with the source.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from cairn.operators.braces import NOT_CALLS, Block, Calls, Rows, first_text, parents, route_path, visibility

_NAME = r"[A-Za-z_$][\w$]*"
_TOKEN = re.compile(rf"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[\w$]+)|(?P<other>=>|\+\+|--|.)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TAG = re.compile(rf"<(?:{_NAME}(?!\s*,|\s+extends\b)|>)")
_ATTRIBUTES = re.compile(r"(?:[^\"'{}/>]|\"[^\"]*\"|'[^']*'|/(?!>))+")
_HOLE_FREE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])+", re.S)
#: Words after which an expression begins, and those after which a bracket holds a condition or a brace opens a block.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof", "default", "extends"}
_CONDITIONS, _BEFORE_BLOCK = {"if", "while", "for", "with"}, {"", ")", "=>", ";", "{", "}", "else", "do", "try", "finally"}

_STATEMENT = re.compile(r"(?:const|let|var|export|import|if|for|while|return|switch|try|throw|type|interface|enum|abstract)\b(?!\s*[(.,:=)]|\s*$)|(?:if|for|while|switch)\s*\(")
_DECORATOR = re.compile(rf"@({_NAME}(?:\.{_NAME})*)(\s*\()?")
_DECLARATION = re.compile(
    rf"(?:^|(?<=[;{{}}]))[^\S\n]*(?P<all>(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?:const\s+)?(?P<kind>class|interface|enum)\s+(?P<type>{_NAME})|(?:async\s+)?function\b\s*\*?\s*(?P<function>{_NAME})|(?:const|let|var)\s+(?P<value>{_NAME})))", re.M
)
_MEMBER = re.compile(rf"(?P<before>(?:(?:public|private|protected|static|async|get|set|override|abstract|readonly|declare|accessor)\s+)*)\*?\s*(?P<name>#?{_NAME})\s*[?!]?\s*(?P<then>[(<=:])")
_IMPORT = re.compile(r"\bimport\s+(?:[^;\"']*?\sfrom\s+)?[\"']([^\"']+)[\"']|\brequire\(\s*[\"']([^\"']+)[\"']\s*\)")
_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
_ROUTE = re.compile(rf"\b(?:app|router|\w*[rR]outer)\s*\.\s*({'|'.join(_VERBS)})\s*\(")
_PATH = re.compile(r"\s*[\"'`]([^\"'`\n]+)[\"'`]")


def lexed(source: str, jsx: bool) -> tuple[str, dict[int, int]]:
    """The source with comments as spaces and literals as quotes, offsets kept, and the partner's place of each opening bracket.

    JSX that never ends is no JSX: the source is then read again without it.
    """
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []  # a context and the place of its bracket
    spans: list[tuple[int, int, bool]] = []  # of literals, and of comments
    value, last, at = False, "", 0

    def ended(closed: str) -> bool:
        """Leaves an element; whether code goes on behind it."""
        stack.pop()
        return not (stack and stack[-1][0] == "children")

    while at < len(source):
        context = stack[-1][0] if stack else ""
        begun = at
        if context == "template":
            found = _HOLE_FREE.match(source, at)
            at = found.end() if found else at
            if at < len(source):
                if source[at] == "`":
                    stack.pop()
                    value, last, at = True, '"', at + 1
                elif source.startswith("${", at):
                    at += 1
                    stack.append(("hole", at))
                    value, last = False, "("
                spans.append((begun, at, False))
                at += 1 if stack and stack[-1] == ("hole", at) else 0
                at += 1 if at == begun else 0  # a lone backslash at the end
            else:
                spans.append((begun, at, False))
            continue
        if context in ("tag", "children"):
            found = _ATTRIBUTES.match(source, at) if context == "tag" else re.compile("[^<{]+").match(source, at)
            at = found.end() if found else at
            c = source[at : at + 1]
            if c == "{":
                stack.append(("hole", at))
                value, last = False, "("
                spans.append((begun, at, False))
                at += 1
                continue
            if context == "tag" and c == ">":
                stack[-1] = ("children", at)
            elif (context == "tag" and source.startswith("/>", at)) or source.startswith("</", at):
                at = source.find(">", at)
                at = len(source) - 1 if at < 0 else at
                if ended(c):
                    value, last = True, '"'
            elif context == "children" and c == "<":
                stack.append(("tag", at))
            at += 1
            spans.append((begun, min(at, len(source)), False))
            continue
        m = _TOKEN.match(source, at)
        kind, token, at = m.lastgroup, m.group(), m.end()
        if kind == "space":
            continue
        if kind == "comment":
            spans.append((begun, at, True))
            continue
        if kind == "string":
            spans.append((begun, at, False))
            value = True
        elif kind == "word":
            value = token not in _BEFORE_VALUE or last == "."
        elif token == "`":
            spans.append((begun, at, False))
            stack.append(("template", begun))
        elif token == "/" and not value and (found := _REGEX.match(source, begun)):
            at = found.end()
            spans.append((begun, at, False))
            value = True
        elif token == "<" and jsx and not value and (found := _TAG.match(source, begun)):
            stack.append(("tag", begun))
            at = begun + 1
            spans.append((begun, at, False))
            continue
        elif token == "{":
            stack.append(("block" if value or last in _BEFORE_BLOCK else "object", begun))
            value = False
        elif token in "([":
            stack.append(("condition" if token == "(" and last in _CONDITIONS else token, begun))
            value = False
        elif token in (")", "]"):
            fits = ("(", "condition") if token == ")" else ("[",)
            if context in fits:
                pairs[stack.pop()[1]] = begun
            value = context != "condition"
        elif token == "}":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in ("(", "[", "condition")), -1)
            if depth >= 0:
                context = stack[depth][0]
                pairs.update((place, begun) for _, place in stack[depth:])
                del stack[depth:]
                value = context != "block"
        elif token not in ("++", "--"):
            value = False
        last = token if kind != "string" else '"'
    if jsx and any(c in ("tag", "children") for c, _ in stack):
        return lexed(source, False)
    out, done = [], 0
    for a, b, comment in spans:
        out += [source[done:a], re.sub(r"[^\n]", " ", source[a:b]) if comment else '"' * (b - a)]
        done = b
    return "".join([*out, source[done:]]), pairs


class _Script:
    """The lexed source of a file, its decorators as spaces, and where constructs end in it."""

    def __init__(self, path: str, source: str):
        self.source = source
        text, self.pairs = lexed(source, not path.lower().endswith((".ts", ".mts", ".cts")))
        self.decorators, out, done = [], [], 0
        for m in _DECORATOR.finditer(text):
            if m.start() >= done:
                end = self.after(m.end() - 1) if m[2] else m.end()
                self.decorators.append((m.start(), end, m[1], source[m.end(1) : end]))
                out += [text[done : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
                done = end
        self.text = "".join([*out, text[done:]])
        self.ends, self.calls = [d[1] for d in self.decorators], Calls(self.text)

    def after(self, opening: int) -> int:
        """Place behind the bracket's partner, or the end of the source."""
        return min(self.pairs.get(opening, len(self.source)) + 1, len(self.source))

    def skip(self, at: int) -> int:
        """Place of the next character that isn't white space."""
        return re.compile(r"\s*").match(self.text, at).end()

    def decorated(self, at: int) -> list[tuple[int, int, str, str]]:
        """The decorators that stand directly before a place."""
        i = j = bisect_right(self.ends, at)
        while i and not self.text[self.decorators[i - 1][0] : at].strip():
            i -= 1
        return self.decorators[i:j]

    def generics(self, at: int) -> int:
        """Place behind type parameters, if any stand here."""
        at = self.skip(at)
        if self.text[at : at + 1] != "<":
            return at
        depth = 0
        for m in re.compile(r"=>|[<>({\[;]").finditer(self.text, at):
            if m.group() in "({[" or m.group() == ";":
                if m.group() == ";" and depth:
                    return m.start()
                continue
            depth += {"<": 1, ">": -1}.get(m.group(), 0)
            if not depth:
                return self.skip(m.end())
        return len(self.text)

    def to(self, at: int, ends: str) -> tuple[str, int]:
        """The first of some tokens behind a type or a list of bases, and its place; braces of types are passed over."""
        step = re.compile(rf"{ends}|[({{\[;}})\]]")
        while m := step.search(self.text, at):
            c = m.group()
            if c == "{":
                before = self.text[max(0, at - 2) : m.start()].rstrip()
                if before[-1:] not in ":|&<,=(":
                    return c, m.start()
            if c in "({[" and c not in ends.replace("\\", "").split("|"):
                at = self.after(m.start())
                continue
            return c, m.start()
        return "", len(self.text)

    def expression(self, at: int) -> int:
        """Place behind an expression: before the semicolon, comma or bracket that ends it, or a line end that nothing goes over."""
        begun = at
        while m := re.compile(r"[({\[\])};,\n]").search(self.text, at):
            c = m.group()
            if c in "({[":
                at = self.after(m.start())
                continue
            if c == "\n":
                following = self.skip(m.end())
                then = self.text[following : following + 1]
                before = self.text[max(begun, m.start() - 400) : m.start()].rstrip()[-1:]
                if _STATEMENT.match(self.text, following):
                    return m.start()
                if at == begun and not self.text[begun : m.start()].strip() or before in "=+-*/%&|^?:<>,.!~" or (then and then in ".?:+-*/%&|^<>=,)]}(["):
                    at = m.end()
                    continue
            return m.start()
        return len(self.text)

    def body(self, at: int, arrow: bool | None) -> tuple[int, int] | None:
        """Where the body of a function begins and ends whose type parameters or arguments stand at a place; None if none does.

        With `arrow` unset a function may end without a body, as overloads and abstract members do: it ends where it begins.
        """
        at = self.generics(at)
        if self.text[at : at + 1] != "(":
            return None
        at = self.skip(self.after(at))
        if self.text[at : at + 1] == ":":
            c, at = self.to(at + 1, "=>" if arrow else r"\n(?!\s*[{|&])")
        else:
            c = "=>" if self.text.startswith("=>", at) else self.text[at : at + 1]
        if arrow:
            return self.arrow(at) if c == "=>" else None
        return (at, self.after(at)) if c == "{" else (at, at)

    def arrow(self, at: int) -> tuple[int, int]:
        """The body behind an arrow."""
        at = self.skip(at + 2)
        return (at, self.after(at)) if self.text[at : at + 1] == "{" else (at, self.expression(at))

    def function_value(self, at: int) -> tuple[int, int] | None:
        """The body of the function that a value is whose type or equals sign stands at a place; None for other values."""
        at = self.skip(at)
        if self.text[at : at + 1] == ":":
            c, at = self.to(at + 1, r"=(?![=>])|\n(?=\s*[\w$]+[^\n]*[=({:])")
            if c != "=":
                return None
        if self.text[at : at + 1] != "=" or self.text[at + 1 : at + 2] in ("=", ">"):
            return None
        at = self.skip(at + 1)
        if m := re.compile(rf"(?:async\s+)?function\b\s*\*?\s*(?:{_NAME})?").match(self.text, at):
            return self.body(m.end(), False)
        if m := re.compile(r"async\b\s*").match(self.text, at):
            at = m.end()
        if m := re.compile(rf"{_NAME}\s*(?==>)").match(self.text, at):
            return self.arrow(m.end())
        return self.body(at, True)


def typescript_symbols(path: str, source: str) -> list[tuple]:
    """Classes, interfaces, enums, functions and arrow constants at any depth, methods and arrow members of classes; routes of decorators under
    their controller, and of routers, named by their handler or, where it has no name, by method and path."""
    s = _Script(path, source)
    imports = [a or b for m in _IMPORT.finditer(source) if s.text[m.start()] == source[m.start()] for a, b in [m.groups()]]
    rows = Rows(path, source, ".".join(x for x in re.sub(r"\.[A-Za-z]+$", "", path).split("/") if x), list(dict.fromkeys(imports)))

    def add(name: str, kind: str, at: int, opened: int, end: int, **rest) -> None:
        notes = s.decorated(at)
        block = Block(source[at:opened], min([at, *(d[0] for d in notes)]), None, opened, end, None, [(d[2], d[3]) for d in notes], True)
        rows.add(name, kind, block, **rest)

    for m in _DECLARATION.finditer(s.text):
        at = m.start("all")
        if name := m["type"]:
            c, opened = s.to(s.generics(m.end()), r"\{")
            if c == "{":
                rest, end = s.text[m.end() : opened], s.after(opened)
                add(name, m["kind"], at, opened, end, bases=parents(rest, "extends"), faces=parents(rest, "implements"))
                if m["kind"] == "class":
                    base = next((first_text(d[3]) for d in s.decorated(at) if d[2] == "Controller"), "")
                    _members(s, name, base, opened, end, add)
            continue
        found = s.body(m.end(), None) if m["function"] else s.function_value(m.end())
        if found:
            add(m["function"] or m["value"], "function", at, *found, calls=s.calls.within(*found))
    for m in _ROUTE.finditer(s.text):
        opening = m.end() - 1
        given, end = _PATH.match(source, m.end()), s.after(opening)
        if given:
            handler = s.text[max(_commas(s, opening, end)[-1] + 1, given.end()) : end - 1].strip() if end > given.end() else ""
            plain = re.fullmatch(rf"(?:{_NAME}\.)*({_NAME})", handler)
            name = plain[1] if plain else "_".join([m[1], *(re.findall("[A-Za-z0-9]+", given[1]) or ["root"])])
            block = Block(source[m.start() : given.end()], m.start(), None, given.end(), end, None, [], True)
            rows.add(name, "route", block, calls=s.calls.within(given.end(), end), route=f"{m[1].upper()} {given[1]}", decorator="".join(m.group()[:-1].split()))
    return rows.out


def _members(s: _Script, owner: str, base: str, opened: int, end: int, add) -> None:
    """Adds the methods of a class body, and its members that are functions."""
    at = opened + 1
    while at < end - 1:
        at = s.skip(at)
        m = _MEMBER.match(s.text, at, end)
        if m is None:
            step = re.compile(r"[({\[;\n]").search(s.text, at, end)
            at = end if step is None else s.after(step.start()) if step.group() in "({[" else step.end()
            continue
        found = s.body(m.start("then"), None) if m["then"] in "(<" else s.function_value(m.start("then"))
        if found and found[1] > found[0] and m["name"] not in (NOT_CALLS - {"constructor"}):
            mapped = next(((d[2], d[3]) for d in s.decorated(at) if d[2].lower() in _VERBS), None)
            route = f"{mapped[0].upper()} {route_path(base, first_text(mapped[1]))}" if mapped else None
            hidden = "private" if m["name"].startswith("#") else visibility(m["before"], "public")
            kind = "constructor" if m["name"] == "constructor" else "method"
            add(m["name"], kind, at, *found, parent=owner, visibility=hidden, calls=s.calls.within(*found), route=route, decorator=mapped[0] if mapped else "")
        at = max(found[1], m.end()) if found else s.expression(m.end())


def _commas(s: _Script, opening: int, end: int) -> list[int]:
    """Places of the commas between the arguments of a call, after that of its bracket."""
    out, at = [opening], opening + 1
    while (m := re.compile(r"[({\[,]").search(s.text, at, end - 1)) is not None:
        at = m.end() if m.group() == "," else s.after(m.start())
        out += [m.start()] if m.group() == "," else []
    return out
