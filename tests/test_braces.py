"""Symbols, tags and edges of Java and TypeScript sources."""

import time

import pytest

from cairn.operators import braces, code, scripts

JAVA = '''package shop.web;
import java.util.List;

/** Orders { */
@RestController
@RequestMapping("/orders")
public class OrderController extends Base<Order> implements Api, Closeable {
    private static final int MAX = 5;
    private final OrderStore store;

    public OrderController(OrderStore store) { this.store = store; }

    @GetMapping("/{id}")
    public Order load(@PathVariable("id") long id) throws IOException {
        for (int i = 0; i < 3; i++) { check("a;b"); }
        return store.find(id);
    }
    @RequestMapping(value = "/all", method = RequestMethod.POST)
    List<Order> all() { return store.everything(); }
    @Test
    void loads() { load(1); }
}
interface Api { Order load(long id); }
'''

SCRIPT = '''import { Get } from '@nestjs/common'

@Controller('users')
export class UserController extends Base implements Shape<B> {
  limit = 5
  constructor(private readonly users: Users) {}

  @Get(':id')
  async one(@Param('id') id: string): Promise<User> {
    if (id) { return this.users.find(id) }
    return load(`x{`)
  }
  #secret() { hide() }
}

export const useThing = (a: string): string => {
  return fetchIt(a)
}
export default function Card({ name }: Props) {
  return render(name)
}
router.get('/users/:id', (req, res) => { send(res) })
'''


def by_name(rows):
    names = [f.split()[0] for f in code.SYMBOL.split(", ")]
    return {(r["name"], r["kind"]): r for r in (dict(zip(names, x, strict=True)) for x in rows)}


def test_java():
    got = by_name(braces.java_symbols("OrderController.java", JAVA))
    assert set(got) == {("OrderController", "class"), ("MAX", "constant"), ("store", "field"), ("OrderController", "constructor"), ("load", "method"), ("all", "method"), ("loads", "test"), ("Api", "interface")} | {("load", "method")}
    owner = got["OrderController", "class"]
    assert owner["extends"] == ["Base"] and owner["implements"] == ["Api", "Closeable"] and owner["package"] == "shop.web" and owner["imports"] == ["java.util.List"]
    assert (owner["start_line"], owner["end_line"]) == (5, 22)
    assert got["all", "method"]["route"] == "POST /orders/all" and got["all", "method"]["calls"] == ["everything"]
    assert got["MAX", "constant"]["visibility"] == "private" and got["loads", "test"]["calls"] == ["load"]


def test_typescript():
    got = by_name(scripts.typescript_symbols("users.ts", SCRIPT))
    assert set(got) == {("UserController", "class"), ("constructor", "constructor"), ("one", "method"), ("#secret", "method"), ("useThing", "function"), ("Card", "function"), ("get_users_id", "route")}
    one = got["one", "method"]
    assert one["route"] == "GET /users/:id" and one["annotations"] == ["Get"] and one["calls"] == ["find", "load"] and (one["start_line"], one["end_line"]) == (8, 12)
    assert got["UserController", "class"]["start_line"] == 3 and got["UserController", "class"]["implements"] == ["Shape"]
    assert got["#secret", "method"]["visibility"] == "private" and got["Card", "function"]["start_line"] == 19


@pytest.mark.parametrize("text", ["", "}", "class {", "((({{{", "@", "@A(", "class A { void f( {", "'", "/*", "`", ";" * 1000, "{" * 3000])
def test_broken_sources(text):
    for parse in (braces.java_symbols, scripts.typescript_symbols):
        assert isinstance(parse("x", text), list)


LOST = """package shop;

@RestController
@RequestMapping("/orders")
public class OrderController {
    private final Store store;

    @GetMapping("/{id}")
    public Order load(long id) {%s
        return store.find(id);
    }

    @PostMapping("/new")
    public Order create(Order given) {
        if (given == null) {%s
            throw new Missing();
        }
        return store.add(given);
    %s

    @DeleteMapping("/{id}")
    public void drop(long id) {
        store.drop(id);
    }
}

class Helper {
    int one() { return 1; }
}
"""


@pytest.mark.parametrize("lost", [("", "", "}"), ("", "", ""), ("", "", "}}"), ("", "}", "}"), ("{", "", "}"), ("check(", "", "}"), ("}", "", "}"), ("", "log((1);", "}")])
def test_java_out_of_balance(lost):
    """A bracket too many or too few costs no other member: all keep their owner, and what follows keeps its routes and lines."""
    got = by_name(braces.java_symbols("x.java", LOST % lost))
    assert {("OrderController", "class"), ("store", "field"), ("load", "method"), ("create", "method"), ("drop", "method"), ("Helper", "class"), ("one", "method")} == set(got)
    assert {k: got[k, "method"]["parent"] for k in ("load", "create", "drop", "one")} == {"load": "OrderController", "create": "OrderController", "drop": "OrderController", "one": "Helper"}
    assert [got[k, "method"]["route"] for k in ("load", "create", "drop")] == ["GET /orders/{id}", "POST /orders/new", "DELETE /orders/{id}"]
    assert (got["drop", "method"]["start_line"], got["drop", "method"]["end_line"]) == (21, 24) and got["drop", "method"]["calls"] == ["drop"]
    assert got["create", "method"]["start_line"] == 13 and got["create", "method"]["end_line"] <= 20


def test_java_annotation_without_its_bracket():
    got = by_name(braces.java_symbols("x.java", LOST.replace('"/{id}")\n    public Order', '"/{id}"\n    public Order') % ("", "", "}")))
    assert {"load", "create", "drop", "one"} <= {name for name, _ in got} and got["create", "method"]["route"] == "POST /orders/new"


MODERN = r"""// a { comment
import React, { useState } from 'react'
import type { User } from "./types"
/* import hidden from 'nowhere' */

export enum Color { Red = 'r', Blue = 'b' }
const pattern = /[{"'`/]\/(/g, other = total / 2 / count
const page = `<p>${user.map((u) => `${show(u)}{`).join('')}</p>`
const add = (a: number, b = 1): number => a + b
const twice = async x => await run(x)
export const config: { [key: string]: () => void } = { start() { go() } }

export function UserCard<T extends { id: string }>({ user }: Props<T>): { a: number } | JSX.Element {
  const [open, setOpen] = useState<string>('')
  const toggle = () => {
    setOpen(don(t))
  }
  return <div className="a{" onClick={() => { toggle(); }}>
    don't {user.name ? <b>it's</b> : <Empty/>} {
      /* } */ format(user)
    }
    <>{list.map(x => <Row key={x} />)}</>
  </div>
}

describe('cards', () => {
  function helper() { return 1 }
  it('works', async () => {
    const inner = async () => { await check(/}/.test(a)) }
    class Local { run() { helper() } }
  })
})

@Controller({ path: 'cards' })
export class CardController<T = {}> extends mixin({ a: 1 }) implements OnInit {
  @Input() title = 'a {'
  private items: Array<{ a: string }> = []
  static { setup() }
  @HostListener('click', ['$event'])
  onClick = async (e: Event): Promise<void> => {
    if (e) { handle(e) }
  }
  [Symbol.iterator]() { return 1 }
  @Get(':id') @UseGuards(Auth) protected async one(@Param('id') id: string, @Body() { a }: X): Promise<{ a: string }> {
    return this.load(id)
  }
  abstract later(): void
  get size(): number { return count(this.items) }
}
if (ready) /}{/.exec(x)
app.get('/api/users/:id', auth, getUser)
router
  .post("/items", Items.create)
router.delete(`/`, (req, res) => { send(res) })
"""


def test_script_contexts():
    """Braces and quotes in comments, templates, regular expressions and JSX hide nothing; functions in callbacks count."""
    got = by_name(scripts.typescript_symbols("src/cards.tsx", MODERN))
    want = {("Color", "enum"), ("add", "function"), ("twice", "function"), ("UserCard", "function"), ("toggle", "function"), ("helper", "function"), ("inner", "function"), ("Local", "class"), ("run", "method"), ("CardController", "class")}
    want |= {("onClick", "method"), ("one", "method"), ("size", "method"), ("getUser", "route"), ("create", "route"), ("delete_root", "route")}
    assert set(got) == want
    line = lambda text: MODERN[: MODERN.index(text)].count("\n") + 1
    card, owner = got["UserCard", "function"], got["CardController", "class"]
    assert (card["start_line"], card["end_line"]) == (line("export function UserCard"), line("describe(") - 2) and card["calls"] == ["setOpen", "don", "toggle", "format", "map"]
    assert (got["add", "function"]["end_line"], got["twice", "function"]["calls"]) == (line("const add"), ["run"]) and got["inner", "function"]["calls"] == ["check", "test"]
    assert owner["implements"] == ["OnInit"] and owner["annotations"] == ["Controller"] and (owner["start_line"], owner["end_line"]) == (line("@Controller"), line("if (ready)") - 1)
    assert got["one", "method"]["route"] == "GET /cards/:id" and got["one", "method"]["annotations"] == ["Get", "UseGuards"] and got["one", "method"]["visibility"] == "protected" and got["one", "method"]["calls"] == ["load"]
    assert got["onClick", "method"]["annotations"] == ["HostListener"] and got["onClick", "method"]["calls"] == ["handle"] and got["run", "method"]["parent"] == "Local"
    assert got["getUser", "route"]["route"] == "GET /api/users/:id" and got["create", "route"]["route"] == "POST /items" and got["delete_root", "route"]["calls"] == ["send"]
    assert card["imports"] == ["react", "./types"] and card["package"] == "src.cards"


def test_script_generics_are_no_elements():
    """An arrow with type parameters, a type assertion in plain TypeScript, and an element that never ends."""
    for path in ("a.ts", "a.tsx"):
        assert {("pick", "function"), ("last", "function")} == set(by_name(scripts.typescript_symbols(path, "const pick = <T,>(x: T) => x\nconst y = a < b && c > d\nfunction last() { return 1 }")))
    assert ("last", "function") in by_name(scripts.typescript_symbols("a.ts", "const x = <any>y\nfunction last() {}"))
    assert ("last", "function") in by_name(scripts.typescript_symbols("a.js", "const x = <p>\nfunction last() {}"))


@pytest.mark.parametrize("text", ["const f = () => { " * 3000, "a(function(){" * 3000 + "})" * 3000, "<a>" * 5000, "`${" * 5000, "const f = (\n" * 5000, "class A { f() {" * 2000, "@A(" * 5000, "public void f(int a) {\n" * 3000, "x = /a/ / /b/\n" * 5000, "/" * 20000, "const f = a =>\n" * 5000, "const a: {" * 5000, "class A<" * 3000, " \n" * 20000])
def test_long_sources_take_little_time(text):
    for parse in (braces.java_symbols, scripts.typescript_symbols):
        begun = time.process_time()
        parse("x.tsx", text)
        assert time.process_time() - begun < 5


def test_tags_and_edges(spark):
    rows = [("a/OrderController.java", "java", JAVA), ("web/users.ts", "typescript", SCRIPT), ("b.java", "java", None), ("c/Config.java", "java", "@Configuration class Config { @Bean Clock clock() { return null; } int other() { return 1; } }"), ("c.xml", "xml", "<a/>")]
    symbols = code.tagged(code.symbols(spark.createDataFrame(rows, "path string, language string, text string"))).cache()
    tags = {(r.name, r.kind): r.tags for r in symbols.collect()}
    assert tags["OrderController", "class"] == ["controller", "api"] and tags["loads", "test"] == ["test"] and tags["all", "method"] == ["route", "api"]
    assert tags["Card", "function"] == ["component", "ui"] and tags["useThing", "function"] == ["hook"]
    assert tags["UserController", "class"] == ["component", "ui", "hook", "controller"]  # the rule for hooks ignores case, so "User" counts
    assert tags["get_users_id", "route"] == ["route", "api"]
    edges = {(r.source, r.target, r.edge_type) for r in code.edges(symbols).collect()}
    assert {("OrderController", "Api", "implements"), ("loads", "load", "tested_by"), ("all", "POST /orders/all", "routes_to"), ("OrderController", "java.util.List", "imports"), ("one", "find", "calls"), ("Config", "clock", "configures")} <= edges
    assert ("Config", "other", "configures") not in edges
