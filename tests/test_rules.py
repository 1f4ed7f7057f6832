"""Rule cases: what a source reports, as (line, column)."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import builtin
from tessera.plans.engine import Config, check, exploded, parse_nodes
from tessera.plans.rule import Card, Rule, RuleError, captured, report
from tessera.sources.files import scan_texts

TODAY = "2024-07-01"


def run(spark, sources, rules, **kw):
    df = spark.createDataFrame(list(sources.items()), "path string, text string")
    return check(spark, scan_texts(df, F.col("path"), F.col("text")), Config(rules, **{k: v for k, v in kw.items() if k in ("severity", "namespaces")}), TODAY, unused=kw.get("unused", False), whole=kw.get("whole", True))


def places(outcome):
    return [(r.file, r.line, r.column) for r in outcome.sorted().collect()]


def messages(outcome):
    return [r.message for r in outcome.sorted().collect()]


SINGLE = [
    (builtin.no_default_export(), "a.ts", "export default parse\n", [(1, 1)]),
    (builtin.no_default_export(), "a.ts", "const x = 1\nexport { x as default, y }\n", [(2, 15)]),
    (builtin.no_default_export(), "a.tsx", "export { default } from './x'\nexport { default as parse } from './y'\n", [(1, 10)]),
    (builtin.no_default_export(), "a.ts", "// default\nexport { parse }\nexport const d = 'default'\n", []),
    (builtin.no_default_export(), "a.py", "default = 1\n", []),
    (builtin.no_restricted_imports([{"module": "lodash"}]), "a.ts", "import merge from 'lodash';\nimport x from 'lodash/merge'\n", [(1, 1)]),
    (builtin.no_restricted_imports([{"module": "lodash/*"}]), "a.ts", "import a from 'lodash'\nimport b from \"lodash/a/b\"\n", [(2, 1)]),
    (builtin.no_restricted_imports([{"module": "stripe", "from": ["!packages/payments/*"]}]), "packages/payments/x/y.ts", "import s from 'stripe'\n", []),
    (builtin.no_restricted_imports([{"module": "stripe", "from": ["!packages/payments/*"]}]), "packages/a.ts", "import s from 'stripe'\n", [(1, 1)]),
    (builtin.no_restricted_imports([{"module": "*", "from": ["src/*", "!src/ok/*"]}]), "src/ok/a.ts", "import s from 'stripe'\n", []),
    (builtin.no_restricted_imports(), "a.ts", "import s from 'stripe'\n", []),
    (builtin.no_broad_except(), "a.py", "try:\n    f()\nexcept:\n    pass\n", [(3, 1)]),
    (builtin.no_broad_except(), "a.py", "try:\n    f()\nexcept Exception as e:\n    pass\nexcept BaseException:\n    pass\n", [(3, 1), (5, 1)]),
    (builtin.no_broad_except(), "a.py", "from x import Exception\ntry:\n    f()\nexcept Exception:\n    pass\n", []),
    (builtin.no_broad_except(), "a.py", "try:\n    f()\nexcept (Exception, ValueError):\n    pass\nexcept KeyError:\n    pass\nexcept a.Exception:\n    pass\n", []),
    (builtin.no_mutable_default_argument(), "a.py", "def f(a, b=[], *, c={}, d={1}):\n    pass\n", [(1, 10), (1, 19), (1, 25)]),
    (builtin.no_mutable_default_argument(), "a.py", "def f(é=list(), b=dict(x=1), c=tuple()):\n    g = lambda z=set(): z\n", [(1, 7), (1, 18), (2, 16)]),
    (builtin.no_mutable_default_argument(), "a.py", "def list(): ...\ndef f(a=list(), b: x = []):\n    pass\n", []),
    (builtin.no_mutable_default_argument(), "a.py", "class A:\n    def list(self): ...\n    def f(self, a=list()): ...\n    class B:\n        def g(a=set()): ...\n", [(3, 17), (5, 15)]),
    (builtin.no_mutable_default_argument(), "a.py", "def f(a=[]:\n", []),
    (builtin.no_context_in_struct(), "a.go", 'package a\n\nimport "context"\n\ntype C struct {\n\tctx context.Context\n\tp *context.Context\n\tn int\n\to, q context.Context `json:"x"`\n\tcontext.Context\n}\n', [(6, 2), (7, 2), (9, 2), (10, 2)]),
    (builtin.no_context_in_struct(), "a.go", 'package a\n\nimport context "my/pkg"\nimport (\n\tc "context"\n)\ntype C struct {\n\tctx c.Context\n}\n', []),
    (builtin.no_context_in_struct(), "a.go", "package a\n\ntype C struct {\n\tctx context.Context\n}\n", []),
    (builtin.no_package_init(), "a.go", "package a\n\nfunc init() {\n\tfunc init() {}()\n}\n\nfunc (t T) init() {}\nfunc initAll() { init() }\n", [(3, 1)]),
    (builtin.no_glob_import(), "a.rs", "use std::io::*;\nuse a::prelude::*;\npub use b::c;\n    use d::*; // x\n", [(1, 1), (4, 5)]),
    (builtin.no_glob_import(["d::*"]), "a.rs", "use d::*;\nuse a::prelude::*;\n", [(2, 1)]),
    (builtin.no_unwrap(), "src/a.rs", "fn f() {\n    let x = g(1)?.h().unwrap();\n    y.expect(\"no\");\n    z.unwrap_or(1);\n}\n", [(2, 13), (3, 5)]),
    (builtin.no_unwrap(), "src/a.rs", "#[cfg(test)]\nmod tests {\n    fn f() { x.unwrap(); }\n}\n#[test]\nfn t() { x.unwrap() }\n#[attest]\nfn u() { x.unwrap() }\n#[test]\nuse a;\nfn v() { x.unwrap() }\n", [(8, 10), (11, 10)]),
    (builtin.no_unwrap(), "tests/a.rs", "fn f() { x.unwrap(); }\n", []),
    (builtin.no_unwrap(["src/gen/*"]), "src/gen/a.rs", "fn f() { x.unwrap(); }\n", []),
]


def test_single_file_rules(spark):
    """All cases in one corpus: each rule and source under a name of its own."""
    for rules in {id(r): r for r, *_ in SINGLE}.values():
        mine = [(p, s, w) for r, p, s, w in SINGLE if r is rules]
        sources, want = {}, []
        for k, (path, source, places_) in enumerate(mine):
            head, _, tail = path.rpartition("/")
            name = f"{head}/{k}{tail}" if head else f"{k}{tail}"
            sources[name] = source
            want += [(name, *p) for p in places_]
        assert sorted(places(run(spark, sources, [rules]))) == sorted(want), rules.id


def test_unused_exports(spark):
    sources = {
        "src/a.ts": "export function used() {}\nexport const left = 1, both = 2\nexport { x as renamed, y }\nexport class K {}\n",
        "src/b.ts": "import { used, both as other } from './a'\nimport { K } from './a.ts'\nexport const alone = 1\n",
        "src/c/index.ts": "export const viaIndex = 1\nexport const no = 2\n",
        "src/d.ts": "import { viaIndex } from './c'\nimport * as ns from './e'\nimport { z } from 'package'\n",
        "src/e.ts": "export const anything = 1\n",
        "src/f.ts": "export * from './g'\n",
        "src/g.ts": "export const covered = 1\n",
        "src/main.ts": "export const entry = 1\n",
        "src/deep/h.ts": "import { alone } from '../b'\n",
    }
    got = messages(run(spark, sources, [builtin.no_unused_exports(["src/main.ts"])]))
    assert got == [f"'{n}' is exported but nothing imports it" for n in ("left", "renamed", "y", "no")]
    assert messages(run(spark, sources, [builtin.no_unused_exports()], whole=False)) == []


@pytest.mark.parametrize(
    ("sources", "want"),
    [
        ({"a": "./b", "b": "./c", "c": ""}, []),
        ({"a": "./b", "b": "./a"}, ["circular import: src/a.ts → src/b.ts → src/a.ts"]),
        ({"a": "./b", "b": "./c", "c": "./a"}, ["circular import: src/a.ts → src/b.ts → src/c.ts → src/a.ts"]),
        ({"a": "./a"}, []),
        ({"a": "./b ./c", "b": "./d", "c": "./d", "d": ""}, []),
        ({"a": "./b", "b": "./a ./c", "c": "./b ./a"}, ["circular import: src/a.ts → src/b.ts → src/a.ts", "circular import: src/a.ts → src/b.ts → src/c.ts → src/a.ts", "circular import: src/b.ts → src/c.ts → src/b.ts"]),
        ({"x": "./a", "a": "package ./b", "b": "./a"}, ["circular import: src/a.ts → src/b.ts → src/a.ts"]),
    ],
)
def test_circular_imports(spark, sources, want):
    files = {f"src/{k}.ts": "".join(f"import '{m}'\n" if m[:1] == "." else f"import x from '{m}'\n" for m in v.split()) for k, v in sources.items()}
    assert sorted(messages(run(spark, files, [builtin.no_circular_imports()]))) == sorted(want)


def test_depth_bounds_the_search(spark):
    ring = {f"src/{i}.ts": f"export * from './{(i + 1) % 5}'\n" for i in range(5)}
    assert messages(run(spark, ring, [builtin.no_circular_imports(4)])) == []
    assert len(messages(run(spark, ring, [builtin.no_circular_imports(5)]))) == 1


def test_directives_and_severity(spark):
    shout = Rule("local/no-debug", "(debugger_statement) @d", Card("debugger", "remove it", "debugger", "log()"), lambda: [report(captured("d"))])
    sources = {
        "a.ts": "// tessera-disable-next-line local/no-debug reason: agreed\ndebugger\ndebugger\n",
        "b.ts": "// tessera-disable-file local/no-debug reason: old expires: 2024-06-30\ndebugger\n",
        "c.ts": "// tessera-disable-file local/other reason: unused\ndebugger\n",
        "d.ts": "// tessera-disable-next-line local/no-debug\ndebugger\n",
        "e.ts": "// tessera-disable-file local/no-debug reason: fine expires: 2024-07-01\ndebugger\n",
    }
    out = run(spark, sources, [shout], unused=True)
    got = [(r.rule_ns + "/" + r.rule_name, r.file, r.line, r.severity) for r in out.sorted().collect()]
    assert got == [
        ("local/no-debug", "a.ts", 3, "error"), ("local/no-debug", "c.ts", 2, "error"), ("local/no-debug", "d.ts", 2, "error"),
        ("tessera/suppression", "b.ts", 1, "error"), ("tessera/suppression", "c.ts", 1, "warn"), ("tessera/suppression", "d.ts", 1, "error"),
    ]
    assert places(run(spark, sources, [shout], severity={"local/no-debug": "off"})) == []
    assert {r.severity for r in run(spark, {"a.ts": "debugger"}, [shout], severity={"local/no-debug": "warn"}).sorted().collect()} == {"warn"}


def test_configuration_switches_rules_on(spark):
    """A rule that is off by itself runs where the configuration says so, at the severity that it says."""
    off = Rule("local/no-debug", "(debugger_statement) @d", Card("debugger", "remove it", "debugger", "log()"), lambda: [report(captured("d"))], severity="off")
    assert places(run(spark, {"a.ts": "debugger\n"}, [off])) == []
    assert [r.severity for r in run(spark, {"a.ts": "debugger\n"}, [off], severity={"local/no-debug": "warn"}).sorted().collect()] == ["warn"]


def test_more_rules_than_one_projection_takes(spark):
    rules = [Rule(f"local/r{k}", "(debugger_statement) @d", Card(f"m{k}", "r", "a", "b"), lambda: [report(captured("d"))]) for k in range(120)]
    assert messages(run(spark, {"a.ts": "debugger\n"}, rules)) == [f"m{k}" for k in sorted(range(120), key=lambda k: f"r{k}")]


def test_profile(spark):
    from tessera.operators.reports import profile

    df = spark.createDataFrame([("a.ts", "debugger\ndebugger\n"), ("b.ts", "x\n")], "p string, t string")
    rules = [Rule("local/d", "(debugger_statement) @d", Card("m", "r", "a", "b"), lambda: [report(captured("d"))]), Rule("local/n", "(class_declaration) @d", Card("m", "r", "a", "b"), lambda: [])]
    out = check(spark, scan_texts(df, F.col("p"), F.col("t")), Config(rules), TODAY, profile=True)
    ranked = {r.rule_name: r for r in profile(out.timings).collect()}
    assert (ranked["d"].matches, ranked["n"].matches) == (2, 0) and ranked["d"].query_ms > 0 and places(out) == [("a.ts", 1, 1), ("a.ts", 2, 1)]
    assert check(spark, scan_texts(df, F.col("p"), F.col("t")), Config(rules), TODAY).timings.isEmpty()


BINDINGS = [
    ("a.ts", "import d, { a as b } from 'm'; import * as n from 'k'\nfunction f(p, { q, r: [s = 1] }, ...t) { const c = 1; { let b = 2; USE } }\n", {"d": ("import", "m", "default", False), "b": ("let", None, None, True), "n": ("import", "k", "*", False), "p": ("param", None, None, False), "q": ("param", None, None, False), "s": ("param", None, None, False), "t": ("param", None, None, False), "c": ("const", None, None, False), "f": ("function", None, None, False), "r": (None, None, None, False)}),
    ("a.tsx", "const x = 1\nclass K { m(x) { try { g() } catch ({ message: e }) { USE } } }\n", {"x": ("param", None, None, True), "e": ("catch-param", None, None, False), "message": (None, None, None, False), "K": ("class", None, None, False), "m": (None, None, None, False)}),
    ("a.go", "package p\nimport ( \"context\"; j \"encoding/json\"; _ \"x/z\" )\nvar g int\nconst k = 1\ntype T[P any] struct {}\nfunc f(a int, rest ...string) (err error) { for i, w := range a { if v := w; v { switch y := v.(type) { case int: d := 1; USE } } } }\nfunc (r *T) m(k int) { USE2 }\n", {"context": ("import", "context", "*", False), "j": ("import", "encoding/json", "*", False), "json": (None, None, None, False), "z": (None, None, None, False), "g": ("var", None, None, False), "k": ("const", None, None, False), "T": ("type", None, None, False), "P": (None, None, None, False), "f": ("function", None, None, False), "a": ("param", None, None, False), "rest": ("param", None, None, False), "err": ("param", None, None, False), "i": ("loop", None, None, False), "v": ("var", None, None, False), "y": ("var", None, None, False), "d": ("var", None, None, False), "r": (None, None, None, False)}),
    ("a.rs", "use std::{io::{self, Read as R}, fmt};\nuse serde::*;\nconst C: u8 = 1;\nstatic S: u8 = 1;\nstruct P { x: u8 }\ntrait W { fn z(&self); }\nmod m { fn hidden() {} }\nfn f<T>(a: u8, P { x, y: q }: P) { let C2 { b, .. } = c; if let Some(v) = a { for (n, _) in xs { match n { Kind::A(w) => { let a = 1; ys.map(|e| USE) } } } } }\n", {"io": ("import", "std", "io", False), "R": ("import", "std::io", "Read", False), "Read": (None, None, None, False), "fmt": ("import", "std", "fmt", False), "C": ("const", None, None, False), "S": ("var", None, None, False), "P": ("type", None, None, False), "W": ("trait", None, None, False), "m": ("module", None, None, False), "hidden": (None, None, None, False), "z": (None, None, None, False), "f": ("function", None, None, False), "T": ("type-param", None, None, False), "a": ("let", None, None, True), "x": ("param", None, None, False), "y": (None, None, None, False), "q": ("param", None, None, False), "b": ("let", None, None, False), "v": ("let", None, None, False), "Some": (None, None, None, False), "n": ("loop", None, None, False), "w": ("let", None, None, False), "Kind": (None, None, None, False), "e": ("param", None, None, False)}),
    ("a.py", "import a.b, c as d\nfrom m import x as y\nfrom k import *\ndef f(p, *q, r=1, **s):\n    with o() as w:\n        for i in p:\n            try:\n                t = [u for u in i]; USE\n            except E as e:\n                pass\nclass K:\n    inner = 1\n    def g(self):\n        pass\n", {"a": ("import", "a", "*", False), "b": (None, None, None, False), "d": ("import", "c", "*", False), "y": ("import", "m", "x", False), "p": ("param", None, None, False), "q": ("param", None, None, False), "s": ("param", None, None, False), "w": ("context-manager", None, None, False), "i": ("loop", None, None, False), "t": ("assignment", None, None, False), "u": (None, None, None, False), "e": ("catch-param", None, None, False), "f": ("function", None, None, False), "K": ("class", None, None, False), "inner": (None, None, None, False)}),
    ("a.js", "export const x = a => b => { var v; for (let i = 0; i < 1; i++) { USE } }\nfunction other(w) { let z }\n", {"x": ("const", None, None, False), "a": ("param", None, None, False), "b": ("param", None, None, False), "v": ("var", None, None, False), "i": ("let", None, None, False), "w": (None, None, None, False), "z": (None, None, None, False), "other": ("function", None, None, False)}),
]


def test_bindings_within_functions_and_blocks():
    from tessera.functions.globs import star_to_regex
    from tessera.sources.files import LANGUAGES
    from tessera.sources.parsers import parse
    from tessera.sources.tree import Tree

    assert star_to_regex("a*").startswith("(?s)")
    for path, source, want in BINDINGS:
        for name, bound in want.items():
            text = source.replace("USE2", "").replace("USE", f"USE({name})").encode()
            p = parse(text, LANGUAGES[path.rpartition(".")[2]])
            tree = Tree(p.root, text, p.scopes, p.decls)
            at = text.index(b"USE(") + 4
            (n,) = [x for x in tree.nodes if x.kind.endswith("identifier") and x.start == at]
            assert tree.binding(n) == bound, (path, name)


def test_combined_equals_separate(spark):
    sources = {f"m{k}{p}": s for k, (_, p, s, _) in enumerate(SINGLE) if "/" not in p}
    rules = list({r.id: r for r, *_ in SINGLE}.values())
    alone = sorted(x for r in rules for x in places(run(spark, sources, [r])))
    assert sorted(places(run(spark, sources, rules))) == alone


def test_rules_are_validated():
    card = Card("m", "r", "bad", "good")
    ok = dict(id="local/x", query="(program) @p", card=card, check=lambda: [])
    Rule(**ok)
    for change in ({"id": "x"}, {"id": "local/X"}, {"query": " "}, {"query": "(nothing) @x"}, {"query": "(program)"}, {"query": "(program @p"}, {"query": "(program nothing: (_) @x)"}, {"query": "(program !nothing) @x"}, {"query": "(identifier (_) @x)"}, {"query": "(statement_block (program) @x)"}, {"query": "(pair !key key: (_) @k)"}, {"languages": ()}, {"languages": ("cobol",)}, {"severity": "fatal"}, {"card": Card("m", "r", "same", "same ")}, {"card": Card("", "r", "a", "b")}, {"check": None}):
        with pytest.raises(ValueError):
            Rule(**(ok | change))
    with pytest.raises(RuleError):
        Config([Rule(**(ok | {"id": "other/x"}))])


def test_navigation(spark):
    from tessera.operators import navigation as nav

    source = "import os as list\nclass A:\n    set = 1\n    def f(self, a=list()):\n        return set(x for x in a)\n"
    df = spark.createDataFrame([("a.py", source)], "path string, text string")
    parsed = parse_nodes(scan_texts(df, F.col("path"), F.col("text"))).cache()
    nodes, scopes, decls = (exploded(parsed, p) for p in ("nodes", "scopes", "decls"))
    root = nodes.filter("parent_id IS NULL").first()
    assert root.kind == "module" and (root.line, root.column) == (1, 1) and root.post == nodes.count() - 1
    calls = nodes.filter("kind = 'call'")
    assert {(r.ancestor_kind) for r in nav.ancestors(calls, nodes).collect()} >= {"module", "class_definition", "function_definition"}
    functions = nodes.filter("kind = 'function_definition'")
    near = {r.ancestor_id for r in nav.closest_ancestor(calls, nodes, functions.union(nodes.filter("kind = 'module'"))).collect()}
    assert near == {functions.first().node_id}
    assert nav.subtree(functions, nodes).filter("inner_kind = 'call'").count() == calls.count()
    names = {r.name: (r.binding, r.shadowed) for r in nav.bindings(nodes.filter("kind = 'identifier'"), nodes, scopes, decls).join(nodes.select("file", "node_id", F.col("text").alias("name")), ["file", "node_id"]).collect()}
    assert names["list"] == ("import", False) and names["a"][0] == "param" and names["set"] == ("assignment", False)
    uses = nav.bindings(calls.select("file", (F.col("node_id") + 1).alias("node_id")), nodes, scopes, decls).collect()
    assert [r.binding for r in uses] == ["import"]
    assert nav.parent(nodes, nodes).count() == nodes.count() and nav.children(nodes, nodes, named=True).count() == nodes.count() - 1
