import pytest

from tessera.plans import project_rules as p
from tessera.plans.rule import RuleError
from test_rules import places, run

CASES = [
    (p.one_parser_per_file(), "a.rs", "fn f() { let p = tree::Parser::new(); MyParser::new(1); Parser::news(); }\n#[test]\nfn t() { Parser::new(); }\n", [(1, 18), (1, 39)]),
    (p.no_ambient_authority(["ok.rs"]), "a.rs", "use std::process::Command;\nuse std::{net, fs};\nfn f() { std::net::TcpStream::connect(x); a::b(); }\n", [(1, 1), (3, 10)]),
    (p.no_ambient_authority(["ok.rs"]), "ok.rs", "use std::process::Command;\n", []),
    (p.tracked_reads_only(["a"]), "a.rs", "use std::fs;\nfn f() { std::fs::read(x); fs::read(y); offs::read(z); }\n", [(1, 1), (2, 10), (2, 28)]),
    (p.tracked_reads_only(["b"]), "a.rs", "use std::fs::read;\n", []),
    (p.no_ambient_observation(["a"]), "a.rs", "fn f() { std::time::Instant::now(); env::vars(); later(SystemTime::now()); }\n", [(1, 10), (1, 37), (1, 56)]),
    (p.deterministic_iteration(["a"]), "a.rs", "use std::collections::{HashMap, BTreeMap};\nfn f() { let m: HashMap<u8, u8> = HashMap::new(); std::collections::HashSet::new(); BTreeMap::new(); }\n", [(1, 1), (2, 35), (2, 51)]),
    (p.deterministic_iteration(["b"]), "a.rs", "use std::collections::HashMap;\n", []),
    (p.sandbox_containment(allow=["core/"]), "a.rs", "use wasmtime::Engine;\nfn f() { x::wasmtime::go(); wasmtimes::go(); }\n", [(1, 1), (2, 10)]),
    (p.sandbox_containment(allow=["core/"]), "core/a.rs", "use wasmtime::Engine;\n", []),
    (p.gates_are_and(), "a.ts", "const r = { gates: { fileContains: ['a', 'b'], fileNotContains: ['c'] }, other: ['a', 'b'] }\n", [(1, 22)]),
    (p.rule_declares_language(), "a.ts", "defineRule({ id: 'x' })\ndefineRule({ id: 'y', language: ['go'] })\nother({ id: 'z' })\n", [(1, 1)]),
    (p.reduce_touches_no_tree(), "a.ts", "const r = { check(ctx) { ctx.text(n) }, reduce(ctx) { ctx.facts('a'); f(ctx.text(n)); other.text(n) } }\n", [(1, 73)]),
    (p.facts_must_serialize(), "a.ts", "ctx.emitFact({ kind: 'a', n: m.decl, t: ctx.text(m.decl), o: options.kind })\nctx.other({ n: m.decl })\n", [(1, 27)]),
    (p.node_handle_truthiness(), "a.ts", "function f(ctx, n) {\n  const p = ctx.parent(n), r = ctx.root, d = dirs.root, k = ctx.kind(n)\n  if (!p) return\n  if (!r || !d || !k) return\n  if (p === undefined) return\n}\nconst q = ctx.parent(1); if (!q) x()\n", [(3, 7), (4, 7)]),
    (p.no_eval_in_rules(), "a.ts", "eval('1')\nnew Function('x')\nnew Foo(eval)\na.eval()\n", [(1, 1), (2, 1)]),
    (p.explicit_encoding(), "a.py", "open(p)\nopen(p, 'rb')\nopen(p, mode='wb')\nopen('b', mode=b)\np.read_text()\np.write_text(x, encoding='u')\np.read_bytes()\nopen(p, 'r', encoding=e)\np.read_text('b', 'b')\n", [(1, 1), (4, 1), (5, 1), (9, 1)]),
    (p.stdout_write(), "a.py", "import sys\nsys.stdout.write('x')\nsys.stdout.buffer.write(b'x')\nstdout.write('x')\n", [(2, 1)]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_project_rules(spark, case):
    rule, path, source, want = CASES[case]
    assert places(run(spark, {path: source}, [rule])) == [(path, *x) for x in want]


def test_scopes_are_needed():
    for make in (p.tracked_reads_only, p.no_ambient_observation):
        with pytest.raises(RuleError, match="scope"):
            make([])


HOST = 'fn register() {\n    object.set("line", 1);\n    object.set(r#"hidden"#, 2);\n    object.set("file", 3);\n    other.get("no");\n}\n#[cfg(test)]\nmod tests {\n    fn t() { object.set("tested", 1); }\n}\n'
KINDS = 'impl K {\n    fn as_str(self) -> &\'static str {\n        match self {\n            Self::A => "known",\n            Self::B => "new",\n            Self::C => "",\n        }\n    }\n    fn other(self) -> &\'static str { match self { Self::A => "free" } }\n}\n'
TYPES = "export interface CheckContext {\n  /** text: not one */\n  line(n: Node): number\n  readonly root: Node\n  optional?(): void\n}\nexport interface Other {\n  unseen(): void\n}\nexport type BindingKind =\n  | 'known'\n  | 'second'\n\nexport type More = 'new'\n"


@pytest.mark.parametrize(
    ("rule", "source", "types", "want"),
    [
        (p.host_api_matches_types("a.rs", "t.d.ts"), HOST, TYPES, ["`hidden` is offered by the host, and t.d.ts does not say so", "`optional` is declared in t.d.ts, and the host has none", "`root` is declared in t.d.ts, and the host has none"]),
        (p.host_api_matches_types("a.rs", "t.d.ts"), HOST, None, ["there is no `t.d.ts` that could say what the host offers"]),
        (p.host_api_matches_types("b.rs", "t.d.ts"), HOST, None, []),
        (p.binding_kinds_are_typed("a.rs", "t.d.ts"), KINDS, TYPES, ["`new` is no member of BindingKind, so no rule can ask for it"]),
        (p.binding_kinds_are_typed("a.rs", "t.d.ts"), KINDS, None, ["there is no `t.d.ts` that could list the kinds"]),
    ],
)
def test_rules_that_read_another_file(spark, rule, source, types, want):
    from pyspark.sql import functions as F

    from tessera.plans.engine import Config, check, declared_files
    from tessera.sources.files import scan_texts

    files = scan_texts(spark.createDataFrame([("a.rs", source)], "p string, t string"), F.col("p"), F.col("t"))
    sides = declared_files([rule], lambda path: None if types is None else types.encode())
    out = check(spark, files, Config([rule]), "2024-07-01", sides=sides)
    assert sorted(r.message for r in out.violations.collect()) == want
