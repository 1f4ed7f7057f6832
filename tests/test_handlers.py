import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_rules import run

from tessera.operators.fixes import apply_fixes
from tessera.plans.engine import Config, check, declared_files
from tessera.plans.handlers import handler
from tessera.plans.rule import Card, Rule, RuleError
from tessera.sources.files import scan_texts

CARD = Card("found", "fix it", "a", "b")


def test_python_handler_reports_facts_and_fixes(spark):
    def speak(ctx, m):
        at = m["d"]
        start, end = ctx.range(at)
        ctx.report(at, f"in {ctx.file_path}", {"start": start, "end": end, "replacement": "", "safe": True})
        ctx.emit_fact("seen", {"file": "lie", "line": ctx.line(at)})
        ctx.emit_fact("seen", {"again": True})

    rule = Rule("local/python", "(debugger_statement) @d", CARD, handler(speak))
    got = run(spark, {"a.ts": "debugger\nx\ndebugger\n"}, [rule])
    rows = got.sorted().collect()
    assert [(r.line, r.message, r.fix.end) for r in rows] == [(1, "in a.ts", 8), (3, "in a.ts", 19)]
    assert [(r.sequence, r.data, r.file) for r in got.facts.orderBy("sequence").collect()] == [(0, '{"line": 1}', "a.ts"), (1, '{"again": true}', "a.ts"), (2, '{"line": 3}', "a.ts"), (3, '{"again": true}', "a.ts")]
    files = spark.createDataFrame([("a.ts", "debugger\nx\ndebugger\n")], "file string, source string")
    assert apply_fixes(files, got.violations).first().source == "\nx\n\n"


BROKEN = ["ctx.emit_fact('', {})", "ctx.emit_fact('#x', {})", "ctx.emit_fact('k', [1])", "[x for x in iter(int, 1)]", "ctx.read_file('undeclared')", "ctx.read_file('../x')", "ctx.file_exists('/etc/passwd')"]


def test_python_handler_is_bounded(spark):
    for body in BROKEN:
        scope = {}
        exec(f"def speak(ctx, m):\n    {body}\n", scope)
        rule = Rule("local/python", "(debugger_statement) @d", CARD, handler(scope["speak"]), timeout_ms=200)
        with pytest.raises(PySparkException):
            run(spark, {"a.ts": "debugger\n"}, [rule]).violations.agg(F.count("*")).collect()


def test_timeouts_of_rule_and_configuration(spark):
    """A rule's own budget holds; without one the configuration's does."""
    def slow(ctx, m):
        import time

        time.sleep(0.3)
        ctx.report(m["d"])

    files = scan_texts(spark.createDataFrame([("a.ts", "debugger\n")], "p string, t string"), F.col("p"), F.col("t"))
    make = lambda ms: Rule("local/slow", "(debugger_statement) @d", CARD, handler(slow), timeout_ms=ms)
    assert check(spark, files, Config([make(5_000)], timeout_ms=50), "2024-07-01").violations.count() == 1
    assert check(spark, files, Config([make(None)]), "2024-07-01").violations.count() == 1
    with pytest.raises(PySparkException, match="more than 50 ms"):
        check(spark, files, Config([make(None)], timeout_ms=50), "2024-07-01")


def test_context(spark):
    """Every capability, on one file."""
    source = "import { read as load } from '@app/files'\nfunction f(load) {\n  return load(1)\n}\nload(2)\n"

    def speak(ctx, m):
        call, fn = m["call"], m["fn"]
        up = [ctx.kind(a) for a in ctx.ancestors(call)]
        near = ctx.closest_ancestor(call, "(function_declaration name: (identifier) @name) @f")
        inner = ctx.query_subtree(call, "(identifier) @i")
        side = (ctx.read_file("notes.md"), ctx.file_exists("none.md"), ctx.read_file("none.md"))
        ctx.emit_fact("call", {
            "text": ctx.text(call), "loc": ctx.loc(call), "kind": ctx.kind(call), "named": ctx.is_named(call), "up": up, "parent": ctx.kind(ctx.parent(call)), "top": ctx.parent(ctx.root) is None,
            "children": [ctx.kind(c) for c in ctx.children(call)], "named_children": [ctx.kind(c) for c in ctx.named_children(call)], "near": near and ctx.text(near["name"]), "inner": [ctx.text(x["i"]) for x in inner],
            "binding": ctx.binding_kind(fn), "shadowed": ctx.is_shadowed(fn), "import": ctx.resolves_to_import(fn, "@app/files"), "named_import": ctx.resolves_to_import(fn, "@app/files", "read"),
            "other": ctx.resolves_to_import(fn, "@app/files", "load"), "glob": ctx.is_imported_from(fn, "@app/*"), "no_glob": ctx.is_imported_from(fn, "*/lib"), "side": side, "today": ctx.today, "length": len(ctx.file_text), "path": ctx.file_path,
        })

    rule = Rule("local/context", "(call_expression function: (identifier) @fn) @call", CARD, handler(speak), reads=("notes.md", "none.md"))
    sides = declared_files([rule], {"notes.md": b"hello"}.get)
    files = scan_texts(spark.createDataFrame([("src/a.ts", source)], "p string, t string"), F.col("p"), F.col("t"))
    out = check(spark, files, Config([rule]), "2024-07-01", sides=sides)
    import json

    inner, outer = (json.loads(r.data) for r in out.facts.orderBy("sequence").collect())
    assert (inner["text"], inner["loc"]["line"], inner["loc"]["column"], inner["kind"], inner["named"], inner["top"]) == ("load(1)", 3, 10, "call_expression", True, True)
    assert inner["up"][0] == inner["parent"] and inner["up"][-1] == "program" and "function_declaration" in inner["up"]
    assert inner["children"][0] == "identifier" and inner["named_children"] == ["identifier", "arguments"]
    assert (inner["near"], outer["near"], inner["inner"]) == ("f", None, ["load"])
    assert (inner["binding"], inner["shadowed"], inner["import"], inner["glob"]) == ("param", True, False, False)
    assert (outer["binding"], outer["shadowed"], outer["import"], outer["named_import"], outer["other"], outer["glob"], outer["no_glob"]) == ("import", False, True, True, False, True, False)
    assert inner["side"] == ["hello", False, None] and inner["today"] == "2024-07-01" and inner["length"] == len(source) and inner["path"] == "src/a.ts"
    assert {(r.file, r.path, r.hash is None) for r in out.reads.collect()} == {("src/a.ts", "notes.md", False), ("src/a.ts", "none.md", True)}


def test_declared_reads_stay_within_the_project_and_bounds():
    for path in ("/etc/passwd", "../x", "a/../../x", ""):
        with pytest.raises(RuleError):
            Rule("local/x", "(program) @p", CARD, lambda: [], reads=(path,))
    rule = Rule("local/x", "(program) @p", CARD, lambda: [], reads=("a", "b"))
    assert declared_files([rule], {"a": b"\xff"}.get)["a"][0] is None and declared_files([rule], lambda p: None)["b"] == (None, None)
    with pytest.raises(RuleError, match="bytes"):
        declared_files([rule], lambda p: b"x" * (40 << 20))
