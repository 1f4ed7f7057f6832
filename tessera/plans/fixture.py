"""A synthetic source corpus, made by tasks: for measuring, and for checking a run's rows against arithmetic."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import builtin
from tessera.plans.engine import Config, Outcome, check
from tessera.plans.rule import Card, Rule, captured, report
from tessera.sources.files import scan_texts

#: Line of the debugger statement: two imports, eight functions of four lines, a class of fifteen.
DEBUGGER_LINE = 2 + 8 * 4 + 15 + 1


def source_files(spark: SparkSession, n: int = 2_000) -> DataFrame:
    """src/mNNNN.ts: imports of the next file and of a type, eight exported functions, a class; a debugger in every 20th."""
    nxt = F.format_string("m%04d", (F.col("id") + 1) % n)
    functions = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.format_string("export function f%d(a: number, b: number) {\n  const c = a + b\n  return c * %d\n}\n", k, k)), "")
    methods = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.format_string("  m%d(x: string) {\n    return this.name + x\n  }\n", k)), "")
    head = F.concat(F.lit("import { f0 } from './"), nxt, F.lit("'\nimport type { T } from './types'\n"))
    body = F.concat(F.format_string("export class C%d {\n  name = ''\n", F.col("id")), methods, F.lit("}\n"))
    text = F.concat(head, functions, body, F.when(F.col("id") % 20 == 0, "debugger\n").otherwise(""))
    return scan_texts(spark.range(n).repartition(8), F.format_string("src/m%04d.ts", F.col("id")), text)


#: Code that stands after a document's text, by language; lines count from the one after the text. {n} is the document, {n+1} and {n-2} others.
CODE = {
    "ts": "import {{ alpha }} from './{next}'\nexport function alpha(a) {{\n  const list = a\n  return list(a)\n}}\nexport const beta = 1\n",
    "rules.ts": "export const r = defineRule({{ gates: {{ fileContains: ['a', 'b'] }}, check(ctx, m) {{ ctx.emitFact({{ n: m.x }}) }}, reduce(ctx) {{ ctx.text(1) }} }})\n{call}('x')\nfunction f(ctx) {{ const p = ctx.parent(1); if (!p) return }}\n",
    "py": "import os{renamed}\ndef f(a, b=[], c=list()):\n    try:\n        return open(a)\n    except {caught}:\n        sys.stdout.write(a)\n",
    "go": "package p\n{imports}\ntype C struct {{\n\tctx context.Context\n}}\nfunc {name}() {{}}\n",
    "rs": "use std::collections::{used};\nfn f() {{ g().unwrap(); }}\n#[test]\nfn t() {{ g().unwrap(); }}\n",
}


def module(n: Column) -> Column:
    return F.format_string("d%012d", n)


def document_sources(documents: DataFrame, extension: str, path: str = "src") -> DataFrame:
    """A source file for each document: its whole text as a comment, then some code that depends on doc_id.

    Every third TypeScript file imports the one two before it, the others the next one. Every 20th stops in
    the debugger.
    """
    n = F.col("doc_id")
    ends = F.regexp_replace(F.coalesce("text", F.lit("")), "[*]/|/[*]", "")
    text = F.concat(F.lit("# "), F.replace(ends, F.lit("\n"), F.lit("\n# "))) if extension == "py" else F.concat(F.lit("/*"), ends, F.lit("*/"))
    given = {
        "next": module(F.when(n % 3 == 2, n - 2).otherwise(n + 1)),
        "renamed": F.when(n % 4 == 0, " as list").otherwise(""),
        "caught": F.when(n % 2 == 0, "Exception").otherwise("KeyError"),
        "imports": F.when(n % 3 == 0, "var x int").otherwise('import "context"'),
        "name": F.when(n % 2 == 0, "init").otherwise("setup"),
        "call": F.when(n % 2 == 0, "eval").otherwise("evil"),
        "used": F.when(n % 2 == 0, "*").otherwise("HashMap"),
    }
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(CODE[extension]):
        parts += [F.lit(literal)] + ([given[name]] if name else [])
    last = F.when((n % 20 == 0) & F.lit(extension == "ts"), "debugger\n").otherwise("")
    return scan_texts(documents, F.concat(F.lit(f"{path}/"), module(n), F.lit(f".{extension}")), F.concat(text, F.lit("\n"), *parts, last))


def no_debugger() -> Rule:
    return Rule("local/no-debugger", "(debugger_statement) @at", Card("debugger statement", "remove it", "debugger", "log(x)"), lambda: [report(captured("at"))])


def twenty_rules() -> list[Rule]:
    """Both whole-corpus rules, and eighteen over five queries, of which every fifth finds the debugger."""
    rules = [builtin.no_unused_exports(), builtin.no_circular_imports()]
    queries = ("(debugger_statement) @n", "(export_statement) @n", "(class_declaration) @n", "(import_statement) @n", "(function_declaration) @n")
    for k in range(18):
        name = "debugger" if k % 5 == 0 else "nothing"
        rules.append(Rule(f"local/r{k}", queries[k % 5], Card("found", "remove", "a", "b"), lambda hit=name: [report(captured("n"), when=captured("n")["text"] == hit)]))
    return rules


def run(spark: SparkSession, files: DataFrame, rules: list[Rule]) -> Outcome:
    return check(spark, files, Config(rules), "2024-07-01")
