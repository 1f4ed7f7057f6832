"""Reporters over sorted violations: human, JSON, SARIF and agent forms; listings and profile."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.violations import ORDER, canonical

#: Severity -> SARIF level.
LEVELS = {"error": "error", "warn": "warning", "off": "note"}


def human_lines(violations: DataFrame) -> DataFrame:
    """violations with `lines`: the two lines that a terminal shows for each."""
    where = F.format_string("%s:%d:%d", "file", "line", "column")
    return violations.withColumn("lines", F.concat(where, F.lit(" "), "severity", F.lit(" ["), F.concat_ws("/", "rule_ns", "rule_name"), F.lit("] "), "message", F.lit("\n  → "), "remediation"))


def human(violations: DataFrame) -> Iterator[str]:
    """The report's lines in canonical order, streamed from one partition after another, then the summary."""
    for r in canonical(human_lines(violations)).select("lines").toLocalIterator():
        yield r["lines"]
    n = violations.agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warn").alias("w")).first()
    if not n["e"] and not n["w"]:
        yield "no violations"
    else:
        yield ", ".join(f"{k} {w}{'s' if k != 1 else ''}" for k, w in ((n["e"], "error"), (n["w"], "warning")) if k)


def json_rows(violations: DataFrame) -> DataFrame:
    """violations with `json`: one object each, null fields left out."""
    item = F.struct(F.concat_ws("/", "rule_ns", "rule_name").alias("rule"), "file", "line", "column", "message", "remediation", "severity", "fix")
    return violations.withColumn("json", F.to_json(item))


def json_report(violations: DataFrame, files_discovered: int, files_parsed: int, warn_only: bool = False) -> Iterator[str]:
    """The document in pieces: violations are streamed from one partition after another and never held together."""
    sums = violations.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors")).first()
    head = {"version": 1, "ok": warn_only or not sums["errors"], "total": sums["n"], "files_discovered": files_discovered, "files_parsed": files_parsed, "warn_only": warn_only}
    yield json.dumps(head, indent=2)[:-2] + ',\n  "violations": ['
    yield from _items((json.loads(r["json"]) for r in canonical(json_rows(violations)).select("json").toLocalIterator()), 4)
    yield "\n  ]\n}" if sums["n"] else "]\n}"


def _items(rows: Iterable[dict], indent: int) -> Iterator[str]:
    """The entries of a JSON list, each in pieces of its own."""
    for k, row in enumerate(rows):
        text = json.dumps(row, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * indent)
        yield f"{',' if k else ''}\n{' ' * indent}{text}"


def rule_index(violations: DataFrame) -> DataFrame:
    """violations with rule_index: the place, from 0, of their rule among the rules that fired."""
    fired = violations.select("rule_ns", "rule_name").distinct()
    # one row per configured rule at most
    numbered = fired.withColumn("rule_index", (F.row_number().over(Window.orderBy("rule_ns", "rule_name")) - 1).cast("int"))
    return violations.join(numbered, ["rule_ns", "rule_name"])


def sarif_report(violations: DataFrame, tool: str = "tessera", version: str = "0.1.0") -> Iterator[str]:
    """The document in pieces; rules that fired, which are of the configuration, come first, results are streamed."""
    indexed = rule_index(violations)
    fired = indexed.groupBy("rule_index", "rule_ns", "rule_name").agg(F.first("remediation").alias("help")).orderBy("rule_index").collect()
    driver = {"name": tool, "version": version, "rules": [{"id": f"{r['rule_ns']}/{r['rule_name']}", "help": {"text": r["help"]}} for r in fired]}
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": []}]}

    def result(r) -> dict:
        where = {"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["line"], "startColumn": r["column"]}}}
        return {"ruleId": f"{r['rule_ns']}/{r['rule_name']}", "ruleIndex": r["rule_index"], "level": LEVELS.get(r["severity"], "note"), "message": {"text": r["message"]}, "locations": [where]}

    before, _, after = json.dumps(head, indent=2, ensure_ascii=False).rpartition('"results": []')
    yield before + '"results": ['
    yield from _items(map(result, canonical(indexed).toLocalIterator()), 8)
    yield ("\n      ]" if fired else "]") + after


def agent_rows(violations: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per violation: its rule's card, and its own message only where it is not the card's. Sorted, rows of a rule stand together, so no rule's locations become one row.

    cards: rule_ns, rule_name, card_message, card_remediation; one row per configured rule.
    """
    own = F.when(~F.col("message").eqNullSafe(F.col("card_message")), F.col("message"))
    joined = violations.join(cards, ["rule_ns", "rule_name"], "left")
    return joined.select("rule_ns", "rule_name", "file", "line", "column", F.col("card_message").alias("card"), F.coalesce("card_remediation", "remediation").alias("remediation"), own.alias("message"))


def agent_report(violations: DataFrame, cards: DataFrame) -> Iterator[str]:
    """The report's lines, streamed: a rule's card once, then its locations."""
    rule = None
    for r in canonical(agent_rows(violations, cards), "message").toLocalIterator():
        if rule != (r["rule_ns"], r["rule_name"]):
            rule = (r["rule_ns"], r["rule_name"])
            yield f"{'/'.join(rule)}: {r['card']}"
            yield f"  fix: {r['remediation']}"
        yield f"  {r['file']}:{r['line']}:{r['column']}" + (f" {r['message']}" if r["message"] else "")


def profile(timings: DataFrame) -> DataFrame:
    """timings (rule_ns, rule_name, query_ms, handler_ms, matches) summed by rule, costliest first, then by rule."""
    total = timings.groupBy("rule_ns", "rule_name").agg(F.sum("query_ms").alias("query_ms"), F.sum("handler_ms").alias("handler_ms"), F.sum("matches").alias("matches"))
    return total.withColumn("total_ms", F.col("query_ms") + F.col("handler_ms")).orderBy(F.desc("total_ms"), *ORDER[:2])
