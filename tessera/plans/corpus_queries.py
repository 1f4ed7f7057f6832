"""Registered queries: the engine's operators on the driver's tables, each with the same in DuckDB's SQL.

A document stands for a file at docs/<source>/<doc_id>.txt; three line rules give violations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import cache, directives, fixes, gates, imports, navigation, reports, violations
from tessera.operators.reduce_phase import circular_imports, unused_exports
from tessera.operators.tables import checkpointed
from tessera.plans import builtin, engine, fixture, project_rules
from tessera.plans.handlers import handler
from tessera.plans.rule import Card, Rule
from tessera.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.format_string("docs/%s/%d.txt", "source", "doc_id")
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("file"), F.coalesce("text", F.lit("")).alias("source"), "lang")


# --- gates -----------------------------------------------------------------------------------------


@_query("SELECT doc_id FROM documents WHERE contains(text, 'License') AND contains(text, 'under') AND NOT contains(text, 'MIT')")
def gate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = gates.Gates(file_contains=["License", "under", ""], file_not_contains=["MIT"])
    return _files(spark, sf_dir).filter(gates.admits_content(F.col("source"), gate)).select("doc_id")


@_query(r"""SELECT page_id, path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
WHERE regexp_full_match(path, '.*example\.(com|org)/.*') AND NOT regexp_full_match(path, '(blog|m)\..*')""")
def gate_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    gate = gates.Gates(path_matches=["**/*example.{com,org}/**", "*example.{com,org}/*"], path_not_matches=["{blog,m}.*"])
    return pages.filter(gates.admits_path(F.col("path"), gate))


# --- positions, directives ----------------------------------------------------------------------------

_LINES_SQL = """lines AS (SELECT file, line, t AS text FROM (SELECT 'docs/' || source || '/' || doc_id || '.txt' AS file,
  unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS line, unnest(string_split(d.text, chr(10))) AS t FROM documents d WHERE d.text <> ''))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file", F.posexplode(directives.lines(F.col("source"))).alias("at", "text")).select("file", (F.col("at") + 1).cast("int").alias("line"), "text")


@_query(f"""WITH {_LINES_SQL} SELECT file, CAST(line AS INTEGER) AS line, CAST(strlen(split_part(text, 'that', 1)) + 1 AS INTEGER) AS "column" FROM lines WHERE contains(text, 'that')""")
def scan_lines_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.instr("text", "that")
    return _lines(spark, sf_dir).filter(at > 0).select("file", "line", directives.byte_column(F.col("text"), at - 1).alias("column"))


_DIRECTIVE_TEXT = {
    0: ("// tessera-disable-next-line local/shout, local/long reason: agreed: once", "shout"),
    1: ("# tessera-disable-file local/shout reason: legacy expires: 2024-06-30", "shout"),
    2: ("-- tessera-disable-next-line local/shout", None),
    3: ("x tessera-disable-next-line-later local/shout reason: prose", None),
    4: ("/* tessera-disable-file Local reason: bad id */", None),
    5: ("é tessera-disable-next-line local/long reason: not for this rule", None),
}


def _with_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a directive, by doc_id, a line that breaks local/shout, and the document's own text."""
    text = F.element_at(F.create_map(*[F.lit(x) for k, (t, _) in _DIRECTIVE_TEXT.items() for x in (k, t)]), (F.col("doc_id") % 6).cast("int"))
    return _files(spark, sf_dir).select("doc_id", "file", F.concat(text, F.lit("\nA!!\n"), "source").alias("source"))


def _shouts(texts: DataFrame) -> DataFrame:
    rows = texts.select("file", F.posexplode(directives.lines(F.col("source"))).alias("at", "text")).filter(F.contains("text", F.lit("!!")))
    return rows.select(F.lit("local").alias("rule_ns"), F.lit("shout").alias("rule_name"), "file", (F.col("at") + 1).cast("int").alias("line"), F.lit(1).alias("column"), F.lit("shouting").alias("message"), F.lit("lower your voice").alias("remediation"), F.lit("error").alias("severity"))


_DOC_FILE = "'docs/' || source || '/' || doc_id || '.txt'"


@_query(f"""SELECT {_DOC_FILE} AS file, CASE WHEN doc_id % 6 IN (1) THEN 'file' ELSE 'next_line' END AS scope,
CASE doc_id % 6 WHEN 0 THEN 'local/shout,local/long' WHEN 1 THEN 'local/shout' ELSE 'local/long' END AS rules,
CASE doc_id % 6 WHEN 0 THEN 'agreed: once' WHEN 1 THEN 'legacy' ELSE 'not for this rule' END AS reason,
CASE WHEN doc_id % 6 = 1 THEN '2024-06-30' END AS expires, 1 AS line, CASE doc_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 4 END AS "column"
FROM documents WHERE doc_id % 6 IN (0, 1, 5)""")
def directive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = directives.scan(_with_directives(spark, sf_dir))
    return valid.select("file", "scope", F.array_join("rules", ",").alias("rules"), "reason", "expires", "line", "column")


@_query(f"""SELECT {_DOC_FILE} AS file, 1 AS line, CASE doc_id % 6 WHEN 2 THEN 4 ELSE 4 END AS "column" FROM documents WHERE doc_id % 6 IN (2, 4)""")
def directive_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directives.scan(_with_directives(spark, sf_dir))[1].select("file", "line", "column")


@_query(f"""WITH f AS (SELECT {_DOC_FILE} AS file, doc_id % 6 AS k, string_split('A!!' || chr(10) || coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT file, k, unnest(range(2, len(lines) + 2)) AS line, unnest(lines) AS text FROM f)
SELECT 'local/shout' AS rule, file, CAST(line AS INTEGER) AS line, 'error' AS severity FROM l WHERE contains(text, '!!') AND k <> 1 AND NOT (k = 0 AND line = 2)
UNION ALL SELECT 'tessera/suppression', file, 1, 'error' FROM f WHERE k IN (1, 2, 4)
UNION ALL SELECT 'tessera/suppression', file, 1, 'warn' FROM f WHERE k = 5""")
def suppress_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _with_directives(spark, sf_dir)
    valid, malformed = directives.scan(texts)
    out = directives.apply(_shouts(texts), valid, malformed, today="2024-07-01", unused=True)
    return out.select(F.concat_ws("/", "rule_ns", "rule_name").alias("rule"), "file", "line", "severity")


# --- violations, order, severity, reports ----------------------------------------------------------------

_VIOLATIONS_SQL = f"""{_LINES_SQL}, v AS (
  SELECT 'local' AS rule_ns, 'shout' AS rule_name, file, line, strlen(split_part(text, '!!', 1)) + 1 AS "column", 'shouting' AS message, 'error' AS severity FROM lines WHERE contains(text, '!!')
  UNION ALL SELECT 'local-x', 'address', file, line, strlen(split_part(text, '@', 1)) + 1, 'an address in ' || file, 'warn' FROM lines WHERE contains(text, '@')
  UNION ALL SELECT 'local', 'licence', file, line, strlen(split_part(text, 'License', 1)) + 1, 'a licence', 'off' FROM lines WHERE contains(text, 'License'))"""
_RULES = (("local", "shout", "!!", "shouting", "error"), ("local-x", "address", "@", None, "warn"), ("local", "licence", "License", "a licence", "off"))


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the lines for all rules: what each finds is exploded from one array."""
    def found(ns: str, name: str, needle: str, message: str | None, severity: str):
        at = F.instr("text", needle)
        said = F.lit(message) if message else F.concat(F.lit("an address in "), "file")
        return F.when(at > 0, F.struct(F.lit(ns).alias("rule_ns"), F.lit(name).alias("rule_name"), directives.byte_column(F.col("text"), at - 1).alias("column"), said.alias("message"), F.lit(severity).alias("severity")))

    rows = _lines(spark, sf_dir).withColumn("x", F.explode(F.array_compact(F.array(*(found(*r) for r in _RULES)))))
    return rows.select("x.rule_ns", "x.rule_name", "file", "line", "x.column", "x.message", F.lit("see the guide").alias("remediation"), "x.severity")


@_query(f"""WITH {_VIOLATIONS_SQL} SELECT rule_ns, rule_name, file, CAST(line AS INTEGER) AS line, CAST("column" AS INTEGER) AS "column",
row_number() OVER (ORDER BY rule_ns, rule_name, file, line, "column") AS position FROM v""")
def violations_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _violations(spark, sf_dir).select("rule_ns", "rule_name", "file", "line", "column")
    return violations.positioned(v, *violations.ORDER)


@_query(f"""WITH {_VIOLATIONS_SQL} SELECT rule_ns, rule_name, coalesce(o.severity, v.severity, 'error') AS severity, count(*) AS n FROM v
LEFT JOIN (VALUES ('local', 'licence', 'warn'), ('local', 'shout', NULL)) o(ns, name, severity) ON ns = rule_ns AND name = rule_name GROUP BY ALL""")
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    override = F.when((F.col("rule_ns") == "local") & (F.col("rule_name") == "licence"), "warn")
    v = _violations(spark, sf_dir).withColumn("severity", violations.resolved_severity(override, F.col("severity")))
    return v.groupBy("rule_ns", "rule_name", "severity").agg(F.count("*").alias("n"))


@_query(f"WITH {_VIOLATIONS_SQL} SELECT NOT coalesce(bool_or(severity = 'error'), false) AS ok, CASE WHEN coalesce(bool_or(severity = 'error'), false) THEN 1 ELSE 0 END AS exit_code FROM v")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations.failing(_violations(spark, sf_dir))


@_query(f"""WITH {_VIOLATIONS_SQL} SELECT file || ':' || line || ':' || "column" || ' ' || severity || ' [' || rule_ns || '/' || rule_name || '] ' || message || chr(10) || '  → see the guide' AS lines FROM v""")
def report_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.human_lines(_violations(spark, sf_dir)).select("lines")


@_query(f"""WITH {_VIOLATIONS_SQL}, r AS (SELECT rule_ns, rule_name, row_number() OVER (ORDER BY rule_ns, rule_name) - 1 AS i FROM (SELECT DISTINCT rule_ns, rule_name FROM v))
SELECT rule_ns, rule_name, file, CAST(line AS INTEGER) AS line, CAST(i AS INTEGER) AS rule_index FROM v JOIN r USING (rule_ns, rule_name)""")
def report_sarif_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rule_index(_violations(spark, sf_dir)).select("rule_ns", "rule_name", "file", "line", "rule_index")


@_query(f"""WITH {_VIOLATIONS_SQL} SELECT rule_ns, rule_name, file, CAST(line AS INTEGER) AS line, CAST("column" AS INTEGER) AS "column", rule_name AS card, 'see the guide' AS remediation, CASE WHEN message <> rule_name THEN message END AS message FROM v""")
def report_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = spark.createDataFrame([(ns, name, name, "see the guide") for ns, name, *_ in _RULES], "rule_ns string, rule_name string, card_message string, card_remediation string")
    return reports.agent_rows(_violations(spark, sf_dir), cards)


@_query(f"""WITH {_VIOLATIONS_SQL} SELECT file, CAST(line AS INTEGER) AS line, rule_ns || '/' || rule_name AS rule, message AS said, severity FROM v""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.json_rows(_violations(spark, sf_dir).withColumn("fix", F.lit(None).cast("struct<start:bigint>")))
    item = F.from_json("json", "rule string, file string, line int, message string, severity string").alias("x")
    return rows.select(item).select("x.file", "x.line", "x.rule", F.col("x.message").alias("said"), "x.severity")


@_query("""SELECT event_type AS rule_name, CAST(sum(event_id % 7) AS BIGINT) AS query_ms, CAST(sum(event_id % 11) AS BIGINT) AS handler_ms, count(*) AS matches, CAST(sum(event_id % 7 + event_id % 11) AS BIGINT) AS total_ms FROM events GROUP BY event_type""")
def profile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    t = e.select(F.lit("local").alias("rule_ns"), F.col("event_type").alias("rule_name"), (F.col("event_id") % 7).alias("query_ms"), (F.col("event_id") % 11).alias("handler_ms"), F.lit(1).alias("matches"))
    return reports.profile(t).drop("rule_ns")


# --- facts and reduce ------------------------------------------------------------------------------------


_LINES_BEFORE = "CAST(len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1 AS INTEGER)"


def _sources(spark: SparkSession, sf_dir: str, extension: str, path: str = "src") -> DataFrame:
    return fixture.document_sources(_table(spark, sf_dir, "documents"), extension, path)


def _check(spark: SparkSession, sf_dir: str, extension: str, rules: list[Rule], path: str = "src", **config) -> engine.Outcome:
    return engine.check(spark, _sources(spark, sf_dir, extension, path), engine.Config(rules, **config), "2024-07-01")


def _path_sql(extension: str, path: str = "src") -> str:
    return f"printf('{path}/d%012d.{extension}', doc_id)"


def _calls(ctx, m) -> None:
    """A handler that emits facts: each call in a function, with what its name is."""
    inside = ctx.closest_ancestor(m["call"], "(function_declaration name: (identifier) @name) @f")
    ctx.emit_fact("call", {"name": ctx.text(m["fn"]), "binding": ctx.binding_kind(m["fn"]), "inside": inside and ctx.text(inside["name"])})
    for a in ctx.named_children(m["args"]):
        ctx.emit_fact("argument", {"name": ctx.text(a), "binding": ctx.binding_kind(a), "inside": None})


@_query(f"""SELECT {_path_sql("ts")} AS file, f.* FROM documents, (VALUES (0, 'call', 'list', 'const', 'alpha'), (1, 'argument', 'a', 'param', NULL)) f(sequence, kind, name, binding, inside)""")
def match_emit_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("local/calls", "(call_expression function: (identifier) @fn arguments: (arguments) @args) @call", Card("m", "r", "a", "b"), handler(_calls))
    body = F.from_json("data", "name string, binding string, inside string").alias("x")
    return _check(spark, sf_dir, "ts", [rule]).facts.select("file", "sequence", "kind", body).select("file", "sequence", "kind", "x.*")


@_query("SELECT DISTINCT printf('c%d', c_custkey) AS file, CAST(c_nationkey AS VARCHAR) AS symbol, printf('''%d'' is exported but nothing imports it', c_nationkey) AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 25 = c_nationkey AND o_orderpriority <> '1-URGENT')")
def reduce_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers export their nation; orders import a nation of their customer, urgent ones all of it."""
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    exports = c.select(F.concat(F.lit("c"), "c_custkey").alias("file"), F.col("c_nationkey").cast("string").alias("symbol"), F.lit(1).alias("line"), F.lit(1).alias("column"))
    taken = o.select(F.concat(F.lit("o"), "o_orderkey").alias("file"), F.concat(F.lit("./c"), "o_custkey").alias("specifier"), (F.col("o_orderkey") % 25).cast("string").alias("symbol"), (F.col("o_orderpriority") == "1-URGENT").alias("all_of_it"))
    files = exports.select("file").unionByName(taken.select("file")).distinct()
    return unused_exports(exports, taken.filter("NOT all_of_it"), taken.filter("all_of_it").select("file", "specifier"), files).select("file", "symbol", "message")


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT event_type AS a, nxt AS b FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND nxt <> event_type),
p AS (SELECT a AS root, [a] AS path, b AS nxt FROM e UNION ALL SELECT root, list_append(path, nxt), e.b FROM p JOIN e ON e.a = nxt WHERE nxt <> root AND NOT list_contains(path, nxt) AND nxt > root)
SELECT array_to_string(path, ' ') AS cycle, len(path) AS length FROM p WHERE nxt = root""")
def reduce_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = _table(spark, sf_dir, "events").select("event_type", F.lead("event_type").over(w).alias("target")).filter("target IS NOT NULL AND target <> event_type").distinct()
    edges = step.select(F.col("event_type").alias("file"), "target", F.lit(1).alias("line"), F.lit(1).alias("column"), F.row_number().over(Window.partitionBy("event_type").orderBy("target")).alias("ordinal"))
    found = circular_imports(edges)
    ring = F.slice("path", F.lit(1), F.size("path") - 1)
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    turned = F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, F.lit(1), at - 1))
    return found.select(F.array_join(turned, " ").alias("cycle"), F.size(ring).cast("long").alias("length"))


_RESTRICTIONS = [{"module": "https://m.*"}, {"module": "*example.net/en/*", "from": ["!4*"]}, {"module": "http://*", "from": ["*1", "*2", "!*2"]}, {"module": "*/de/*"}]


@_query("""SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN 0 WHEN url LIKE '%example.net/en/%' AND CAST(page_id AS VARCHAR) NOT LIKE '4%' THEN 1 WHEN url LIKE 'http://%' AND CAST(page_id AS VARCHAR) LIKE '%1' THEN 2 WHEN url LIKE '%/de/%' THEN 3 END AS restriction FROM pages
WHERE url LIKE 'https://m.%' OR (url LIKE '%example.net/en/%' AND CAST(page_id AS VARCHAR) NOT LIKE '4%') OR (url LIKE 'http://%' AND CAST(page_id AS VARCHAR) LIKE '%1') OR url LIKE '%/de/%'""")
def first_match_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = builtin.restriction(F.col("url"), F.col("page_id").cast("string"), _RESTRICTIONS)
    return _table(spark, sf_dir, "pages").select("page_id", place.alias("restriction")).filter("restriction IS NOT NULL")


@_query("""SELECT url AS file FROM pages WHERE (page_id % 2 = 0 OR page_id % 5 = 0) AND url NOT LIKE '%blog%'""")
def selection_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a file of its own at <page_id>/<url>: pages may share a url, and selecting one of them selects no other."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.col("page_id").cast("string"), F.lit("/"), "url").alias("file"))
    changed = pages.filter("page_id % 2 = 0").select("file").unionByName(pages.filter("page_id % 5 = 0").select("file"))
    return files.narrowed(pages.filter(gates.selects(F.col("file"), [], ["*blog*"])), changed).select(F.col("url").alias("file"))


@_query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'PY' WHEN 2 THEN 'go' WHEN 3 THEN 'txt' ELSE 'mjs' END AS e, text FROM documents)
SELECT doc_id, CASE e WHEN 'ts' THEN 'typescript' WHEN 'PY' THEN 'python' WHEN 'go' THEN 'go' ELSE 'javascript' END AS language, concat_ws(',', CASE WHEN e IN ('ts', 'mjs') THEN '0' END, CASE WHEN e = 'PY' AND contains(text, 'License') THEN '1' END, CASE WHEN e IN ('go', 'mjs') AND doc_id % 2 = 0 THEN '2' END) AS rules
FROM d WHERE e IN ('ts', 'mjs') OR e = 'PY' AND contains(text, 'License') OR e = 'go' AND doc_id % 2 = 0""")
def gate_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three gates at once: which rules each file admits."""
    docs = _table(spark, sf_dir, "documents")
    extension = F.element_at(F.array(*[F.lit(x) for x in ("ts", "PY", "go", "txt", "mjs")]), (F.col("doc_id") % 5 + 1).cast("int"))
    listed = docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "even/").otherwise("odd/"), "doc_id", F.lit("."), extension).alias("file"), F.col("text").alias("source"))
    listed = listed.withColumn("language", files.language_of(F.col("file")))
    card = Card("m", "r", "a", "b")
    rules = [
        Rule("local/a", "(program) @p", card, lambda: [], languages=("typescript", "javascript")),
        Rule("local/b", "(module) @p", card, lambda: [], languages=("python",), gates=gates.Gates(file_contains=["License"])),
        Rule("local/c", "(import_spec) @p", card, lambda: [], languages=("go",), gates=gates.Gates(path_matches=["even/**"])),
    ]
    rules[2].languages = ("go", "javascript")
    return gates.admitted(listed, rules, content=True).select("doc_id", "language", F.array_join("rules", ",").alias("rules"))


@_query(f"""WITH f AS (SELECT doc_id FROM documents) SELECT {_path_sql("ts")} AS file, CASE WHEN doc_id % 3 = 2 THEN printf('src/d%012d.ts', doc_id - 2) ELSE printf('src/d%012d.ts', doc_id + 1) END AS target
FROM documents WHERE CASE WHEN doc_id % 3 = 2 THEN doc_id - 2 ELSE doc_id + 1 END IN (SELECT doc_id FROM f)""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sources(spark, sf_dir, "ts")
    edges = found.select("file", F.regexp_extract("source", "from '([^']*)'\nexport function alpha", 1).alias("specifier"))
    return imports.resolved(edges, found.select("file")).select("file", "target")


# --- fixes, cache -------------------------------------------------------------------------------------------


@_query("""WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + CAST(l_linenumber * 3 AS BIGINT) AS b FROM lineitem WHERE l_returnflag <> 'R'),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b, n) AS i FROM s),
g AS (SELECT k, i, b AS last, CAST(1 AS BIGINT) AS applied FROM o WHERE i = 1
UNION ALL SELECT o.k, o.i, CASE WHEN o.a < g.last THEN g.last ELSE o.b END, g.applied + CASE WHEN o.a < g.last THEN 0 ELSE 1 END FROM g JOIN o ON o.k = g.k AND o.i = g.i + 1)
SELECT k AS l_orderkey, max(applied) AS applied FROM g GROUP BY k""")
def fix_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    a = F.col("l_quantity").cast("bigint")
    fix = F.struct(a.alias("start"), (a + F.col("l_linenumber") * 3).alias("end"), F.lit("").alias("replacement"), (F.col("l_returnflag") != "R").alias("safe"))
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", fix.alias("fix")))).alias("x"))
    taken = F.size(fixes.chosen(F.transform("x", lambda y: y["fix"]), F.lit(10_000))).cast("bigint")
    return g.select("l_orderkey", taken.alias("applied")).filter("applied > 0")


@_query("""SELECT doc_id, replace(text, 'the', 'THE') AS source, (len(text) - len(replace(text, 'the', ''))) // 3 AS applied FROM documents WHERE contains(text, 'the')""")
def fix_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _files(spark, sf_dir).filter(F.contains("source", F.lit("the")))
    parts = F.split("source", "the", -1)
    starts = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda acc, p: F.struct((acc["at"] + F.octet_length(p) + 3).alias("at"), F.array_append(acc["starts"], acc["at"] + F.octet_length(p)).alias("starts")))["starts"]
    fix = lambda s: F.struct(s.cast("bigint").alias("start"), (s + 3).cast("bigint").alias("end"), F.lit("THE").alias("replacement"), F.lit(True).alias("safe"))
    chosen = fixes.chosen(F.transform(starts, fix), F.octet_length("source"))
    return texts.withColumn("take", chosen).select("doc_id", fixes.splice(F.col("source"), F.col("take")).alias("source"), F.size("take").cast("bigint").alias("applied"))


@_query("""WITH now AS (SELECT DISTINCT doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 7 <> 3),
r AS (SELECT doc_id // 10 AS key, doc_id AS path, CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 31 = 5 THEN 'old' ELSE md5(text) END AS hash FROM documents)
SELECT key FROM r LEFT JOIN now ON now.path = r.path GROUP BY key HAVING bool_and(r.hash IS NOT DISTINCT FROM now.hash)""")
def cache_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    now = d.filter("doc_id % 7 <> 3").select(F.col("doc_id").alias("path"), F.col("h").alias("hash"))
    seen = F.when(F.col("doc_id") % 7 == 3, F.lit(None)).when(F.col("doc_id") % 31 == 5, "old").otherwise(F.col("h"))
    reads = d.select(F.expr("doc_id div 10").alias("key"), F.col("doc_id").alias("path"), seen.alias("hash"))
    return cache.valid_keys(reads, now)


@_query("""SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS entry FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    return cache.merged(d.filter("key % 2 = 0").withColumn("entry", F.lit("old")), d.filter("key % 3 = 0").withColumn("entry", F.lit("new")), whole=False)


@_query("""SELECT doc_id, sha256(strlen('run') || ':run:' || strlen(f) || ':' || f || ':64:' || sha256(text)) AS key FROM (SELECT doc_id, text, 'docs/' || source || '/' || doc_id || '.txt' AS f FROM documents)""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.keys(_files(spark, sf_dir), "run", "2024-07-01").select("doc_id", "key")


@_query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'dated' ELSE 'plain' END AS kind FROM documents WHERE doc_id % 3 <> 0 AND NOT (doc_id % 4 <> 0 AND contains(text, 'License'))""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two files in three, every fourth of them of a date; files that hold `License` count only by their dated key."""
    keyed = cache.keys(_files(spark, sf_dir), "run", "2024-07-01").withColumn("dated", F.contains("source", F.lit("License")))
    kept = keyed.filter("doc_id % 3 <> 0")
    entries = kept.select(F.when(F.col("doc_id") % 4 == 0, F.col("dated_key")).otherwise(F.col("key")).alias("key"), F.when(F.col("doc_id") % 4 == 0, "dated").otherwise("plain").alias("kind"))
    return cache.hits(keyed, entries).join(keyed.select("file", "doc_id"), "file").select("doc_id", "kind")


# --- source code: each document's text as a comment, and some code after it ----------------------------------


@_query(f"""SELECT {_path_sql("ts")} AS file, {_LINES_BEFORE} + 7 AS line, 1 AS "column", 'debugger statement' AS message, 'error' AS severity FROM documents WHERE doc_id % 20 = 0""")
def check_single_file_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, "ts", [fixture.no_debugger()]).violations.select("file", "line", "column", "message", "severity")


@_query(f"""SELECT {_path_sql("ts")} AS file, {_LINES_BEFORE} + 7 AS line, 'warn' AS severity FROM documents WHERE doc_id % 20 = 0""")
def severity_off_then_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that is off by itself and switched on by the configuration, beside one that is switched off."""
    off, on = fixture.no_debugger(), builtin.no_default_export()
    off.severity = "off"
    return _check(spark, sf_dir, "ts", [off, on], severity={off.id: "warn", on.id: "off"}).violations.select("file", "line", "severity")


@_query(f"""WITH d AS (SELECT doc_id, {_path_sql("ts")} AS file, {_LINES_BEFORE} AS n FROM documents)
SELECT file, n + 6 AS line, '''beta'' is exported but nothing imports it' AS message FROM d
UNION ALL SELECT file, n + 2, '''alpha'' is exported but nothing imports it' FROM d WHERE CASE WHEN doc_id % 3 = 0 THEN doc_id + 2 ELSE doc_id - 1 END NOT IN (SELECT doc_id FROM d)""")
def check_unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, "ts", [builtin.no_unused_exports()]).violations.select("file", "line", "message")


@_query(f"""WITH d AS (SELECT doc_id, {_path_sql("ts")} AS file, {_LINES_BEFORE} AS n FROM documents)
SELECT c.file, c.n + 1 AS line, 'circular import: ' || a.file || ' → ' || b.file || ' → ' || c.file || ' → ' || a.file AS message FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 JOIN d c ON c.doc_id = a.doc_id + 2 WHERE a.doc_id % 3 = 0""")
def check_circular_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check(spark, sf_dir, "ts", [builtin.no_circular_imports()]).violations.select("file", "line", "message")


@_query(f"""WITH d AS (SELECT doc_id, {_path_sql("py")} AS file, {_LINES_BEFORE} AS n FROM documents)
SELECT 'tessera/no-mutable-default-argument' AS rule, file, n + 2 AS line, 10 AS "column" FROM d
UNION ALL SELECT 'tessera/no-mutable-default-argument', file, n + 2, 16 FROM d WHERE doc_id % 4 <> 0
UNION ALL SELECT 'tessera/no-broad-except', file, n + 5, 5 FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT 'local/py-explicit-encoding', file, n + 4, 16 FROM d UNION ALL SELECT 'local/py-stdout-buffer', file, n + 6, 9 FROM d""")
def check_python_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [builtin.no_broad_except(), builtin.no_mutable_default_argument(), project_rules.explicit_encoding(), project_rules.stdout_write()]
    return _placed(_check(spark, sf_dir, "py", rules))


def _placed(outcome: engine.Outcome) -> DataFrame:
    return outcome.violations.select(F.concat_ws("/", "rule_ns", "rule_name").alias("rule"), "file", "line", "column")


@_query(f"""WITH d AS (SELECT doc_id, {_path_sql("go")} AS file, {_LINES_BEFORE} AS n FROM documents)
SELECT 'tessera/no-context-in-struct' AS rule, file, n + 4 AS line, 2 AS "column" FROM d WHERE doc_id % 3 <> 0 UNION ALL SELECT 'tessera/no-package-init', file, n + 6, 1 FROM d WHERE doc_id % 2 = 0""")
def check_go_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(_check(spark, sf_dir, "go", [builtin.no_context_in_struct(), builtin.no_package_init()]))


@_query(f"""WITH d AS (SELECT doc_id, {_path_sql("rs")} AS file, {_LINES_BEFORE} AS n FROM documents)
SELECT 'tessera/no-glob-import' AS rule, file, n + 1 AS line, 1 AS "column" FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 'tessera/no-unwrap', file, n + 2, 10 FROM d""")
def check_rust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(_check(spark, sf_dir, "rs", [builtin.no_glob_import(), builtin.no_unwrap()]))


@_query(f"""SELECT 'local/deterministic-iteration' AS rule, {_path_sql("rs")} AS file, {_LINES_BEFORE} + 1 AS line, 1 AS "column" FROM documents WHERE doc_id % 2 = 1""")
def check_rust_project_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [project_rules.deterministic_iteration(["src"]), project_rules.tracked_reads_only(["src"]), project_rules.no_ambient_authority(), project_rules.sandbox_containment(), project_rules.one_parser_per_file()]
    return _placed(_check(spark, sf_dir, "rs", rules))


_RULE_LINE = fixture.CODE["rules.ts"].format(call="").split("\n")
_AT = {
    "rule-declares-language": (1, _RULE_LINE[0].index("defineRule")),
    "gates-are-and": (1, _RULE_LINE[0].index("fileContains")),
    "facts-must-serialize": (1, _RULE_LINE[0].index("n: m.x")),
    "reduce-touches-no-tree": (1, _RULE_LINE[0].index("ctx.text")),
    "node-handle-truthiness": (3, _RULE_LINE[2].index("!p")),
}


@_query(f"""WITH d AS (SELECT doc_id, {_path_sql("rules.ts")} AS file, {_LINES_BEFORE} AS n FROM documents)
SELECT 'local/' || r.rule AS rule, file, n + r.line AS line, r.place + 1 AS "column" FROM d, (VALUES {", ".join(f"('{k}', {line}, {place})" for k, (line, place) in _AT.items())}) r(rule, line, place)
UNION ALL SELECT 'local/no-eval-in-rules', file, n + 2, 1 FROM d WHERE doc_id % 2 = 0""")
def check_rules_about_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [project_rules.gates_are_and(), project_rules.rule_declares_language(), project_rules.reduce_touches_no_tree(), project_rules.facts_must_serialize(), project_rules.node_handle_truthiness(), project_rules.no_eval_in_rules()]
    return _placed(_check(spark, sf_dir, "rules.ts", rules))


@_query(f"""WITH d AS (SELECT doc_id, {_path_sql("ts")} AS file, {_LINES_BEFORE} AS n FROM documents)
SELECT 'tessera/no-restricted-imports' AS rule, file, n + 1 AS line, 1 AS "column" FROM d WHERE CASE WHEN doc_id % 3 = 2 THEN doc_id - 2 ELSE doc_id + 1 END % 10 = 7
UNION ALL SELECT 'local/no-debugger', file, n + 7, 1 FROM d WHERE doc_id % 20 = 0""")
def check_combined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rules in one walk over each tree."""
    return _placed(_check(spark, sf_dir, "ts", [builtin.no_restricted_imports([{"module": "./*7"}]), fixture.no_debugger(), builtin.no_default_export()]))


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parsed = checkpointed(engine.parse_nodes(_sources(spark, sf_dir, "ts")))
    return tuple(engine.exploded(parsed, p) for p in ("nodes", "scopes", "decls"))


@_query(f"""SELECT {_path_sql("ts")} AS file, CAST(2 AS BIGINT) AS exports, CAST(1 AS BIGINT) AS functions, CAST(1 AS BIGINT) AS calls FROM documents""")
def navigate_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, _ = _nodes(spark, sf_dir)
    exports = nodes.filter("kind = 'export_statement'")
    inner = navigation.subtree(exports, nodes)
    calls = navigation.query_subtree(exports, nodes, nodes.filter("kind = 'call_expression'")).groupBy("file").agg(F.count("*").alias("calls"))
    counted = inner.groupBy("file").agg(F.countDistinct("node_id").alias("exports"), F.count_if(F.col("inner_kind") == "function_declaration").alias("functions"))
    return counted.join(calls, "file")


@_query(f"""SELECT {_path_sql("ts")} AS file, r.* FROM documents, (VALUES (1, 'return_statement', 'statement_block'), (2, 'statement_block', 'function_declaration'), (3, 'function_declaration', 'export_statement'), (4, 'export_statement', 'program'), (5, 'program', NULL)) r(place, kind, above)""")
def navigate_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is around the only call, innermost first, each with its parent."""
    nodes, _, _ = _nodes(spark, sf_dir)
    up = navigation.ancestors(nodes.filter("kind = 'call_expression'"), nodes)
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("ancestor_depth")))
    at = up.select("file", F.col("ancestor_id").alias("node_id"), F.col("ancestor_kind").alias("kind"), place.alias("place"))
    return at.join(navigation.parent(at, nodes), ["file", "node_id"]).select("file", "place", "kind", F.col("parent_kind").alias("above"))


@_query(f"""SELECT {_path_sql("ts")} AS file, r.* FROM documents, (VALUES ('identifier', 0), ('arguments', 1)) r(kind, child_idx)""")
def navigate_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, _ = _nodes(spark, sf_dir)
    kids = navigation.children(nodes.filter("kind = 'call_expression'"), nodes, named=True)
    return kids.select("file", F.col("child_kind").alias("kind"), "child_idx")


@_query(f"""SELECT {_path_sql("ts")} AS file, 'alpha' AS inside, 'list' AS name FROM documents UNION ALL SELECT {_path_sql("ts")}, 'alpha', 'a' FROM documents""")
def navigate_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function around each identifier within the call."""
    nodes, _, _ = _nodes(spark, sf_dir)
    names = navigation.subtree(nodes.filter("kind = 'call_expression'"), nodes).filter("inner_kind = 'identifier'").select("file", F.col("inner_id").alias("node_id"))
    functions = nodes.filter("kind = 'function_declaration'")
    near = navigation.closest_ancestor(names, nodes, functions)
    title = nodes.filter("kind = 'identifier' AND field = 'name'").select("file", F.col("parent_id").alias("ancestor_id"), F.col("text").alias("inside"))
    return near.join(title, ["file", "ancestor_id"]).join(nodes.select("file", "node_id", F.col("text").alias("name")), ["file", "node_id"]).select("file", "inside", "name")


@_query(f"""SELECT {_path_sql("ts")} AS file, b.* FROM documents, (VALUES ('alpha', 'import', false, 2), ('a', 'param', false, 3), ('list', 'const', false, 2), ('beta', 'const', false, 1)) b(name, binding, shadowed, uses)""")
def resolve_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, scopes, decls = _nodes(spark, sf_dir)
    names = nodes.filter("kind = 'identifier'")
    found = navigation.bindings(names, nodes, scopes, decls).join(names.select("file", "node_id", F.col("text").alias("name")), ["file", "node_id"])
    return found.groupBy("file", "name", "binding", "shadowed").agg(F.count("*").cast("int").alias("uses"))


@_query(f"""WITH d AS (SELECT {_path_sql("ts")} AS file, CASE WHEN doc_id % 3 = 2 THEN doc_id - 2 ELSE doc_id + 1 END AS n FROM documents)
SELECT file, n = 7 AS exact, n % 10 = 7 AS globbed FROM d WHERE n % 10 = 7""")
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in which an identifier is imported from a module that ends in 7, and from exactly one such."""
    nodes, scopes, decls = _nodes(spark, sf_dir)
    bound = navigation.bindings(nodes.filter("kind = 'identifier'"), nodes, scopes, decls)
    exact = navigation.resolves_to_import(bound, "./d000000000007", "alpha").select("file").distinct().withColumn("exact", F.lit(True))
    globbed = navigation.imported_from(bound, "./*7").select("file").distinct()
    return globbed.join(exact, "file", "left").select("file", F.coalesce("exact", F.lit(False)).alias("exact"), F.lit(True).alias("globbed"))


@_query(f"""SELECT {_path_sql("ts")} AS file, 'notes.md' AS path, false AS absent FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT {_path_sql("ts")}, 'none.md', true FROM documents WHERE doc_id % 20 = 0""")
def tracked_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that a handler makes of declared files, with absences."""
    rule = Rule("local/reads", "(debugger_statement) @d", Card("m", "r", "a", "b"), handler(lambda ctx, m: (ctx.read_file("notes.md"), ctx.file_exists("none.md"))), reads=("notes.md", "none.md"))
    sides = engine.declared_files([rule], {"notes.md": b"text"}.get)
    out = engine.check(spark, _sources(spark, sf_dir, "ts"), engine.Config([rule]), "2024-07-01", sides=sides)
    return out.reads.select("file", "path", F.col("hash").isNull().alias("absent"))
