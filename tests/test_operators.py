"""Unit cases of the engine's operators."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.functions.globs import GlobError, any_glob, glob_to_regex, star_to_regex
from tessera.functions.identifiers import RuleId, is_date
from tessera.operators import cache, directives, fixes, gates, imports, reports, violations
from tessera.operators.patterns import PatternError, compile_query, match_at
from tessera.sources import files
from tessera.sources.tree import Node


def holds(spark, condition):
    return spark.range(1).select(condition.alias("x")).first().x


def test_globs(spark):
    yes = [("src/**/*.tsx", "src/a/B.tsx"), ("src/**/*.tsx", "src/B.tsx"), ("*.ts", "a/b.ts"), ("**/x", "x"), ("a/**", "a/b/c"), ("{a,b}/*.[jt]s", "b/x.ts"), ("a?c", "a/c"), ("[!a]b", "cb"), (r"\*", "*"), ("a.b", "a.b")]
    no = [("src/**/*.tsx", "src/a.ts"), ("src/**/*.tsx", "lib/a.tsx"), ("a/**", "a"), ("a.b", "axb"), ("[!a]b", "ab"), ("x", "x\n")]
    for pattern, path in yes + no:
        assert holds(spark, F.lit(path).rlike(glob_to_regex(pattern))) == ((pattern, path) in yes), (pattern, path)
    for bad in ("[a", "{a", "a}", "a\\"):
        with pytest.raises(GlobError, match="include"):
            any_glob([bad], "include")
    for pattern, text, want in (("lodash/*", "lodash/a/b", True), ("lodash/*", "lodash", False), ("*", "", True), ("a*b*c", "axbxbc", True), ("a*b", "ab\n", False), ("a+b", "a+b", True), ("a*a", "a", False)):
        assert holds(spark, F.lit(text).rlike(star_to_regex(pattern))) == want


def test_gates(spark):
    check = lambda path, **kw: holds(spark, gates.admits_path(F.lit(path), gates.Gates(**kw)))
    assert check("a.ts") and check("src/a.ts", path_matches=["src/*"]) and not check("lib/a.ts", path_matches=["src/*"])
    assert not check("src/gen/a.ts", path_matches=["src/**"], path_not_matches=["**/gen/**"])
    content = lambda text, **kw: holds(spark, gates.admits_content(F.lit(text), gates.Gates(**kw)))
    assert content("makeStyles theme", file_contains=["makeStyles", "theme"]) and not content("makeStyles", file_contains=["makeStyles", "theme"])
    assert not content("x @generated", file_not_contains=["@generated", "DO NOT EDIT"]) and content("x", file_contains=[""]) and not content("x", file_not_contains=[""])


def test_identifiers():
    assert str(RuleId.parse("a-b/c1")) == "a-b/c1" and RuleId.parse("a/x") < RuleId.parse("a-b/x") and "a/x" > "a-b/x"
    for bad in ("a", "A/b", "a/b/c", "-a/b", "a-/b", "a/b--c", "a/", "/b", "a/b\n"):
        with pytest.raises(ValueError):
            RuleId.parse(bad)
    assert is_date("2026-02-31") and not any(map(is_date, ("2026-13-01", "2026-00-10", "2026-1-1", "26-01-01", "2026-01-32", "2026/01/01")))


def scan(spark, text):
    df = spark.createDataFrame([("f", text)], "file string, source string")
    good, bad = directives.scan(df, "x")
    return [tuple(r)[2:] for r in good.orderBy("line").collect()], [tuple(r)[1:] for r in bad.orderBy("line").collect()]


def test_directive_grammar(spark):
    good, bad = scan(
        spark,
        "// x-disable-next-line local/a, local/b tess/c reason: why: because\n# x-disable-file local/a reason: old expires: 2026-01-31\r\n"
        "é x-disable-file a/b reason: x expires: in 2020 expires: 2026-02-31\nax-disable-file a/b reason: no\nx-disable-file-later a/b reason: no\n"
        "x-disable-file_ x-disable-next-line a/b reason: second stands alone\n",
    )
    assert good == [
        ("next_line", ["local/a", "local/b", "tess/c"], "why: because", None, 1, 4), ("file", ["local/a"], "old", "2026-01-31", 2, 3),
        ("file", ["a/b"], "x expires: in 2020", "2026-02-31", 3, 4), ("next_line", ["a/b"], "second stands alone", None, 6, 17),
    ]
    assert bad == []
    good, bad = scan(spark, "x-disable-file a/b\nx-disable-file a/b reason:\nx-disable-file reason: r\nx-disable-file b reason: r\nx-disable-file a/b reason: r expires: soon\nx-disable-file a/b reason: expires: 2026-01-01\nx-disable-file a/b reason: ok")
    assert [r[-2] for r in good] == [7] and [(line, column) for line, column, _ in bad] == [(k, 1) for k in range(1, 7)]
    assert all(w in p for w, (_, _, p) in zip(("no `reason:`", "empty `reason:`", "names no rules", "`b` is not a rule id", "unreadable `expires: soon`", "empty `reason:`"), bad, strict=True))


FIXES = [
    ("const a = 1;", [(0, 5, "let", True)], "let a = 1;", 1),
    ("aaa bbb ccc", [(0, 3, "xxxx", True), (4, 7, "y", True), (8, 11, "zzzzz", True)], "xxxx y zzzzz", 3),
    ("const a = 1;", [(0, 5, "let", False)], "const a = 1;", 0),
    ("aaaa", [(0, 3, "x", True), (1, 4, "y", True)], "xa", 1),
    ("abcd", [(0, 2, "X", True), (2, 4, "Y", True)], "XY", 2),
    ("héé", [(1, 3, "a", True), (4, 5, "b", True)], "haé", 2),
    ("abcdefghi", [(3, 6, "", True), (1, 5, "", True), (5, 9, "", True)], "a", 2),
    ("ab", [(1, 1, "-", True), (0, 9, "no", True)], "a-b", 1),
]


def test_fixes(spark):
    kind = "file string, source string, fixes array<struct<start:bigint,end:bigint,replacement:string,safe:boolean>>"
    df = spark.createDataFrame([(str(i), s, f) for i, (s, f, _, _) in enumerate(FIXES)], kind)
    out = fixes.apply_fixes(df.select("file", "source"), df.select("file", F.explode("fixes").alias("fix")))
    got = {int(r.file): (r.source, r.applied) for r in out.collect()}
    assert got == {i: (w, n) for i, (_, _, w, n) in enumerate(FIXES)}


def test_import_paths(spark):
    known = ["src/a.ts", "src/a/index.ts", "src/b/index.tsx", "c.js", "src/d.ts"]
    cases = [("src/x.ts", "./a", "src/a.ts"), ("src/x.ts", "./b", "src/b/index.tsx"), ("src/x.ts", "../c", "c.js"), ("src/x.ts", "./d.ts", "src/d.ts"), ("src/x.ts", "../../c", "c.js"), ("x.ts", "./src/./b/../a", "src/a.ts"), ("src/x.ts", "react", None), ("src/x.ts", "./no", None)]
    edges = spark.createDataFrame([(f, s) for f, s, _ in cases], "file string, specifier string")
    got = {(r.file, r.specifier): r.target for r in imports.resolved(edges, spark.createDataFrame([(k,) for k in known], "file string")).collect()}
    assert got == {(f, s): t for f, s, t in cases if t}


def test_cache(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y expires: z"), ("c", "new")], "file string, source string")
    now = cache.keys(df, "run", "2024-01-01")
    rows = {r.file: r for r in now.collect()}
    now = now.withColumn("dated", F.contains("source", F.lit("expires:")))
    found = lambda *keys: [r.file for r in cache.hits(now, spark.createDataFrame([(k, 1) for k in keys], "key string, n int")).orderBy("file").collect()]
    assert found(rows["a"].key, rows["b"].key) == ["a"] and found(rows["b"].dated_key, rows["a"].dated_key) == ["a", "b"]
    reads = spark.createDataFrame([("k", "p", "1"), ("l", "p", "2"), ("l", "q", None), ("m", "q", None)], "key string, path string, hash string")
    assert {r.key for r in cache.stale_keys(reads, {"p": ("text", "1"), "q": (None, None)}).collect()} == {"l"}
    assert {r.key for r in cache.stale_keys(reads, {"p": ("text", "2"), "q": ("text", "3")}).collect()} == {"k", "l", "m"}
    assert len({r.key for r in cache.keys(spark.createDataFrame([("ab", "c"), ("a", "bc")], "file string, source string"), "r", "t").collect()}) == 2
    assert cache.config_hash(["a", "b"], [], {}, {}, []) == cache.config_hash(["b", "a"], [], {}, {}, []) != cache.config_hash(["a"], [], {}, {}, [])


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "rule_ns string, rule_name string, file string, line int, column int, message string, remediation string, severity string, fix struct<start:bigint,end:bigint,replacement:string,safe:boolean>")
    assert json.loads("".join(reports.json_report(none, 1, 0))) == {"version": 1, "ok": True, "total": 0, "files_discovered": 1, "files_parsed": 0, "warn_only": False, "violations": []}
    assert json.loads("".join(reports.sarif_report(none)))["runs"][0]["results"] == [] and list(reports.human(none)) == ["no violations"]
    assert list(reports.agent_report(none, spark.createDataFrame([], "rule_ns string, rule_name string, card_message string, card_remediation string"))) == []


def test_many_fixes_of_one_file(spark):
    """Work is linear in a file's fixes."""
    from tessera.operators.fixes import apply_fixes

    n = 60_000
    files = spark.createDataFrame([("a", "x" * n)], "file string, source string")
    v = spark.range(n).select(F.lit("a").alias("file"), F.struct(F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.lit("yy").alias("replacement"), F.lit(True).alias("safe")).alias("fix"))
    row = apply_fixes(files, v).first()
    assert row.source == "yy" * n and row.applied == n


def test_reports(spark):
    rows = [("a", "x", "f.ts", 2, 1, "m", "r", "error", None), ("a-b", "x", "e.ts", 1, 3, "own", "r", "warn", (0, 1, "y", True))]
    v = spark.createDataFrame(rows, "rule_ns string, rule_name string, file string, line int, column int, message string, remediation string, severity string, fix struct<start:bigint,end:bigint,replacement:string,safe:boolean>")
    assert list(reports.human(v)) == ["f.ts:2:1 error [a/x] m\n  → r", "e.ts:1:3 warn [a-b/x] own\n  → r", "1 error, 1 warning"]
    report = json.loads("".join(reports.json_report(v, 12, 3)))
    assert (report["version"], report["ok"], report["total"], report["files_discovered"], report["files_parsed"]) == (1, False, 2, 12, 3)
    assert report["violations"][1]["fix"] == {"start": 0, "end": 1, "replacement": "y", "safe": True} and "fix" not in report["violations"][0]
    run = json.loads("".join(reports.sarif_report(v)))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["a/x", "a-b/x"] and [(r["ruleIndex"], r["level"]) for r in run["results"]] == [(0, "error"), (1, "warning")]
    cards = spark.createDataFrame([("a", "x", "m", "r"), ("a-b", "x", "card", "r")], "rule_ns string, rule_name string, card_message string, card_remediation string")
    assert list(reports.agent_report(v, cards)) == ["a/x: m", "  fix: r", "  f.ts:2:1", "a-b/x: card", "  fix: r", "  e.ts:1:3 own"]
    assert tuple(violations.failing(v).first()) == (False, 1) and tuple(violations.failing(v, warn_only=True).first())[1] == 0
    assert tuple(violations.failing(v.limit(0)).first()) == (True, 0)


def tree():
    return Node("list", 0, 9).add(Node("open", 0, 1, named=False), Node("a", 1, 2, "first"), Node("b", 3, 4), Node("a", 5, 6, "last"))


def found(query):
    return [[(n, x.start) for n, x in m] for m in match_at(compile_query(query)[0], tree())]


def test_patterns():
    assert found("(list (a) @x)") == [[("x", 1)], [("x", 5)]] and found("(list first: (a) @x)") == [[("x", 1)]]
    assert found("(list . (a) @x)") == [[("x", 1)]] and found("(list (_) @x .)") == [[("x", 5)]] and found('(list "open" @x)') == [[("x", 0)]]
    assert found("(list !last (a) @x)") == [] and found("(list (a) (a) @x)") == [[("x", 5)]] and found("(list [(a) (b)] @x)") == [[("x", 1)], [("x", 3)], [("x", 5)]]
    assert found("(list (b)? @x (a) @y)") == [[("x", 3), ("y", 5)]] and found("(list (a)* @x)") == [[("x", 1), ("x", 5)]] and found("(list (c)* (b) @x)") == [[("x", 3)]]
    for bad in ("(list", "list)", "(list)", "()", "[]", "(a ^) @x", ""):
        with pytest.raises(PatternError):
            compile_query(bad)


def test_discovery_and_git(spark, tmp_path):
    for name, text in {"a.ts": "1", "b/c.py": "2", "b/skip.ts": "3", "out/x.ts": "4", ".hidden/y.go": "5", "b/.gitignore": "skip.*\n!keep\n", ".gitignore": "/out/\n*.log\n", "z.log": "6", "b/keep": "7"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.ts").write_bytes(b"\xff\xfe")
    root = str(tmp_path)
    assert files.walk(root) == [".gitignore", ".hidden/y.go", "a.ts", "b/.gitignore", "b/c.py", "b/keep", "bad.ts"]
    assert files.walk(root, ["**/*.{ts,py}"], ["b/**"]) == ["a.ts", "bad.ts"]
    rows = {r.file: r.language for r in files.scan_tree(spark, root, ["**/*.{ts,py,go}"]).collect()}
    assert rows == {"a.ts": "typescript", "b/c.py": "python", ".hidden/y.go": "go"}
    stored = {r.file for r in files.scan_store(spark, root, ["**/*.{ts,py,go}"]).collect()}
    assert {"a.ts", "b/c.py", "b/skip.ts", "out/x.ts"} == stored
    with pytest.raises(files.ScanError):
        files.walk(root + "/none")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    (tmp_path / "a.ts").write_text("changed")
    (tmp_path / "b/c.py").unlink()
    (tmp_path / "new.ts").write_text("n")
    assert files.changed_since(root, "HEAD") == ["a.ts", "new.ts"] and files.staged(root) == []
    git("add", "new.ts")
    assert files.staged(root) == ["new.ts"]
    with pytest.raises(files.ScanError):
        files.changed_since(root, "nowhere")


def test_watch(spark, tmp_path):
    from tessera.streaming.watch import watch

    source, seen = tmp_path / "in", []
    spark.createDataFrame([("a", "x")], "file string, source string").write.parquet(str(source))
    watch(spark, str(source), "file string, source string", lambda df, n: seen.append((n, df.count())), str(tmp_path / "state"), available_now=True).awaitTermination(60)
    assert seen == [(0, 1)]


def _cycles_by_search(edges, max_depth):
    """First sightings of cycles, restated: all paths, sorted by root and edge ordinals."""
    out = {}
    for f, t, n in edges:
        out.setdefault(f, []).append((n, t))
    sights = []

    def walk(root, path, taken):
        for n, t in sorted(out.get(path[-1], [])):
            if t in path:
                cycle = path[path.index(t) :]
                sights.append((root, (*taken, n), path[-1], n, cycle))
            elif len(path) < max_depth:
                walk(root, [*path, t], (*taken, n))

    for root in out:
        walk(root, [root], ())
    first = {}
    for _, _, file, n, cycle in sorted(sights, key=lambda s: (s[0], s[1])):
        k = min(tuple(cycle[i:] + cycle[:i]) for i in range(len(cycle)))
        first.setdefault(k, (file, n, tuple([*cycle, cycle[0]])))
    return sorted(first.values())


def test_circular_imports_in_one_task_and_by_joins(spark):
    import random

    from tessera.operators.reduce_phase import circular_imports

    rng = random.Random(8)
    for depth in (3, 24):
        edges, names = [], "abcdefgh"
        for f in names:
            for n, t in enumerate(rng.sample([x for x in names if x != f], rng.randrange(3))):
                edges.append((f, t, n + 1))
        edges.append(("0", "c", 1))  # leads to cycles and is searched first
        df = spark.createDataFrame([(f, t, n, 1, n) for f, t, n in edges], "file string, target string, line int, column int, ordinal int")
        want = _cycles_by_search(edges, depth)
        for one_task in (10**6, 0):
            assert sorted((r.file, r.line, tuple(r.path)) for r in circular_imports(df, depth, one_task).collect()) == want
    assert circular_imports(df.limit(0)).count() == 0


def test_scratch_deletes_what_is_not_kept(spark):
    import os

    from tessera.operators.tables import checkpointed, scratch

    at = lambda df: os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    outside = checkpointed(spark.range(3))
    with scratch(spark) as keep:
        a, b = checkpointed(spark.range(5)), checkpointed(spark.range(7))
        with scratch(spark) as inner:
            c = checkpointed(spark.range(2))
            inner.append(c)
        gone, kept = at(a), [at(b), at(c)]
        keep += [b, c]
    assert not os.path.exists(gone) and all(os.path.isdir(k) for k in kept) and os.path.isdir(at(outside))
    assert b.count() == 7 and c.count() == 2 and outside.count() == 3
