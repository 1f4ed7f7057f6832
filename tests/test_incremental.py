"""Warm runs give what cold ones do."""

import glob
import os

from pyspark.sql import functions as F

from tessera.plans import builtin
from tessera.plans.engine import STORE, Config, check, check_incremental
from tessera.plans.fixture import no_debugger
from tessera.sources.files import scan_texts


def scanned(spark, sources):
    df = spark.createDataFrame(list(sources.items()), "path string, text string")
    return scan_texts(df, F.col("path"), F.col("text"))


def rows(outcome):
    return sorted(tuple(r[:6]) for r in outcome.sorted().collect())


def test_warm_equals_cold(spark, tmp_path):
    config, store = Config([no_debugger(), builtin.no_unused_exports(), builtin.no_circular_imports()]), str(tmp_path / "store")
    sources = {
        "a.ts": "import { y } from './b'\nexport const x = 1\ndebugger\n",
        "b.ts": "import { x } from './a'\nexport const y = 1, z = 2\n",
        "c.ts": "// tessera-disable-file local/no-debugger reason: old expires: 2024-06-30\ndebugger\n",
    }
    run = lambda s, **kw: rows(check_incremental(spark, scanned(spark, s), config, "2024-07-01", store, **kw))
    cold = rows(check(spark, scanned(spark, sources), config, "2024-07-01"))
    assert len(cold) == 4 and run(sources) == cold == run(sources)
    keys = lambda: {r.key for r in spark.read.schema(STORE).parquet(f"{store}/entries").collect()}
    first = keys()
    assert len(first) == 3
    changed = sources | {"b.ts": "export const y = 1\n"}
    assert run(changed) == rows(check(spark, scanned(spark, changed), config, "2024-07-01")) and len(keys() & first) == 2
    part = {"a.ts": "debugger\n"}
    assert run(part, whole=False) == rows(check(spark, scanned(spark, part), config, "2024-07-01", whole=False)) and len(keys()) == 4
    for f in glob.glob(f"{store}/entries/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"damaged")
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert run(sources) == cold


def test_recorded_reads_and_dates_decide_what_is_looked_at_again(spark, tmp_path):
    """An entry is stale once a file that its handler read, or missed, is another; one that asked for the date is of that day."""
    from tessera.plans.engine import declared_files
    from tessera.plans.handlers import handler
    from tessera.plans.rule import Card, Rule

    def speak(ctx, m):
        ctx.report(m["d"], f"{ctx.read_file('limits.json')} {ctx.file_exists('more.json')}")

    def dated(ctx, m):
        ctx.report(m["d"], ctx.today)

    card, query = Card("m", "r", "a", "b"), "(debugger_statement) @d"
    rules = [Rule("local/reads", query, card, handler(speak), reads=("limits.json", "more.json")), Rule("local/dated", query, card, handler(dated), languages=("javascript",))]
    config, store = Config(rules), str(tmp_path / "store")
    files = scanned(spark, {"a.ts": "debugger\n", "b.js": "debugger\n", "c.ts": "x\n"})

    def go(project, today="2024-07-01"):
        sides = declared_files(rules, project.get)
        cold = rows(check(spark, files, config, today, sides=sides))
        assert rows(check_incremental(spark, files, config, today, store, sides=sides)) == cold
        return [r[5] for r in cold]

    keys = lambda: {r.key for r in spark.read.schema(STORE).parquet(f"{store}/entries").collect()}
    assert go({"limits.json": b"1"}) == ["2024-07-01", "1 False"]
    first = keys()
    assert go({"limits.json": b"1"}) == ["2024-07-01", "1 False"] and keys() == first
    assert go({"limits.json": b"2"}) == ["2024-07-01", "2 False"]
    assert go({"limits.json": b"2", "more.json": b""}) == ["2024-07-01", "2 True"]
    assert go({}) == ["2024-07-01", "None False"] and keys() == first
    assert go({}, "2024-07-02") == ["2024-07-02", "None False"] and len(keys() - first) == 1


def test_changed_helpers_change_the_key(tmp_path, monkeypatch):
    """The key of a run holds the code of what a rule calls, in its own module and in those that it names."""
    import importlib
    import sys

    from tessera.plans.engine import code_digest, run_key
    from tessera.plans.handlers import handler
    from tessera.plans.rule import Card, Rule

    monkeypatch.syspath_prepend(str(tmp_path))

    def key(limit=3, helper="return 1", other="X = 1", deep="y = 1"):
        for name, text in (("helper_deep", f"{deep}\n"), ("helper_b", f"import helper_deep\n{other}\ndef f():\n    return X\n"), ("rule_a", f"from helper_b import f\ndef helper():\n    {helper}\ndef make(limit):\n    def check(ctx, m):\n        return helper() + limit + f()\n    return check\n")):
            (tmp_path / f"{name}.py").write_text(text)
            sys.modules.pop(name, None)
        importlib.invalidate_caches()
        for cached in tmp_path.rglob("*.pyc"):
            cached.unlink()
        check = importlib.import_module("rule_a").make(limit)
        assert code_digest(check) == code_digest(check)
        return run_key(Config([Rule("local/x", "(program) @p", Card("m", "r", "a", "b"), handler(check))]))

    keys = [key(), key(limit=4), key(helper="return 2"), key(other="X = 2"), key(deep="y = 2"), key()]
    assert len(set(keys)) == 5 and keys[0] == keys[-1]
    make = lambda needle: Config([builtin.no_restricted_imports([{"module": needle}])])
    assert run_key(make("a")) == run_key(make("a")) != run_key(make("b"))
