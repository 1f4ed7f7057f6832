"""python -m tessera check | watch | rules | explain | lsp | mcp: 0 nothing wrong, 1 errors found, 2 the run itself failed."""

from __future__ import annotations

import argparse
import contextlib
import datetime
import json
import sys
import tempfile
import threading
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import functions as F

from tessera import config as configs
from tessera import server
from tessera.operators import fixes, reports
from tessera.operators.violations import failing
from tessera.operators.gates import admits_any_path
from tessera.plans.engine import Config, Outcome, check, check_incremental, declared_files
from tessera.sources import files as scans


def cards(spark, config: Config):
    rows = [(r.rule_id.namespace, r.rule_id.name, r.card.message, r.card.remediation) for r in config.rules]
    return spark.createDataFrame(rows, "rule_ns string, rule_name string, card_message string, card_remediation string")


def listing(config: Config, declared: int) -> str:
    rules = [{"id": r.id, "severity": config.resolved(r), "languages": list(r.languages), "message": r.card.message} for r in config.rules]
    return json.dumps({"version": 1, "declared": declared, "enabled": sum(x["severity"] != "off" for x in rules), "rules": rules}, indent=2)


def explanation(config: Config, rule: str) -> str:
    for r in config.rules:
        if r.id == rule:
            return f"{r.id} ({config.resolved(r)})\n{r.card.message}\n→ {r.card.remediation}\n\nbad:\n{r.card.bad}\n\ngood:\n{r.card.good}"
    raise configs.ConfigError(f"no rule `{rule}` is configured")


def render(spark, outcome: Outcome, config: Config, form: str, warn_only: bool) -> Iterator[str]:
    """The report in pieces, as they are to be written."""
    if form == "json":
        return reports.json_report(outcome.violations, outcome.discovered.count(), outcome.parsed.count(), warn_only)
    if form == "sarif":
        return reports.sarif_report(outcome.violations)
    lines = reports.agent_report(outcome.violations, cards(spark, config)) if form == "agent" else reports.human(outcome.violations)
    return (f"{x}\n" for x in lines)


def write_fixes(root: str, files, violations) -> int:
    """Apply safe fixes below root; only files that change are written."""
    n = 0
    for r in fixes.apply_fixes(files.select("file", "source"), violations).filter("changed").toLocalIterator():
        Path(root, r["file"]).write_text(r["source"], "utf-8", newline="")
        n += 1
    return n


def side_reader(root: str):
    """Reads a declared file below root; one that a link leads out of it is refused."""
    base = Path(root).resolve()

    def read(path: str) -> bytes | None:
        at = Path(base, path).resolve()
        if not at.is_relative_to(base):
            raise configs.ConfigError(f"`{path}` lies outside the project")
        return at.read_bytes() if at.is_file() else None

    return read


def run(spark, root: str, config: Config, today: str, paths: list[str] | None = None, fix: bool = False, unused: bool = False, store: str | None = None, profile: bool = False) -> Outcome:
    """paths: the selection to look at; null is everything that discovery finds, on which whole-corpus rules run too."""
    known = scans.walk(root, config.include, config.exclude)
    chosen = spark.createDataFrame([(p,) for p in known], "file string")
    if paths is not None:
        chosen = scans.narrowed(chosen, spark.createDataFrame([(p,) for p in paths], "file string"))
    # a file that no rule admits by its path is listed, but not read
    files = scans.scan_listed(chosen.filter(admits_any_path(F.col("file"), scans.language_of(F.col("file")), config.active())), root)
    listed = chosen.filter(scans.language_of(F.col("file")).isNotNull())
    sides = declared_files(config.active(), side_reader(root))

    def once() -> Outcome:
        if store:
            return check_incremental(spark, files, config, today, store, paths is None, unused, sides, listed)
        return check(spark, files, config, today, paths is None, unused, sides, profile, listed)

    out = once()
    # what was fixed is looked at again
    return once() if fix and write_fixes(root, files, out.violations) else out


@contextlib.contextmanager
def time_limit(spark, ms: int | None) -> Iterator[None]:
    """Cancel the jobs of what runs within, again and again, once so many milliseconds have passed."""
    done, late, tag = threading.Event(), threading.Event(), "tessera-run"

    def watch() -> None:
        if not done.wait(ms / 1000):
            late.set()
            while not done.wait(0.1):
                spark.sparkContext.cancelJobsWithTag(tag)

    if ms is None:
        yield
        return
    spark.sparkContext.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        yield
    except Exception:
        if not late.is_set():
            raise
    finally:
        done.set()
        spark.sparkContext.removeJobTag(tag)
    if late.is_set():  # a result that came too late is none
        raise configs.ConfigError(f"the run took more than {ms} ms")


def follow(spark, a: argparse.Namespace, config: Config, stop: Callable[[int], bool] = lambda n: False) -> int:
    """Run now, and after every change below the root; what earlier runs found of unchanged files is kept."""
    from tessera.streaming.watch import watch_tree

    with tempfile.TemporaryDirectory(prefix="tessera-watch-") as own:
        done = threading.Event()

        def once(_, n: int) -> None:
            today = a.today or datetime.datetime.now(datetime.UTC).date().isoformat()
            try:
                out = run(spark, a.root, config, today, store=a.store or f"{own}/store")
                for part in render(spark, out, config, a.format, a.warn_only):
                    sys.stdout.write(part)
                sys.stdout.flush()
            finally:
                if stop(n):
                    done.set()

        query = watch_tree(spark, str(Path(a.root).resolve()), once, f"{own}/stream")
        try:
            while not done.wait(0.2) and query.isActive:
                pass
        except KeyboardInterrupt:
            pass
        finally:
            query.stop()
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("command", choices=("check", "watch", "rules", "explain", "lsp", "mcp"))
    parser.add_argument("rule", nargs="?")
    parser.add_argument("--root", default=".")
    parser.add_argument("--config")
    parser.add_argument("--format", choices=("human", "json", "sarif", "agent"), default="human")
    parser.add_argument("--since")
    parser.add_argument("--staged", action="store_true")
    parser.add_argument("--fix", action="store_true")
    parser.add_argument("--warn-only", action="store_true")
    parser.add_argument("--report-unused", action="store_true")
    parser.add_argument("--store", help="folder of the result cache")
    parser.add_argument("--profile", action="store_true", help="say on stderr what each rule cost; not with --store")
    parser.add_argument("--today", help="date that directives expire against; the current one in UTC by default")
    a = parser.parse_args(argv)
    try:
        config, limits = configs.load(a.config or Path(a.root, configs.NAME))
        if a.command == "rules":
            print(listing(config, len(config.rules)))
            return 0
        if a.command == "explain":
            print(explanation(config, a.rule or ""))
            return 0
        paths = scans.changed_since(a.root, a.since) if a.since else scans.staged(a.root) if a.staged else None
        if paths is not None:
            print("whole-corpus rules are skipped on a selection of files", file=sys.stderr)
        today = a.today or datetime.datetime.now(datetime.UTC).date().isoformat()
        if spark is None:
            from tessera.session import local_session

            spark = local_session(memory="2g")
        if a.command in ("lsp", "mcp"):
            project = server.Project(spark, a.root, a.config, a.store, lambda: a.today or datetime.datetime.now(datetime.UTC).date().isoformat())
            if a.command == "mcp":
                server.serve_mcp(sys.stdin.buffer, sys.stdout.buffer, project)
            else:
                server.serve_lsp(sys.stdin.buffer, sys.stdout.buffer, a.root, project.violations)
            return 0
        if a.command == "watch":
            return follow(spark, a, config)
        with time_limit(spark, limits.whole):
            out = run(spark, a.root, config, today, paths, a.fix, a.report_unused, a.store, a.profile)
            code = failing(out.violations, a.warn_only).first()["exit_code"]
            for part in render(spark, out, config, a.format, a.warn_only):
                sys.stdout.write(part)
            sys.stdout.write("\n" if a.format in ("json", "sarif") else "")
            if a.profile:
                for r in reports.profile(out.timings).collect():  # one row per configured rule
                    print(f"{r['total_ms']:10.1f} ms  {r['rule_ns']}/{r['rule_name']}  query {r['query_ms']:.1f}, handler {r['handler_ms']:.1f}, {r['matches']} matches", file=sys.stderr)
        return code
    except Exception as e:  # any failure of the run is told apart from violations
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
