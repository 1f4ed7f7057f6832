"""A run: files, pruning, one parse per file, rules, facts, whole-corpus rules, directives, canonical order."""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import sys
import sysconfig
import time
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera
from tessera import schemas
from tessera.operators import cache
from tessera.operators import directives as dirs
from tessera.operators.gates import admitted
from tessera.operators.patterns import matches
from tessera.operators.tables import at_once, checkpointed
from tessera.operators.violations import canonical, numbered
from tessera.plans.handlers import TIMEOUT_MS, Context, deadline
from tessera.plans.rule import MATCHES, Corpus, Handler, Rule, RuleError
from tessera.sources.parsers import parse, tables
from tessera.sources.tree import Node, Tree


@dataclass
class Config:
    rules: list[Rule]
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    #: Rule id -> severity, over what the rule says itself.
    severity: dict[str, str] = field(default_factory=dict)
    #: Namespaces that rules may use, besides the shipped one.
    namespaces: list[str] = field(default_factory=lambda: ["local"])
    directive_prefix: str = "tessera"
    #: Budget of one call of a handler, in milliseconds, where the rule names none.
    timeout_ms: int = TIMEOUT_MS

    def __post_init__(self) -> None:
        for r in self.rules:
            if r.rule_id.namespace not in (*self.namespaces, "tessera"):
                raise RuleError(f"{r.id}: namespace `{r.rule_id.namespace}` is not declared")
        if "tessera" in self.namespaces:
            raise RuleError("namespace `tessera` is reserved")
        for s in self.severity.values():
            if s not in schemas.SEVERITIES:
                raise RuleError(f"unknown severity `{s}`")

    def resolved(self, r: Rule) -> str:
        return self.severity.get(r.id, r.severity)

    def active(self) -> list[Rule]:
        """The rules that run: a word of the configuration switches one on as well as off."""
        return [r for r in self.rules if self.resolved(r) != "off"]


@dataclass
class Outcome:
    violations: DataFrame
    facts: DataFrame
    directives: DataFrame
    discovered: DataFrame
    parsed: DataFrame
    #: rule_ns, rule_name, query_ms, handler_ms, matches; without rows unless the run was profiled.
    timings: DataFrame
    #: file, path, hash: other files that handlers read; a null hash is an absence.
    reads: DataFrame

    def sorted(self) -> DataFrame:
        return canonical(self.violations, "message")


#: Text and digest of files that rules declare in `reads`; the digest is null for one that is not there, the text for one that is no text.
Sides = dict[str, tuple[str | None, str | None]]
#: Bytes of declared files that are shipped with every task, at most.
MOST_SIDES = 64 << 20


def declared_files(rules: list[Rule], read: Callable[[str], bytes | None]) -> Sides:
    """The files that rules declare; read gives a file's bytes, or null where there is none."""
    out, total = {}, 0
    for path in sorted({p for r in rules for p in r.reads}):
        data = read(path)
        if data is None:
            out[path] = (None, None)
            continue
        total += len(data)
        if total > MOST_SIDES:
            raise RuleError(f"the files that rules read are over {MOST_SIDES} bytes")
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            text = None
        out[path] = (text, hashlib.sha256(data).hexdigest())
    return out


# --- parsing and matching in one task ------------------------------------------------------------------


def _attributes(root: Node, source: bytes) -> dict[int, list[str]]:
    """For each node, the attributes attached to the items around it: the run of attributes right before each."""
    out: dict[int, list[str]] = {}
    stack: list[tuple[Node, list[str]]] = [(root, [])]
    while stack:
        n, held = stack.pop()
        out[id(n)] = held
        run: list[str] = []
        for c in n.children:
            if c.kind == "attribute_item":
                run.append(source[c.start : c.end].decode("utf-8", "replace"))
                stack.append((c, held))
                continue
            stack.append((c, held + run if c.kind in ("function_item", "mod_item") else held))
            run = []
    return out


class _Light:
    """What tasks need of a rule; its expressions stay on the driver."""

    def __init__(self, r: Rule, timeout_ms: int):
        self.id, self.compiled, self.reads = r.id, r.compiled, r.reads
        self.run = r.check.run if isinstance(r.check, Handler) else None
        self.timeout_ms = r.timeout_ms or timeout_ms


def match_file(file: str, language: str, source: str, wanted: list[int], rules: list[_Light], today: str = "", sides: Sides | None = None, profile: bool = False) -> list[tuple]:
    """Rows of MATCHES for one file: parsed once, one walk for all rules; handlers speak here, expressions later."""
    data = source.encode("utf-8")
    p = parse(data, language)
    if p.root is None:
        return []
    tree, attributes = Tree(p.root, data, p.scopes, p.decls), None
    out, seq, contexts = [], {}, {}
    spent, handled = {} if profile else None, {}
    for owner, index, captures in matches(p.root, [(i, rules[i].compiled[language]) for i in wanted], spent=spent):
        k = seq[owner] = seq.get(owner, -1) + 1
        rule = rules[owner]
        first: dict[str, Node] = {}
        for name, n in captures:
            first.setdefault(name, n)
        if rule.run is not None:
            if owner not in contexts:
                contexts[owner] = Context(file, language, tree, today, sides or {}, rule.reads)
            begun = time.perf_counter_ns()
            with deadline(rule.timeout_ms, f"{rule.id}: the check of {file}"):
                rule.run(contexts[owner], first)
            handled[owner] = handled.get(owner, 0) + time.perf_counter_ns() - begun
            said, contexts[owner].said = contexts[owner].said, []
            if said:
                out.append((file, owner, k, index, [], said))
            continue
        cells = []
        for name, n in first.items():
            line, column = tree.position(n)
            bound = tree.binding(n) if n.kind.endswith("identifier") else (None, None, None, False)
            if language == "rust":
                attributes = attributes or _attributes(p.root, data)
            cells.append((name, {"name": name, "node_id": tree.places[id(n)], "kind": n.kind, "text": tree.text(n), "line": line, "column": column, "start": n.start, "end": n.end, "binding": bound[0], "module": bound[1], "imported": bound[2], "shadowed": bound[3], "attributes": attributes[id(n)] if attributes else []}))
        out.append((file, owner, k, index, cells, None))
    if profile:
        for i in wanted:
            times = {"query_ns": spent.get(i, 0), "handler_ns": handled.get(i, 0), "matches": seq.get(i, -1) + 1}
            out.append((file, i, -1, 0, [], [("#time", None, None, None, None, json.dumps(times))]))
    return out


#: Files that a task turns into rows at a time.
_FILES = 64


def match_rules(files: DataFrame, rules: list[Rule], today: str = "", timeout_ms: int = TIMEOUT_MS, sides: Sides | None = None, profile: bool = False) -> DataFrame:
    """MATCHES of admitted files (file, language, source, rules). Parsing and all rules' patterns and handlers share one pass, so no tree is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(MATCHES))
    names = [f.name for f in schema.field("said").type.value_type]
    light = [_Light(r, timeout_ms) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _FILES):
                b = whole.slice(at, _FILES)
                rows = [r for f, lang, source, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in match_file(f, lang, source, wanted, light, today, sides, profile)]
                cols = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in schema]
                cols[5] = [x and [dict(zip(names, y, strict=True)) for y in x] for x in cols[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return files.select("file", "language", "source", "rules").mapInArrow(run, MATCHES)


def parse_nodes(files: DataFrame) -> DataFrame:
    """files with nodes, scopes and decls as arrays: one parse per file, to be written once and exploded as needed."""
    node = "array<struct<node_id:int,parent_id:int,child_idx:int,depth:int,pre:int,post:int,kind:string,field:string,named:boolean,start_byte:bigint,end_byte:bigint,line:int,column:int,text:string,ancestors:array<int>,scopes:array<int>>>"
    schema = f"file string, nodes {node}, scopes array<struct<scope_id:int,pre:int,post:int,depth:int,kind:string>>, decls array<struct<scope_id:int,name:string,kind:string,module:string,imported:string>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _FILES):
                out = [[], [], [], []]
                for f, lang, source in zip(*(c.to_pylist() for c in whole.slice(at, _FILES).columns), strict=True):
                    parts = tables(source.encode("utf-8"), lang)
                    out[0].append(f)
                    for k, (rows, field_) in enumerate(zip(parts, list(arrow)[1:], strict=True), 1):
                        names = [x.name for x in field_.type.value_type]
                        out[k].append([dict(zip(names, r, strict=True)) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return files.filter("language IS NOT NULL").select("file", "language", "source").mapInArrow(run, schema)


def exploded(parsed: DataFrame, part: str) -> DataFrame:
    return parsed.select("file", F.explode(part).alias("x")).select("file", "x.*")


# --- the run ---------------------------------------------------------------------------------------------


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


#: Rules of expressions that one projection evaluates, so that its generated code stays within bounds.
_RULES = 50


def said(found: DataFrame, active: list[Rule]) -> DataFrame:
    """(file, rule, match_seq, n, kind, line, column, message, fix, data): what rules say about MATCHES, all in one scan."""
    out = None
    for a in range(0, max(1, len(active)), _RULES):
        speaks = None
        for i, r in list(enumerate(active))[a : a + _RULES]:
            if emits := r.emits():
                all_ = F.array_compact(F.array(*[e.said() for e in emits]))
                speaks = F.when(F.col("rule") == i, all_) if speaks is None else speaks.when(F.col("rule") == i, all_)
        rows = found.filter(F.col("rule").between(a, a + _RULES - 1)) if len(active) > _RULES else found
        each = rows.select("file", "rule", "match_seq", F.posexplode(F.coalesce(*([F.col("said")] + ([] if speaks is None else [speaks])))).alias("n", "x"))
        each = each.select("file", "rule", "match_seq", "n", "x.*")
        out = each if out is None else out.unionByName(each)
    return out


_REPORTS = ["rule_ns", "rule_name", "file", "line", "column", "message", "remediation", "severity", "fix"]


def _of_rule(active: list[Rule], get: Callable[[Rule], str]) -> Column:
    """A property of the row's rule, from the configuration's list."""
    return F.get(F.array(*[F.lit(get(r)) for r in active]), F.col("rule")) if active else F.lit(None).cast("string")


def _named(rows: DataFrame, active: list[Rule]) -> DataFrame:
    return rows.withColumns({"rule_ns": _of_rule(active, lambda r: r.rule_id.namespace), "rule_name": _of_rule(active, lambda r: r.rule_id.name)})


def reports_of(rows: DataFrame, active: list[Rule], config: Config) -> DataFrame:
    """Violations among what rules said."""
    shape = {"message": F.coalesce("message", _of_rule(active, lambda r: r.card.message)), "remediation": _of_rule(active, lambda r: r.card.remediation), "severity": _of_rule(active, config.resolved)}
    return _named(rows.filter("kind = ''"), active).withColumns(shape).select(*_REPORTS)


def facts_of(rows: DataFrame, active: list[Rule]) -> DataFrame:
    """Facts among what rules said, in a row's place as they were said."""
    facts = _named(rows.filter("kind <> '' AND NOT startswith(kind, '#')"), active)
    return numbered(facts, "match_seq", "n").select("rule_ns", "rule_name", "file", "kind", "data", "sequence")


def file_phase(fit: DataFrame, active: list[Rule], config: Config, today: str, sides: Sides | None, profile: bool) -> DataFrame:
    """What the rules say about admitted files, each file on its own."""
    return checkpointed(said(match_rules(fit, active, today, config.timeout_ms, sides, profile), active))


def corpus_phase(facts: DataFrame, listed: DataFrame, active: list[Rule], config: Config) -> DataFrame | None:
    """Violations of whole-corpus rules: each sees its own facts and the list of files."""
    def of(r: Rule) -> DataFrame:
        own = facts.filter((F.col("rule_ns") == r.rule_id.namespace) & (F.col("rule_name") == r.rule_id.name))
        got = r.reduce(Corpus(own, listed))
        return checkpointed(got.select(F.lit(r.rule_id.namespace).alias("rule_ns"), F.lit(r.rule_id.name).alias("rule_name"), "file", "line", "column", F.coalesce("message", F.lit(r.card.message)).alias("message"), F.lit(r.card.remediation).alias("remediation"), F.lit(config.resolved(r)).alias("severity"), F.lit(None).cast(schemas.FIX).alias("fix")))

    out = at_once(facts.sparkSession, *(lambda r=r: of(r) for r in active if r.reduce))
    return _union(out) if out else None


def _finish(found: DataFrame, more: DataFrame | None, facts: DataFrame, directives: DataFrame, config: Config, today: str, unused: bool) -> tuple[DataFrame, DataFrame]:
    """(violations after directives, valid directives); directives: checkpointed rows of dirs.found() in files that some rule looked at."""
    valid, malformed = dirs.split(directives)
    violations = found if more is None else found.unionByName(more)
    if directives.isEmpty():
        return violations, valid
    return dirs.apply(checkpointed(violations), valid, malformed, today, config.directive_prefix, unused), valid


def _timings(rows: DataFrame, active: list[Rule]) -> DataFrame:
    times = F.from_json("data", "query_ns bigint, handler_ns bigint, matches bigint")
    each = _named(rows.filter("kind = '#time'"), active).select("rule_ns", "rule_name", times.alias("t"))
    ms = lambda n: F.sum(f"t.{n}") / 1e6
    return each.groupBy("rule_ns", "rule_name").agg(ms("query_ns").alias("query_ms"), ms("handler_ns").alias("handler_ms"), F.sum("t.matches").alias("matches"))


def _reads(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = '#read'").select("file", F.from_json("data", "path string, hash string").alias("x")).select("file", "x.*").distinct()


def check(spark: SparkSession, files: DataFrame, config: Config, today: str, whole: bool = True, unused: bool = False, sides: Sides | None = None, profile: bool = False, listed: DataFrame | None = None) -> Outcome:
    """files (file, language, source, ...) under a configuration.

    today: the run's date, YYYY-MM-DD; nothing asks the clock. whole: the files are the entire corpus; on a
    part of it whole-corpus rules do not run, as they would report what they cannot see. sides: see
    declared_files(). listed: all files (file) that were discovered, where files holds only those to be read.
    """
    files = files.filter("language IS NOT NULL")
    active = config.active()
    fit = admitted(files, active, content=True)
    rows, directives = at_once(spark, lambda: file_phase(fit, active, config, today, sides, profile), lambda: checkpointed(dirs.found(fit, config.directive_prefix)))
    facts = checkpointed(facts_of(rows, active)) if whole and any(r.reduce for r in active) else facts_of(rows, active)
    listed = (files if listed is None else listed).select("file").distinct()
    more = corpus_phase(facts, listed, active, config) if whole else None
    violations, valid = _finish(reports_of(rows, active, config), more, facts, directives, config, today, unused)
    return Outcome(violations, facts, valid, listed, fit.select("file"), _timings(rows, active), _reads(rows))


# --- incremental runs ------------------------------------------------------------------------------------

_V = "struct<rule_ns:string,rule_name:string,file:string,line:int,column:int,message:string,remediation:string,severity:string,fix:" + schemas.FIX + ">"
_F = "struct<rule_ns:string,rule_name:string,file:string,kind:string,data:string,sequence:int>"
_R = "struct<path:string,hash:string>"
STORE = f"key string, violations array<{_V}>, facts array<{_F}>, directives array<{dirs.FOUND}>, reads array<{_R}>"
#: What whole-corpus rules said of a set of entries: digest stands for the entries and the list of files.
CORPUS = f"digest string, violations array<{_V}>"


def _own(path: str | None) -> bool:
    """Whether a module's file is of a project, not of Python's library or of installed packages."""
    return bool(path) and not any(str(path).startswith(sysconfig.get_paths()[n]) for n in ("stdlib", "platstdlib", "purelib", "platlib"))


def code_digest(f: Callable) -> str:
    """A digest of a function and of all that it calls, as far as it is a project's code: changed helpers change it.

    Of a module that has a file the whole file counts, and those of the modules that it names; else the
    function's byte code, its constants, what it closes over and the functions that it names.
    """
    seen: set[int] = set()
    h = hashlib.sha256()

    def value(x: object) -> None:
        if id(x) in seen:
            return
        seen.add(id(x))
        if isinstance(x, types.ModuleType):
            path = getattr(x, "__file__", None)
            if _own(path) and not (x.__name__ == "tessera" or x.__name__.startswith("tessera.")):  # the engine's own code is in the key anyway
                h.update(Path(path).read_bytes())
                for y in list(vars(x).values()):
                    owner = sys.modules.get(getattr(y, "__module__", None) or "")
                    if isinstance(y, types.ModuleType) or owner is not None and owner is not x and callable(y):
                        value(y if isinstance(y, types.ModuleType) else owner)
        elif isinstance(x, types.CodeType):
            h.update(x.co_code)
            h.update(repr(x.co_names).encode())
            for y in x.co_consts:
                value(y)
        elif isinstance(x, types.FunctionType):
            path = x.__code__.co_filename
            module = sys.modules.get(x.__module__ or "")
            if module is not None and getattr(module, "__file__", None) == path:
                value(module)
            value(x.__code__)
            for y in (*(x.__defaults__ or ()), *(x.__kwdefaults__ or {}).values(), *(c.cell_contents for c in (x.__closure__ or ()) if c.cell_contents is not x)):
                value(y)
            for n in x.__code__.co_names:
                y = x.__globals__.get(n)
                if isinstance(y, (types.FunctionType, types.ModuleType)):
                    value(y)
        elif isinstance(x, (set, frozenset)):
            h.update(repr(sorted(map(repr, x))).encode())
        else:
            h.update(re.sub(r" at 0x[0-9a-f]+", "", repr(x)).encode())

    value(f)
    return h.hexdigest()


def engine_digest() -> str:
    """A digest of this package's own code, the training-data operators aside."""
    base = Path(tessera.__file__).parent
    h = hashlib.sha256(tessera.__version__.encode())
    for f in sorted(base.rglob("*.py")):
        if f.relative_to(base).parts[0] != "llm":
            h.update(str(f.relative_to(base)).encode())
            h.update(f.read_bytes())
    return h.hexdigest()


def run_key(config: Config) -> str:
    """A digest of all that a file's result depends on besides the file: rules with their code, severities, versions."""
    def of(r: Rule) -> str:
        return code_digest(r.check.run if isinstance(r.check, Handler) else r.check)

    rules = [[r.id, r.query, list(r.languages), vars(r.gates), vars(r.card), config.resolved(r), r.timeout_ms, list(r.reads), of(r)] for r in config.rules]
    return cache.config_hash(config.include, config.exclude, config.severity, {"engine": engine_digest(), "python": sys.version, "timeout": config.timeout_ms, "prefix": config.directive_prefix}, rules)


def check_incremental(spark: SparkSession, files: DataFrame, config: Config, today: str, store: str, whole: bool = True, unused: bool = False, sides: Sides | None = None, listed: DataFrame | None = None) -> Outcome:
    """check(), with per-file results kept in a Parquet store: files whose key is known, and whose recorded reads are as they were, are neither parsed nor matched.

    A whole run leaves the entries of its own files alone; a partial one adds to what was there. What
    whole-corpus rules said is kept too, under a digest of the entries and the files' names. An unreadable
    store counts as empty. Results equal check()'s.
    """
    files = files.filter("language IS NOT NULL")
    active = config.active()
    run = run_key(config)
    listed = (files if listed is None else listed).select("file").distinct()
    old = cache.load(spark, f"{store}/entries", STORE)
    fit = cache.keys(admitted(files, active, content=True), run, today).drop("content_hash")
    # one row per file: what a file emits is bounded by the file
    state = fit.select("file", "key", "dated_key", F.contains("source", F.lit("expires:")).alias("dated"))
    stale = cache.stale_keys(old.select("key", F.explode("reads").alias("x")).select("key", "x.*"), sides or {}) if sides is not None else None
    known = old if stale is None else old.join(stale, "key", "left_anti")
    found = checkpointed(state.join(cache.hits(state, known).withColumnRenamed("key", "hit_key"), "file", "left"))
    counts = found.agg(F.count("*").alias("n"), F.count("hit_key").alias("hit")).first()
    entries = found.filter("hit_key IS NOT NULL").select("file", F.col("hit_key").alias("key"), "violations", "facts", "directives", "reads")
    if counts["n"] > counts["hit"]:
        misses = fit.join(found.filter("hit_key IS NULL").select("file"), "file", "left_semi")
        new = checkpointed(_entries(misses, found, active, config, today, sides))
        entries = entries.unionByName(new)
    changed = counts["n"] > counts["hit"] or whole and counts["n"] != old.count()
    if changed:
        cache.save(cache.merged(old, entries.drop("file"), whole), store)
        if whole:  # the store's old files are gone
            entries = _stored(spark, store, state)
    facts = entries.select(F.explode("facts").alias("x")).select("x.*")
    more = None
    if whole and any(r.reduce for r in active):
        low = lambda c: F.sum(F.xxhash64(c).cast("decimal(20,0)")).cast("string")
        sums = [entries.agg(low("key"), F.count("*")).first(), listed.agg(low("file"), F.count("*")).first()]
        digest = hashlib.sha256(json.dumps([run, *map(list, sums)]).encode()).hexdigest()
        kept = cache.load(spark, f"{store}/corpus", CORPUS).filter(F.col("digest") == digest)
        if kept.isEmpty():
            more = corpus_phase(facts, listed, active, config)
            # a row without violations says that there are none
            rows = more.select(F.lit(digest).alias("digest"), F.array(F.struct(*_REPORTS)).alias("violations"))
            cache.save(rows.unionByName(spark.createDataFrame([(digest, [])], CORPUS)), store, "corpus")
            kept = cache.load(spark, f"{store}/corpus", CORPUS).filter(F.col("digest") == digest)
        more = kept.select(F.explode("violations").alias("x")).select("x.*")
    reported = entries.select(F.explode("violations").alias("x")).select("x.*")
    directives = entries.select("file", F.explode("directives").alias("x")).select("file", "x.*")
    violations, valid = _finish(reported, more, facts, directives, config, today, unused)
    reads = entries.select("file", F.explode("reads").alias("x")).select("file", "x.*")
    return Outcome(violations, facts, valid, listed, state.select("file"), spark.createDataFrame([], "rule_ns string, rule_name string, query_ms double, handler_ms double, matches long"), reads)


def _entries(misses: DataFrame, state: DataFrame, active: list[Rule], config: Config, today: str, sides: Sides | None) -> DataFrame:
    """New entries (file, key, ...) of files that are not in the store."""
    rows = file_phase(misses, active, config, today, sides, False)
    kinds = {"violations": _V, "facts": _F, "directives": dirs.FOUND, "reads": _R}

    def part(df: DataFrame, name: str) -> DataFrame:
        own = F.struct(*[c for c in df.columns if c != "file" or name in ("violations", "facts")])
        return df.select("file", *[(own if n == name else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()], F.lit(None).cast("boolean").alias("asked"))

    asked = rows.filter("kind = '#today'").select("file", *[F.lit(None).cast(t).alias(n) for n, t in kinds.items()], F.lit(True).alias("asked"))
    parts = [part(reports_of(rows, active, config), "violations"), part(facts_of(rows, active), "facts"), part(dirs.found(misses, config.directive_prefix), "directives"), part(_reads(rows), "reads"), asked]
    # one shuffle brings together what a file has given
    said_ = _union(parts).groupBy("file").agg(*[F.collect_list(n).alias(n) for n in kinds], F.max("asked").alias("asked"))
    out = state.filter("hit_key IS NULL").select("file", "key", "dated_key", "dated").join(said_, "file", "left")
    key = F.when(F.col("dated") | F.col("asked"), F.col("dated_key")).otherwise(F.col("key")).alias("key")
    return out.select("file", key, *[F.coalesce(n, F.array().cast(f"array<{t}>")).alias(n) for n, t in kinds.items()])


def _stored(spark: SparkSession, store: str, state: DataFrame) -> DataFrame:
    """The entries of a whole run as they have been stored, with their files."""
    by = state.select("file", F.explode(F.array("key", "dated_key")).alias("key"))
    return by.join(spark.read.schema(STORE).parquet(f"{store}/entries"), "key").select("file", "key", "violations", "facts", "directives", "reads")
