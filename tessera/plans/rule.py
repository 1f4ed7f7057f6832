"""What a rule is: metadata, a query, and DataFrame programs over its matches and facts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identifiers import RuleId
from tessera.operators.gates import Gates
from tessera.operators.patterns import Pattern, compile_query
from tessera.schemas import SEVERITIES
from tessera.sources.parsers import FAMILY, FIELDS, KINDS, LEAVES, ROOTS

CAPTURE = "struct<name:string,node_id:int,kind:string,text:string,line:int,column:int,start:bigint,end:bigint,binding:string,module:string,imported:string,shadowed:boolean,attributes:array<string>>"
FIX = "struct<start:bigint,end:bigint,replacement:string,safe:boolean>"
#: What a match says: kind is empty for a report, starts with # for a mark of the engine's own, and is a fact's kind else.
SAID = f"struct<kind:string,line:int,column:int,message:string,fix:{FIX},data:string>"
#: captures: the first node of each name; said: what a handler has said, null for rules of expressions.
MATCHES = f"file string, rule int, match_seq int, pattern_index int, captures map<string,{CAPTURE}>, said array<{SAID}>"


class RuleError(ValueError):
    """A rule that cannot be used as it is written."""


def compile_for(query: str, language: str) -> list[Pattern]:
    """A query's patterns, checked against what a language's parser makes."""
    family = FAMILY[language]
    return compile_query(query, KINDS[family], FIELDS[family], LEAVES, ROOTS)


@dataclass(frozen=True)
class Card:
    message: str
    remediation: str
    bad: str
    good: str

    def check(self) -> None:
        for name in ("message", "remediation", "bad", "good"):
            if not getattr(self, name).strip():
                raise RuleError(f"card: {name} is empty")
        if self.bad.strip() == self.good.strip():
            raise RuleError("card: both examples are the same")


@dataclass(frozen=True)
class Emit:
    """What a rule says about a match for which `when` holds: expressions over its file, match_seq and captures."""

    kind: Column
    when: Column | None = None
    line: Column | None = None
    column: Column | None = None
    message: Column | None = None
    fix: Column | None = None
    data: Column | None = None

    def said(self) -> Column:
        kinds = {"kind": "string", "line": "int", "column": "int", "message": "string", "fix": FIX, "data": "string"}
        row = F.struct(*[(F.lit(None) if getattr(self, n) is None else getattr(self, n)).cast(t).alias(n) for n, t in kinds.items()])
        return row if self.when is None else F.when(self.when, row)


@dataclass(frozen=True)
class Handler:
    """A check in Python: run(context, captures by name), called once per match in the task that parsed the file."""

    run: Callable


@dataclass
class Corpus:
    """What reduce sees: the rule's own facts and the list of files, no trees."""

    facts: DataFrame
    files: DataFrame

    def of(self, kind: str, schema: str) -> DataFrame:
        """Facts of a kind with their payload's fields; a `file` within the payload never counts."""
        body = F.from_json("data", schema).alias("x")
        rows = self.facts.filter(F.col("kind") == kind).select("file", "sequence", body)
        names = [n for n in rows.schema["x"].dataType.names if n != "file"]
        return rows.select("file", "sequence", *[F.col(f"x.{n}").alias(n) for n in names])


@dataclass
class Rule:
    id: str
    query: str
    card: Card
    #: What it says about a match: a function that gives expressions, or a Handler.
    check: Callable[[], list[Emit]] | Handler
    languages: tuple[str, ...] = ("typescript", "tsx")
    severity: str = "error"
    gates: Gates = field(default_factory=Gates)
    reduce: Callable[[Corpus], DataFrame] | None = None
    #: Budget of one call of a handler, over the configuration's.
    timeout_ms: int | None = None
    #: Other files, by path from the project's root, that a handler may read.
    reads: tuple[str, ...] = ()
    compiled: dict[str, list[Pattern]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.rule_id = RuleId.parse(self.id)
        if self.severity not in SEVERITIES:
            raise RuleError(f"{self.id}: unknown severity `{self.severity}`")
        if not self.languages:
            raise RuleError(f"{self.id}: names no language")
        for language in self.languages:
            if language not in FAMILY:
                raise RuleError(f"{self.id}: unknown language `{language}`")
        if not self.query.strip():
            raise RuleError(f"{self.id}: query is empty")
        if not isinstance(self.check, Handler) and not callable(self.check):
            raise RuleError(f"{self.id}: check is missing")
        for path in self.reads:
            if path.startswith("/") or ".." in path.split("/") or not path:
                raise RuleError(f"{self.id}: `{path}` lies outside the project")
        self.card.check()
        self.compiled = {language: compile_for(self.query, language) for language in self.languages}

    def emits(self) -> list[Emit]:
        """The expressions of a rule that is no handler."""
        return [] if isinstance(self.check, Handler) else list(self.check())


def captured(name: str) -> Column:
    """The first node captured under a name; null if the match has none."""
    return F.try_element_at("captures", F.lit(name))


def report(at: Column, message: Column | None = None, fix: Column | None = None, when: Column | None = None) -> Emit:
    """A report at a captured node; without a message the card's counts."""
    return Emit(F.lit(""), when, at["line"], at["column"], message, fix)


def fact(kind: str | Column, when: Column | None = None, **data: Column) -> Emit:
    """A fact with a JSON object of the given fields."""
    if isinstance(kind, str) and (not kind or kind.startswith("#")):
        raise RuleError("a fact needs a kind, which does not start with #")
    return Emit(F.lit(kind) if isinstance(kind, str) else kind, when, data=F.to_json(F.struct(*[c.alias(n) for n, c in data.items()])))


def unquoted(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
