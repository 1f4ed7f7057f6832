"""Rules of the kind that a project keeps for itself: paths that must not be named, calls that need an argument."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.globs import star_to_regex
from tessera.operators.gates import Gates
from tessera.plans.handlers import Context, handler
from tessera.plans.rule import Card, Emit, Rule, RuleError, captured, report
from tessera.sources.tree import Node

#: What each rule looks for.
PROCESS_TOKENS = ("std::net", "process::Command", "TcpStream", "UdpSocket")
OBSERVATIONS = ("SystemTime::now", "Instant::now", "env::var", "env::vars", "env::current_dir", "rand::thread_rng", "rand::random")
TEXT_CALLS = ("open", "read_text", "write_text")


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _under_tests(path: str) -> bool:
    return path.startswith("tests/") or "/tests/" in path


def _nested(ctx: Context, site: Node) -> bool:
    """Whether a path is a part of a longer one, or of a use declaration: each place is reported once, at its outermost."""
    return any(ctx.kind(a) in ("use_declaration", "scoped_identifier") for a in ctx.ancestors(site))


def _scope(name: str, scope: list[str] | None) -> list[str]:
    if not scope:
        raise RuleError(f"local/{name} has no `scope`: name the folders that it is for")
    return scope


_PATHS = "[(use_declaration argument: (_) @path) (scoped_identifier path: (_) @path)] @site"
_CALLS = "(call_expression function: (scoped_identifier) @callee) @call"


def one_parser_per_file(allow: list[str] | None = None, suffix: str = "Parser::new") -> Rule:
    def check() -> list[Emit]:
        tests = F.exists(captured("call")["attributes"], lambda a: a.rlike("(?<![A-Za-z0-9_])test(?![A-Za-z0-9_])"))
        free = _any(F.col("file").rlike(star_to_regex(p)) for p in allow or [])
        hit = F.endswith(captured("callee")["text"], F.lit(suffix)) & ~free & ~F.coalesce(tests, F.lit(False))
        return [report(captured("call"), F.lit("this file would be parsed twice: the run has its tree already"), when=hit)]

    card = Card("own parser", "work on the tree that the run made of the file", "let p = Parser::new();", "fn check(tree: &Tree) {}")
    return Rule("local/one-parser-per-file", _CALLS, card, check, languages=("rust",), gates=Gates(file_contains=[suffix]))


def _path_rule(name: str, card: Card, said: str, hit: Callable[[str, str], str | None], gates: Gates | None = None) -> Rule:
    """A rule about outermost paths: hit(file, path's text) names what is wrong, said is the message with its place."""

    def check(ctx: Context, m: dict[str, Node]) -> None:
        found = hit(ctx.file_path, ctx.text(m["path"]))
        if found is not None and not _nested(ctx, m["site"]):
            ctx.report(m["site"], said.format(found))

    return Rule(f"local/{name}", _PATHS, card, handler(check), languages=("rust",), gates=gates or Gates())


def no_ambient_authority(allow: list[str] | None = None, tokens: tuple[str, ...] = PROCESS_TOKENS) -> Rule:
    def hit(file: str, path: str) -> str | None:
        return path if any(t in path for t in tokens) and not _under_tests(file) and file not in (allow or ()) else None

    card = Card("sockets or child processes in a library", "let the caller do it and pass the outcome in", "use std::net::TcpStream;", "fn load(fetch: impl Fn(&str) -> String) {}")
    return _path_rule("no-ambient-authority", card, "`{}` talks to something other than this program", hit)


def tracked_reads_only(scope: list[str] | None = None, allow: list[str] | None = None) -> Rule:
    scope = _scope("tracked-reads-only", scope)

    def hit(file: str, path: str) -> str | None:
        return path if "fs" in path.split("::") and file.startswith(tuple(scope)) and file not in (allow or ()) else None

    card = Card("file read behind the cache's back", "read through the context, which notes what was read", "let s = std::fs::read(p)?;", "let s = ctx.read(p)?;")
    return _path_rule("tracked-reads-only", card, "`{}` is a read that the cache does not learn of", hit, Gates(file_contains=["fs"]))


def deterministic_iteration(scope: list[str] | None = None, unordered: tuple[str, ...] = ("HashMap", "HashSet")) -> Rule:
    """Collections whose order is chance, in code whose output is compared."""
    scope = _scope("deterministic-iteration", scope)

    def check(ctx: Context, m: dict[str, Node]) -> None:
        name = next((u for u in unordered if u in ctx.text(m["path"])), None)
        if name and ctx.file_path.startswith(tuple(scope)) and not _nested(ctx, m["site"]):
            ctx.report(m["site"], f"the order of a `{name}` differs from run to run")

    query = "[(use_declaration argument: (_) @path) (scoped_identifier path: (_) @path)] @site"
    card = Card("collection without an order", "use a BTreeMap or BTreeSet, or sort before anything is written", "use std::collections::HashMap;", "use std::collections::BTreeMap;")
    return Rule("local/deterministic-iteration", query, card, handler(check), languages=("rust",), gates=Gates(file_contains=["Hash"]))


def sandbox_containment(crate: str = "wasmtime", allow: list[str] | None = None) -> Rule:
    """A crate that only the folders in `allow` may name."""

    def hit(file: str, path: str) -> str | None:
        return path if crate in path.split("::") and not file.startswith(tuple(allow or ["\0"])) else None

    card = Card("contained crate named outside its home", "go through the crate that wraps it", f"use {crate}::Engine;", "use sandbox::Runtime;")
    return _path_rule("sandbox-containment", card, "`{}` belongs to the sandbox's own crate", hit, Gates(file_contains=[crate]))


def _unquoted(text: str) -> str:
    """A Rust string literal's contents."""
    return re.sub(r'^b?r?#*"|"#*$', "", text)


def _in_test_code(ctx: Context, n: Node) -> bool:
    """Whether a function or module around a node has an attribute that says test."""
    inner = n
    for up in ctx.ancestors(n):
        kids = ctx.children(up)
        at = kids.index(inner)
        while ctx.kind(inner) in ("function_item", "mod_item") and at and ctx.kind(kids[at - 1]) == "attribute_item":
            at -= 1
            if re.search(r"(?<![A-Za-z0-9_])test(?![A-Za-z0-9_])", ctx.text(kids[at])):
                return True
        inner = up
    return False


def interface_members(text: str, interfaces: tuple[str, ...]) -> set[str]:
    """Names of the members of interfaces in a declaration file, up to each one's closing brace at a line's start."""
    out: set[str] = set()
    for name in interfaces:
        body = re.search(rf"interface {re.escape(name)}\b[^{{]*\{{(.*?)(?:\n\}}|\Z)", text, re.S)
        for line in body.group(1).split("\n") if body else ():
            member = re.match(r"\s*(?:readonly )?([A-Za-z0-9_]+)(?:\(|:|\?\()", line)
            if member:
                out.add(member.group(1))
    return out


def host_api_matches_types(host: str, types: str, interfaces: tuple[str, ...] = ("CheckContext", "ReduceContext"), besides: tuple[str, ...] = ("file",)) -> Rule:
    """What `host` registers by .set("name", ...) and what the interfaces in `types` declare are the same names."""

    def check(ctx: Context, m: dict[str, Node]) -> None:
        if ctx.file_path != host:
            return
        text = ctx.read_file(types)
        if text is None:
            ctx.report(m["root"], f"there is no `{types}` that could say what the host offers")
            return
        calls = ctx.query_subtree(m["root"], "(call_expression function: (field_expression field: (field_identifier) @method) arguments: (arguments . [(string_literal) (raw_string_literal)] @name)) @call")
        offered = {_unquoted(ctx.text(c["name"])) for c in calls if ctx.text(c["method"]) == "set" and not _in_test_code(ctx, c["call"])}
        declared = interface_members(text, interfaces)
        for name in sorted(declared - offered):
            ctx.report(m["root"], f"`{name}` is declared in {types}, and the host has none")
        for name in sorted(offered - declared - set(besides)):
            ctx.report(m["root"], f"`{name}` is offered by the host, and {types} does not say so")

    card = Card("host and its declarations differ", "change both together", 'object.set("lines", f) // declared nowhere', 'object.set("line", f) // line(n: Node): number')
    return Rule("local/host-api-matches-types", "(source_file) @root", card, handler(check), languages=("rust",), reads=(types,))


def union_members(text: str, name: str) -> set[str]:
    """The quoted members of a union type in a declaration file; the declaration ends at an empty line."""
    found = re.search(rf"export type {re.escape(name)}\b(.*?)(?:\n\n|\Z)", text, re.S)
    return set(re.findall(r"'([^']+)'", found.group(1))) if found else set()


def binding_kinds_are_typed(source: str, types: str, union: str = "BindingKind", functions: tuple[str, ...] = ("as_str", "kind_str")) -> Rule:
    """Every string that a match arm of the named functions of `source` gives is a member of a union in `types`."""

    def check(ctx: Context, m: dict[str, Node]) -> None:
        if ctx.file_path != source:
            return
        text = ctx.read_file(types)
        if text is None:
            ctx.report(m["root"], f"there is no `{types}` that could list the kinds")
            return
        known = union_members(text, union)
        for arm in ctx.query_subtree(m["root"], "(match_arm value: (string_literal) @kind) @arm"):
            within = ctx.closest_ancestor(arm["arm"], "(function_item name: (identifier) @name) @function")
            kind = _unquoted(ctx.text(arm["kind"]))
            if within and ctx.text(within["name"]) in functions and kind and kind not in known:
                ctx.report(arm["arm"], f"`{kind}` is no member of {union}, so no rule can ask for it")

    card = Card("kind that the types leave out", "add it to the union", 'Self::Param => "parm"', "Self::Param => \"param\" // export type BindingKind = 'param'")
    return Rule("local/binding-kinds-are-typed", "(source_file) @root", card, handler(check), languages=("rust",), reads=(types,))


def no_ambient_observation(scope: list[str] | None = None, allow: list[str] | None = None) -> Rule:
    scope = _scope("no-ambient-observation", scope)

    def check() -> list[Emit]:
        text = captured("callee")["text"]
        within = _any(F.startswith("file", F.lit(p)) for p in scope)
        hit = _any(F.endswith(text, F.lit(t)) for t in OBSERVATIONS) & within & ~F.col("file").isin(*(allow or [""]))
        return [report(captured("call"), F.concat(F.lit("`"), text, F.lit("` makes the result depend on when or where it is run")), when=hit)]

    card = Card("clock, environment or chance in cached code", "pass what is needed as an argument", "let t = Instant::now();", "fn run(started: Instant) {}")
    return Rule("local/no-ambient-observation", _CALLS, card, check, languages=("rust",))


def explicit_encoding() -> Rule:
    """Calls of open, read_text and write_text without encoding; open in a binary mode, by a literal, needs none."""

    def check(ctx: Context, m: dict[str, Node]) -> None:
        name = ctx.text(m["fn"])
        if name not in TEXT_CALLS:
            return
        given = {}
        plain = []
        for a in ctx.named_children(m["args"]):
            word, eq, value = ctx.text(a).partition("=")
            if ctx.kind(a) == "keyword_argument" and eq:
                given[word.strip()] = value.strip()
            else:
                plain.append(a)
        mode = given.get("mode", "")
        if len(plain) > 1 and ctx.kind(plain[1]) == "string":
            mode = ctx.text(plain[1])
        binary = name == "open" and mode[-1:] in ("'", '"') and "b" in mode.strip("rRuUbBfF").strip("'\"")
        if "encoding" not in given and not binary:
            ctx.report(m["call"], f"`{name}` takes the encoding of the machine's locale")

    card = Card("text file opened in whatever encoding the machine has", "name the encoding", "open(p)", "open(p, encoding='utf-8')")
    call = "(call function: [(identifier) @fn (attribute attribute: (identifier) @fn)] arguments: (argument_list) @args) @call"
    return Rule("local/py-explicit-encoding", call, card, handler(check), languages=("python",))


def stdout_write() -> Rule:
    def check() -> list[Emit]:
        hit = (captured("method")["text"] == "write") & (captured("obj")["text"] == "sys.stdout")
        return [report(captured("call"), F.lit("what reaches sys.stdout depends on the console's encoding"), when=hit)]

    card = Card("text written through sys.stdout", "write bytes to sys.stdout.buffer", "sys.stdout.write(s)", "sys.stdout.buffer.write(b)")
    return Rule("local/py-stdout-buffer", "(call function: (attribute object: (_) @obj attribute: (identifier) @method)) @call", card, check, languages=("python",), gates=Gates(file_contains=["sys.stdout"]))


# --- rules about rules, which are written in TypeScript -----------------------------------------------


def gates_are_and() -> Rule:
    """Content gates with two needles or more: a file must hold them all."""

    def check(ctx: Context, m: dict[str, Node]) -> None:
        key, n = ctx.text(m["key"]), len(ctx.named_children(m["list"]))
        if key in ("fileContains", "fileNotContains") and n > 1:
            ctx.report(m["pair"], f"`{key}` has {n} needles; a file that lacks any of them is passed over")

    card = Card("content gate with several needles", "keep the one needle that every wanted file holds", "gates: { fileContains: ['open', 'read'] }", "gates: { fileContains: ['open'] }")
    return Rule("local/gates-are-and", "(pair key: (property_identifier) @key value: (array) @list) @pair", card, handler(check), gates=Gates(file_contains=["Contains"]))


def rule_declares_language(definer: str = "defineRule") -> Rule:
    def check(ctx: Context, m: dict[str, Node]) -> None:
        keys = {ctx.text(ctx.field(p, "key")) for p in ctx.named_children(m["options"]) if ctx.kind(p) == "pair"}
        if ctx.text(m["callee"]) == definer and "language" not in keys:
            ctx.report(m["call"], "without `language` the rule looks at TypeScript alone")

    card = Card("rule without a language", "say which languages it is for", "defineRule({ id: 'local/x' })", "defineRule({ id: 'local/x', language: ['go'] })")
    query = "(call_expression function: (identifier) @callee arguments: (arguments (object) @options)) @call"
    return Rule("local/rule-declares-language", query, card, handler(check), gates=Gates(file_contains=[definer]))


#: What a check's context has and a reduce's has not.
TREE_API = tuple("text kind parent children namedChildren ancestors querySubtree closestAncestor line column isNamed root fileText filePath emitFact resolvesToImport isImportedFrom bindingKind isShadowed".split())


def reduce_touches_no_tree(api: tuple[str, ...] = TREE_API) -> Rule:
    def check(ctx: Context, m: dict[str, Node]) -> None:
        if ctx.text(m["name"]) != "reduce":
            return
        for use in ctx.query_subtree(m["body"], "(member_expression property: (property_identifier) @what) @use"):
            what = ctx.text(use["what"])
            if what in api and ctx.text(use["use"]).startswith("ctx."):
                ctx.report(use["use"], f"there is no tree in reduce for `ctx.{what}` to look at")

    card = Card("tree used in reduce", "emit what is needed as a fact while the tree is there", "reduce(ctx) { ctx.line(node) }", "check(ctx, m) { ctx.emitFact({ kind: 'at', line: ctx.line(m.n) }) }")
    query = "(method_definition name: (property_identifier) @name body: (statement_block) @body) @method"
    return Rule("local/reduce-touches-no-tree", query, card, handler(check), gates=Gates(file_contains=["reduce"]))


def facts_must_serialize() -> Rule:
    def check(ctx: Context, m: dict[str, Node]) -> None:
        if ctx.text(m["method"]) != "emitFact":
            return
        for pair in ctx.named_children(m["payload"]):
            value = ctx.field(pair, "value") if ctx.kind(pair) == "pair" else None
            if value is not None and ctx.kind(value) == "member_expression" and ctx.text(value).startswith("m."):
                ctx.report(pair, f"`{ctx.text(value)}` is a node, which is nothing once the file is done")

    card = Card("node within a fact", "put its text, line or column there", "ctx.emitFact({ kind: 'x', at: m.call })", "ctx.emitFact({ kind: 'x', at: ctx.line(m.call) })")
    query = "(call_expression function: (member_expression property: (property_identifier) @method) arguments: (arguments (object) @payload)) @call"
    return Rule("local/facts-must-serialize", query, card, handler(check), gates=Gates(file_contains=["emitFact"]))


def node_handle_truthiness(giving: tuple[str, ...] = ("parent",)) -> Rule:
    """A variable that holds a node, tested by `!`: the root's handle is 0."""

    def check(ctx: Context, m: dict[str, Node]) -> None:
        if "method" in m and ctx.text(m["method"]) not in giving or "property" in m and ctx.text(m["property"]) != "ctx.root":
            return
        block = ctx.closest_ancestor(m["variable"], "(statement_block) @block")
        name = ctx.text(m["name"])
        for test in ctx.query_subtree(block["block"], "(unary_expression argument: (identifier) @what) @test") if block else ():
            if ctx.text(test["what"]) == name and ctx.text(test["test"]).startswith("!"):
                ctx.report(test["test"], f"`!{name}` also holds for the root, whose handle is 0")

    card = Card("node tested by its truth", "compare with undefined", "const up = ctx.parent(n)\nif (!up) return", "const up = ctx.parent(n)\nif (up === undefined) return")
    query = """(variable_declarator name: (identifier) @name value: (call_expression function: (member_expression property: (property_identifier) @method))) @variable
        (variable_declarator name: (identifier) @name value: (member_expression) @property) @variable"""
    return Rule("local/node-handle-truthiness", query, card, handler(check), gates=Gates(file_contains=["ctx."]))


def no_eval_in_rules() -> Rule:
    def check() -> list[Emit]:
        name = captured("name")["text"]
        return [report(captured("site"), F.concat(F.lit("`"), name, F.lit("` runs code that nobody can read here")), when=name.isin("eval", "Function"))]

    card = Card("code made at run time", "write it as a function", "const f = new Function(body)", "const f = (x) => x + 1")
    return Rule("local/no-eval-in-rules", "[(call_expression function: (identifier) @name) (new_expression constructor: (identifier) @name)] @site", card, check)
