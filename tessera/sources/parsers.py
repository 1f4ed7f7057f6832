"""Parsers for the supported languages: trees, scopes and declarations of one file.

Curly-brace languages are read by tolerant parsers of this package, so that every file gives a tree; Python by
the standard library's, and a file that does not parse gives no nodes.
"""

from __future__ import annotations

import ast
import sys
from dataclasses import dataclass, field

from tessera.sources.ecma import KINDS as ECMA_KINDS
from tessera.sources.ecma import Ecma
from tessera.sources.golang import KINDS as GO_KINDS
from tessera.sources.golang import Go
from tessera.sources.rustlang import KINDS as RUST_KINDS
from tessera.sources.rustlang import Rust
from tessera.sources.tree import Node, Tree

#: Node kinds that each family of parsers produces; a query that names another is refused.
KINDS = {
    "js": ECMA_KINDS,
    "go": GO_KINDS,
    "rust": RUST_KINDS,
    "python": frozenset("module function_definition class_definition lambda block except_clause as_pattern identifier tuple list dictionary set call attribute argument_list keyword_argument string integer default_parameter typed_default_parameter parameters import_statement import_from_statement expression".split()),
}
#: Names of the fields that children stand in.
FIELDS = {
    "js": frozenset("alias alternative argument arguments body condition consequence constructor declaration finalizer function handler increment index initializer key kind label left name object operator parameter parameters pattern property return_type right source type type_arguments value".split()),
    "go": frozenset("alias alternative arguments body channel communication condition consequence element field function index initializer key label left name operand operator package parameters path receiver result right type type_parameters update value".split()),
    "rust": frozenset("alias alternative argument arguments body condition consequence element field function left list macro name operator parameters path pattern return_type right trait type type_arguments type_parameters value".split()),
    "python": frozenset("arguments attribute function name object value".split()),
}
#: Kinds that never have children.
LEAVES = frozenset("identifier property_identifier type_identifier field_identifier package_identifier shorthand_property_identifier shorthand_property_identifier_pattern shorthand_field_identifier statement_identifier primitive_type number regex this super null true false undefined string_literal raw_string_literal interpreted_string_literal rune_literal char_literal integer_literal int_literal float_literal boolean_literal self debugger_statement empty_statement label_name nil iota".split())
ROOTS = frozenset(("program", "source_file", "module"))
FAMILY = {"typescript": "js", "tsx": "js", "javascript": "js", "go": "go", "rust": "rust", "python": "python"}


#: Deep nesting is descended into; Python frames cost no C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))


@dataclass
class Parsed:
    root: Node | None
    #: (start, end, kind) in bytes; the first is the whole file.
    scopes: list[tuple[int, int, str]] = field(default_factory=list)
    #: (scope, name, kind, module, imported)
    decls: list[tuple[int, str, str, str | None, str | None]] = field(default_factory=list)


def parse(source: bytes, language: str) -> Parsed:
    if language == "python":
        return _python(source)
    p = Go(source) if language == "go" else Rust(source) if language == "rust" else Ecma(source, language != "javascript")
    p.parse()
    return Parsed(p.root, p.scopes, p.decls)


def tables(source: bytes, language: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows of nodes, scopes (scope_id, pre, post, depth, kind) and decls of a file."""
    p = parse(source, language)
    if p.root is None:
        return [], [], []
    nodes = Tree(p.root, source, p.scopes, p.decls).rows()
    starts = [(n[9], n[10], n[4]) for n in nodes]
    scopes = []
    for k, (a, b, kind) in enumerate(p.scopes):
        inside = [pre for s, e, pre in starts if a <= s and e <= b]
        depth = sum(1 for c, d, _ in p.scopes if (c, -d) < (a, -b) and d >= b)
        if inside:
            scopes.append((k, min(inside), max(inside), depth, kind))
    return nodes, scopes, p.decls


# --- Python -----------------------------------------------------------------------------------------

_LITERALS = {ast.List: "list", ast.Dict: "dictionary", ast.Set: "set", ast.Tuple: "tuple", ast.Name: "identifier", ast.Call: "call", ast.Attribute: "attribute", ast.Lambda: "lambda"}


class _Python(ast.NodeVisitor):
    def __init__(self, source: bytes):
        self.source, self.starts = source, [0]
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.out = Parsed(Node("module", 0, len(source)), [(0, len(source), "file")])
        self.parent, self.scope = self.out.root, 0
        #: What a name that is stored to is bound by.
        self.role = "assignment"
        self.globals: dict[int, set[str]] = {}

    def span(self, n: ast.AST) -> tuple[int, int]:
        return self.starts[n.lineno - 1] + n.col_offset, self.starts[n.end_lineno - 1] + n.end_col_offset

    def within(self, node: Node, parts: list) -> None:
        self.parent, kept = node, self.parent
        for p in parts:
            if isinstance(p, ast.AST):
                self.visit(p)
        self.parent = kept

    def put(self, n: ast.AST, kind: str, name: str | None = None) -> Node:
        node = Node(kind, *self.span(n), name)
        self.parent.add(node)
        return node

    def bind(self, name: str, kind: str, module: str | None = None, imported: str | None = None) -> None:
        scope = 0 if name in self.globals.get(self.scope, ()) else self.scope
        self.out.decls.append((scope, name, kind, module, imported))

    def enter(self, n: ast.AST, kind: str, work) -> None:
        kept = self.scope
        self.out.scopes.append((*self.span(n), kind))
        self.scope = len(self.out.scopes) - 1
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.globals[self.scope] = {x for s in ast.walk(n) if isinstance(s, ast.Global) for x in s.names}
        work()
        self.scope = kept

    def generic_visit(self, n: ast.AST) -> None:
        kind = _LITERALS.get(type(n))
        if kind is None and isinstance(n, ast.expr):
            kind = "string" if isinstance(n, ast.Constant) and isinstance(n.value, str) or isinstance(n, ast.JoinedStr) else "expression"
        if kind:
            self.within(self.put(n, kind), list(ast.iter_child_nodes(n)))
        else:
            for c in ast.iter_child_nodes(n):
                self.visit(c)

    def visit_Name(self, n: ast.Name) -> None:
        self.put(n, "identifier")
        if isinstance(n.ctx, ast.Store):
            self.bind(n.id, self.role)

    def visit_keyword(self, n: ast.keyword) -> None:
        self.within(self.put(n, "keyword_argument"), [n.value])

    def visit_Import(self, n: ast.Import) -> None:
        self.put(n, "import_statement")
        for a in n.names:
            self.bind(a.asname or a.name.split(".")[0], "import", a.name if a.asname else a.name.split(".")[0], "*")

    def visit_ImportFrom(self, n: ast.ImportFrom) -> None:
        self.put(n, "import_from_statement")
        for a in n.names:
            if a.name != "*":
                self.bind(a.asname or a.name, "import", "." * n.level + (n.module or ""), a.name)

    def visit_ExceptHandler(self, n: ast.ExceptHandler) -> None:
        node = self.put(n, "except_clause")
        if n.type is not None and n.name:
            at, end = self.span(n.type)
            stop = self.source.find(n.name.encode(), end) + len(n.name.encode())
            as_pattern = Node("as_pattern", at, stop)
            node.add(as_pattern)
            self.within(as_pattern, [n.type])
            self.bind(n.name, "catch-param")
        elif n.type is not None:
            self.within(node, [n.type])
        if n.body:
            body = Node("block", self.span(n.body[0])[0], self.span(n.body[-1])[1])
            node.add(body)
            self.within(body, n.body)

    def parameters(self, a: ast.arguments) -> None:
        plain = [*a.posonlyargs, *a.args]
        pairs = list(zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults, strict=True)) + list(zip(a.kwonlyargs, a.kw_defaults, strict=True))
        for arg in [*(x for x, _ in pairs), a.vararg, a.kwarg]:
            if arg is not None:
                self.bind(arg.arg, "param")
        for arg, default in pairs:
            if default is not None:
                p = Node("typed_default_parameter" if arg.annotation else "default_parameter", self.span(arg)[0], self.span(default)[1])
                self.parent.add(p.add(Node("identifier", self.span(arg)[0], self.span(arg)[0] + len(arg.arg.encode()), "name")))
                self.within(p, [default])
                p.children[-1].field = "value"

    def function(self, n: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.bind(n.name, "function")
        node = self.put(n, "function_definition")

        def work() -> None:
            self.parent, kept = node, self.parent
            self.parameters(n.args)
            self.parent = kept
            self.within(node, [*n.body])

        for d in n.decorator_list:
            self.visit(d)
        self.enter(n, "function", work)

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_Lambda(self, n: ast.Lambda) -> None:
        node = self.put(n, "lambda")

        def work() -> None:
            self.parent, kept = node, self.parent
            self.parameters(n.args)
            self.visit(n.body)
            self.parent = kept

        self.enter(n, "function", work)

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        self.bind(n.name, "class")
        node = self.put(n, "class_definition")
        for b in [*n.decorator_list, *n.bases, *n.keywords]:
            self.visit(b)
        self.enter(n, "class", lambda: self.within(node, n.body))

    def stored(self, role: str, target: ast.AST | None) -> None:
        kept, self.role = self.role, role
        if target is not None:
            self.visit(target)
        self.role = kept

    def loop(self, n: ast.For | ast.AsyncFor) -> None:
        self.stored("loop", n.target)
        for part in (n.iter, *n.body, *n.orelse):
            self.visit(part)

    visit_For = visit_AsyncFor = loop

    def visit_withitem(self, n: ast.withitem) -> None:
        self.visit(n.context_expr)
        self.stored("context-manager", n.optional_vars)

    def comprehension(self, n: ast.expr) -> None:
        node = self.put(n, "expression")

        def work() -> None:
            self.parent, kept = node, self.parent
            for g in n.generators:
                self.stored("comprehension", g.target)
                for part in (g.iter, *g.ifs):
                    self.visit(part)
            for part in (n.key, n.value) if isinstance(n, ast.DictComp) else (n.elt,):
                self.visit(part)
            self.parent = kept

        self.enter(n, "function", work)

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = comprehension

    def visit_Attribute(self, n: ast.Attribute) -> None:
        node = self.put(n, "attribute")
        self.within(node, [n.value])
        if node.children:
            node.children[-1].field = "object"
        node.add(Node("identifier", node.end - len(n.attr.encode()), node.end, "attribute"))

    def visit_Call(self, n: ast.Call) -> None:
        node = self.put(n, "call")
        self.within(node, [n.func])
        if node.children:
            node.children[-1].field = "function"
        parts = [*n.args, *n.keywords]
        spans = [self.span(p) for p in parts]
        args = Node("argument_list", min((a for a, _ in spans), default=node.end), max((b for _, b in spans), default=node.end), "arguments")
        node.add(args)
        self.within(args, parts)


def _python(source: bytes) -> Parsed:
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Parsed(None)
    v = _Python(source)
    v.visit(module)
    return v.out
