"""JavaScript and TypeScript: a tolerant recursive-descent parser.

Statements descend, expressions climb by precedence, types are skipped over with their names kept. What
cannot be read is passed over token by token, so every file gives a tree. Scopes and declarations are
noted on the way: a name belongs to the statement list, parameter list or catch clause that declares it.
"""

from __future__ import annotations

from tessera.sources.descent import Descent
from tessera.sources.lexer import substitution_end
from tessera.sources.tree import Node

#: Binding strength of binary operators.
_POWER = {b"??": 1, b"||": 2, b"&&": 3, b"|": 4, b"^": 5, b"&": 6, b"==": 7, b"!=": 7, b"===": 7, b"!==": 7, b"<": 8, b">": 8, b"<=": 8, b">=": 8, b"instanceof": 8, b"in": 8, b"<<": 9, b"+": 10, b"-": 10, b"*": 11, b"/": 11, b"%": 11, b"**": 12}
_ASSIGN = frozenset(b"= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_UNARY = frozenset(b"! ~ + - typeof void delete".split())
_WORDS = {b"this": "this", b"super": "super", b"null": "null", b"true": "true", b"false": "false", b"undefined": "undefined"}
_DECLARATIONS = frozenset(b"interface type enum namespace module declare abstract".split())
_MODIFIERS = frozenset(b"public private protected static readonly abstract override declare accessor async get set".split())
_TYPE_WORDS = frozenset(b"keyof typeof readonly unique infer asserts abstract new".split())
KINDS = frozenset(
    """program statement_block expression_statement empty_statement lexical_declaration variable_declaration variable_declarator
    function_declaration generator_function_declaration function_expression generator_function arrow_function method_definition formal_parameters
    required_parameter optional_parameter class_declaration abstract_class_declaration class class_body class_heritage public_field_definition decorator
    interface_declaration type_alias_declaration enum_declaration internal_module module ambient_declaration type_annotation type_arguments type_identifier predefined_type
    if_statement else_clause for_statement for_in_statement while_statement do_statement return_statement throw_statement try_statement catch_clause finally_clause
    switch_statement switch_body switch_case switch_default break_statement continue_statement labeled_statement debugger_statement with_statement statement_identifier
    import_statement import_clause named_imports import_specifier namespace_import export_statement export_clause export_specifier namespace_export
    call_expression new_expression member_expression subscript_expression arguments identifier property_identifier private_property_identifier shorthand_property_identifier shorthand_property_identifier_pattern
    string template_string template_substitution number regex this super null true false undefined import object pair computed_property_name array spread_element
    object_pattern array_pattern pair_pattern object_assignment_pattern assignment_pattern rest_pattern unary_expression update_expression binary_expression
    assignment_expression augmented_assignment_expression ternary_expression await_expression yield_expression parenthesized_expression sequence_expression
    as_expression satisfies_expression non_null_expression jsx_element jsx_expression""".split()
)


class Ecma(Descent):
    """One file; `typed`: TypeScript."""

    FAMILY, ROOT = "js", "program"

    def __init__(self, source: bytes, typed: bool = True, start: int = 0, stop: int | None = None):
        super().__init__(source, start, stop)
        self.typed = typed

    def parse(self) -> Ecma:
        self.statements(0, self.n, self.root)
        return self

    def bound(self, pattern: Node | None) -> list[Node]:
        """The names that a pattern binds."""
        if pattern is None:
            return []
        if pattern.kind in ("identifier", "shorthand_property_identifier_pattern"):
            return [pattern]
        if pattern.kind in ("pair_pattern", "assignment_pattern", "object_assignment_pattern"):
            want = "value" if pattern.kind == "pair_pattern" else "left"
            return [x for c in pattern.children if c.field == want for x in self.bound(c)]
        return [x for c in pattern.children if c.kind.endswith("pattern") or c.kind == "identifier" for x in self.bound(c)]

    # --- statements

    def statements(self, i: int, stop: int, parent: Node) -> None:
        while i < stop:
            i = max(self.statement(i, stop, parent), i + 1)

    def block(self, i: int, parent: Node, field: str | None = None) -> int:
        """A statement block that opens at i; without one the next statement."""
        if self.at(i) != b"{":
            before = len(parent.children)
            i = self.statement(i, self.n, parent)
            if len(parent.children) > before:
                parent.children[before].field = field
            return i
        end = self.match[i]
        node = Node("statement_block", self.t[i].start, self.t[end].end, field)
        parent.add(node)
        kept = self.inside(node.start, node.end)
        self.statements(i + 1, end, node)
        self.scope = kept
        return end + 1

    def condition(self, i: int, parent: Node, field: str = "condition") -> int:
        if self.at(i) != b"(":
            return i
        node, i = self.primary(i, self.n)
        node.field = field
        parent.add(node)
        return i

    def statement(self, i: int, stop: int, parent: Node) -> int:
        t, word = self.t[i], self.at(i)
        if t.kind == "mark":
            if word == b"{":
                return self.block(i, parent)
            if word == b";":
                parent.add(self.leaf("empty_statement", i))
                return i + 1
            if word == b"@":
                return self.decorated(i, stop, parent)
        elif t.kind == "name":
            how = getattr(self, f"on_{word.decode('ascii', 'replace')}", None)
            if how is not None and self.at(i + 1) not in (b"=>", b".", b"=", b",", b")", b":", b"?."):
                done = how(i, stop, parent)
                if done is not None:
                    return done
            if word in _DECLARATIONS and (self.kind(i + 1) in ("name", "string")) and not self.broken(i + 1):
                return self.typed_declaration(i, stop, parent)
            if self.at(i + 1) == b":" and self.kind(i) == "name":
                node = Node("labeled_statement", t.start, t.end).add(self.leaf("statement_identifier", i, "label"))
                parent.add(node)
                i = self.statement(i + 2, stop, node) if i + 2 < stop else i + 2
                return self.close(node, i)
        node = Node("expression_statement", t.start, t.end)
        value, j = self.sequence(i, stop)
        if value is None:
            return i + 1
        parent.add(node.add(value))
        return self.close(node, j)

    def decorated(self, i: int, stop: int, parent: Node) -> int:
        held = []
        while self.at(i) == b"@":
            node = self.leaf("decorator", i)
            value, j = self.unary(i + 1, stop)
            node.add(value)
            node.end = self.t[max(j, i + 1) - 1].end
            held.append(node)
            i = max(j, i + 1)
        before = len(parent.children)
        i = self.statement(i, stop, parent) if i < stop else i
        into = parent.children[before] if len(parent.children) > before else parent
        if into is not parent:
            into.start = min(into.start, held[0].start)
        into.add(*held)
        return i

    def on_import(self, i: int, stop: int, parent: Node) -> int | None:
        if self.at(i + 1) == b"(":
            return None
        node = self.leaf("import_statement", i)
        parent.add(node)
        j, clause, names = i + 1, Node("import_clause", 0, 0), []
        if self.at(j) == b"type" and self.at(j + 1) not in (b"from", b","):
            j += 1
        while j < stop and self.kind(j) != "string" and self.at(j) != b";":
            if self.at(j) == b"{":
                named = Node("named_imports", self.t[j].start, self.t[self.match[j]].end)
                named.add(*self.specifiers(j, "import_specifier"))
                clause.add(named)
                names += [(s.children[-1], self.name_of(s.children[0])) for s in named.children]
                j = self.match[j]
            elif self.at(j) == b"*" and self.kind(j + 2) == "name":
                name = self.leaf("identifier", j + 2)
                clause.add(Node("namespace_import", self.t[j].start, name.end).add(name))
                names.append((name, "*"))
                j += 2
            elif self.kind(j) == "name" and self.at(j) != b"from":
                name = self.leaf("identifier", j)
                clause.add(name)
                names.append((name, "default"))
            elif self.kind(j) != "name" and self.at(j) != b",":
                break
            j += 1
        if clause.children:
            clause.start, clause.end = clause.children[0].start, clause.children[-1].end
            node.add(clause)
        module = None
        if self.kind(j) == "string":
            node.add(self.leaf("string", j, "source"))
            module = self.t[j].text[1:-1].decode("utf-8", "replace")
            j += 1
        if module is not None:
            for name, imported in names:
                self.declare(name, "import", module, imported)
        if self.at(j) in (b"with", b"assert") and self.at(j + 1) == b"{":
            j = self.match[j + 1] + 1
        return self.close(node, j)

    def specifiers(self, i: int, kind: str) -> list[Node]:
        out, end, j = [], self.match[i], i + 1
        while j < end:
            k = j
            while k < end and self.at(k) != b",":
                k += 1
            part = [x for x in range(j, k) if self.kind(x) in ("name", "string")]
            if len(part) in (2, 4) and self.at(part[0]) == b"type" or len(part) == 3 and self.at(part[0]) == b"type" and self.at(part[1]) != b"as":
                part = part[1:]
            if part:
                of = lambda x, f: self.leaf("identifier" if self.kind(x) == "name" else "string", x, f)
                node = Node(kind, self.t[j].start, self.t[k - 1].end).add(of(part[0], "name"))
                if len(part) >= 3 and self.at(part[1]) == b"as":
                    node.add(of(part[2], "alias"))
                out.append(node)
            j = k + 1
        return out

    def on_export(self, i: int, stop: int, parent: Node) -> int | None:
        node, j = self.leaf("export_statement", i), i + 1
        if j >= stop:
            return None
        parent.add(node)
        if self.at(j) == b"type" and self.at(j + 1) in (b"{", b"*"):
            j += 1
        if self.at(j) in (b"{", b"*"):
            if self.at(j) == b"{":
                node.add(Node("export_clause", self.t[j].start, self.t[self.match[j]].end).add(*self.specifiers(j, "export_specifier")))
                j = self.match[j] + 1
            elif self.at(j + 1) == b"as":
                node.add(Node("namespace_export", self.t[j].start, self.t[min(j + 2, self.n - 1)].end).add(self.leaf("identifier", min(j + 2, self.n - 1))))
                j += 3
            else:
                j += 1
            if self.at(j) == b"from" and self.kind(j + 1) == "string":
                node.add(self.leaf("string", j + 1, "source"))
                j += 2
            return self.close(node, min(j, self.n))
        if self.at(j) == b"=":  # export = x
            value, k = self.sequence(j + 1, stop)
            node.add(value)
            return self.close(node, max(k, j + 1))
        default = self.at(j) == b"default"
        if default:
            node.add(self.leaf("default", j, named=False))
            j += 1
            if self.at(j) not in (b"function", b"class", b"async", b"abstract", b"interface", b"@") or self.at(j) == b"async" and self.at(j + 1) != b"function":
                value, k = self.assignment(j, stop)
                if value is not None:
                    value.field = "value"
                node.add(value)
                return self.close(node, max(k, j))
        before = len(node.children)
        j = self.statement(j, stop, node) if j < stop else j
        for c in node.children[before:]:
            c.field = "declaration"
        return self.close(node, j)

    def on_const(self, i: int, stop: int, parent: Node) -> int | None:
        if self.at(i + 1) == b"enum":
            return self.typed_declaration(i + 1, stop, parent)
        return self.variables(i, stop, parent)

    def on_let(self, i: int, stop: int, parent: Node) -> int | None:
        return self.variables(i, stop, parent) if self.kind(i + 1) == "name" or self.at(i + 1) in (b"{", b"[") else None

    def on_var(self, i: int, stop: int, parent: Node) -> int | None:
        return self.variables(i, stop, parent)

    def variables(self, i: int, stop: int, parent: Node, single: bool = False) -> int:
        kind = self.at(i).decode()
        node = Node("variable_declaration" if kind == "var" else "lexical_declaration", self.t[i].start, self.t[i].end)
        parent.add(node.add(self.word(i, "kind" if kind != "var" else None)))
        j = i + 1
        while j < stop:
            pattern, k = self.pattern(j, stop)
            if pattern is None:
                break
            pattern.field = "name"
            d = Node("variable_declarator", pattern.start, pattern.end).add(pattern)
            if self.at(k) == b"!":
                k += 1
            k = self.annotation(k, d)
            if self.at(k) == b"=":
                value, m = self.assignment(k + 1, stop)
                if value is not None:
                    value.field = "value"
                    d.add(value)
                k = max(m, k + 1)
            d.end = self.t[k - 1].end
            node.add(d)
            for x in self.bound(pattern):
                self.declare(x, kind)
            j = k
            if single or self.at(j) != b",":
                break
            j += 1
        return self.close(node, max(j, i + 1)) if not single else max(j, i + 1)

    def on_function(self, i: int, stop: int, parent: Node) -> int | None:
        if self.kind(i + 1) != "name" and self.at(i + 1) != b"*" and self.at(i + 1) != b"(":
            return None
        node, j = self.function(i, i, True)
        parent.add(node)
        return j

    def on_async(self, i: int, stop: int, parent: Node) -> int | None:
        if self.at(i + 1) != b"function" or self.broken(i + 1):
            return None
        node, j = self.function(i, i + 1, True)
        parent.add(node)
        return j

    def function(self, first: int, i: int, declared: bool) -> tuple[Node, int]:
        """A function whose keyword is at i; first: where it starts."""
        star = self.at(i + 1) == b"*"
        kinds = ("generator_function_declaration", "generator_function") if star else ("function_declaration", "function_expression")
        node, j = Node(kinds[not declared], self.t[first].start, self.t[i].end), i + 1 + star
        if self.kind(j) == "name":
            name = self.leaf("identifier", j, "name")
            node.add(name)
            if declared:
                self.declare(name, "function")
            j += 1
        return node, self.callable(node, j)

    def callable(self, node: Node, j: int) -> int:
        """Type parameters, parameters, result and body from token j on, into node."""
        if self.at(j) == b"<":
            j = self.angles(j) or j + 1
        kept = self.inside(node.start, node.end, "function")
        mine = self.scope
        if self.at(j) == b"(":
            j = self.parameters(j, node)
        j = self.annotation(j, node, "return_type")
        if self.at(j) == b"{":
            j = self.block(j, node, "body")
        elif self.at(j) == b";":
            j += 1
        node.end = self.t[min(j, self.n) - 1].end
        self.scopes[mine] = (node.start, node.end, "function")
        self.scope = kept
        return j

    def parameters(self, i: int, node: Node) -> int:
        """A parameter list that opens at i; names go to the present scope."""
        end = self.match[i]
        out, j = Node("formal_parameters", self.t[i].start, self.t[end].end, "parameters"), i + 1
        node.add(out)
        while j < end:
            first = j
            while self.at(j) == b"@":
                _, j = self.unary(j + 1, end)
            while self.at(j) in _MODIFIERS and self.kind(j + 1) == "name":
                j += 1
            pattern, k = self.pattern(j, end, not self.typed)
            if pattern is None:
                j = max(j, first) + 1
                continue
            if not self.typed:
                out.add(pattern)
                for x in self.bound(pattern):
                    self.declare(x, "param")
                while k < end and self.at(k) != b",":
                    k = self.match[k] + 1
                j = k + 1
                continue
            pattern.field = "pattern"
            optional = self.at(k) == b"?"
            p = Node("optional_parameter" if optional else "required_parameter", self.t[first].start, pattern.end).add(pattern)
            k = self.annotation(k + optional, p)
            if self.at(k) == b"=":
                value, m = self.assignment(k + 1, end)
                if value is not None:
                    value.field = "value"
                    p.add(value)
                k = max(m, k + 1)
            p.end = self.t[k - 1].end
            out.add(p)
            for x in self.bound(pattern):
                self.declare(x, "param")
            while k < end and self.at(k) != b",":
                k = self.match[k] + 1
            j = k + 1
        return end + 1

    def on_class(self, i: int, stop: int, parent: Node) -> int | None:
        node, j = self.klass(i, i, "class_declaration")
        parent.add(node)
        return j

    def klass(self, first: int, i: int, kind: str) -> tuple[Node, int]:
        node, j = Node(kind, self.t[first].start, self.t[i].end), i + 1
        if self.kind(j) == "name" and self.at(j) not in (b"extends", b"implements"):
            name = self.leaf("type_identifier" if self.typed else "identifier", j, "name")
            node.add(name)
            if kind != "class":
                self.declare(name, "class")
            j += 1
        if self.at(j) == b"<":
            j = self.angles(j) or j + 1
        if self.at(j) in (b"extends", b"implements"):
            heritage = self.leaf("class_heritage", j)
            while j < self.n and self.at(j) != b"{":
                if self.at(j) == b"extends":
                    value, k = self.unary(j + 1, self.n, False)
                    heritage.add(value)
                    j = max(k, j + 1)
                    if self.at(j) == b"<":
                        j = self.angles(j) or j + 1
                elif self.at(j) == b"<":
                    j = self.angles(j) or j + 1
                else:
                    j += 1
            heritage.end = self.t[min(j, self.n) - 1].end
            node.add(heritage)
        if self.at(j) == b"{":
            end = self.match[j]
            body = Node("class_body", self.t[j].start, self.t[end].end, "body")
            node.add(body)
            self.members(j + 1, end, body)
            j = end + 1
        node.end = self.t[min(j, self.n) - 1].end
        return node, j

    def members(self, i: int, end: int, body: Node) -> None:
        while i < end:
            if self.at(i) in (b";", b","):
                i += 1
                continue
            first = i
            if self.at(i) == b"static" and self.at(i + 1) == b"{":
                i = self.block(i + 1, body)
                continue
            while self.at(i) == b"@":
                d = self.leaf("decorator", i)
                value, i = self.unary(i + 1, end, False)
                d.end = self.t[i - 1].end
                body.add(d.add(value))
            while self.at(i) in _MODIFIERS and (self.kind(i + 1) in ("name", "string", "number") or self.at(i + 1) in (b"[", b"*", b"#")) and i + 1 < end:
                i += 1
            if self.at(i) == b"*":
                i += 1
            name, i = self.property_name(i)
            if name is None:
                i = max(i, first) + 1
                continue
            if self.at(i) in (b"?", b"!"):
                i += 1
            if self.at(i) in (b"(", b"<"):
                m = Node("method_definition", self.t[first].start, name.end).add(name)
                i = self.callable(m, i)
                body.add(m)
                continue
            f = Node("public_field_definition", self.t[first].start, name.end).add(name)
            i = self.annotation(i, f)
            if self.at(i) == b"=":
                value, k = self.assignment(i + 1, end)
                if value is not None:
                    value.field = "value"
                f.add(value)
                i = max(k, i + 1)
            f.end = self.t[i - 1].end
            body.add(f)

    def property_name(self, i: int) -> tuple[Node | None, int]:
        kind = self.kind(i)
        if kind == "name":
            return self.leaf("property_identifier", i, "name"), i + 1
        if kind in ("string", "number"):
            return self.leaf(kind, i, "name"), i + 1
        if self.at(i) == b"#" and self.kind(i + 1) == "name":
            return Node("private_property_identifier", self.t[i].start, self.t[i + 1].end, "name"), i + 2
        if self.at(i) == b"[":
            node = Node("computed_property_name", self.t[i].start, self.t[self.match[i]].end, "name")
            return node.add(self.sequence(i + 1, self.match[i])[0]), self.match[i] + 1
        return None, i

    def typed_declaration(self, i: int, stop: int, parent: Node) -> int:
        """interface, type, enum, namespace, module, declare and abstract class, at i."""
        word, name = self.at(i), i + 1
        if word == b"declare":
            node = self.leaf("ambient_declaration", i)
            parent.add(node)
            j = self.statement(i + 1, stop, node)
            return self.close(node, j)
        if word == b"abstract":
            if self.at(name) != b"class":
                return i + 1
            node, j = self.klass(i, name, "abstract_class_declaration")
            parent.add(node)
            return j
        kinds = {b"interface": "interface_declaration", b"type": "type_alias_declaration", b"enum": "enum_declaration", b"namespace": "internal_module", b"module": "module"}
        node = self.leaf(kinds[word], i).add(self.leaf("string" if self.kind(name) == "string" else "identifier" if word in (b"enum", b"namespace", b"module") else "type_identifier", name, "name"))
        parent.add(node)
        j = name + 1
        if word in (b"namespace", b"module"):
            while self.at(j) == b".":
                j += 2
            j = self.block(j, node, "body") if self.at(j) == b"{" else j
        elif word == b"type":
            if self.at(j) == b"<":
                j = self.angles(j) or j + 1
            j = self.type(j + 1, node) if self.at(j) == b"=" else j
        else:
            while j < stop and self.at(j) != b"{":
                j += 1
            j = self.match[j] + 1 if j < stop else j
        return self.close(node, min(j, self.n))

    def on_if(self, i: int, stop: int, parent: Node) -> int | None:
        node = self.leaf("if_statement", i)
        parent.add(node)
        j = self.block(self.condition(i + 1, node), node, "consequence")
        if self.at(j) == b"else":
            other = self.leaf("else_clause", j, "alternative")
            node.add(other)
            j = self.close(other, self.block(j + 1, other)) if j + 1 < self.n else j + 1
        return self.close(node, j) if self.at(j) != b";" else self.ended(node, j)

    def ended(self, node: Node, j: int) -> int:
        node.end = max(node.end, self.t[min(j, self.n) - 1].end)
        return j

    def on_for(self, i: int, stop: int, parent: Node) -> int | None:
        j = i + 1 + (self.at(i + 1) == b"await")
        if self.at(j) != b"(":
            return None
        end = self.match[j]
        node = Node("for_statement", self.t[i].start, self.t[end].end)
        parent.add(node)
        kept = self.inside(node.start, node.end)
        mine = self.scope
        k, depth_of = j + 1, None
        while k < end:  # which kind of loop it is
            if self.at(k) in (b"of", b"in") and self.kind(k) == "name":
                depth_of = k
                break
            if self.at(k) == b";":
                break
            k = self.match[k] + 1
        if depth_of is not None:
            node.kind, k = "for_in_statement", j + 1
            if self.at(k) in (b"const", b"let", b"var"):
                node.add(self.word(k, "kind"))
                kind, k = self.at(k).decode(), k + 1
                left, _ = self.pattern(k, depth_of)
                for x in self.bound(left):
                    self.declare(x, kind)
            else:
                left, _ = self.unary(k, depth_of)
            right, _ = self.sequence(depth_of + 1, end)
            for x, f in ((left, "left"), (right, "right")):
                if x is not None:
                    x.field = f
                    node.add(x)
        else:
            k = j + 1
            if self.at(k) in (b"const", b"let", b"var"):
                k = self.variables(k, end, node)
                node.children[-1].field = "initializer"
            else:
                value, m = self.sequence(k, end)
                if value is not None:
                    value.field = "initializer"
                    node.add(value)
                k = max(m, k) + 1
            for f in ("condition", "increment"):
                value, m = self.sequence(k, end)
                if value is not None:
                    value.field = f
                    node.add(value)
                k = max(m, k) + 1
        j = self.block(end + 1, node, "body") if end + 1 < self.n else end + 1
        self.ended(node, j)
        self.scopes[mine] = (node.start, node.end, "block")
        self.scope = kept
        return j

    def on_while(self, i: int, stop: int, parent: Node) -> int | None:
        node = self.leaf("while_statement", i)
        parent.add(node)
        return self.ended(node, self.block(self.condition(i + 1, node), node, "body"))

    def on_with(self, i: int, stop: int, parent: Node) -> int | None:
        node = self.leaf("with_statement", i)
        parent.add(node)
        return self.ended(node, self.block(self.condition(i + 1, node, "object"), node, "body"))

    def on_do(self, i: int, stop: int, parent: Node) -> int | None:
        node = self.leaf("do_statement", i)
        parent.add(node)
        j = self.block(i + 1, node, "body")
        if self.at(j) == b"while":
            j = self.condition(j + 1, node)
        return self.close(node, j)

    def on_return(self, i: int, stop: int, parent: Node, kind: str = "return_statement") -> int | None:
        node = self.leaf(kind, i)
        parent.add(node)
        j = i + 1
        if not self.broken(j) and self.at(j) not in (b";", b"}"):
            value, k = self.sequence(j, stop)
            node.add(value)
            j = max(k, j)
        return self.close(node, j)

    def on_throw(self, i: int, stop: int, parent: Node) -> int | None:
        return self.on_return(i, stop, parent, "throw_statement")

    def on_break(self, i: int, stop: int, parent: Node, kind: str = "break_statement") -> int | None:
        node, j = self.leaf(kind, i), i + 1
        if self.kind(j) == "name" and not self.broken(j):
            node.add(self.leaf("statement_identifier", j, "label"))
            j += 1
        parent.add(node)
        return self.close(node, j)

    def on_continue(self, i: int, stop: int, parent: Node) -> int | None:
        return self.on_break(i, stop, parent, "continue_statement")

    def on_debugger(self, i: int, stop: int, parent: Node) -> int | None:
        node = self.leaf("debugger_statement", i)
        parent.add(node)
        return self.close(node, i + 1)

    def on_try(self, i: int, stop: int, parent: Node) -> int | None:
        if self.at(i + 1) != b"{":
            return None
        node = self.leaf("try_statement", i)
        parent.add(node)
        j = self.block(i + 1, node, "body")
        if self.at(j) == b"catch":
            clause = self.leaf("catch_clause", j, "handler")
            node.add(clause)
            kept = self.inside(clause.start, clause.end)
            mine, j = self.scope, j + 1
            if self.at(j) == b"(":
                name, k = self.pattern(j + 1, self.match[j])
                if name is not None:
                    name.field = "parameter"
                    clause.add(name)
                    self.annotation(k, clause)
                for x in self.bound(name):
                    self.declare(x, "catch-param")
                j = self.match[j] + 1
            if self.at(j) == b"{":
                j = self.block(j, clause, "body")
            self.ended(clause, j)
            self.scopes[mine] = (clause.start, clause.end, "block")
            self.scope = kept
        if self.at(j) == b"finally":
            last = self.leaf("finally_clause", j, "finalizer")
            node.add(last)
            j = self.ended(last, self.block(j + 1, last, "body")) if j + 1 < self.n else j + 1
        return self.ended(node, j)

    def on_switch(self, i: int, stop: int, parent: Node) -> int | None:
        node = self.leaf("switch_statement", i)
        parent.add(node)
        j = self.condition(i + 1, node, "value")
        if self.at(j) != b"{":
            return self.ended(node, j)
        end = self.match[j]
        body = Node("switch_body", self.t[j].start, self.t[end].end, "body")
        node.add(body)
        j += 1
        while j < end:
            if self.at(j) not in (b"case", b"default"):
                j += 1
                continue
            case, k = self.leaf("switch_case" if self.at(j) == b"case" else "switch_default", j), j + 1
            body.add(case)
            if case.kind == "switch_case":
                value, m = self.sequence(k, end)
                if value is not None:
                    value.field = "value"
                    case.add(value)
                k = max(m, k)
            if self.at(k) == b":":
                k += 1
            while k < end and self.at(k) not in (b"case", b"default"):
                k = max(self.statement(k, end, case), k + 1)
            self.ended(case, k)
            j = k
        return self.ended(node, end + 1)

    # --- patterns

    def pattern(self, i: int, stop: int, assigned: bool = False) -> tuple[Node | None, int]:
        """A binding pattern at i; assigned: with a default."""
        word = self.at(i)
        if i >= stop:
            return None, i
        if word == b"...":
            inner, j = self.pattern(i + 1, stop)
            if inner is None:
                return None, i + 1
            return Node("rest_pattern", self.t[i].start, inner.end).add(inner), j
        if word == b"{":
            node, j = self.object_pattern(i)
        elif word == b"[":
            end, j = self.match[i], i + 1
            node = Node("array_pattern", self.t[i].start, self.t[end].end)
            while j < end:
                item, k = self.pattern(j, end, True)
                node.add(item)
                j = k
                while j < end and self.at(j) != b",":
                    j = self.match[j] + 1
                j += 1
            j = end + 1
        elif self.kind(i) == "name":
            node, j = self.leaf("this" if word == b"this" else "identifier", i), i + 1
        else:
            return None, i
        if assigned and self.at(j) == b"=":
            return self.defaulted(node, j, stop, "assignment_pattern")
        return node, j

    def defaulted(self, left: Node, j: int, stop: int, kind: str) -> tuple[Node, int]:
        value, k = self.assignment(j + 1, stop)
        left.field = "left"
        node = Node(kind, left.start, self.t[max(k, j + 1) - 1].end).add(left)
        if value is not None:
            value.field = "right"
            node.add(value)
        return node, max(k, j + 1)

    def object_pattern(self, i: int) -> tuple[Node, int]:
        end, j = self.match[i], i + 1
        node = Node("object_pattern", self.t[i].start, self.t[end].end)
        while j < end:
            if self.at(j) == b"...":
                item, j = self.pattern(j, end)
                node.add(item)
            elif self.at(j + 1) == b":" or self.at(j) == b"[" or self.kind(j) in ("string", "number"):
                key, k = self.property_name(j)
                if key is not None and self.at(k) == b":":
                    key.field = "key"
                    value, m = self.pattern(k + 1, end, True)
                    pair = Node("pair_pattern", key.start, self.t[max(m, k + 1) - 1].end).add(key)
                    if value is not None:
                        value.field = "value"
                        pair.add(value)
                    node.add(pair)
                    k = m
                j = max(k, j + 1)
            elif self.kind(j) == "name":
                item, k = self.leaf("shorthand_property_identifier_pattern", j), j + 1
                if self.at(k) == b"=":
                    item, k = self.defaulted(item, k, end, "object_assignment_pattern")
                node.add(item)
                j = k
            while j < end and self.at(j) != b",":
                j = self.match[j] + 1
            j += 1
        return node, end + 1

    # --- types

    def annotation(self, i: int, node: Node, field: str = "type") -> int:
        if self.at(i) != b":":
            return i
        out = self.leaf("type_annotation", i, field)
        node.add(out)
        j = max(self.type(i + 1, out), i + 1)
        out.end = self.t[j - 1].end
        return j

    def angles(self, i: int, into: Node | None = None) -> int | None:
        """The index after the bracket that closes the angle at i; null if it is no list of types."""
        depth, j = 0, i
        while j < self.n:
            w = self.at(j)
            if w == b"<":
                depth += 1
            elif w == b">":
                depth -= 1
                if not depth:
                    return j + 1
            elif w in (b"{", b"[", b"("):
                j = self.match[j]
            elif w in (b";", b"&&", b"||", b")", b"]", b"}") or self.kind(j) == "regex":
                return None
            elif into is not None and self.kind(j) == "name":
                into.add(self.leaf("type_identifier", j))
            j += 1
        return None

    def type(self, i: int, into: Node) -> int:
        """Pass over a type from i on; its names become type_identifier nodes of into."""
        while i < self.n:
            if self.at(i) in (b"|", b"&"):
                i += 1
            while self.at(i) in _TYPE_WORDS and (self.kind(i + 1) in ("name", "string", "template") or self.at(i + 1) in (b"(", b"[", b"{", b"<")):
                i += 1
            w, kind = self.at(i), self.kind(i)
            if w == b"-" and self.kind(i + 1) == "number":
                i += 2
            elif w == b"<" or w == b"(":
                j = (self.angles(i) or i + 1) if w == b"<" else i
                j = self.match[j] + 1 if self.at(j) == b"(" else j
                i = self.type(j + 1, into) if self.at(j) == b"=>" else j
            elif w in (b"{", b"["):
                i = self.match[i] + 1
            elif kind in ("name", "string", "number", "template"):
                if kind == "name":
                    into.add(self.leaf("type_identifier", i))
                i += 1
                if w == b"import" and self.at(i) == b"(":
                    i = self.match[i] + 1
                while self.at(i) == b"." and self.kind(i + 1) == "name":
                    into.add(self.leaf("type_identifier", i + 1))
                    i += 2
                if self.at(i) == b"<":
                    i = self.angles(i, into) or i
            else:
                return i
            while self.at(i) == b"[" and not self.broken(i):
                i = self.match[i] + 1
            if self.at(i) == b"is" and not self.broken(i):
                return self.type(i + 1, into)
            if self.at(i) == b"extends" and not self.broken(i):
                i = self.type(i + 1, into)
                if self.at(i) == b"?":
                    i = self.type(i + 1, into)
                    i = self.type(i + 1, into) if self.at(i) == b":" else i
            if self.at(i) not in (b"|", b"&"):
                return i
        return i

    # --- expressions

    def sequence(self, i: int, stop: int) -> tuple[Node | None, int]:
        left, j = self.assignment(i, stop)
        if left is None or self.at(j) != b"," or j >= stop:
            return left, j
        node = Node("sequence_expression", left.start, left.end).add(left)
        while j < stop and self.at(j) == b",":
            right, k = self.assignment(j + 1, stop)
            if right is None:
                break
            node.add(right)
            node.end, j = right.end, k
        return node, j

    def arrow(self, i: int, stop: int) -> int | None:
        """Where the arrow of an arrow function that starts at i stands; null if none does."""
        j = i
        if self.at(j) == b"async" and not self.broken(j + 1) and (self.kind(j + 1) == "name" or self.at(j + 1) in (b"(", b"<")):
            j += 1
        if self.kind(j) == "name":
            return j + 1 if self.at(j + 1) == b"=>" else None
        if self.at(j) == b"<":
            after = self.angles(j)
            if after is None:
                return None
            j = after
        if self.at(j) != b"(":
            return None
        j = self.match[j] + 1
        if self.at(j) == b"=>":
            return j
        if self.at(j) == b":":
            j = self.type(j + 1, Node("", 0, 0))
            return j if self.at(j) == b"=>" and j < stop else None
        return None

    def arrow_function(self, i: int, at: int, stop: int) -> tuple[Node, int]:
        node = Node("arrow_function", self.t[i].start, self.t[at].end)
        kept = self.inside(node.start, node.end, "function")
        mine, j = self.scope, i
        if self.at(j) == b"async" and j + 1 != at:
            node.add(self.word(j))
            j += 1
        if self.at(j) == b"<":
            j = self.angles(j) or j
        if self.at(j) == b"(":
            j = self.parameters(j, node)
            self.annotation(j, node, "return_type")
        else:
            name = self.leaf("identifier", j, "parameter")
            node.add(name)
            self.declare(name, "param")
        if self.at(at + 1) == b"{":
            j = self.block(at + 1, node, "body")
        else:
            body, k = self.assignment(at + 1, stop)
            if body is not None:
                body.field = "body"
                node.add(body)
            j = max(k, at + 1)
        self.ended(node, j)
        self.scopes[mine] = (node.start, node.end, "function")
        self.scope = kept
        return node, j

    def assignment(self, i: int, stop: int) -> tuple[Node | None, int]:
        if i >= stop:
            return None, i
        if self.kind(i) == "name" or self.at(i) in (b"(", b"<"):
            at = self.arrow(i, stop)
            if at is not None:
                return self.arrow_function(i, at, stop)
        if self.at(i) == b"yield" and self.at(i + 1) not in (b"=", b".", b"=>"):
            node, j = self.leaf("yield_expression", i), i + 1
            j += self.at(j) == b"*"
            value, k = self.assignment(j, stop) if not self.broken(j) else (None, j)
            node.add(value)
            return node, self.ended(node, max(k, j))
        if self.at(i) == b"..." and i + 1 < stop:
            value, j = self.assignment(i + 1, stop)
            node = self.leaf("spread_element", i).add(value)
            return node, self.ended(node, max(j, i + 1))
        left, j = self.binary(i, stop, 0)
        if left is None or j >= stop:
            return left, j
        if self.at(j) == b"?" and not (self.at(j + 1) in (b")", b",", b":")):
            yes, k = self.assignment(j + 1, stop)
            if self.at(k) == b":" and k < stop:
                no, m = self.assignment(k + 1, stop)
                node = Node("ternary_expression", left.start, left.end)
                for x, f in ((left, "condition"), (yes, "consequence"), (no, "alternative")):
                    if x is not None:
                        x.field = f
                        node.add(x)
                return node, self.ended(node, max(m, k + 1))
            return left, j
        if self.at(j) in _ASSIGN:
            plain = self.at(j) == b"="
            right, k = self.assignment(j + 1, stop)
            left.field = "left"
            node = Node("assignment_expression" if plain else "augmented_assignment_expression", left.start, left.end).add(left, None if plain else self.word(j, "operator"))
            if right is not None:
                right.field = "right"
                node.add(right)
            return node, self.ended(node, max(k, j + 1))
        return left, j

    def binary(self, i: int, stop: int, least: int) -> tuple[Node | None, int]:
        left, j = self.unary(i, stop)
        while left is not None and j < stop:
            word = self.at(j)
            if word in (b"as", b"satisfies") and self.kind(j) == "name" and not self.broken(j):
                node = Node(f"{word.decode()}_expression", left.start, left.end).add(left)
                j = max(self.type(j + 1, node), j + 1)
                self.ended(node, j)
                left = node
                continue
            wide = 1
            power = _POWER.get(word) if self.kind(j) in ("mark", "name") else None
            if word == b">" and self.at(j + 1) == b">" and self.t[j + 1].start == self.t[j].end:
                wide, power = 2 + (self.at(j + 2) == b">"), 9
            if power is None or power <= least and not (power == least == 12):
                break
            right, k = self.binary(j + wide, stop, power - (power == 12))
            if right is None:
                break
            left.field, right.field = "left", "right"
            left = Node("binary_expression", left.start, right.end).add(left, Node(word.decode(), self.t[j].start, self.t[j + wide - 1].end, "operator", False), right)
            j = k
        return left, j

    def unary(self, i: int, stop: int, generic: bool = True) -> tuple[Node | None, int]:
        if i >= stop:
            return None, i
        word, kind = self.at(i), self.kind(i)
        if word in _UNARY and kind in ("mark", "name"):
            value, j = self.unary(i + 1, stop)
            if value is None:
                return (self.leaf("identifier", i), i + 1) if kind == "name" else (None, i)
            value.field = "argument"
            return Node("unary_expression", self.t[i].start, value.end).add(self.word(i, "operator"), value), j
        if word in (b"++", b"--"):
            value, j = self.unary(i + 1, stop)
            if value is None:
                return None, i
            value.field = "argument"
            return Node("update_expression", self.t[i].start, value.end).add(self.word(i, "operator"), value), j
        if word == b"await" and kind == "name" and (self.kind(i + 1) not in ("mark", "") or self.at(i + 1) in (b"(", b"[", b"{", b"!")):
            value, j = self.unary(i + 1, stop)
            if value is not None:
                return Node("await_expression", self.t[i].start, value.end).add(value), j
        left, j = self.primary(i, stop)
        return self.suffixes(left, j, stop, generic)

    def suffixes(self, left: Node | None, j: int, stop: int, generic: bool = True, call: bool = True) -> tuple[Node | None, int]:
        while left is not None and j < stop:
            word = self.at(j)
            if word in (b".", b"?.") and (self.kind(j + 1) == "name" or self.at(j + 1) == b"#"):
                hidden = self.at(j + 1) == b"#"
                name = Node("private_property_identifier", self.t[j + 1].start, self.t[min(j + 2, self.n - 1)].end, "property") if hidden else self.leaf("property_identifier", j + 1, "property")
                left.field = "object"
                left = Node("member_expression", left.start, name.end).add(left, name)
                j += 2 + hidden
            elif word == b"[" or word == b"?." and self.at(j + 1) == b"[":
                j += word == b"?."
                index, _ = self.sequence(j + 1, self.match[j])
                left.field = "object"
                node = Node("subscript_expression", left.start, self.t[self.match[j]].end).add(left)
                if index is not None:
                    index.field = "index"
                    node.add(index)
                left, j = node, self.match[j] + 1
            elif call and (word == b"(" or word == b"?." and self.at(j + 1) == b"("):
                j += word == b"?."
                left, j = self.called(left, j)
            elif generic and call and word == b"<" and left.kind in ("identifier", "member_expression") and self.t[j].start == left.end:
                after = self.angles(j)
                if after is None or self.at(after) != b"(":
                    return left, j
                held = Node("type_arguments", self.t[j].start, self.t[after - 1].end, "type_arguments")
                self.angles(j, held)
                left, j = self.called(left, after)
                left.add(held)
            elif call and self.kind(j) == "template":
                left.field = "function"
                left = Node("call_expression", left.start, self.t[j].end).add(left, self.template(j, "arguments"))
                j += 1
            elif word == b"!" and not self.broken(j) and self.t[j].start == left.end:
                left = Node("non_null_expression", left.start, self.t[j].end).add(left)
                j += 1
            elif word in (b"++", b"--") and not self.broken(j):
                left.field = "argument"
                left = Node("update_expression", left.start, self.t[j].end).add(left, self.word(j, "operator"))
                j += 1
            else:
                break
        return left, j

    def called(self, left: Node, j: int) -> tuple[Node, int]:
        left.field = "function"
        args, after = self.arguments(j)
        return Node("call_expression", left.start, args.end).add(left, args), after

    def arguments(self, i: int) -> tuple[Node, int]:
        end, j = self.match[i], i + 1
        node = Node("arguments", self.t[i].start, self.t[end].end, "arguments")
        while j < end:
            value, k = self.assignment(j, end)
            node.add(value)
            j = max(k, j)
            if j < end and self.at(j) != b",":
                j = self.match[j] + 1
                continue
            j += 1
        return node, end + 1

    def template(self, i: int, field: str | None = None) -> Node:
        t = self.t[i]
        node, text, k = self.leaf("template_string", i, field), t.text, 1
        while k < len(text):
            if text[k : k + 1] == b"\\":
                k += 2
            elif text[k : k + 2] == b"${":
                end = substitution_end(text, k + 2)
                inner = Ecma(self.source, self.typed, t.start + k + 2, t.start + end)
                inner.scopes, inner.decls, inner.scope = self.scopes, self.decls, self.scope
                value, _ = inner.sequence(0, inner.n)
                node.add(Node("template_substitution", t.start + k, t.start + min(end + 1, len(text))).add(value))
                k = end + 1
            else:
                k += 1
        return node

    def primary(self, i: int, stop: int) -> tuple[Node | None, int]:
        t, word = self.t[i], self.at(i)
        if t.kind in ("string", "number", "regex"):
            return self.leaf(t.kind, i), i + 1
        if t.kind == "template":
            return self.template(i), i + 1
        if t.kind == "name":
            if word in _WORDS:
                return self.leaf(_WORDS[word], i), i + 1
            if word == b"function":
                return self.function(i, i, False)
            if word == b"async" and self.at(i + 1) == b"function" and not self.broken(i + 1):
                return self.function(i, i + 1, False)
            if word == b"class":
                return self.klass(i, i, "class")
            if word == b"new":
                return self.new(i, stop)
            if word == b"import":
                return self.leaf("import", i), i + 1
            return self.leaf("identifier", i), i + 1
        if word == b"(":
            end = self.match[i]
            inner, _ = self.sequence(i + 1, end)
            return Node("parenthesized_expression", t.start, self.t[end].end).add(inner), end + 1
        if word == b"[":
            args, j = self.arguments(i)
            args.kind, args.field = "array", None
            return args, j
        if word == b"{":
            return self.object(i)
        if word == b"#" and self.kind(i + 1) == "name":
            return Node("private_property_identifier", t.start, self.t[i + 1].end), i + 2
        if word == b"<":
            return self.angled(i, stop)
        return None, i

    def new(self, i: int, stop: int) -> tuple[Node, int]:
        node = self.leaf("new_expression", i)
        if self.at(i + 1) == b"." and self.kind(i + 2) == "name":  # new.target
            return Node("member_expression", self.t[i].start, self.t[i + 2].end).add(self.leaf("property_identifier", i + 2, "property")), i + 3
        target, j = self.primary(i + 1, stop) if i + 1 < stop else (None, i + 1)
        target, j = self.suffixes(target, j, stop, False, False)
        if target is not None:
            target.field = "constructor"
            node.add(target)
        if self.at(j) == b"<":
            j = self.angles(j) or j
        if self.at(j) == b"(" and j < stop:
            args, j = self.arguments(j)
            node.add(args)
        return node, self.ended(node, max(j, i + 1))

    def object(self, i: int) -> tuple[Node, int]:
        end, j = self.match[i], i + 1
        node = Node("object", self.t[i].start, self.t[end].end)
        while j < end:
            first = j
            if self.at(j) == b",":
                j += 1
                continue
            if self.at(j) == b"...":
                value, j = self.assignment(j, end)
                node.add(value)
                j = max(j, first + 1)
                continue
            while self.at(j) in (b"async", b"get", b"set", b"*") and (self.kind(j + 1) in ("name", "string", "number") or self.at(j + 1) in (b"[", b"*", b"#")):
                j += 1
            if self.at(j) == b"*":
                j += 1
            name, k = self.property_name(j)
            if name is None:
                j = self.match[j] + 1
                continue
            if self.at(k) in (b"(", b"<"):
                m = Node("method_definition", self.t[first].start, name.end).add(name)
                j = self.callable(m, k)
                node.add(m)
            elif self.at(k) == b":":
                name.field = "key"
                value, m = self.assignment(k + 1, end)
                pair = Node("pair", name.start, self.t[max(m, k + 1) - 1].end).add(name)
                if value is not None:
                    value.field = "value"
                    pair.add(value)
                node.add(pair)
                j = max(m, k + 1)
            else:
                name.kind, name.field = "shorthand_property_identifier", None
                if self.at(k) == b"=":  # a pattern that is written as an object
                    name, k = self.defaulted(name, k, end, "object_assignment_pattern")
                node.add(name)
                j = k
            while j < end and self.at(j) != b",":
                j = self.match[j] + 1
        return node, end + 1

    def angled(self, i: int, stop: int) -> tuple[Node | None, int]:
        """JSX, or a type assertion: <T>x."""
        if self.kind(i + 1) == "name" or self.at(i + 1) in (b">",):
            element, j = self.jsx(i, stop)
            if element is not None:
                return element, j
        after = self.angles(i)
        if after is None:
            return None, i
        return self.unary(after, stop)

    def jsx(self, i: int, stop: int) -> tuple[Node | None, int]:
        """An element whose tags balance; expressions in braces are read, text is passed over."""
        node, depth, j = self.leaf("jsx_element", i), 0, i
        while j < stop:
            if self.at(j) == b"<":
                closing = self.at(j + 1) == b"/"
                k = j + 1
                while k < stop and self.at(k) != b">":
                    if self.at(k) == b"{":
                        node.add(self.braces(k))
                        k = self.match[k]
                    elif self.at(k) in (b";", b"<"):
                        return None, i
                    k += 1
                if k >= stop:
                    return None, i
                depth += -1 if closing else 0 if self.at(k - 1) == b"/" else 1
                j = k + 1
                if depth <= 0:
                    node.end = self.t[k].end
                    return node, j
            elif self.at(j) == b"{":
                node.add(self.braces(j))
                j = self.match[j] + 1
            else:
                j += 1
        return None, i

    def braces(self, i: int) -> Node:
        node = Node("jsx_expression", self.t[i].start, self.t[self.match[i]].end)
        return node.add(self.sequence(i + 1, self.match[i])[0])
