"""Go: a tolerant recursive-descent parser, with scopes and declarations."""

from __future__ import annotations

from tessera.sources.descent import Descent
from tessera.sources.tree import Node

_POWER = {b"||": 1, b"&&": 2, b"==": 3, b"!=": 3, b"<": 3, b"<=": 3, b">": 3, b">=": 3, b"+": 4, b"-": 4, b"|": 4, b"^": 4, b"*": 5, b"/": 5, b"%": 5, b"<<": 5, b">>": 5, b"&": 5, b"&^": 5}
_ASSIGN = frozenset(b"= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_UNARY = frozenset(b"+ - ! ^ * & <-".split())
_LITERALS = {b"nil": "nil", b"true": "true", b"false": "false", b"iota": "iota"}
KINDS = frozenset(
    """source_file package_clause import_declaration import_spec interpreted_string_literal raw_string_literal rune_literal int_literal package_identifier dot blank_identifier
    var_declaration var_spec const_declaration const_spec type_declaration type_spec type_alias type_parameter_list type_parameter_declaration
    function_declaration method_declaration func_literal parameter_list parameter_declaration variadic_parameter_declaration block
    identifier field_identifier type_identifier label_name struct_type field_declaration_list field_declaration interface_type method_elem qualified_type pointer_type array_type slice_type map_type channel_type function_type generic_type
    short_var_declaration assignment_statement expression_statement if_statement for_statement for_clause range_clause expression_switch_statement type_switch_statement select_statement
    expression_case type_case default_case communication_case return_statement go_statement defer_statement break_statement continue_statement goto_statement fallthrough_statement labeled_statement send_statement inc_statement dec_statement
    selector_expression call_expression argument_list index_expression slice_expression type_assertion_expression composite_literal literal_value keyed_element literal_element unary_expression binary_expression parenthesized_expression expression_list nil true false iota""".split()
)


class Go(Descent):
    FAMILY, ROOT = "go", "source_file"

    def parse(self) -> Go:
        i = 0
        while i < self.n:
            i = max(self.top(i), i + 1)
        return self

    # --- declarations

    def top(self, i: int) -> int:
        word = self.at(i)
        if word == b"package" and self.kind(i + 1) == "name":
            self.root.add(Node("package_clause", self.t[i].start, self.t[i + 1].end).add(self.leaf("package_identifier", i + 1)))
            return i + 2
        if word == b"import":
            return self.imports(i)
        if word == b"func" and self.kind(i + 1) in ("name", "mark"):
            return self.function(i)
        if word in (b"var", b"const", b"type"):
            return self.declaration(i, self.n, self.root)
        return self.match[i] + 1

    def imports(self, i: int) -> int:
        grouped = self.at(i + 1) == b"("
        end = self.match[i + 1] if grouped else next((k for k in range(i + 1, min(i + 4, self.n)) if self.kind(k) == "string"), i)
        node = Node("import_declaration", self.t[i].start, self.t[end].end)
        self.root.add(node)
        for k in range(i + 1, end + 1):
            if self.kind(k) != "string":
                continue
            alias = k - 1 if self.kind(k - 1) == "name" and k - 1 > i and not self.broken(k) or self.at(k - 1) == b"." else None
            path = self.leaf("raw_string_literal" if self.at(k)[:1] == b"`" else "interpreted_string_literal", k, "path")
            spec = Node("import_spec", self.t[k if alias is None else alias].start, path.end)
            module = self.t[k].text[1:-1].decode("utf-8", "replace")
            if alias is None:
                self.decls.append((self.scope, module.rpartition("/")[2], "import", module, "*"))
            else:
                kind = {b".": "dot", b"_": "blank_identifier"}.get(self.at(alias), "package_identifier")
                name = self.leaf(kind, alias, "name")
                spec.add(name)
                if kind == "package_identifier":
                    self.declare(name, "import", module, "*")
            node.add(spec.add(path))
        return end + 1

    def declaration(self, i: int, stop: int, parent: Node) -> int:
        """var, const or type, one or a group of them."""
        word = self.at(i).decode()
        node = self.leaf(f"{word}_declaration", i)
        parent.add(node)
        spec = self.type_spec if word == "type" else self.value_spec
        if self.at(i + 1) == b"(":
            end, j = self.match[i + 1], i + 2
            while j < end:
                j = max(spec(j, end, node, word), j + 1)
            node.end = self.t[end].end
            return end + 1
        j = spec(i + 1, stop, node, word)
        node.end = self.t[max(j, i + 1) - 1].end
        return max(j, i + 1)

    def value_spec(self, i: int, stop: int, parent: Node, word: str) -> int:
        node, j = Node(f"{word}_spec", self.t[i].start if i < self.n else 0, self.t[min(i, self.n - 1)].end), i
        while j < stop and self.kind(j) == "name":
            node.add(self.leaf("identifier", j, "name"))
            j += 1
            if self.at(j) != b",":
                break
            j += 1
        if not node.children:
            return i
        names = list(node.children)
        if j < stop and self.at(j) != b"=" and not self.broken(j) and self.at(j) not in (b";", b")"):
            t, j = self.type(j, stop)
            self.put(node, t, "type")
        if self.at(j) == b"=" and j < stop:
            value, j = self.expressions(j + 1, stop)
            self.put(node, value, "value")
        for x in names:
            self.bind(x, word)
        node.end = self.t[j - 1].end
        parent.add(node)
        return j

    def type_spec(self, i: int, stop: int, parent: Node, word: str) -> int:
        if self.kind(i) != "name" or i >= stop:
            return i
        node, j = Node("type_spec", self.t[i].start, self.t[i].end).add(self.leaf("type_identifier", i, "name")), i + 1
        parent.add(node)
        self.bind(node.children[0], "type")
        kept = self.inside(node.start, node.end)
        mine = self.scope
        if self.at(j) == b"[" and self.kind(j + 1) == "name" and self.match[j] > j + 2 and self.at(j + 2) not in (b"]",):
            j = self.parameters(j, node, "type_parameters", "type-param")
        if self.at(j) == b"=":
            node.kind = "type_alias"
            j += 1
        t, j = self.type(j, stop) if j < stop and not self.broken(j) else (None, j)
        self.put(node, t, "type")
        node.end = self.t[j - 1].end
        self.scopes[mine] = (node.start, node.end, "block")
        self.scope = kept
        return j

    def bind(self, n: Node, kind: str) -> None:
        if self.name_of(n) != "_":
            self.declare(n, kind)

    def put(self, node: Node, child: Node | None, field: str) -> None:
        if child is not None:
            child.field = field
            node.add(child)

    def function(self, i: int) -> int:
        method = self.at(i + 1) == b"("
        node, j = self.leaf("method_declaration" if method else "function_declaration", i), i + 1
        self.root.add(node)
        at = self.match[j] + 1 if method else j
        if self.kind(at) == "name":
            name = self.leaf("field_identifier" if method else "identifier", at, "name")
            node.add(name)
            # a method's name is one of the package's, as the others are
            self.bind(name, "function")
        kept = self.inside(node.start, node.end, "function")
        mine = self.scope
        if method:
            self.parameters(j, node, "receiver", "receiver")
        j = self.signature(at + (self.kind(at) == "name"), node)
        if self.at(j) == b"{" and not self.broken(j):
            j = self.block(j, node, "body")
        node.end = self.t[min(j, self.n) - 1].end
        self.scopes[mine] = (node.start, node.end, "function")
        self.scope = kept
        return j

    def signature(self, j: int, node: Node) -> int:
        if self.at(j) == b"[":
            j = self.parameters(j, node, "type_parameters", "type-param")
        if self.at(j) == b"(":
            j = self.parameters(j, node, "parameters", "param")
        if j < self.n and not self.broken(j):
            if self.at(j) == b"(":
                j = self.parameters(j, node, "result", "param")
            elif self.at(j) not in (b"{", b",", b")", b"}", b"]", b"=", b":=", b";", b":"):
                t, j = self.type(j, self.n)
                self.put(node, t, "result")
        return j

    def parameters(self, i: int, node: Node, field: str, kind: str) -> int:
        """A list of parameters between brackets that open at i. Names count if any parameter has both name and type."""
        end = self.match[i]
        out = Node("type_parameter_list" if kind == "type-param" else "parameter_list", self.t[i].start, self.t[end].end, field)
        node.add(out)
        parts, j = [], i + 1
        while j < end:
            k = j
            while k < end and self.at(k) != b",":
                k = self.match[k] + 1
            if k > j:
                parts.append((j, k))
            j = k + 1
        named = any(self.kind(a) == "name" and b - a > 1 and self.at(a + 1) not in (b".", b"[") or self.kind(a) == "name" and self.at(a + 1) == b"[" and self.match[a + 1] + 1 < b for a, b in parts)
        names: list[Node] = []
        first = None
        for a, b in parts:
            first = a if first is None else first
            if named and self.kind(a) == "name":
                names.append(self.leaf("identifier", a, "name"))
                a += 1
                if a == b:
                    continue
            variadic = self.at(a) == b"..."
            made = "type_parameter_declaration" if kind == "type-param" else "variadic_parameter_declaration" if variadic else "parameter_declaration"
            p = Node(made, self.t[first].start, self.t[b - 1].end).add(*names)
            t, _ = self.type(a + variadic, b)
            self.put(p, t, "type")
            out.add(p)
            for x in names:
                self.bind(x, kind)
            names, first = [], None
        for x in names:
            out.add(x)
        return end + 1

    # --- types

    def type(self, i: int, stop: int) -> tuple[Node | None, int]:
        if i >= stop:
            return None, i
        word, t = self.at(i), self.t[i]
        if word == b"(":
            inner, _ = self.type(i + 1, self.match[i])
            return inner, self.match[i] + 1
        if word in (b"*", b"~"):
            inner, j = self.type(i + 1, stop)
            node = Node("pointer_type", t.start, self.t[max(j, i + 1) - 1].end)
            return node.add(inner), j
        if word == b"[":
            inner, j = self.type(self.match[i] + 1, stop)
            node = Node("slice_type" if self.match[i] == i + 1 else "array_type", t.start, self.t[max(j, i + 1) - 1].end)
            self.put(node, inner, "element")
            return node, j
        if word == b"map" and self.at(i + 1) == b"[":
            key, _ = self.type(i + 2, self.match[i + 1])
            value, j = self.type(self.match[i + 1] + 1, stop)
            node = Node("map_type", t.start, self.t[j - 1].end)
            self.put(node, key, "key")
            self.put(node, value, "value")
            return node, j
        if word in (b"chan", b"<-"):
            j = i + 1
            while self.at(j) in (b"chan", b"<-"):
                j += 1
            inner, j = self.type(j, stop)
            node = Node("channel_type", t.start, self.t[j - 1].end)
            self.put(node, inner, "value")
            return node, j
        if word == b"func":
            node = self.leaf("function_type", i)
            kept = self.inside(t.start, t.end, "function")  # parameters of a type are seen nowhere
            j = self.signature(i + 1, node)
            self.scope = kept
            node.end = self.t[j - 1].end
            return node, j
        if word == b"struct" and self.at(i + 1) == b"{":
            return self.struct(i)
        if word == b"interface" and self.at(i + 1) == b"{":
            return Node("interface_type", t.start, self.t[self.match[i + 1]].end), self.match[i + 1] + 1
        if t.kind != "name":
            return None, i
        if self.at(i + 1) == b"." and self.kind(i + 2) == "name":
            node, j = Node("qualified_type", t.start, self.t[i + 2].end).add(self.leaf("package_identifier", i, "package"), self.leaf("type_identifier", i + 2, "name")), i + 3
        else:
            node, j = self.leaf("type_identifier", i), i + 1
        if self.at(j) == b"[" and j < stop and self.t[j].start == self.t[j - 1].end and self.match[j] > j + 1:
            held = Node("generic_type", t.start, self.t[self.match[j]].end)
            self.put(held, node, "type")
            k = j + 1
            while k < self.match[j]:
                inner, m = self.type(k, self.match[j])
                held.add(inner)
                k = max(m, k) + 1
            return held, self.match[j] + 1
        while self.at(j) == b"|" and j < stop:  # a union of constraints
            _, j = self.type(j + 1, stop)
        return node, j

    def struct(self, i: int) -> tuple[Node, int]:
        end, j = self.match[i + 1], i + 2
        body = Node("field_declaration_list", self.t[i + 1].start, self.t[end].end)
        while j < end:
            if self.at(j) == b";":
                j += 1
                continue
            k = j
            while k < end and self.at(k) != b";" and (k == j or not self.broken(k)):
                k = self.match[k] + 1
            self.field(j, min(k, end), body)
            j = max(k, j + 1)
        return Node("struct_type", self.t[i].start, self.t[end].end).add(body), end + 1

    def field(self, i: int, stop: int, body: Node) -> None:
        last = stop - 1 if self.kind(stop - 1) != "string" else stop - 2
        node, j = Node("field_declaration", self.t[i].start, self.t[stop - 1].end), i
        while j < last and self.kind(j) == "name" and (self.at(j + 1) == b"," or self.at(j + 1) != b"."):
            node.add(self.leaf("field_identifier", j, "name"))
            j += 2 if self.at(j + 1) == b"," else 1
            if self.at(j - 1) != b",":
                break
        t, _ = self.type(j, last + 1)
        self.put(node, t, "type")
        body.add(node)

    # --- statements

    def block(self, i: int, parent: Node, field: str | None = None) -> int:
        end = self.match[i]
        node = Node("block", self.t[i].start, self.t[end].end, field)
        parent.add(node)
        kept = self.inside(node.start, node.end)
        self.statements(i + 1, end, node)
        self.scope = kept
        return end + 1

    def statements(self, i: int, stop: int, parent: Node) -> None:
        while i < stop:
            i = max(self.statement(i, stop, parent), i + 1)

    def statement(self, i: int, stop: int, parent: Node) -> int:
        word = self.at(i)
        if word == b";":
            return i + 1
        if word == b"{":
            return self.block(i, parent)
        if self.kind(i) == "name":
            if word in (b"var", b"const", b"type"):
                return self.declaration(i, stop, parent)
            if word in (b"if", b"for", b"switch", b"select"):
                return getattr(self, f"{word.decode()}_")(i, stop, parent)
            if word in (b"return", b"go", b"defer"):
                node, j = self.leaf(f"{word.decode()}_statement", i), i + 1
                if j < stop and not self.broken(j) and self.at(j) not in (b";", b"}"):
                    value, j = self.expressions(j, stop)
                    node.add(value)
                node.end = self.t[max(j, i + 1) - 1].end
                parent.add(node)
                return max(j, i + 1)
            if word in (b"break", b"continue", b"goto", b"fallthrough"):
                node, j = self.leaf(f"{word.decode()}_statement", i), i + 1
                if self.kind(j) == "name" and not self.broken(j) and j < stop:
                    node.add(self.leaf("label_name", j))
                    j += 1
                node.end = self.t[j - 1].end
                parent.add(node)
                return j
            if self.at(i + 1) == b":" and i + 1 < stop:
                node = Node("labeled_statement", self.t[i].start, self.t[i + 1].end).add(self.leaf("label_name", i, "label"))
                parent.add(node)
                j = self.statement(i + 2, stop, node) if i + 2 < stop else i + 2
                node.end = self.t[max(j, i + 2) - 1].end
                return j
        node, j = self.simple(i, stop)
        parent.add(node)
        return j

    def simple(self, i: int, stop: int, header: bool = False, kind: str = "var") -> tuple[Node | None, int]:
        """An expression, assignment, short declaration, send or increment."""
        left, j = self.expressions(i, stop, header)
        if left is None:
            return None, i
        word = self.at(j) if j < stop else b""
        if word == b":=" or word in _ASSIGN:
            node = Node("short_var_declaration" if word == b":=" else "assignment_statement", left.start, left.end)
            self.put(node, left, "left")
            if self.at(j + 1) == b"range":
                return node, j
            right, k = self.expressions(j + 1, stop, header)
            self.put(node, right, "right")
            if word == b":=":
                for x in left.children:
                    if x.kind == "identifier":
                        self.bind(x, kind)
            node.end = self.t[max(k, j + 1) - 1].end
            return node, max(k, j + 1)
        if word in (b"++", b"--") and not self.broken(j):
            return Node("inc_statement" if word == b"++" else "dec_statement", left.start, self.t[j].end).add(*left.children), j + 1
        if word == b"<-":
            right, k = self.expression(j + 1, stop, 0, header)
            node = Node("send_statement", left.start, self.t[max(k, j + 1) - 1].end)
            self.put(node, left, "channel")
            self.put(node, right, "value")
            return node, max(k, j + 1)
        return Node("expression_statement", left.start, left.end).add(*left.children), j

    def scoped(self, node: Node, i: int, work) -> int:
        """work() in a scope that is the node's own."""
        kept = self.inside(node.start, node.end)
        mine = self.scope
        j = work()
        node.end = max(node.end, self.t[min(max(j, i + 1), self.n) - 1].end)
        self.scopes[mine] = (node.start, node.end, "block")
        self.scope = kept
        return j

    def opening(self, i: int, stop: int) -> int:
        """Where the block of a header that starts at i opens."""
        while i < stop and self.at(i) != b"{":
            if self.at(i) in (b"func", b"struct", b"interface"):  # braces of its own
                while i < stop and self.at(i) != b"{":
                    i = self.match[i] + 1
                i = self.match[i] if i < stop else i
            i = self.match[i] + 1 if i < stop else i
        return i

    def semicolons(self, i: int, stop: int) -> list[int]:
        out = []
        while i < stop:
            if self.at(i) == b";":
                out.append(i)
            i = self.match[i] + 1
        return out

    def if_(self, i: int, stop: int, parent: Node) -> int:
        node = self.leaf("if_statement", i)
        parent.add(node)

        def work() -> int:
            body = self.opening(i + 1, stop)
            cut = self.semicolons(i + 1, body)
            if cut:
                init, _ = self.simple(i + 1, cut[0], True)
                self.put(node, init, "initializer")
            value, _ = self.expression(cut[0] + 1 if cut else i + 1, body, 0, True)
            self.put(node, value, "condition")
            if body >= stop:
                return body
            j = self.block(body, node, "consequence")
            if self.at(j) == b"else" and j + 1 < stop:
                before = len(node.children)
                j = self.if_(j + 1, stop, node) if self.at(j + 1) == b"if" else self.block(j + 1, node) if self.at(j + 1) == b"{" else j + 1
                for c in node.children[before:]:
                    c.field = "alternative"
            return j

        return self.scoped(node, i, work)

    def for_(self, i: int, stop: int, parent: Node) -> int:
        node = self.leaf("for_statement", i)
        parent.add(node)

        def work() -> int:
            body = self.opening(i + 1, stop)
            ranged = next((k for k in range(i + 1, body) if self.at(k) == b"range" and self.kind(k) == "name"), None)
            if ranged is not None:
                clause = Node("range_clause", self.t[i + 1].start, self.t[body - 1].end)
                if self.at(ranged - 1) in (b":=", b"="):
                    left, _ = self.expressions(i + 1, ranged - 1, True)
                    self.put(clause, left, "left")
                    if self.at(ranged - 1) == b":=" and left is not None:
                        for x in left.children:
                            if x.kind == "identifier":
                                self.bind(x, "loop")
                right, _ = self.expression(ranged + 1, body, 0, True)
                self.put(clause, right, "right")
                node.add(clause)
            elif cut := self.semicolons(i + 1, body):
                clause = Node("for_clause", self.t[i + 1].start, self.t[body - 1].end)
                init, _ = self.simple(i + 1, cut[0], True)
                value, _ = self.expression(cut[0] + 1, cut[1] if len(cut) > 1 else body, 0, True)
                step, _ = self.simple(cut[1] + 1, body, True) if len(cut) > 1 else (None, 0)
                for x, f in ((init, "initializer"), (value, "condition"), (step, "update")):
                    self.put(clause, x, f)
                node.add(clause)
            elif body > i + 1:
                value, _ = self.expression(i + 1, body, 0, True)
                node.add(value)
            return self.block(body, node, "body") if body < stop else body

        return self.scoped(node, i, work)

    def switch_(self, i: int, stop: int, parent: Node) -> int:
        node = self.leaf("expression_switch_statement", i)
        parent.add(node)

        def work() -> int:
            body = self.opening(i + 1, stop)
            cut = self.semicolons(i + 1, body)
            a = i + 1
            if cut:
                init, _ = self.simple(a, cut[0], True)
                self.put(node, init, "initializer")
                a = cut[0] + 1
            of_types = body - 5 >= a and [self.at(k) for k in range(body - 4, body)] == [b".", b"(", b"type", b")"]
            if of_types:
                node.kind = "type_switch_statement"
                if self.at(a + 1) == b":=":
                    alias = Node("expression_list", self.t[a].start, self.t[a].end).add(self.leaf("identifier", a))
                    self.put(node, alias, "alias")
                    self.bind(alias.children[0], "var")
                    a += 2
                value, _ = self.expression(a, body - 4, 0, True)
            else:
                value, _ = self.expression(a, body, 0, True) if a < body else (None, a)
            self.put(node, value, "value")
            return self.cases(body, node, "type_case" if of_types else "expression_case") if body < stop else body

        return self.scoped(node, i, work)

    def select_(self, i: int, stop: int, parent: Node) -> int:
        node = self.leaf("select_statement", i)
        parent.add(node)
        return self.scoped(node, i, lambda: self.cases(i + 1, node, "communication_case") if self.at(i + 1) == b"{" else i + 1)

    def cases(self, i: int, node: Node, kind: str) -> int:
        end, j = self.match[i], i + 1
        while j < end:
            if self.at(j) not in (b"case", b"default"):
                j = self.match[j] + 1
                continue
            stop = j + 1
            while stop < end and self.at(stop) not in (b"case", b"default"):
                stop = self.match[stop] + 1
            case = Node("default_case" if self.at(j) == b"default" else kind, self.t[j].start, self.t[stop - 1].end)
            node.add(case)
            kept = self.inside(case.start, case.end)
            colon = j + 1
            while colon < stop and self.at(colon) != b":":
                colon = self.match[colon] + 1
            if case.kind == "communication_case":
                value, _ = self.simple(j + 1, colon, True)
                self.put(case, value, "communication")
            elif case.kind == "expression_case":
                value, _ = self.expressions(j + 1, colon, True)
                self.put(case, value, "value")
            elif case.kind == "type_case":
                k = j + 1
                while k < colon:
                    t, m = self.type(k, colon)
                    self.put(case, t, "type")
                    k = max(m, k) + 1
            self.statements(colon + 1, stop, case)
            self.scope = kept
            j = stop
        return end + 1

    # --- expressions

    def expressions(self, i: int, stop: int, header: bool = False) -> tuple[Node | None, int]:
        value, j = self.expression(i, stop, 0, header)
        if value is None:
            return None, i
        node = Node("expression_list", value.start, value.end).add(value)
        while j < stop and self.at(j) == b",":
            value, k = self.expression(j + 1, stop, 0, header)
            if value is None:
                break
            node.add(value)
            node.end, j = value.end, k
        return node, j

    def expression(self, i: int, stop: int, least: int, header: bool = False) -> tuple[Node | None, int]:
        left, j = self.unary(i, stop, header)
        while left is not None and j < stop and not self.broken(j):
            power = _POWER.get(self.at(j)) if self.kind(j) == "mark" else None
            if power is None or power <= least:
                break
            right, k = self.expression(j + 1, stop, power, header)
            if right is None:
                break
            node = Node("binary_expression", left.start, right.end)
            self.put(node, left, "left")
            node.add(self.word(j, "operator"))
            self.put(node, right, "right")
            left, j = node, k
        return left, j

    def unary(self, i: int, stop: int, header: bool) -> tuple[Node | None, int]:
        if i >= stop:
            return None, i
        if self.at(i) in _UNARY and self.kind(i) == "mark":
            value, j = self.unary(i + 1, stop, header)
            if value is None:
                return None, i
            node = Node("unary_expression", self.t[i].start, value.end).add(self.word(i, "operator"))
            self.put(node, value, "operand")
            return node, j
        return self.suffixes(*self.primary(i, stop, header), stop, header)

    def primary(self, i: int, stop: int, header: bool) -> tuple[Node | None, int]:
        t, word = self.t[i], self.at(i)
        if t.kind == "string":
            kinds = {b"`": "raw_string_literal", b"'": "rune_literal"}
            return self.leaf(kinds.get(word[:1], "interpreted_string_literal"), i), i + 1
        if t.kind == "number":
            return self.leaf("int_literal", i), i + 1
        if word == b"(":
            inner, _ = self.expression(i + 1, self.match[i], 0)
            return Node("parenthesized_expression", t.start, self.t[self.match[i]].end).add(inner), self.match[i] + 1
        if word == b"func":
            node = self.leaf("func_literal", i)
            kept = self.inside(node.start, node.end, "function")
            mine = self.scope
            j = self.signature(i + 1, node)
            if self.at(j) == b"{":
                j = self.block(j, node, "body")
            else:
                node.kind = "function_type"
            node.end = self.t[j - 1].end
            self.scopes[mine] = (node.start, node.end, "function")
            self.scope = kept
            return node, j
        if word in (b"[", b"map", b"struct", b"chan", b"interface") and (t.kind == "mark" or self.at(i + 1) in (b"[", b"{") or word == b"chan"):
            made, j = self.type(i, stop)
            if made is not None and self.at(j) == b"{" and j < stop:
                return self.composite(made, j)
            return made, j
        if t.kind == "name":
            if word in _LITERALS:
                return self.leaf(_LITERALS[word], i), i + 1
            return self.leaf("identifier", i), i + 1
        return None, i

    def composite(self, made: Node, j: int) -> tuple[Node, int]:
        node = Node("composite_literal", made.start, self.t[self.match[j]].end)
        self.put(node, made, "type")
        self.put(node, self.literal(j), "body")
        return node, self.match[j] + 1

    def literal(self, i: int) -> Node:
        end, j = self.match[i], i + 1
        node = Node("literal_value", self.t[i].start, self.t[end].end)
        while j < end:
            k = j
            while k < end and self.at(k) != b",":
                k = self.match[k] + 1
            colon = j
            while colon < k and self.at(colon) != b":":
                colon = self.match[colon] + 1
            if colon < k:
                pair = Node("keyed_element", self.t[j].start, self.t[k - 1].end)
                pair.add(self.element(j, colon), self.element(colon + 1, k))
                node.add(pair)
            elif k > j:
                node.add(self.element(j, k))
            j = k + 1
        return node

    def element(self, i: int, stop: int) -> Node:
        node = Node("literal_element", self.t[min(i, stop - 1)].start, self.t[stop - 1].end)
        return node.add(self.literal(i) if self.at(i) == b"{" else self.expression(i, stop, 0)[0])

    def suffixes(self, left: Node | None, j: int, stop: int, header: bool) -> tuple[Node | None, int]:
        while left is not None and j < stop:
            word = self.at(j)
            if word == b"." and self.kind(j + 1) == "name":
                node = Node("selector_expression", left.start, self.t[j + 1].end)
                self.put(node, left, "operand")
                left, j = node.add(self.leaf("field_identifier", j + 1, "field")), j + 2
            elif self.broken(j):
                break
            elif word == b"." and self.at(j + 1) == b"(":
                node = Node("type_assertion_expression", left.start, self.t[self.match[j + 1]].end)
                self.put(node, left, "operand")
                t, _ = self.type(j + 2, self.match[j + 1])
                self.put(node, t, "type")
                left, j = node, self.match[j + 1] + 1
            elif word == b"(":
                end, k = self.match[j], j + 1
                args = Node("argument_list", self.t[j].start, self.t[end].end)
                while k < end:
                    value, m = self.expression(k, end, 0)
                    if value is None:
                        value, m = self.type(k, end)
                    args.add(value)
                    k = max(m, k)
                    k = self.match[k] + 1 if k < end and self.at(k) != b"," else k + 1
                node = Node("call_expression", left.start, args.end)
                self.put(node, left, "function")
                self.put(node, args, "arguments")
                left, j = node, end + 1
            elif word == b"[":
                end = self.match[j]
                index, _ = self.expression(j + 1, end, 0)
                node = Node("index_expression", left.start, self.t[end].end)
                self.put(node, left, "operand")
                self.put(node, index, "index")
                if any(self.at(k) == b":" for k in range(j + 1, end)):
                    node.kind = "slice_expression"
                left, j = node, end + 1
            elif word == b"{" and not header and left.kind in ("identifier", "selector_expression", "index_expression"):
                left.kind = {"identifier": "type_identifier", "selector_expression": "qualified_type", "index_expression": "generic_type"}[left.kind]
                if left.kind == "qualified_type" and len(left.children) == 2 and left.children[0].kind == "identifier":
                    left.children[0].kind, left.children[0].field = "package_identifier", "package"
                    left.children[1].kind, left.children[1].field = "type_identifier", "name"
                left, j = self.composite(left, j)
            else:
                break
        return left, j
