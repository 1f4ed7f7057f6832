"""Rust: a tolerant recursive-descent parser, with scopes and declarations."""

from __future__ import annotations

from tessera.sources.descent import Descent
from tessera.sources.tree import Node

_POWER = {b"..": 1, b"..=": 1, b"||": 2, b"&&": 3, b"==": 4, b"!=": 4, b"<": 4, b">": 4, b"<=": 4, b">=": 4, b"|": 5, b"^": 6, b"&": 7, b"+": 9, b"-": 9, b"*": 10, b"/": 10, b"%": 10}
_ASSIGN = frozenset(b"= += -= *= /= %= &= |= ^=".split())
_UNARY = frozenset(b"! - *".split())
_PREFIX = frozenset(b"pub async const unsafe extern default".split())
_ITEMS = {b"struct": "struct_item", b"enum": "enum_item", b"union": "union_item", b"trait": "trait_item", b"type": "type_item"}
_NAMES = {b"struct": "type", b"enum": "type", b"union": "type", b"trait": "trait", b"type": "type"}
_PRIMITIVE = frozenset("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str".split())
KINDS = frozenset(
    """source_file use_declaration use_wildcard scoped_use_list use_list use_as_clause scoped_identifier scoped_type_identifier identifier type_identifier primitive_type field_identifier shorthand_field_identifier
    attribute_item inner_attribute_item visibility_modifier function_item function_signature_item mod_item struct_item enum_item union_item trait_item type_item impl_item const_item static_item extern_crate_declaration macro_definition macro_invocation token_tree
    declaration_list field_declaration_list field_declaration enum_variant_list enum_variant ordered_field_declaration_list parameters parameter self_parameter closure_parameters type_parameters type_parameter type_arguments generic_type reference_type pointer_type tuple_type array_type function_type dynamic_type abstract_type never_type lifetime
    block let_declaration let_condition expression_statement if_expression else_clause match_expression match_block match_arm match_pattern while_expression for_expression loop_expression label return_expression break_expression continue_expression
    call_expression field_expression arguments index_expression unary_expression reference_expression binary_expression assignment_expression compound_assignment_expr range_expression try_expression await_expression type_cast_expression closure_expression parenthesized_expression tuple_expression array_expression struct_expression field_initializer_list field_initializer shorthand_field_initializer unsafe_block async_block generic_function
    string_literal raw_string_literal char_literal integer_literal float_literal boolean_literal self super crate metavariable empty_statement
    tuple_struct_pattern struct_pattern field_pattern tuple_pattern slice_pattern ref_pattern mut_pattern reference_pattern or_pattern captured_pattern range_pattern remaining_field_pattern""".split()
)


class Rust(Descent):
    FAMILY, ROOT = "rust", "source_file"

    def parse(self) -> Rust:
        self.items(0, self.n, self.root)
        return self

    def put(self, node: Node, child: Node | None, field: str | None) -> None:
        if child is not None:
            child.field = field
            node.add(child)

    def ended(self, node: Node, j: int) -> int:
        node.end = max(node.end, self.t[min(max(j, 1), self.n) - 1].end)
        return j

    def scoped(self, node: Node, work, kind: str = "block") -> int:
        """work() in a scope that is the node's own."""
        kept = self.inside(node.start, node.end, kind)
        mine = self.scope
        j = self.ended(node, work())
        self.scopes[mine] = (node.start, node.end, kind)
        self.scope = kept
        return j

    # --- items

    def items(self, i: int, stop: int, parent: Node) -> None:
        while i < stop:
            j = self.item(i, stop, parent)
            i = max(self.statement(i, stop, parent) if j is None else j, i + 1)

    def item(self, i: int, stop: int, parent: Node) -> int | None:
        """The item at i, if there is one."""
        word = self.at(i)
        if word == b"#" and (self.at(i + 1) == b"[" or self.at(i + 1) == b"!" and self.at(i + 2) == b"["):
            inner = self.at(i + 1) == b"!"
            end = self.match[i + 1 + inner]
            parent.add(Node("inner_attribute_item" if inner else "attribute_item", self.t[i].start, self.t[end].end))
            return end + 1
        if self.kind(i) != "name":
            return None
        first, j = i, i
        while self.at(j) in _PREFIX and j < stop:
            if self.at(j) == b"pub" and self.at(j + 1) == b"(":
                j = self.match[j + 1] + 1
            elif self.at(j) == b"const" and (self.kind(j + 1) == "name" and self.at(j + 1) not in (b"fn", b"unsafe", b"async", b"extern") or self.at(j + 1) == b"{"):
                break
            elif self.at(j) == b"extern" and self.kind(j + 1) == "string":
                j += 2
            elif self.at(j) in (b"unsafe", b"async", b"default") and self.at(j + 1) in (b"{", b"move", b"|", b"||", b".", b"(", b"=", b";", b",", b")"):
                break
            else:
                j += 1
        word, named = self.at(j), self.kind(j + 1) == "name"
        if word == b"use":
            return self.use(first, j, stop, parent)
        if word == b"fn" and named:
            return self.function(first, j, stop, parent)
        if word == b"mod" and named:
            node = Node("mod_item", self.t[first].start, self.t[j + 1].end).add(self.leaf("identifier", j + 1, "name"))
            parent.add(node)
            self.declare(node.children[0], "module")
            return self.ended(node, self.body(j + 2, node, self.items)) if self.at(j + 2) == b"{" else self.close(node, j + 2)
        if word in _ITEMS and named and not (word == b"union" and self.at(j + 2) not in (b"{", b"<")):
            return self.typed(first, j, stop, parent)
        if word == b"impl" and (named or self.at(j + 1) in (b"<", b"!", b"&", b"(", b"[", b"::", b"*")):
            return self.impl(first, j, stop, parent)
        if word in (b"const", b"static") and (named or self.at(j + 1) == b"_"):
            node, k = Node(f"{word.decode()}_item", self.t[first].start, self.t[j].end), j + 1
            k += self.at(k) == b"mut"
            self.put(node, self.leaf("identifier", k, "name"), "name")
            parent.add(node)
            self.declare(node.children[0], "const" if word == b"const" else "var")
            k += 1
            if self.at(k) == b":":
                k = self.type(k + 1, stop, node, "type")
            if self.at(k) == b"=":
                value, m = self.expression(k + 1, stop, 0)
                self.put(node, value, "value")
                k = max(m, k + 1)
            return self.close(node, k)
        if word == b"crate" and j > first and self.at(j - 1) == b"extern":
            name = self.leaf("identifier", j + 1, "name") if named else None
            node = Node("extern_crate_declaration", self.t[first].start, self.t[j].end).add(name)
            parent.add(node)
            self.declare(name, "import", "", self.name_of(name) if name else None)
            return self.close(node, j + 2)
        if word == b"{" and j > first and self.kind(j - 1) == "string":  # extern "C" { }
            node = Node("declaration_list", self.t[j].start, self.t[self.match[j]].end)
            parent.add(node)
            self.items(j + 1, self.match[j], node)
            return self.match[j] + 1
        if word == b"macro_rules" and self.at(j + 1) == b"!":
            k = j + 2 + (self.kind(j + 2) == "name")
            node = Node("macro_definition", self.t[first].start, self.t[self.match[min(k, self.n - 1)]].end)
            parent.add(node.add(self.leaf("identifier", j + 2, "name") if k > j + 2 else None))
            return self.match[min(k, self.n - 1)] + 1
        return None

    def use(self, first: int, i: int, stop: int, parent: Node) -> int:
        end = i
        while end < stop and self.at(end) != b";":
            end = self.match[end] + 1
        end = min(end, stop - 1)
        node = Node("use_declaration", self.t[first].start, self.t[end].end)
        parent.add(node)
        last = end if self.at(end) == b";" else end + 1
        self.put(node, self.use_tree(i + 1, last, ""), "argument")
        return end + 1

    def use_tree(self, i: int, stop: int, prefix: str) -> Node | None:
        """One entry of a use declaration; names that it binds are declared."""
        if i >= stop:
            return None
        start, names, j = i, [], i
        if self.at(j) == b"::":
            j += 1
        while j < stop and self.kind(j) == "name" and self.at(j) != b"as":
            names.append(j)
            j += 1
            if self.at(j) != b"::":
                break
            j += 1
        text = lambda k: self.t[k].text.decode("utf-8", "replace")
        join = lambda ks: "::".join([*([prefix] if prefix else []), *map(text, ks)])
        if j < stop and self.at(j) == b"*":
            return Node("use_wildcard", self.t[start].start, self.t[j].end).add(self.path(names))
        if j < stop and self.at(j) == b"{":
            listed = Node("use_list", self.t[j].start, self.t[self.match[j]].end, "list")
            k, end = j + 1, self.match[j]
            while k < end:
                m = k
                while m < end and self.at(m) != b",":
                    m = self.match[m] + 1
                listed.add(self.use_tree(k, m, join(names)))
                k = m + 1
            if not names:
                listed.field = None
                return listed
            node = Node("scoped_use_list", self.t[start].start, self.t[end].end)
            self.put(node, self.path(names), "path")
            return node.add(listed)
        if not names:
            return None
        if j < stop and self.at(j) == b"as" and j + 1 < stop:
            node = Node("use_as_clause", self.t[start].start, self.t[j + 1].end)
            self.put(node, self.path(names), "path")
            alias = self.leaf("identifier", j + 1, "alias")
            node.add(alias)
            if self.at(j + 1) != b"_":
                self.declare(alias, "import", join(names[:-1]) if len(names) > 1 or not prefix else prefix, text(names[-1]))
            return node
        node = self.path(names)
        if text(names[-1]) == "self" and prefix and len(names) == 1:
            self.decls.append((self.scope, prefix.rpartition("::")[2], "import", prefix.rpartition("::")[0], prefix.rpartition("::")[2]))
        else:
            self.decls.append((self.scope, text(names[-1]), "import", join(names[:-1]), text(names[-1])))
        return node

    def path(self, names: list[int]) -> Node | None:
        if not names:
            return None
        kinds = {b"self": "self", b"super": "super", b"crate": "crate"}
        node = self.leaf(kinds.get(self.at(names[0]), "identifier"), names[0])
        for k in names[1:]:
            outer = Node("scoped_identifier", node.start, self.t[k].end)
            self.put(outer, node, "path")
            self.put(outer, self.leaf("identifier", k), "name")
            node = outer
        return node

    def function(self, first: int, i: int, stop: int, parent: Node) -> int:
        node = Node("function_item", self.t[first].start, self.t[i + 1].end).add(self.leaf("identifier", i + 1, "name"))
        parent.add(node)
        self.declare(node.children[0], "function")

        def work() -> int:
            j = self.generics(i + 2, node)
            if self.at(j) == b"(":
                j = self.parameters(j, node)
            if self.at(j) == b"->":
                j = self.type(j + 1, stop, node, "return_type")
            j = self.where(j, stop)
            if self.at(j) == b"{":
                return self.block(j, node, "body")
            node.kind = "function_signature_item"
            return j + 1 if self.at(j) == b";" else j

        return self.scoped(node, work, "function")

    def generics(self, i: int, node: Node) -> int:
        """A list of type parameters at i; their names go to the present scope."""
        if self.at(i) != b"<":
            return i
        end = self.angle(i)
        if end is None:
            return i
        out, j = Node("type_parameters", self.t[i].start, self.t[end - 1].end, "type_parameters"), i + 1
        node.add(out)
        while j < end - 1:
            k = j + (self.at(j) == b"const")
            if self.kind(k) == "name":
                name = self.leaf("type_identifier", k, "name")
                out.add(Node("type_parameter", self.t[j].start, name.end).add(name))
                self.declare(name, "type-param")
            while k < end - 1 and self.at(k) != b",":
                k = (self.angle(k) or k + 1) if self.at(k) == b"<" else self.match[k] + 1
            j = k + 1
        return end

    def angle(self, i: int) -> int | None:
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
            elif w in (b"(", b"[", b"{"):
                j = self.match[j]
            elif w in (b";", b")", b"]", b"}", b"&&", b"||", b"=>") and not (w == b"&&"):
                return None
            j += 1
        return None

    def parameters(self, i: int, node: Node) -> int:
        end, j = self.match[i], i + 1
        out = Node("parameters", self.t[i].start, self.t[end].end, "parameters")
        node.add(out)
        while j < end:
            while self.at(j) == b"#" and self.at(j + 1) == b"[":
                j = self.match[j + 1] + 1
            k = self.until(j, end, b",")
            own = [x for x in range(j, k) if self.at(x) == b"self" and self.kind(x) == "name"]
            colon = self.until(j, k, b":")
            if own and own[0] < colon:
                out.add(Node("self_parameter", self.t[j].start, self.t[k - 1].end).add(self.leaf("self", own[0])))
            elif k > j:
                p = Node("parameter", self.t[j].start, self.t[k - 1].end)
                pattern, _ = self.pattern(j, colon)
                self.put(p, pattern, "pattern")
                if colon < k:
                    self.type(colon + 1, k, p, "type")
                out.add(p)
                self.bind(pattern, "param")
            j = k + 1
        return end + 1

    def until(self, i: int, stop: int, mark: bytes) -> int:
        while i < stop and self.at(i) != mark:
            i = (self.angle(i) or i + 1) if self.at(i) == b"<" and mark != b":" else self.match[i] + 1
        return min(i, stop)

    def where(self, j: int, stop: int) -> int:
        if self.at(j) == b"where":
            while j < stop and self.at(j) not in (b"{", b";"):
                j = self.match[j] + 1
        return j

    def body(self, i: int, node: Node, inside) -> int:
        """A list of declarations in braces, in a scope of its own."""
        end = self.match[i]
        out = Node("declaration_list", self.t[i].start, self.t[end].end, "body")
        node.add(out)
        kept = self.inside(out.start, out.end)
        inside(i + 1, end, out)
        self.scope = kept
        return end + 1

    def typed(self, first: int, i: int, stop: int, parent: Node) -> int:
        word = self.at(i)
        node = Node(_ITEMS[word], self.t[first].start, self.t[i + 1].end).add(self.leaf("type_identifier", i + 1, "name"))
        parent.add(node)
        self.declare(node.children[0], _NAMES[word])

        def work() -> int:
            j = self.generics(i + 2, node)
            if word == b"type":
                if self.at(j) == b"=":
                    j = self.type(j + 1, stop, node, "type")
                while j < stop and self.at(j) != b";":
                    j = self.match[j] + 1
                return min(j + 1, stop)
            while j < stop and self.at(j) not in (b"{", b";", b"("):
                j = self.match[j] + 1
            if word == b"trait" and self.at(j) == b"{":
                return self.body(j, node, self.items)
            if self.at(j) in (b"{", b"("):
                self.fields(j, node, word)
                j = self.match[j] + 1
                j = self.where(j, stop)
            return j + 1 if self.at(j) == b";" else j

        return self.scoped(node, work)

    def fields(self, i: int, node: Node, word: bytes) -> None:
        end, j = self.match[i], i + 1
        kind = "enum_variant_list" if word == b"enum" else "ordered_field_declaration_list" if self.at(i) == b"(" else "field_declaration_list"
        out = Node(kind, self.t[i].start, self.t[end].end, "body")
        node.add(out)
        while j < end:
            while self.at(j) == b"#" and self.at(j + 1) == b"[":
                out.add(Node("attribute_item", self.t[j].start, self.t[self.match[j + 1]].end))
                j = self.match[j + 1] + 1
            k = self.until(j, end, b",")
            a = j
            while self.at(a) == b"pub":
                a = self.match[a + 1] + 1 if self.at(a + 1) == b"(" else a + 1
            if a < k and self.kind(a) == "name" and kind != "ordered_field_declaration_list":
                made = Node("enum_variant" if word == b"enum" else "field_declaration", self.t[j].start, self.t[k - 1].end)
                made.add(self.leaf("identifier" if word == b"enum" else "field_identifier", a, "name"))
                if self.at(a + 1) == b":":
                    self.type(a + 2, k, made, "type")
                elif self.at(a + 1) in (b"{", b"("):
                    self.fields(a + 1, made, b"struct")
                out.add(made)
            elif a < k and kind == "ordered_field_declaration_list":
                self.type(a, k, out, "type")
            j = k + 1

    def impl(self, first: int, i: int, stop: int, parent: Node) -> int:
        node = Node("impl_item", self.t[first].start, self.t[i].end)
        parent.add(node)

        def work() -> int:
            j = self.generics(i + 1, node)
            j += self.at(j) == b"!"
            j = self.type(j, stop, node, "type")
            if self.at(j) == b"for":
                node.children[-1].field = "trait"
                j = self.type(j + 1, stop, node, "type")
            j = self.where(j, stop)
            while j < stop and self.at(j) not in (b"{", b";"):
                j = self.match[j] + 1
            return self.body(j, node, self.items) if self.at(j) == b"{" else j + 1

        return self.scoped(node, work)

    # --- types and patterns

    def type(self, i: int, stop: int, into: Node, field: str | None = None) -> int:
        """A type from i on, as a child of into."""
        start = i
        while i < stop and (self.at(i) in (b"&", b"&&", b"*", b"mut", b"const", b"dyn", b"impl", b"?", b"unsafe", b"extern") or self.kind(i) == "lifetime" or self.kind(i) == "string" and self.at(i - 1) == b"extern"):
            i += 1
        if i >= stop:
            return i
        wrapped = {b"&": "reference_type", b"&&": "reference_type", b"*": "pointer_type", b"dyn": "dynamic_type", b"impl": "abstract_type"}.get(self.at(start))
        holder = Node(wrapped, self.t[start].start, self.t[start].end, field) if wrapped else into
        word = self.at(i)
        if word == b"for" and self.at(i + 1) == b"<":
            i = self.angle(i + 1) or i + 2
            word = self.at(i)
        if word == b"(":
            node, end = Node("tuple_type", self.t[i].start, self.t[self.match[i]].end), self.match[i]
            k = i + 1
            while k < end:
                k = max(self.type(k, end, node), k) + 1
            i = end + 1
        elif word == b"[":
            node, end = Node("array_type", self.t[i].start, self.t[self.match[i]].end), self.match[i]
            self.type(i + 1, end, node, "element")
            i = end + 1
        elif word == b"fn" and self.at(i + 1) == b"(":
            node, end = Node("function_type", self.t[i].start, self.t[self.match[i + 1]].end), self.match[i + 1]
            i = self.ended(node, self.type(end + 2, stop, node, "return_type") if self.at(end + 1) == b"->" else end + 1)
        elif word == b"!":
            node, i = self.leaf("never_type", i), i + 1
        elif word == b"<":
            end = self.angle(i)
            if end is None:
                return i + 1
            node, i = Node("type_identifier", self.t[i].start, self.t[end - 1].end), end
            while self.at(i) == b"::" and self.kind(i + 1) == "name":
                i = self.ended(node, i + 2)
        elif self.kind(i) == "name" or word in (b"::", b"_"):
            node, i = self.type_path(i, stop)
            if node is None:
                return i
        else:
            return i
        self.put(holder, node, None if wrapped else field)
        while i < stop and self.at(i) == b"+" and (self.kind(i + 1) in ("name", "lifetime") or self.at(i + 1) in (b"?", b"(")) and wrapped in ("dynamic_type", "abstract_type", "reference_type"):
            i = self.type(i + 1, stop, holder) if self.kind(i + 1) != "lifetime" else i + 2
        if wrapped:
            self.ended(holder, i)
            into.add(holder)
        return i

    def type_path(self, i: int, stop: int) -> tuple[Node | None, int]:
        j = i + (self.at(i) == b"::")
        if self.kind(j) != "name" and self.at(j) != b"_":
            return None, i + 1
        names = [j]
        j += 1
        while self.at(j) == b"::" and self.kind(j + 1) == "name" and j + 1 < stop:
            names.append(j + 1)
            j += 2
        last = self.t[names[-1]].text.decode("utf-8", "replace")
        if len(names) == 1:
            node = self.leaf("primitive_type" if last in _PRIMITIVE else "type_identifier", names[0])
        else:
            node = Node("scoped_type_identifier", self.t[names[0]].start, self.t[names[-1]].end)
            self.put(node, self.path(names[:-1]), "path")
            self.put(node, self.leaf("type_identifier", names[-1]), "name")
        k = j + (self.at(j) == b"::" and self.at(j + 1) == b"<")
        if self.at(k) == b"<" and (end := self.angle(k)) is not None and end <= stop:
            held = Node("generic_type", node.start, self.t[end - 1].end)
            args = Node("type_arguments", self.t[k].start, self.t[end - 1].end)
            m = k + 1
            while m < end - 1:
                if self.kind(m) == "name" and self.at(m + 1) == b"=":
                    m += 2
                m = max(self.type(m, end - 1, args), m) + 1
            self.put(held, node, "type")
            self.put(held, args, "type_arguments")
            return held, end
        if self.at(j) == b"(" and last in ("Fn", "FnMut", "FnOnce"):
            end = self.match[j]
            if self.at(end + 1) == b"->":
                return node, self.type(end + 2, stop, Node("", 0, 0))
            return node, end + 1
        return node, j

    def bind(self, pattern: Node | None, kind: str) -> None:
        """Declare the names of a pattern; the constructor that it matches is none of them."""
        if pattern is None:
            return
        if pattern.kind in ("identifier", "shorthand_field_identifier"):
            self.declare(pattern, kind)
            return
        if pattern.kind.endswith("pattern"):
            for c in pattern.children:
                if c.field not in ("type", "name", "condition"):
                    self.bind(c, kind)

    def pattern(self, i: int, stop: int) -> tuple[Node | None, int]:
        node, j = self.one_pattern(i + (self.at(i) == b"|"), stop)
        if node is None or self.at(j) != b"|" or j >= stop:
            return node, j
        out = Node("or_pattern", node.start, node.end).add(node)
        while j < stop and self.at(j) == b"|":
            node, k = self.one_pattern(j + 1, stop)
            if node is None:
                break
            out.add(node)
            out.end, j = node.end, k
        return out, j

    def one_pattern(self, i: int, stop: int) -> tuple[Node | None, int]:
        if i >= stop:
            return None, i
        word, kind = self.at(i), self.kind(i)
        if word in (b"ref", b"mut", b"&", b"&&", b"box"):
            inner, j = self.one_pattern(i + 1, stop)
            if inner is None:
                return None, i
            made = {b"ref": "ref_pattern", b"mut": "mut_pattern"}.get(word, "reference_pattern")
            return Node(made, self.t[i].start, inner.end).add(inner), j
        if word in (b"(", b"["):
            node = Node("tuple_pattern" if word == b"(" else "slice_pattern", self.t[i].start, self.t[self.match[i]].end)
            self.patterns(i, node)
            return node, self.match[i] + 1
        if word in (b"..", b"..="):
            return self.leaf("remaining_field_pattern", i), i + 1
        if kind in ("string", "number") or word == b"-":
            j = i + (word == b"-")
            node = self.literal(j) if j < stop else None
            if node is not None and self.at(j + 1) in (b"..=", b"..", b"..."):
                return Node("range_pattern", node.start, self.t[min(j + 2, stop - 1)].end).add(node), min(j + 3, stop)
            return node, j + 1
        if kind != "name" and word != b"::":
            return None, i
        if word == b"_":
            return self.word(i), i + 1
        j = i + (word == b"::")
        names = [j]
        j += 1
        while self.at(j) == b"::" and (self.kind(j + 1) == "name" or self.at(j + 1) == b"<"):
            if self.at(j + 1) == b"<":
                j = self.angle(j + 1) or j + 2
                continue
            names.append(j + 1)
            j += 2
        target = self.path(names)
        if self.at(j) == b"(" and j < stop:
            node = Node("tuple_struct_pattern", target.start, self.t[self.match[j]].end)
            self.put(node, target, "type")
            self.patterns(j, node)
            return node, self.match[j] + 1
        if self.at(j) == b"{" and j < stop:
            node, end, k = Node("struct_pattern", target.start, self.t[self.match[j]].end), self.match[j], j + 1
            self.put(node, target, "type")
            while k < end:
                m = self.until(k, end, b",")
                colon = self.until(k, m, b":")
                if colon < m:
                    f = Node("field_pattern", self.t[k].start, self.t[m - 1].end).add(self.leaf("field_identifier", k, "name"))
                    inner, _ = self.pattern(colon + 1, m)
                    self.put(f, inner, "pattern")
                    node.add(f)
                elif k < m and self.at(k) != b"..":
                    while self.at(k) in (b"ref", b"mut"):
                        k += 1
                    node.add(Node("field_pattern", self.t[k].start, self.t[m - 1].end).add(self.leaf("shorthand_field_identifier", k)))
                k = m + 1
            return node, end + 1
        if self.at(j) == b"@" and j < stop:
            inner, k = self.one_pattern(j + 1, stop)
            return Node("captured_pattern", target.start, self.t[max(k, j + 1) - 1].end).add(target, inner), max(k, j + 1)
        if self.at(j) == b"!" and self.at(j + 1) in (b"(", b"[", b"{"):
            return Node("macro_invocation", target.start, self.t[self.match[j + 1]].end), self.match[j + 1] + 1
        if self.at(j) in (b"..=", b"..") and j < stop:
            return Node("range_pattern", target.start, self.t[min(j + 1, stop - 1)].end), min(j + 2, stop)
        name = self.name_of(target)
        if target.kind == "identifier" and (name[:1].isupper() or name in ("true", "false")):
            # a constant or a variant without fields: as the language cannot tell by form, its own convention does
            target.kind = "type_identifier" if name[:1].isupper() else "boolean_literal"
        return target, j

    def patterns(self, i: int, node: Node) -> None:
        end, j = self.match[i], i + 1
        while j < end:
            item, k = self.pattern(j, end)
            node.add(item)
            j = max(k, j)
            while j < end and self.at(j) != b",":
                j = self.match[j] + 1
            j += 1

    # --- statements and expressions

    def block(self, i: int, parent: Node, field: str | None = None) -> int:
        end = self.match[i]
        node = Node("block", self.t[i].start, self.t[end].end, field)
        parent.add(node)
        kept = self.inside(node.start, node.end)
        self.items(i + 1, end, node)
        self.scope = kept
        return end + 1

    def statement(self, i: int, stop: int, parent: Node) -> int:
        word = self.at(i)
        if word == b";":
            return i + 1
        if word == b"let" and self.kind(i) == "name":
            node = self.leaf("let_declaration", i)
            parent.add(node)
            pattern, j = self.pattern(i + 1, stop)
            self.put(node, pattern, "pattern")
            if self.at(j) == b":":
                j = self.type(j + 1, stop, node, "type")
            if self.at(j) == b"=" and j < stop:
                value, k = self.expression(j + 1, stop, 0)
                self.put(node, value, "value")
                j = max(k, j + 1)
            if self.at(j) == b"else" and self.at(j + 1) == b"{":
                j = self.block(j + 1, node, "alternative")
            self.bind(pattern, "let")
            return self.close(node, max(j, i + 1))
        value, j = self.expression(i, stop, 0, statement=True)
        if value is None:
            return self.match[i] + 1 if word != b"{" else i + 1
        if self.at(j) == b";" and j < stop:
            parent.add(Node("expression_statement", value.start, self.t[j].end).add(value))
            return j + 1
        parent.add(value)
        return j

    def expression(self, i: int, stop: int, least: int, header: bool = False, statement: bool = False) -> tuple[Node | None, int]:
        """header: no struct literals, as a block follows; statement: what ends with a block ends here."""
        if i < stop and self.at(i) in (b"..", b"..="):
            value, j = self.expression(i + 1, stop, 1, header)
            return Node("range_expression", self.t[i].start, self.t[max(j, i + 1) - 1].end).add(value), max(j, i + 1)
        left, j = self.unary(i, stop, header, statement)
        if statement and left is not None and left.kind in ("if_expression", "match_expression", "while_expression", "for_expression", "loop_expression", "block", "unsafe_block", "async_block") and self.at(j) not in (b".", b"?"):
            return left, j
        while left is not None and j < stop:
            word = self.at(j)
            if word == b"as" and self.kind(j) == "name":
                node = Node("type_cast_expression", left.start, left.end)
                self.put(node, left, "value")
                j = self.ended(node, max(self.type(j + 1, stop, node, "type"), j + 1))
                left = node
                continue
            if word in _ASSIGN and self.kind(j) == "mark":
                if least:
                    break
                right, k = self.expression(j + 1, stop, 0, header)
                node = Node("assignment_expression" if word == b"=" else "compound_assignment_expr", left.start, left.end)
                self.put(node, left, "left")
                self.put(node, right, "right")
                left, j = node, self.ended(node, max(k, j + 1))
                continue
            wide = 2 if word in (b"<", b">") and self.at(j + 1) == word and self.t[j + 1].start == self.t[j].end else 1
            power = 8 if wide == 2 else _POWER.get(word) if self.kind(j) == "mark" else None
            if power is None or power <= least:
                break
            right, k = self.expression(j + wide, stop, power, header)
            if right is None and power != 1:
                break
            node = Node("range_expression" if power == 1 else "binary_expression", left.start, self.t[j + wide - 1].end)
            self.put(node, left, "left")
            node.add(Node(word.decode() * wide, self.t[j].start, self.t[j + wide - 1].end, "operator", False))
            self.put(node, right, "right")
            left, j = node, self.ended(node, max(k, j + wide))
        return left, j

    def unary(self, i: int, stop: int, header: bool, statement: bool = False) -> tuple[Node | None, int]:
        if i >= stop:
            return None, i
        word = self.at(i)
        if word in _UNARY and self.kind(i) == "mark":
            value, j = self.unary(i + 1, stop, header)
            return (None, i) if value is None else (Node("unary_expression", self.t[i].start, value.end).add(self.word(i, "operator"), value), j)
        if word in (b"&", b"&&") and self.kind(i) == "mark":
            j = i + 1 + (self.at(i + 1) == b"mut")
            value, j = self.unary(j, stop, header)
            if value is None:
                return None, i
            value.field = "value"
            return Node("reference_expression", self.t[i].start, value.end).add(value), j
        left, j = self.primary(i, stop, header)
        if statement and left is not None and left.kind in ("if_expression", "match_expression", "while_expression", "for_expression", "loop_expression", "block", "unsafe_block") and self.at(j) not in (b".", b"?"):
            return left, j
        return self.suffixes(left, j, stop)

    def literal(self, i: int) -> Node | None:
        word, kind = self.at(i), self.kind(i)
        if kind == "number":
            return self.leaf("float_literal" if b"." in word else "integer_literal", i)
        if kind == "string":
            made = "char_literal" if word.lstrip(b"b")[:1] == b"'" else "raw_string_literal" if word[:1] == b"r" or word[:2] == b"br" else "string_literal"
            return self.leaf(made, i)
        return None

    def primary(self, i: int, stop: int, header: bool) -> tuple[Node | None, int]:
        t, word = self.t[i], self.at(i)
        found = self.literal(i)
        if found is not None:
            return found, i + 1
        if t.kind == "lifetime" and self.at(i + 1) == b":":
            value, j = self.primary(i + 2, stop, header) if i + 2 < stop else (None, i + 2)
            if value is not None:
                value.start = t.start
                value.add(self.leaf("label", i))
            return value, j
        if word == b"(":
            end, k, parts = self.match[i], i + 1, []
            comma = False
            while k < end:
                value, m = self.expression(k, end, 0)
                parts.append(value)
                k = max(m, k)
                comma = comma or self.at(k) == b","
                k = self.match[k] + 1 if k < end and self.at(k) != b"," else k + 1
            return Node("tuple_expression" if comma or not parts else "parenthesized_expression", t.start, self.t[end].end).add(*parts), end + 1
        if word == b"[":
            args, j = self.arguments(i)
            args.kind, args.field = "array_expression", None
            return args, j
        if word == b"{":
            holder = Node("", 0, 0)
            j = self.block(i, holder)
            return holder.children[0], j
        if word in (b"|", b"||") and t.kind == "mark" or word == b"move" and self.at(i + 1) in (b"|", b"||"):
            return self.closure(i, stop, header)
        if t.kind != "name" and word not in (b"::", b"<"):
            return None, i
        if word in (b"if", b"while"):
            return self.conditional(i, stop)
        if word == b"match":
            return self.matched(i, stop)
        if word == b"for" and self.at(i + 1) != b"<":
            return self.loop(i, stop)
        if word == b"loop" and self.at(i + 1) == b"{":
            node = self.leaf("loop_expression", i)
            return node, self.ended(node, self.block(i + 1, node, "body"))
        if word in (b"unsafe", b"async", b"const") and (self.at(i + 1) == b"{" or self.at(i + 1) == b"move" and self.at(i + 2) == b"{"):
            node = self.leaf("async_block" if word == b"async" else "unsafe_block", i)
            return node, self.ended(node, self.block(i + 1 + (self.at(i + 1) == b"move"), node))
        if word == b"async" and self.at(i + 1) in (b"|", b"||", b"move"):
            return self.closure(i + 1, stop, header)
        if word in (b"return", b"break", b"continue"):
            node, j = self.leaf(f"{word.decode()}_expression", i), i + 1
            if self.kind(j) == "lifetime":
                node.add(self.leaf("label", j))
                j += 1
            if word != b"continue" and j < stop and self.at(j) not in (b";", b",", b")", b"}", b"]", b"=>"):
                value, k = self.expression(j, stop, 0, header)
                node.add(value)
                j = max(k, j)
            return node, self.ended(node, j)
        if word == b"let":  # a condition
            pattern, j = self.pattern(i + 1, stop)
            node = self.leaf("let_condition", i)
            self.put(node, pattern, "pattern")
            self.bind(pattern, "let")
            if self.at(j) == b"=":
                value, k = self.expression(j + 1, stop, 3, True)
                self.put(node, value, "value")
                j = max(k, j + 1)
            return node, self.ended(node, j)
        return self.named(i, stop, header)

    def named(self, i: int, stop: int, header: bool) -> tuple[Node | None, int]:
        """A name or path, and what it begins: a macro call, a struct, a generic function."""
        t = self.t[i]
        if self.at(i) == b"<":
            end = self.angle(i)
            if end is None or self.at(end) != b"::" or self.kind(end + 1) != "name":
                return None, i
            node, j = Node("scoped_identifier", t.start, self.t[end + 1].end).add(self.leaf("identifier", end + 1, "name")), end + 2
            return node, j
        j = i + (self.at(i) == b"::")
        if self.kind(j) != "name":
            return None, i
        if self.at(j) in (b"true", b"false"):
            return self.leaf("boolean_literal", j), j + 1
        names, generic = [j], None
        j += 1
        while self.at(j) == b"::" and j + 1 < stop:
            if self.kind(j + 1) == "name":
                names.append(j + 1)
                j += 2
            elif self.at(j + 1) == b"<" and (end := self.angle(j + 1)) is not None:
                generic = (j + 1, end)
                j = end
            else:
                break
        node = self.path(names)
        if self.at(j) == b"!" and self.at(j + 1) in (b"(", b"[", b"{") and j + 1 < stop:
            end = self.match[j + 1]
            made = Node("macro_invocation", node.start, self.t[end].end)
            self.put(made, node, "macro")
            tree = Node("token_tree", self.t[j + 1].start, self.t[end].end)
            self.tokens(j + 2, end, tree)
            return made.add(tree), end + 1
        if self.at(j) == b"{" and not header and self.literal_follows(j, self.name_of(node)):
            return self.structure(node, j)
        if generic is not None and generic[1] == j:
            made = Node("generic_function", node.start, self.t[j - 1].end)
            self.put(made, node, "function")
            node = made
        return node, j

    def tokens(self, i: int, end: int, tree: Node) -> None:
        """A macro's arguments are tokens: what they mean is the macro's affair."""
        for k in range(i, end):
            if self.kind(k) == "name":
                tree.add(self.leaf("identifier", k))

    def literal_follows(self, j: int, name: str) -> bool:
        """Whether the brace after a path opens a struct's fields."""
        if not name.rpartition("::")[2][:1].isupper():
            return False
        return self.match[j] == j + 1 or self.at(j + 1) == b".." or self.kind(j + 1) in ("name", "number") and self.at(j + 2) in (b":", b",", b"}") or self.at(j + 1) == b"#"

    def structure(self, target: Node, j: int) -> tuple[Node, int]:
        end, k = self.match[j], j + 1
        node = Node("struct_expression", target.start, self.t[end].end)
        target.kind = {"identifier": "type_identifier", "scoped_identifier": "scoped_type_identifier"}.get(target.kind, target.kind)
        self.put(node, target, "name")
        body = Node("field_initializer_list", self.t[j].start, self.t[end].end, "body")
        node.add(body)
        while k < end:
            if self.at(k) == b"..":
                value, m = self.expression(k + 1, end, 0)
                body.add(value)
                k = max(m, k + 1) + 1
            elif self.at(k + 1) == b":":
                f = Node("field_initializer", self.t[k].start, self.t[k + 1].end).add(self.leaf("field_identifier", k, "field"))
                value, m = self.expression(k + 2, end, 0)
                self.put(f, value, "value")
                k = self.ended(f, max(m, k + 2))
                body.add(f)
            elif self.kind(k) == "name":
                body.add(Node("shorthand_field_initializer", self.t[k].start, self.t[k].end).add(self.leaf("identifier", k)))
                k += 1
            while k < end and self.at(k) != b",":
                k = self.match[k] + 1
            k += 1
        return node, end + 1

    def arguments(self, i: int) -> tuple[Node, int]:
        end, k = self.match[i], i + 1
        node = Node("arguments", self.t[i].start, self.t[end].end, "arguments")
        while k < end:
            value, m = self.expression(k, end, 0)
            node.add(value)
            k = max(m, k)
            k = self.match[k] + 1 if k < end and self.at(k) not in (b",", b";") else k + 1
        return node, end + 1

    def suffixes(self, left: Node | None, j: int, stop: int) -> tuple[Node | None, int]:
        while left is not None and j < stop:
            word = self.at(j)
            if word == b"." and self.at(j + 1) == b"await":
                left, j = Node("await_expression", left.start, self.t[j + 1].end).add(left), j + 2
            elif word == b"." and self.kind(j + 1) in ("name", "number"):
                node = Node("field_expression", left.start, self.t[j + 1].end)
                self.put(node, left, "value")
                left, j = node.add(self.leaf("field_identifier", j + 1, "field")), j + 2
                if self.at(j) == b"::" and self.at(j + 1) == b"<" and (end := self.angle(j + 1)) is not None:
                    made = Node("generic_function", left.start, self.t[end - 1].end)
                    self.put(made, left, "function")
                    left, j = made, end
            elif word == b"?":
                left, j = Node("try_expression", left.start, self.t[j].end).add(left), j + 1
            elif word == b"(":
                args, after = self.arguments(j)
                node = Node("call_expression", left.start, args.end)
                self.put(node, left, "function")
                left, j = node.add(args), after
            elif word == b"[":
                args, after = self.arguments(j)
                node = Node("index_expression", left.start, args.end).add(left)
                left, j = node.add(*args.children), after
            else:
                break
        return left, j

    def closure(self, i: int, stop: int, header: bool) -> tuple[Node, int]:
        node = self.leaf("closure_expression", i)

        def work() -> int:
            j = i + (self.at(i) == b"move")
            if self.at(j) == b"||":
                j += 1
            else:
                end = j + 1
                while end < stop and self.at(end) != b"|":
                    end = self.match[end] + 1
                out = Node("closure_parameters", self.t[j].start, self.t[min(end, stop - 1)].end, "parameters")
                node.add(out)
                k = j + 1
                while k < end:
                    pattern, m = self.one_pattern(k, end)
                    item = pattern
                    if self.at(m) == b":" and pattern is not None:
                        item = Node("parameter", pattern.start, pattern.end)
                        self.put(item, pattern, "pattern")
                        m = self.ended(item, self.type(m + 1, end, item, "type"))
                    out.add(item)
                    self.bind(pattern, "param")
                    k = max(m, k)
                    while k < end and self.at(k) != b",":
                        k = self.match[k] + 1
                    k += 1
                j = end + 1
            if self.at(j) == b"->":
                j = self.type(j + 1, stop, node, "return_type")
            if j >= stop:
                return j
            body, k = self.expression(j, stop, 0, header)
            self.put(node, body, "body")
            return max(k, j)

        return node, self.scoped(node, work, "function")

    def conditional(self, i: int, stop: int) -> tuple[Node, int]:
        word = self.at(i).decode()
        node = self.leaf(f"{word}_expression", i)

        def work() -> int:
            value, j = self.expression(i + 1, stop, 0, True)
            self.put(node, value, "condition")
            j = max(j, i + 1)
            while j < stop and self.at(j) not in (b"{", b";", b"}"):
                j += 1
            if self.at(j) != b"{" or j >= stop:
                return j
            j = self.block(j, node, "consequence" if word == "if" else "body")
            if word == "if" and self.at(j) == b"else" and j + 1 < stop:
                other = self.leaf("else_clause", j, "alternative")
                node.add(other)
                if self.at(j + 1) == b"if":
                    inner, j = self.conditional(j + 1, stop)
                    other.add(inner)
                else:
                    j = self.block(j + 1, other) if self.at(j + 1) == b"{" else j + 1
                self.ended(other, j)
            return j

        return node, self.scoped(node, work)

    def loop(self, i: int, stop: int) -> tuple[Node, int]:
        node = self.leaf("for_expression", i)

        def work() -> int:
            pattern, j = self.pattern(i + 1, stop)
            self.put(node, pattern, "pattern")
            if self.at(j) == b"in":
                value, k = self.expression(j + 1, stop, 0, True)
                self.put(node, value, "value")
                j = max(k, j + 1)
            self.bind(pattern, "loop")
            while j < stop and self.at(j) not in (b"{", b";", b"}"):
                j += 1
            return self.block(j, node, "body") if self.at(j) == b"{" and j < stop else j

        return node, self.scoped(node, work)

    def matched(self, i: int, stop: int) -> tuple[Node, int]:
        node = self.leaf("match_expression", i)
        value, j = self.expression(i + 1, stop, 0, True)
        self.put(node, value, "value")
        j = max(j, i + 1)
        while j < stop and self.at(j) not in (b"{", b";"):
            j += 1
        if self.at(j) != b"{" or j >= stop:
            return node, self.ended(node, j)
        end, k = self.match[j], j + 1
        body = Node("match_block", self.t[j].start, self.t[end].end, "body")
        node.add(body)
        while k < end:
            while self.at(k) == b"#" and self.at(k + 1) == b"[":
                k = self.match[k + 1] + 1
            arm = self.leaf("match_arm", k)
            body.add(arm)
            k = max(self.scoped(arm, lambda a=arm, at=k: self.arm(a, at, end)), k + 1)
        return node, self.ended(node, end + 1)

    def arm(self, arm: Node, i: int, end: int) -> int:
        holder = Node("match_pattern", self.t[i].start, self.t[i].end, "pattern")
        pattern, j = self.pattern(i, end)
        holder.add(pattern)
        self.bind(pattern, "let")
        j = max(j, i)
        if self.at(j) == b"if":
            value, k = self.expression(j + 1, end, 0, True)
            self.put(holder, value, "condition")
            j = max(k, j + 1)
        while j < end and self.at(j) != b"=>":
            j = self.match[j] + 1
        self.ended(holder, j)
        arm.add(holder)
        if j >= end:
            return end
        value, k = self.expression(j + 1, end, 0, statement=True)
        self.put(arm, value, "value")
        k = max(k, j + 1)
        if self.at(k) == b"," and k < end:
            return k + 1
        while value is None and k < end and self.at(k) != b",":
            k = self.match[k] + 1
        return k
