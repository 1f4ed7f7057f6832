"""Syntax trees as interval-encoded rows."""

from __future__ import annotations

import dataclasses
from bisect import bisect_right
from dataclasses import dataclass


@dataclass(eq=False, slots=True)
class Node:
    kind: str
    start: int
    end: int
    field: str | None = None
    named: bool = True
    children: list[Node] = dataclasses.field(default_factory=list)

    def add(self, *nodes: Node | None) -> Node:
        self.children += [n for n in nodes if n is not None]
        return self


class Tree:
    """A parsed file with what navigation needs, each index made once: document order, parents, line starts, scopes."""

    def __init__(self, root: Node, source: bytes, scopes: list[tuple[int, int, str]], decls: list[tuple]):
        self.root, self.source = root, source
        #: By id(node), in document order: (place, parent, last place below).
        self.parents: dict[int, Node | None] = {}
        self.places: dict[int, int] = {}
        self.nodes: list[Node] = []
        stack: list[tuple[Node, Node | None]] = [(root, None)]
        while stack:
            n, parent = stack.pop()
            self.places[id(n)], self.parents[id(n)] = len(self.nodes), parent
            self.nodes.append(n)
            if len(n.children) > 1:
                n.children.sort(key=lambda c: (c.start, -c.end))
            stack += [(c, n) for c in reversed(n.children)]
        self.breaks = [-1]
        at = source.find(b"\n")
        while at >= 0:
            self.breaks.append(at)
            at = source.find(b"\n", at + 1)
        order = sorted(range(len(scopes)), key=lambda k: (scopes[k][0], -scopes[k][1], k))
        self._scope_starts = [scopes[k][0] for k in order]
        self._scopes, self._outer, open_ = [], [], []
        for k in order:
            a, b, kind = scopes[k]
            while open_ and self._scopes[open_[-1]][1] < b:
                open_.pop()
            self._outer.append(open_[-1] if open_ else -1)
            open_.append(len(self._scopes))
            self._scopes.append((a, b, kind, k))
        self._declared: dict[tuple[int, str], tuple] = {}
        for scope, name, kind, module, imported in decls:
            known = self._declared.get((scope, name))
            if known is None or kind == "import" and known[0] != "import":
                self._declared[scope, name] = (kind, module, imported)

    def text(self, n: Node) -> str:
        return self.source[n.start : n.end].decode("utf-8", "replace")

    def position(self, n: Node) -> tuple[int, int]:
        """Line and byte column, from 1."""
        line = bisect_right(self.breaks, n.start - 1)
        return line, n.start - self.breaks[line - 1]

    def parent(self, n: Node) -> Node | None:
        return self.parents[id(n)]

    def ancestors(self, n: Node) -> list[Node]:
        """Innermost first, without the node itself."""
        out, at = [], self.parents[id(n)]
        while at is not None:
            out.append(at)
            at = self.parents[id(at)]
        return out

    def binding(self, n: Node) -> tuple[str | None, str | None, str | None, bool]:
        """(kind, module, imported name, shadowed) of what an identifier names: the innermost enclosing scope that declares it holds.

        Class scopes are not seen from functions within them.
        """
        if not self._declared:
            return None, None, None, False
        name = self.text(n)
        found = [self._declared[k, name] for k in self.seen(n) if (k, name) in self._declared]
        return (*found[0], len(found) > 1) if found else (None, None, None, False)

    def seen(self, n: Node) -> list[int]:
        """The scopes whose names a node sees, innermost first."""
        out, in_function = [], False
        at = bisect_right(self._scope_starts, n.start) - 1
        while at >= 0:
            a, b, kind, k = self._scopes[at]
            if n.end <= b and a <= n.start:
                if not (kind == "class" and in_function):
                    out.append(k)
                in_function = in_function or kind == "function"
            at = self._outer[at]
        return out

    def rows(self) -> list[tuple]:
        """(node_id, parent_id, child_idx, depth, pre, post, kind, field, named, start, end, line, column, text, ancestors, scopes), root first.

        pre and post number a node and the last of its descendants in document order, so "within" is a range;
        ancestors and scopes list what is around a node, innermost first, so that "around" is an equality.
        Lines and columns count from 1, columns in bytes.
        """
        out: list[list] = []
        for me, n in enumerate(self.nodes):
            up = self.parents[id(n)]
            parent = None if up is None else self.places[id(up)]
            around = [] if parent is None else [parent, *out[parent][14]]
            idx = 0 if up is None else next(i for i, c in enumerate(up.children) if c is n)
            out.append([me, parent, idx, len(around), me, me, n.kind, n.field, n.named, n.start, n.end, *self.position(n), self.text(n), around, self.seen(n)])
        for r in reversed(out):
            if r[1] is not None:
                out[r[1]][5] = max(out[r[1]][5], r[5])
        return [tuple(r) for r in out]
