"""What the descent parsers share: tokens, nodes, scopes and declarations."""

from __future__ import annotations

from tessera.sources.lexer import Token, lex, matching
from tessera.sources.tree import Node


class Descent:
    """One file's parse; `root`, `scopes` and `decls` are the result.

    What cannot be read is passed over token by token, so every file gives a tree.
    """

    FAMILY = ""
    ROOT = ""

    def __init__(self, source: bytes, start: int = 0, stop: int | None = None):
        self.source = source
        text = source if stop is None else source[start:stop]
        self.t: list[Token] = lex(text, self.FAMILY)
        if start:
            self.t = [Token(x.kind, x.text, x.start + start, x.end + start) for x in self.t]
        self.match = matching(self.t)
        self.n = len(self.t)
        self.root = Node(self.ROOT, 0, len(source))
        self.scopes: list[tuple[int, int, str]] = [(0, len(source), "block")]
        self.decls: list[tuple[int, str, str, str | None, str | None]] = []
        self.scope = 0

    def at(self, i: int) -> bytes:
        return self.t[i].text if i < self.n else b""

    def kind(self, i: int) -> str:
        return self.t[i].kind if i < self.n else ""

    def broken(self, i: int) -> bool:
        """Whether a line ends before token i."""
        return i >= self.n or i == 0 or b"\n" in self.source[self.t[i - 1].end : self.t[i].start]

    def leaf(self, kind: str, i: int, field: str | None = None, named: bool = True) -> Node:
        return Node(kind, self.t[i].start, self.t[i].end, field, named)

    def word(self, i: int, field: str | None = None) -> Node:
        return self.leaf(self.t[i].text.decode("utf-8", "replace"), i, field, False)

    def close(self, node: Node, i: int) -> int:
        """node ends with the token before i, or with a semicolon there."""
        if self.at(i) == b";":
            i += 1
        node.end = max(node.end, self.t[i - 1].end)
        return i

    def name_of(self, n: Node) -> str:
        return self.source[n.start : n.end].decode("utf-8", "replace")

    def declare(self, n: Node | None, kind: str, module: str | None = None, imported: str | None = None) -> None:
        if n is not None:
            self.decls.append((self.scope, self.name_of(n), kind, module, imported))

    def inside(self, start: int, end: int, kind: str = "block") -> int:
        """Enter a scope; returns the one to go back to."""
        self.scopes.append((start, end, kind))
        kept, self.scope = self.scope, len(self.scopes) - 1
        return kept
