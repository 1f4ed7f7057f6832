"""What a check in Python is given: one file's tree, its bindings, other files that the rule declared, and a place to speak."""

from __future__ import annotations

import contextlib
import json
import re
import signal
import threading
from collections.abc import Callable, Iterator

from tessera.functions.globs import star_to_regex
from tessera.operators.patterns import Pattern, matches
from tessera.plans.rule import Handler, RuleError, compile_for
from tessera.sources.tree import Node, Tree

#: Default budget of one call, in milliseconds.
TIMEOUT_MS = 1_000


class ReadError(RuleError):
    """A read of a file that the rule has not declared, or of one outside the project."""


@contextlib.contextmanager
def deadline(ms: int, what: str) -> Iterator[None]:
    """Interrupt what runs within after so many milliseconds; only a process's main thread can be interrupted."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise RuleError(f"{what} took more than {ms} ms")

    old = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, ms / 1000)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def handler(run: Callable[[Context, dict[str, Node]], None]) -> Handler:
    """A rule's check out of run(context, first captured node by name). It must depend on its arguments alone."""
    return Handler(run)


_compiled: dict[tuple[str, str], list[Pattern]] = {}


def _query(text: str, language: str) -> list[Pattern]:
    if (text, language) not in _compiled:
        _compiled[text, language] = compile_for(text, language)
    return _compiled[text, language]


class Context:
    """The capabilities of a check of one file. Nodes are the parser's own; none of them is ever false."""

    def __init__(self, file: str, language: str, tree: Tree, today: str, sides: dict[str, tuple[str | None, str | None]], declared: tuple[str, ...]):
        self.file_path, self._language, self._tree, self._today = file, language, tree, today
        self._sides, self._declared = sides, declared
        #: (kind, line, column, message, fix, data), as SAID has them.
        self.said: list[tuple] = []
        self._marked: set[tuple] = set()

    # the file

    @property
    def file_text(self) -> str:
        return self._tree.source.decode("utf-8", "replace")

    @property
    def root(self) -> Node:
        return self._tree.root

    # nodes

    def kind(self, n: Node) -> str:
        return n.kind

    def text(self, n: Node) -> str:
        return self._tree.text(n)

    def is_named(self, n: Node) -> bool:
        return n.named

    def line(self, n: Node) -> int:
        return self._tree.position(n)[0]

    def column(self, n: Node) -> int:
        return self._tree.position(n)[1]

    def loc(self, n: Node) -> dict:
        line, column = self._tree.position(n)
        return {"file": self.file_path, "line": line, "column": column}

    def range(self, n: Node) -> tuple[int, int]:
        """First byte, and the one after the last."""
        return n.start, n.end

    def parent(self, n: Node) -> Node | None:
        return self._tree.parent(n)

    def children(self, n: Node) -> list[Node]:
        return list(n.children)

    def named_children(self, n: Node) -> list[Node]:
        return [c for c in n.children if c.named]

    def field(self, n: Node, name: str) -> Node | None:
        """The first child in a field."""
        return next((c for c in n.children if c.field == name), None)

    def ancestors(self, n: Node) -> list[Node]:
        """Innermost first, up to the root."""
        return self._tree.ancestors(n)

    # queries

    def query_subtree(self, n: Node, query: str) -> list[dict[str, Node]]:
        """The matches of a query in a node and below it: the first node of each capture."""
        out = []
        for _, _, captures in matches(n, [(0, _query(query, self._language))]):
            first: dict[str, Node] = {}
            for name, node in captures:
                first.setdefault(name, node)
            out.append(first)
        return out

    def closest_ancestor(self, n: Node, query: str) -> dict[str, Node] | None:
        """The match of a query at the innermost ancestor that it captures; a match within one does not count."""
        patterns = _query(query, self._language)
        for up in self._tree.ancestors(n):
            for _, _, captures in matches(up, [(0, patterns)], below=False):
                first: dict[str, Node] = {}
                for name, node in captures:
                    first.setdefault(name, node)
                if any(x is up for x in first.values()):
                    return first
        return None

    # bindings

    def binding_kind(self, n: Node) -> str | None:
        return self._tree.binding(n)[0]

    def is_shadowed(self, n: Node) -> bool:
        return self._tree.binding(n)[3]

    def resolves_to_import(self, n: Node, module: str, name: str | None = None) -> bool:
        """Whether an identifier is imported from exactly this module; name: the export, `default` or `*`."""
        kind, of, imported, _ = self._tree.binding(n)
        return kind == "import" and of == module and name in (None, imported)

    def is_imported_from(self, n: Node, pattern: str) -> bool:
        """Whether an identifier is imported from a module that a `*` pattern fits."""
        kind, of, _, _ = self._tree.binding(n)
        return kind == "import" and of is not None and re.match(star_to_regex(pattern).replace("\\z", "\\Z"), of) is not None

    # beyond the file

    def _mark(self, kind: str, data: dict) -> None:
        key = (kind, *data.values())
        if key not in self._marked:
            self._marked.add(key)
            self.said.append((kind, None, None, None, None, json.dumps(data, ensure_ascii=False)))

    def _side(self, path: str) -> tuple[str | None, str | None]:
        if path.startswith("/") or ".." in path.split("/"):
            raise ReadError(f"`{path}` lies outside the project")
        path = "/".join(p for p in path.split("/") if p not in ("", "."))
        if path not in self._declared:
            raise ReadError(f"`{path}` is not among the files that the rule declares in `reads`")
        text, digest = self._sides.get(path, (None, None))
        self._mark("#read", {"path": path, "hash": digest})
        return text, digest

    def read_file(self, path: str) -> str | None:
        """The text of a declared file; null if there is none. The read, or the absence, is part of what the result depends on."""
        text, digest = self._side(path)
        if text is None and digest is not None:
            raise ReadError(f"`{path}` is no text")
        return text

    def file_exists(self, path: str) -> bool:
        return self._side(path)[1] is not None

    @property
    def today(self) -> str:
        """The run's date; who asks for it depends on it."""
        self._mark("#today", {})
        return self._today

    # speaking

    def report(self, at: Node, message: str | None = None, fix: dict | None = None) -> None:
        """A violation at a node; fix: start, end, replacement, safe."""
        line, column = self._tree.position(at)
        self.said.append(("", line, column, message, fix and {"safe": False, **fix}, None))

    def emit_fact(self, kind: str, data: dict) -> None:
        if not kind or kind.startswith("#"):
            raise RuleError("a fact needs a kind, which does not start with #")
        if not isinstance(data, dict):
            raise RuleError("a fact's payload is a JSON object")
        self.said.append((kind, None, None, None, None, json.dumps({k: v for k, v in data.items() if k != "file"}, ensure_ascii=False)))
