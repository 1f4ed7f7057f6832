"""A project served to editors (language server protocol) and to agents (model context protocol), over two streams.

Both speak JSON-RPC; one run of the project answers them, with what earlier runs left in the store.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO
from urllib.parse import quote, unquote

#: Fixed values of the protocols.
PARSE_ERROR, METHOD_NOT_FOUND, INVALID_PARAMS = -32700, -32601, -32602
MCP_VERSION = "2024-11-05"
ERROR, WARNING = 1, 2


@dataclass
class Violation:
    rule: str
    file: str
    line: int
    column: int
    message: str
    remediation: str
    severity: str


class Project:
    """What the servers ask: a run, the configured rules, and one of them."""

    def __init__(self, spark, root: str, config: str | None = None, store: str | None = None, today: Callable[[], str] | None = None):
        self.spark, self.root, self.config, self.store, self.today = spark, str(Path(root).resolve()), config, store, today

    def _run(self):
        import datetime

        from tessera import __main__ as cli
        from tessera import config as configs

        config, limits = configs.load(self.config or Path(self.root, configs.NAME))
        today = self.today() if self.today else datetime.datetime.now(datetime.UTC).date().isoformat()
        with cli.time_limit(self.spark, limits.whole):
            return cli.run(self.spark, self.root, config, today, store=self.store), config

    def violations(self) -> list[Violation]:
        """Of the whole project; an editor holds them all anyway."""
        from pyspark.sql import functions as F

        rows = self._run()[0].sorted().select(F.concat_ws("/", "rule_ns", "rule_name").alias("rule"), "file", "line", "column", "message", "remediation", "severity")
        return [Violation(*r) for r in rows.toLocalIterator()]

    def check(self) -> str:
        from tessera import __main__ as cli

        out, config = self._run()
        text = "".join(cli.render(self.spark, out, config, "agent", False))
        return text or "no violations\n"

    def rules(self) -> str:
        from tessera import config as configs

        config, _ = configs.load(self.config or Path(self.root, configs.NAME))
        return "".join(f"{r.id} ({config.resolved(r)}): {r.card.message}\n" for r in config.rules) or "no rules are configured\n"

    def explain(self, rule: str) -> str:
        from tessera import __main__ as cli
        from tessera import config as configs

        config, _ = configs.load(self.config or Path(self.root, configs.NAME))
        try:
            return cli.explanation(config, rule)
        except configs.ConfigError as e:
            raise configs.ConfigError(f"{e}; there are: {', '.join(r.id for r in config.rules) or 'none'}") from None


# --- messages -----------------------------------------------------------------------------------------


def _answer(message: dict, result: object = None, error: tuple[int, str] | None = None) -> dict:
    body = {"jsonrpc": "2.0", "id": message.get("id")}
    return body | ({"error": {"code": error[0], "message": error[1]}} if error else {"result": result})


def read_line(stream: BinaryIO) -> str | None:
    """The next message of a stream of lines; null at its end."""
    while line := stream.readline():
        if line.strip():
            return line.decode("utf-8", "replace")
    return None


def write_line(stream: BinaryIO, message: dict) -> None:
    stream.write(json.dumps(message, ensure_ascii=False).encode() + b"\n")
    stream.flush()


def read_framed(stream: BinaryIO) -> str | None:
    """The next message that a header gives the length of; null at the stream's end."""
    length = None
    while line := stream.readline():
        if not line.strip():
            if length is not None:
                return stream.read(length).decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            length = int(value)
    return None


def write_framed(stream: BinaryIO, message: dict) -> None:
    data = json.dumps(message, ensure_ascii=False).encode()
    stream.write(b"Content-Length: %d\r\n\r\n%s" % (len(data), data))
    stream.flush()


def _parsed(text: str) -> dict | None:
    try:
        message = json.loads(text)
    except json.JSONDecodeError:
        return None
    return message if isinstance(message, dict) and "method" in message else None


# --- agents -------------------------------------------------------------------------------------------

TOOLS = [
    {"name": "tessera_check", "description": "Run the project's rules. Gives what breaks them, by rule, with how to mend it. Worth a call after every edit.", "inputSchema": {"type": "object", "properties": {}}},
    {"name": "tessera_rules", "description": "List the configured rules and what each is for. Worth a call before writing code.", "inputSchema": {"type": "object", "properties": {}}},
    {
        "name": "tessera_explain", "description": "Say what one rule wants, with an example that breaks it and one that does not.",
        "inputSchema": {"type": "object", "properties": {"rule": {"type": "string", "description": "A rule's id, as in tessera/no-default-export"}}, "required": ["rule"]},
    },
]


def serve_mcp(source: BinaryIO, sink: BinaryIO, project: Project) -> None:
    """Answer an agent's host until it hangs up. A tool that fails is an answer too, marked as an error."""
    while (text := read_line(source)) is not None:
        message = _parsed(text)
        if message is None:
            write_line(sink, _answer({}, error=(PARSE_ERROR, "no JSON-RPC message")))
            continue
        if "id" not in message:  # a notification
            continue
        write_line(sink, _mcp(message, project))


def _mcp(message: dict, project: Project) -> dict:
    method, given = message["method"], message.get("params") or {}
    if method == "initialize":
        return _answer(message, {"protocolVersion": given.get("protocolVersion", MCP_VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": _version()}})
    if method == "ping":
        return _answer(message, {})
    if method == "tools/list":
        return _answer(message, {"tools": TOOLS})
    if method != "tools/call":
        return _answer(message, error=(METHOD_NOT_FOUND, f"no method `{method}`"))
    name, arguments = given.get("name"), given.get("arguments") or {}
    work = {"tessera_check": project.check, "tessera_rules": project.rules, "tessera_explain": lambda: project.explain(arguments["rule"])}.get(name)
    if work is None or name == "tessera_explain" and not isinstance(arguments.get("rule"), str):
        return _answer(message, error=(INVALID_PARAMS, f"no tool `{name}` with these arguments"))
    try:
        text, failed = work(), False
    except Exception as e:  # the model is told what went wrong
        text, failed = f"{type(e).__name__}: {e}", True
    return _answer(message, {"content": [{"type": "text", "text": text}], "isError": failed})


def _version() -> str:
    from tessera import __version__

    return __version__


# --- editors ------------------------------------------------------------------------------------------


def path_of(uri: str) -> str | None:
    """The path that a file:// address names."""
    if not uri.startswith("file://"):
        return None
    path = unquote(uri[len("file://") :])
    return path[1:] if len(path) > 2 and path[0] == "/" and path[1].isalpha() and path[2] == ":" else path


def uri_of(path: str) -> str:
    return "file://" + ("" if path.startswith("/") else "/") + quote(path)


def diagnostic(v: Violation) -> dict:
    """A violation as editors show it: places count from 0, one character wide; the remediation is part of the message."""
    line, character = max(0, v.line - 1), max(0, v.column - 1)
    return {
        "range": {"start": {"line": line, "character": character}, "end": {"line": line, "character": character + 1}},
        "severity": ERROR if v.severity == "error" else WARNING, "source": "tessera", "code": v.rule, "message": f"{v.message}\n{v.remediation}",
    }


def serve_lsp(source: BinaryIO, sink: BinaryIO, root: str, violations: Callable[[], list[Violation]]) -> None:
    """Answer an editor until it leaves: a run whenever a document is opened or saved, and diagnostics for every open one, none for clean ones."""
    base, opened = str(Path(root).resolve()), {}

    def publish() -> None:
        by: dict[str, list[dict]] = defaultdict(list)
        try:
            for v in violations():
                by[f"{base}/{v.file}"].append(diagnostic(v))
        except Exception as e:  # the editor stays
            write_framed(sink, {"jsonrpc": "2.0", "method": "window/logMessage", "params": {"type": ERROR, "message": f"tessera: {e}"}})
        for path, uri in opened.items():
            write_framed(sink, {"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": uri, "diagnostics": by.get(path, [])}})

    while (text := read_framed(source)) is not None:
        message = _parsed(text)
        if message is None:
            write_framed(sink, _answer({}, error=(PARSE_ERROR, "no JSON-RPC message")))
            continue
        method = message["method"]
        uri = ((message.get("params") or {}).get("textDocument") or {}).get("uri") or ""
        path = path_of(uri)
        if method == "exit":
            return
        if method in ("textDocument/didOpen", "textDocument/didSave"):
            if path is not None:
                opened[str(Path(path).resolve())] = uri
            publish()
        elif method == "textDocument/didClose":
            if path is not None:
                opened.pop(str(Path(path).resolve()), None)
        elif "id" in message:
            results = {"initialize": {"capabilities": {"textDocumentSync": {"openClose": True, "change": 0, "save": {"includeText": False}}}, "serverInfo": {"name": "tessera", "version": _version()}}, "shutdown": None}
            write_framed(sink, _answer(message, results[method]) if method in results else _answer(message, error=(METHOD_NOT_FOUND, f"no method `{method}`")))
