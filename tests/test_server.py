"""The servers and the watched tree, over streams in memory and folders of their own."""

import io
import json
import os
import threading
import time
from types import SimpleNamespace

from tessera import __main__ as cli
from tessera import config as configs
from tessera import server
from tessera.streaming import watch as w

CONFIG = {"rules": ["tessera/no-default-export"]}


def framed(*messages):
    return io.BytesIO(b"".join(b"Content-Length: %d\r\n\r\n%s" % (len(m), m) for m in (json.dumps(x).encode() for x in messages)))


def unframed(data):
    stream, out = io.BytesIO(data), []
    while (text := server.read_framed(stream)) is not None:
        out.append(json.loads(text))
    return out


def project(spark, root):
    (root / "a b.ts").write_text("export default 1\n")
    (root / "c.ts").write_text("export const x = 1\n")
    (root / "tessera.json").write_text(json.dumps(CONFIG))
    return server.Project(spark, str(root), today=lambda: "2024-07-01")


def test_agents_are_answered(spark, tmp_path):
    p = project(spark, tmp_path)
    call = lambda n, name, **a: {"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": name, "arguments": a}}
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, call(3, "tessera_check"), call(4, "tessera_rules"), call(5, "tessera_explain", rule="tessera/no-default-export"), call(6, "tessera_explain", rule="no/such"), call(7, "nothing"), {"id": 8, "method": "nothing"}, {"id": 9, "method": "ping"}, call(10, "tessera_explain")]
    sink = io.BytesIO()
    server.serve_mcp(io.BytesIO("\n".join(map(json.dumps, asked)).encode() + b"\nnot json\n"), sink, p)
    got = {m["id"]: m for m in map(json.loads, sink.getvalue().splitlines())}
    assert got[1]["result"]["serverInfo"]["name"] == "tessera" and [t["name"] for t in got[2]["result"]["tools"]] == ["tessera_check", "tessera_rules", "tessera_explain"]
    text = lambda n: got[n]["result"]["content"][0]["text"]
    assert "a b.ts:1:1" in text(3) and not got[3]["result"]["isError"] and "no-default-export (error)" in text(4) and "good:" in text(5)
    assert got[6]["result"]["isError"] and "tessera/no-default-export" in text(6)
    assert [got[n]["error"]["code"] for n in (7, 8, 10, None)] == [server.INVALID_PARAMS, server.METHOD_NOT_FOUND, server.INVALID_PARAMS, server.PARSE_ERROR] and got[9]["result"] == {}
    (tmp_path / "tessera.json").write_text("{")
    sink = io.BytesIO()
    server.serve_mcp(io.BytesIO(json.dumps(call(1, "tessera_check")).encode() + b"\n"), sink, p)
    assert json.loads(sink.getvalue())["result"]["isError"]


def test_editors_are_answered(spark, tmp_path):
    p = project(spark, tmp_path)
    uri = lambda n: server.uri_of(str(tmp_path / n))
    doc = lambda method, n: {"jsonrpc": "2.0", "method": f"textDocument/{method}", "params": {"textDocument": {"uri": uri(n)}}}
    sink = io.BytesIO()
    server.serve_lsp(framed({"id": 1, "method": "initialize"}, doc("didOpen", "a b.ts"), doc("didOpen", "c.ts"), doc("didClose", "a b.ts"), doc("didSave", "c.ts"), {"id": 2, "method": "other"}, {"id": 3, "method": "shutdown"}, {"method": "exit"}, {"id": 4, "method": "late"}), sink, str(tmp_path), p.violations)
    got = unframed(sink.getvalue())
    published = [(m["params"]["uri"], len(m["params"]["diagnostics"])) for m in got if m.get("method", "").endswith("publishDiagnostics")]
    assert published == [(uri("a b.ts"), 1), (uri("a b.ts"), 1), (uri("c.ts"), 0), (uri("c.ts"), 0)] and "%20" in uri("a b.ts")
    (d,) = next(m for m in got if m.get("method", "").endswith("publishDiagnostics"))["params"]["diagnostics"]
    assert d["range"] == {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 1}} and d["severity"] == 1 and d["code"] == "tessera/no-default-export" and "\n" in d["message"]
    assert {m["id"]: "error" in m for m in got if "id" in m} == {1: False, 2: True, 3: False}
    sink = io.BytesIO()
    server.serve_lsp(framed(doc("didOpen", "c.ts")), sink, str(tmp_path), lambda: 1 / 0)
    assert [m["method"] for m in unframed(sink.getvalue())] == ["window/logMessage", "textDocument/publishDiagnostics"]


def test_what_has_changed(tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.ts").write_text("x")
    (tmp_path / "a.ts").write_text("a")
    (tmp_path / "b.ts").write_text("b")
    before = w.snapshot(str(tmp_path))
    (tmp_path / "a.ts").write_text("aa")
    (tmp_path / "b.ts").unlink()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.ts").write_text("c")
    assert w.changes(before, w.snapshot(str(tmp_path))) == [("a.ts", "edited"), ("b.ts", "deleted"), ("sub/c.ts", "added")]
    assert w.interesting("src/a.ts") and not w.interesting("x/node_modules/a.ts")


def test_edits_and_deletions_start_runs(spark, tmp_path):
    """The stream goes on after a run that failed, and tells what was added, edited and deleted."""
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.ts").write_text("a")
    (root / "b.ts").write_text("b")
    seen, errors = [], []

    def run(df, n):
        seen.append(sorted(map(tuple, df.collect())))
        if len(seen) == 2:
            raise ValueError("broken")

    query = w.watch_tree(spark, str(root), run, str(tmp_path / "state"), on_error=errors.append)
    try:
        def wait(n):
            end = time.time() + 60
            while len(seen) < n and time.time() < end:
                time.sleep(0.1)

        wait(1)
        (root / "a.ts").write_text("more")
        wait(2)
        os.remove(root / "b.ts")
        wait(3)
    finally:
        query.stop()
    assert seen == [[("a.ts", "added"), ("b.ts", "added")], [("a.ts", "edited")], [("b.ts", "deleted")]] and [str(e) for e in errors] == ["broken"]


def test_watching_a_project(spark, tmp_path, capsys):
    project(spark, tmp_path)
    config, _ = configs.load(tmp_path / "tessera.json")
    threading.Timer(0.0, lambda: None).start()
    a = SimpleNamespace(root=str(tmp_path), today="2024-07-01", store=None, format="human", warn_only=False)
    assert cli.follow(spark, a, config, stop=lambda n: True) == 0
    assert "a b.ts:1:1 error [tessera/no-default-export]" in capsys.readouterr().out
