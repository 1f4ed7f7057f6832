import json
import subprocess
from pathlib import Path

import pytest

from tessera.__main__ import main
from tessera.config import ConfigError, parse

GOOD = {"include": ["src/**"], "rules": ["tessera/no-default-export", {"rule": "no-restricted-imports", "options": {"restrictions": [{"module": "lodash"}]}}], "timeouts": {"global": 600000}}


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("export default x\n")
    (tmp_path / "src/b.ts").write_text("import l from 'lodash'\n")
    (tmp_path / "other.ts").write_text("export default y\n")
    (tmp_path / "tessera.json").write_text(json.dumps(GOOD))
    return tmp_path


def test_configuration_is_strict(tmp_path):
    config, limits = parse(json.dumps(GOOD), tmp_path)
    assert [r.id for r in config.rules] == ["tessera/no-default-export", "tessera/no-restricted-imports"] and limits.rule == 1_000 and limits.whole == 600_000
    (tmp_path / "r.py").write_text("from tessera.plans.builtin import no_unwrap\ndef make(**o):\n    r = no_unwrap(**o)\n    r.__init__('mine/r', r.query, r.card, r.check, ('rust',))\n    return r\n")
    config, _ = parse(json.dumps({"rules": [{"rule": "./r.py", "options": {"allow": []}}], "namespaces": ["mine"]}), tmp_path)
    assert [r.id for r in config.rules] == ["mine/r"]
    for bad in ({"rule": []}, {"include": "src"}, {"include": ["[a"]}, {"severity": {"x": "warn"}}, {"severity": {"a/b": "loud"}}, {"timeouts": {"rule": 0}}, {"timeouts": {"x": 1}}, {"rules": ["other/x"]}, {"rules": ["tessera/none"]}, {"rules": [{"rule": "no-unwrap", "options": {"x": 1}}]}, {"rules": [{"rule": "no-unwrap", "options": {"maxDepth": 1}}]}, {"rules": ["no-unwrap", "tessera/no-unwrap"]}, {"rules": ["../x.py"]}, {"rules": ["./none.py"]}, {"rules": ["./r.py"]}, {"namespaces": ["tessera"]}, []):
        with pytest.raises(ValueError):
            parse(json.dumps(bad), tmp_path)
    with pytest.raises(ConfigError):
        parse("{", tmp_path)


def test_check_renders_and_exits(spark, project, capsys):
    root = str(project)
    assert main(["check", "--root", root], spark) == 1
    assert capsys.readouterr().out.splitlines() == ["src/a.ts:1:1 error [tessera/no-default-export] default export", "  → export a name, so that importers and searches agree on it", "src/b.ts:1:1 error [tessera/no-restricted-imports] importing 'lodash' is restricted — this import is not allowed here", "  → use what this part of the tree may depend on, or do the work elsewhere", "2 errors"]
    assert main(["check", "--root", root, "--format", "json", "--warn-only"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["ok"] and report["total"] == 2 and report["files_discovered"] == 2
    assert main(["check", "--root", root, "--config", str(project / "none.json")], spark) == 2
    assert main(["rules", "--root", root]) == 0 and json.loads(capsys.readouterr().out.split("\n", 0)[0])["enabled"] == 2
    assert main(["explain", "tessera/no-default-export", "--root", root]) == 0 and main(["explain", "x/y", "--root", root]) == 2


def test_selections_and_store(spark, project, capsys):
    root, store = str(project), str(project / ".store")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    Path(root, "src/b.ts").write_text("export const fine = 1\n")
    assert main(["check", "--root", root, "--since", "HEAD"], spark) == 0 and "no violations" in capsys.readouterr().out
    assert main(["check", "--root", root, "--staged"], spark) == 0
    assert main(["check", "--root", root, "--since", "nowhere"], spark) == 2
    assert main(["check", "--root", root, "--store", store], spark) == 1 == main(["check", "--root", root, "--store", store], spark)


def test_run_limit(spark, project):
    (project / "tessera.json").write_text(json.dumps(GOOD | {"timeouts": {"global": 1}}))
    assert main(["check", "--root", str(project)], spark) == 2


def test_profile_and_side_files(spark, project, capsys):
    (project / "r.py").write_text("from tessera.plans.handlers import handler\nfrom tessera.plans.rule import Card, Rule\ndef check(ctx, m):\n    ctx.report(m['p'], str(ctx.read_file('notes.txt')))\nrule = Rule('local/r', '(program) @p', Card('m', 'r', 'a', 'b'), handler(check), reads=('notes.txt',))\n")
    (project / "notes.txt").write_text("hello")
    (project / "tessera.json").write_text(json.dumps(GOOD | {"rules": ["./r.py"]}))
    assert main(["check", "--root", str(project), "--profile"], spark) == 1
    said = capsys.readouterr()
    assert said.out.splitlines()[0] == "src/a.ts:1:1 error [local/r] hello" and "local/r" in said.err and "2 matches" in said.err
    (project / "notes.txt").unlink()
    (project / "notes.txt").symlink_to("/etc/hostname")
    assert main(["check", "--root", str(project)], spark) == 2 and "outside" in capsys.readouterr().err


def test_configuration_programs_and_packaged_rules(tmp_path, monkeypatch):
    from tessera.config import load

    (tmp_path / "tessera_config.py").write_text("from tessera.config import Limits\nfrom tessera.plans.builtin import no_unwrap\nfrom tessera.plans.engine import Config\nconfig = Config([no_unwrap()], include=['src/**'])\nlimits = Limits(rule=77)\n")
    config, limits = load(tmp_path / "tessera_config.py")
    assert [r.id for r in config.rules] == ["tessera/no-unwrap"] and limits.rule == config.timeout_ms == 77
    for text in ("config = 1\n", "x\n"):
        (tmp_path / "bad.py").write_text(text)
        with pytest.raises(ConfigError):
            load(tmp_path / "bad.py")
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "ours_rules.py").write_text("from tessera.plans.builtin import no_unwrap\ndef make(allow):\n    r = no_unwrap(allow)\n    r.__init__('local/ours', r.query, r.card, r.check, r.languages)\n    return r\n")
    config, _ = parse(json.dumps({"rules": [{"rule": "ours_rules:make", "options": {"allow": []}}]}), tmp_path)
    assert [r.id for r in config.rules] == ["local/ours"]
    with pytest.raises(ConfigError):
        parse(json.dumps({"rules": ["ours_rules:nothing"]}), tmp_path)
