"""Configuration files: strict JSON, read on the driver."""

from __future__ import annotations

import importlib
import importlib.util
import json
from dataclasses import dataclass
from pathlib import Path

from tessera.functions.globs import any_glob
from tessera.functions.identifiers import RuleId
from tessera.plans import builtin
from tessera.plans.engine import Config
from tessera.plans.rule import Rule, RuleError

#: Keys of the file; anything else is a mistake and is refused.
KEYS = ("$schema", "include", "exclude", "namespaces", "severity", "timeouts", "rules")
#: Option names as files write them -> parameters of rule factories.
OPTIONS = {"entryPoints": "entry_points", "maxDepth": "max_depth", "restrictions": "restrictions", "allow": "allow", "scope": "scope"}
NAME = "tessera.json"


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass(frozen=True)
class Limits:
    """Budgets in milliseconds: of one call of a handler, and of a whole run; a run has none unless the file gives it, as a cluster's runs vary by orders."""

    rule: int = 1_000
    whole: int | None = None


def _strings(value: object, key: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"`{key}` is a list of strings")
    return value


def _factory(name: str, base: Path, options: dict) -> Rule:
    if name.startswith("."):  # a Python file of the project, with a `rule` or a factory `make`
        path = (base / name).resolve()
        if not path.is_relative_to(base.resolve()):
            raise ConfigError(f"rule `{name}` lies outside the project")
        if not path.is_file():
            raise ConfigError(f"rule `{name}` is not there")
        spec = importlib.util.spec_from_file_location(f"tessera_rule_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        made = module.make(**options) if hasattr(module, "make") else getattr(module, "rule", None)
        if not isinstance(made, Rule):
            raise ConfigError(f"rule `{name}` exports neither `rule` nor `make`")
        return made
    if ":" in name:  # an installed package's factory, module:name
        module, _, attribute = name.partition(":")
        try:
            made = getattr(importlib.import_module(module), attribute)
        except (ImportError, AttributeError) as e:
            raise ConfigError(f"rule `{name}`: {e}") from None
        made = made if isinstance(made, Rule) else made(**options)
        if not isinstance(made, Rule):
            raise ConfigError(f"rule `{name}` is none")
        return made
    known = name if name in builtin.FACTORIES else f"{builtin.NAMESPACE}/{name.rpartition('/')[2]}"
    if known not in builtin.FACTORIES or "/" in name and not name.startswith(f"{builtin.NAMESPACE}/"):
        raise ConfigError(f"unknown rule `{name}`")
    unknown = set(options) - set(OPTIONS)
    if unknown:
        raise ConfigError(f"rule `{name}`: unknown option `{sorted(unknown)[0]}`")
    try:
        return builtin.FACTORIES[known](**{OPTIONS[k]: v for k, v in options.items()})
    except TypeError as e:
        raise ConfigError(f"rule `{name}`: {e}") from None


def parse(text: str, base: Path) -> tuple[Config, Limits]:
    """A file's text -> what it configures. The first mistake is reported, by its key."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError(f"not JSON: {e}") from None
    if not isinstance(raw, dict):
        raise ConfigError("a configuration is an object")
    for key in raw:
        if key not in KEYS:
            raise ConfigError(f"unknown key `{key}`")
    include, exclude, namespaces = (_strings(raw.get(k, []), k) for k in ("include", "exclude", "namespaces"))
    any_glob(include, "include")
    any_glob(exclude, "exclude")
    severity = raw.get("severity", {})
    if not isinstance(severity, dict):
        raise ConfigError("`severity` is an object of rule ids")
    for key in severity:
        RuleId.parse(key)
    timeouts = raw.get("timeouts", {})
    if not isinstance(timeouts, dict) or set(timeouts) - {"rule", "global"} or not all(isinstance(v, int) and v > 0 for v in timeouts.values()):
        raise ConfigError("`timeouts` holds `rule` and `global`, in milliseconds")
    rules, listed = [], raw.get("rules", [])
    if not isinstance(listed, list):
        raise ConfigError("`rules` is a list")
    for entry in listed:
        if isinstance(entry, str):
            entry = {"rule": entry}
        if not isinstance(entry, dict) or set(entry) - {"rule", "options"} or not isinstance(entry.get("rule"), str) or not isinstance(entry.get("options", {}), dict):
            raise ConfigError("an entry of `rules` is a name, or an object of `rule` and `options`")
        rules.append(_factory(entry["rule"], base, entry.get("options", {})))
    if len({r.id for r in rules}) < len(rules):
        raise ConfigError("a rule is listed twice")
    limits = Limits(timeouts.get("rule", Limits.rule), timeouts.get("global", Limits.whole))
    return Config(rules, include, exclude, severity, ["local", *namespaces], timeout_ms=limits.rule), limits


def program(path: Path) -> tuple[Config, Limits]:
    """A configuration that a Python file makes: its `config`, and `limits` if it has any."""
    spec = importlib.util.spec_from_file_location("tessera_config", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    config, limits = getattr(module, "config", None), getattr(module, "limits", Limits())
    if not isinstance(config, Config) or not isinstance(limits, Limits):
        raise ConfigError("a configuration program has a `config`, of Config, and may have `limits`, of Limits")
    config.timeout_ms = limits.rule
    return config, limits


def load(path: str | Path) -> tuple[Config, Limits]:
    path = Path(path)
    if path.suffix == ".py":
        try:
            return program(path)
        except ConfigError as e:
            raise ConfigError(f"{path}: {e}") from None
        except Exception as e:
            raise ConfigError(f"{path}: {type(e).__name__}: {e}") from e
    try:
        text = path.read_text("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"cannot read {path}: {e}") from None
    try:
        return parse(text, path.parent)
    except (ConfigError, RuleError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from None
