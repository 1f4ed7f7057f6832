"""Globs as regular expressions for rlike()."""

from __future__ import annotations

import re


class GlobError(ValueError):
    """A glob that cannot be read; names the field it stands in."""

    def __init__(self, field: str, pattern: str, detail: str):
        super().__init__(f"{field}: cannot read glob `{pattern}`: {detail}")
        self.field, self.pattern = field, pattern


def _escape(c: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", c)


def glob_to_regex(pattern: str, field: str = "glob") -> str:
    """A path glob: `*` and `?` also match `/`, `**/` any directories or none, `{a,b}` either, `[..]` a class, `\\` quotes."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        at_start = i == 0 or pattern[i - 1] == "/"
        if pattern.startswith("**/", i) and at_start:
            out.append("(?:.*/)?")
            i += 3
        elif pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out.append(".+")
            i += 2
        elif c == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] not in ("!", "^") else i + 3)
            if end < 0:
                raise GlobError(field, pattern, "unclosed character class")
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            out.append(f"[{'^' if negated else ''}{re.sub(r'([\\\[\]^&~])', r'\\\1', body)}]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
            i += 1
        elif c == "}":
            if not depth:
                raise GlobError(field, pattern, "unopened alternatives")
            depth -= 1
            out.append(")")
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\":
            if i + 1 == len(pattern):
                raise GlobError(field, pattern, "dangling escape")
            out.append(_escape(pattern[i + 1]))
            i += 2
        else:
            out.append(_escape(c))
            i += 1
    if depth:
        raise GlobError(field, pattern, "unclosed alternatives")
    return "(?s)\\A(?:" + "".join(out) + ")\\z"


def any_glob(patterns: list[str], field: str = "glob") -> str | None:
    """One expression for "some pattern matches"; null without patterns."""
    if not patterns:
        return None
    return "(?s)\\A(?:" + "|".join(glob_to_regex(p, field)[len("(?s)\\A(?:") : -len(")\\z")] for p in patterns) + ")\\z"


def star_to_regex(pattern: str) -> str:
    """A module specifier glob: `*` is any run of characters, everything else is itself."""
    return "(?s)\\A" + ".*".join(_escape_all(p) for p in pattern.split("*")) + "\\z"


def _escape_all(text: str) -> str:
    return "".join(_escape(c) for c in text)
