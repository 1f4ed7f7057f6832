"""A small lexer for the curly-brace languages: enough to find declarations, never fails."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Token classes, tried in order. Byte patterns, so that offsets are byte offsets.
_COMMON = [("space", rb"[ \t\r\n\x0b\x0c]+"), ("comment", rb"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?")]
_NAME = ("name", rb"[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*")
_NUMBER = ("number", rb"[0-9][A-Za-z0-9_.]*")
_STRINGS = ("string", rb"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?")
_JS_MARK = ("mark", rb"=>|\.\.\.|===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\*\*=|\*\*|<<=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[^\x00]")
_GO_MARK = ("mark", rb"\.\.\.|:=|<-|&&|\|\||==|!=|<=|>=|\+\+|--|<<=|>>=|&\^=|&\^|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[^\x00]")
_RUST_MARK = ("mark", rb"=>|\.\.=|\.\.\.|\.\.|::|->|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[^\x00]")
LEXERS = {
    "js": [*_COMMON, ("template", rb"`"), _STRINGS, _NAME, _NUMBER, _JS_MARK],
    "go": [*_COMMON, ("string", rb"`[^`]*`?|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"), _NAME, _NUMBER, _GO_MARK],
    "rust": [*_COMMON, ("string", rb"b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|b?\"(?:[^\"\\]|\\[\s\S])*\"?|b?'(?:[^'\\\n]|\\[^\n]{1,8}?)'"), ("lifetime", rb"'[A-Za-z_][A-Za-z0-9_]*"), _NAME, ("number", rb"[0-9](?:[A-Za-z0-9_]|\.(?=[0-9]))*"), _RUST_MARK],
}
_COMPILED = {k: re.compile(b"|".join(b"(?P<%s>%s)" % (n.encode(), p) for n, p in v), re.S) for k, v in LEXERS.items()}
#: A slash after one of these starts a regular expression in JavaScript.
_BEFORE_REGEX = frozenset(b"( [ { } , ; = : ? ! & | + - * % ^ ~ < > => == != === !== && || ?? += -= *= <= >= ++ -- return typeof case in of void delete".split())
_REGEX = re.compile(rb"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


class Token(NamedTuple):
    kind: str
    text: bytes
    start: int
    end: int


def lex(source: bytes, family: str) -> list[Token]:
    """Tokens without white space and comments."""
    out: list[Token] = []
    at, pattern = 0, _COMPILED[family]
    while at < len(source):
        if family == "js" and source[at : at + 1] == b"/" and source[at + 1 : at + 2] not in (b"/", b"*") and (not out or out[-1].text in _BEFORE_REGEX):
            m = _REGEX.match(source, at)
            if m:
                out.append(Token("regex", m.group(), at, m.end()))
                at = m.end()
                continue
        m = pattern.match(source, at)
        if not m:
            at += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "h":  # the marks of a raw string
            kind = "string"
        if kind == "template":
            end = template_end(source, at)
        if kind not in ("space", "comment"):
            out.append(Token(kind, source[at:end], at, end))
        at = end
    return out


def substitution_end(text: bytes, k: int) -> int:
    """Index of the brace that closes a template's substitution whose contents start at k."""
    depth = 0
    while k < len(text):
        c = text[k]
        if c == 92:  # backslash
            k += 1
        elif c == 123:
            depth += 1
        elif c == 125:
            if not depth:
                return k
            depth -= 1
        elif c in (34, 39):
            end = text.find(c, k + 1)
            k = end if end > 0 else k
        elif c == 96:
            k = template_end(text, k) - 1
        k += 1
    return len(text)


def template_end(text: bytes, k: int) -> int:
    """Index after the backquote that closes the template that opens at k."""
    k += 1
    while k < len(text):
        c = text[k]
        if c == 92:
            k += 1
        elif c == 96:
            return k + 1
        elif c == 36 and text[k + 1 : k + 2] == b"{":
            k = substitution_end(text, k + 2)
        k += 1
    return len(text)


_OPEN, _CLOSE = {b"(": b")", b"[": b"]", b"{": b"}"}, {b")", b"]", b"}"}


def matching(tokens: list[Token]) -> list[int]:
    """For each opening bracket the index of its closing one (or the last token), for others their own index."""
    out, stack = list(range(len(tokens))), []
    for i, t in enumerate(tokens):
        if t.kind == "mark" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "mark" and t.text in _CLOSE:
            while stack:
                j = stack.pop()
                if _OPEN[tokens[j].text] == t.text:
                    out[j] = i
                    break
                out[j] = i - 1
    for j in stack:
        out[j] = len(tokens) - 1
    return out
