"""Rust tokens with their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, life, num, str, char, punct, end
    text: str
    line: int
    last: int


class CodeError(ValueError):
    """The text is not Rust that the parser knows."""


_PUNCT = ["<<=", ">>=", "...", "..=", "::", "->", "=>", "==", "!=", "<=", ">=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "..", "<<", ">>"]
_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)
    |(?P<open>/\*)
    |(?P<raw>(?:b|c)?r(?P<hash>\#*)")
    |(?P<str>(?:b|c)?"(?:[^"\\]|\\.)*")
    |(?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))')
    |(?P<life>'[^\W\d]\w*)
    |(?P<name>r\#[^\W\d]\w*|[^\W\d]\w*)
    |(?P<num>0[xob][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.(?!\.|[^\W\d])[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*)
    |(?P<punct>"""
    + "|".join(re.escape(p) for p in _PUNCT)
    + r"|[^\w\s])",
    re.X | re.S,
)


def stream(text: str) -> Iterator[Token]:
    """One token after the other, so that a long text is never held as tokens."""
    at, line = 0, 1
    if text.startswith("#!") and not text.startswith("#!["):
        at = text.find("\n") if "\n" in text else len(text)
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CodeError(f"line {line}: unknown character {text[at]!r}")
        kind, end = m.lastgroup, m.end()
        if kind in ("name", "punct", "num", "life"):  # the most, and never over the end of a line
            yield Token(kind, m.group(), line, line)
            at = end
            continue
        if m.group("open"):
            depth, end = 1, at + 2
            while depth:
                nxt = re.compile(r"/\*|\*/").search(text, end)
                if not nxt:
                    raise CodeError(f"line {line}: the comment does not end")
                depth += 1 if nxt.group() == "/*" else -1
                end = nxt.end()
            kind = "space"
        elif m.group("raw"):
            close = text.find('"' + m.group("hash"), end)
            if close < 0:
                raise CodeError(f"line {line}: the string does not end")
            kind, end = "str", close + 1 + len(m.group("hash"))
        piece = text[at:end]
        last = line + piece.count("\n")
        if m.group("space") is None and kind != "space":
            yield Token(kind, piece, line, last)
        at, line = end, last
    yield Token("end", "", line, line)


def tokens(text: str) -> list[Token]:
    return list(stream(text))
