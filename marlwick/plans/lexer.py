"""Tokens of the dialect: words in any case, numbers, quoted strings, operators, punctuation, line comments."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import ParseError


class Token(NamedTuple):
    kind: str  # word, int, float, string, op, punct, param, end
    value: str
    at: int


_SCAN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*)
      |(?P<float>\d+\.\d+)|(?P<int>\d+)
      |(?P<string>'(?:[^']|'')*')
      |(?P<word>[^\W\d]\w*)
      |(?P<param>\$\d+)
      |(?P<op>[-+*/%<>=!&|@?~^\#]+)
      |(?P<punct>[(),.;\[\]])""",
    re.X,
)
#: Characters that let a longer operator end in a sign, as in @-; otherwise the sign is the next expression's.
_ODD = set("~!@#%^&|?")


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        kind, value = m.lastgroup, m[0]
        if kind == "op":
            cut = value.find("--")
            if cut > 0:
                value = value[:cut]
            while len(value) > 1 and value[-1] in "+-" and not _ODD & set(value):
                value = value[:-1]
            if len(value) > 1 and value[-1] == "*" and value[:-1] in ("+", "-", "*", "/", "%"):
                value = value[:-1]
        if kind == "word":
            value = value.lower()
        elif kind == "string":
            value = value[1:-1].replace("''", "'")
        if kind != "skip":
            out.append(Token(kind, value, at))
        at += len(m[0]) if kind != "op" else len(value)
    out.append(Token("end", "", len(text)))
    return out
