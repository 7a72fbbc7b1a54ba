"""A tokenizer for SQL text that keeps every character."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

PATTERN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<string>'(?:[^']|'')*')
      |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
      |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
      |(?P<word>[^\W\d]\w*)
      |(?P<sign><>|<=|>=|!=|\|\||::|->|.)""",
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokenize(sql: str) -> list[Token]:
    out = [Token(m.lastgroup, m[0]) for m in PATTERN.finditer(sql)]
    if any(t.kind == "sign" and t.text in "'\"`" for t in out):
        raise ParseError("a quote isn't closed")
    return out


def text(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def meaningful(tokens: list[Token]) -> list[int]:
    """Places of the tokens that aren't white space or comments."""
    return [i for i, t in enumerate(tokens) if t.kind != "space"]
