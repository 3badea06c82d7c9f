"""Text to tokens. White space and commas separate; // starts a comment to the end of the line."""

from __future__ import annotations

import re
from enum import Enum
from typing import NamedTuple

from fellgate.lang.errors import LexError


class Kind(Enum):
    OPENING_PARENTHESIS = "("
    CLOSING_PARENTHESIS = ")"
    OPENING_BRACE = "{"
    CLOSING_BRACE = "}"
    SEPARATOR = "."
    WILDCARD = "*"
    KEYWORD = "keyword"
    NUMBER = "number"
    OPERATOR = "operator"


class Token(NamedTuple):
    kind: Kind
    lexeme: str
    position: int


_PATTERN = re.compile(
    r"""(?P<skip>[\s,]+|//[^\n]*)
      | (?P<keyword>[A-Za-z_:@]+)
      | (?P<number>-?[0-9][0-9.]*)
      | (?P<operator>!=|<=|>=|[=!<>])
      | (?P<single>[(){}.*])""",
    re.VERBOSE,
)


def tokens(text: str) -> list[Token]:
    """All tokens of a query. A sign is part of a number; the parser allows it in a bbox only."""
    out, at = [], 0
    while at < len(text):
        m = _PATTERN.match(text, at)
        if m is None:
            raise LexError(f"Unexpected character {text[at]!r} at position {at}.", at)
        if m.lastgroup != "skip":
            kind = Kind(m[0]) if m.lastgroup == "single" else Kind(m.lastgroup)
            out.append(Token(kind, m[0], at))
        at = m.end()
    return out
