"""What can be wrong with the text of a query. All have a position and serialise to JSON."""

from __future__ import annotations


class QueryError(ValueError):
    """Base: message and position (in characters from the start)."""

    def __init__(self, message: str, position: int, **details: str) -> None:
        super().__init__(message)
        self.message, self.position, self.details = message, position, details

    def as_json(self) -> dict:
        return {"message": self.message, "position": self.position, **self.details}


class LexError(QueryError):
    """A character that begins no token."""


class UnexpectedToken(QueryError):
    """Another token than the expected one."""

    def __init__(self, expected: str, position: int, lexeme: str, kind: str) -> None:
        super().__init__(f"Expected {expected} at position {position}, found {lexeme!r} ({kind}).", position, currentLexeme=lexeme, currentKind=kind, expectedMessage=expected)


class UnexpectedEnd(QueryError):
    """The text ends where more was expected."""

    def __init__(self, expected: str, position: int) -> None:
        super().__init__(f"The query ends at position {position}, expected {expected}.", position, expectedMessage=expected)


class IllegalTraversal(QueryError):
    """A sub-statement asks for objects that its context does not have."""
