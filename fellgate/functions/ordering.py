"""The order of tag values: numbers by value where both sides have one, else bytes.

A value's number is what its digits, dots and dashes spell, wherever they stand
("12 ft 3" is 123); it has none if they spell no plain decimal, so negative
numbers are strings.  A pure number comes before other spellings of its value.

Against a literal this needs no dictionary: greater and less are closed forms
over built-in functions, and whatever depends on the literal alone is decided
before the query runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[0-9]+\.?[0-9]*|\.[0-9]*")


def number(value: str) -> float | None:
    """The number in a value, if it has one."""
    kept = re.sub(r"[^0-9.\-]", "", value)
    if not _PLAIN.fullmatch(kept):
        return None
    return 0.0 if kept == "." else float(kept)


def is_number(value: str) -> bool:
    return number(value) is not None and re.fullmatch(r"[0-9.\-]+", value) is not None


def less(a: str, b: str) -> bool:
    """Does a come before b? (Both trimmed.) Not transitive over mixed values."""
    x, y = number(a), number(b)
    if x is None or y is None:
        return a.encode() < b.encode()
    return is_number(a) if x == y else x < y


def sorted_values(values: list[str]) -> list[str]:
    """Values in this order, trimmed (stable; mixed values that have no order keep theirs)."""
    import functools

    return sorted((v.strip() for v in values), key=functools.cmp_to_key(lambda a, b: 0 if a == b else -1 if less(a, b) else 1))


def _number_of(value: Column) -> Column:
    kept = F.regexp_replace(value, r"[^0-9.\-]", "")
    return F.when(kept.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]*)$"), F.coalesce(kept.try_cast("double"), F.lit(0.0)))


def _comes_before(literal: str, value: Column) -> Column:
    """less(literal, value) for a column."""
    text = F.lit(literal) < value
    x = number(literal)
    if x is None:
        return text
    y = _number_of(value)
    tie = F.lit(is_number(literal))
    return F.when(y.isNull(), text).when(y == x, tie).otherwise(F.lit(x) < y)


def compare(value: Column, op: str, literal: str) -> Column:
    """value op literal; NULL where value is."""
    if op == "=":
        return value == literal
    if op == "!=":
        return value != literal
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")  # F.trim cuts blanks alone
    same, after = trimmed == literal, _comes_before(literal, trimmed)
    match op:
        case ">":
            return ~same & after
        case ">=":
            return same | after
        case "<":
            return ~same & ~after
        case "<=":
            return same | ~after
    raise ValueError(op)
