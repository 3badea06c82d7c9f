"""The syntax tree of a query: plain values, compared by content."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class ObjectType(Enum):
    """What a statement returns; the word of the language."""

    NODES = "nodes"
    WAYS = "ways"
    RELATIONS = "relations"
    CHILD_RELATIONS = "child_relations"

    @property
    def table(self) -> str:
        """nodes, ways or relations."""
        return "relations" if self is ObjectType.CHILD_RELATIONS else self.value


#: Where membership edges lead, by the type of the context.
TRAVERSALS = {
    "nodes": (ObjectType.WAYS, ObjectType.RELATIONS),
    "ways": (ObjectType.NODES, ObjectType.RELATIONS),
    "relations": (ObjectType.NODES, ObjectType.WAYS, ObjectType.RELATIONS, ObjectType.CHILD_RELATIONS),
}


@dataclass(frozen=True)
class Bbox:
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float


@dataclass(frozen=True)
class This:
    """The object that the surrounding filter looks at."""


@dataclass(frozen=True)
class HasKey:
    """key=* or, if not present, key!=*."""

    key: str
    present: bool


@dataclass(frozen=True)
class Compare:
    """key op value; false for objects without the key, whatever the operator."""

    key: str
    op: str
    value: str


@dataclass(frozen=True)
class And:
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Or:
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Not:
    inner: Filter


@dataclass(frozen=True)
class Statement:
    location: Bbox | This
    type: ObjectType
    filter: Filter
    position: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Related:
    """True if an object that the statement finds around the context exists."""

    statement: Statement


@dataclass(frozen=True)
class Query:
    statements: tuple[Statement, ...]


Filter = HasKey | Compare | And | Or | Not | Related


def explain(node: Query | Statement | Filter | Bbox | This, indent: int = 0) -> str:
    """The tree as indented lines."""
    pad = "  " * indent
    match node:
        case Query(statements):
            return "\n".join([f"{pad}query", *(explain(s, indent + 1) for s in statements)])
        case Statement(location, kind, inner):
            return "\n".join([f"{pad}statement {explain(location)} {kind.value}", explain(inner, indent + 1)])
        case Bbox():
            return f"bbox({node.min_lon}, {node.min_lat}, {node.max_lon}, {node.max_lat})"
        case This():
            return "this"
        case HasKey(key, present):
            return f"{pad}{key}{'=' if present else '!='}*"
        case Compare(key, op, value):
            return f"{pad}{key}{op}{value}"
        case Not(inner):
            return f"{pad}not\n{explain(inner, indent + 1)}"
        case Related(statement):
            return f"{pad}related\n{explain(statement, indent + 1)}"
        case And(left, right) | Or(left, right):
            return f"{pad}{type(node).__name__.lower()}\n{explain(left, indent + 1)}\n{explain(right, indent + 1)}"
    raise TypeError(node)
