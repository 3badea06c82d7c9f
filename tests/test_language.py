import pytest

from fellgate.lang.errors import IllegalTraversal, LexError, QueryError, UnexpectedEnd, UnexpectedToken
from fellgate.lang.lexer import Kind, tokens
from fellgate.lang.parser import parse
from fellgate.lang.syntax import And, Bbox, Compare, HasKey, Not, ObjectType, Or, Related, explain


def first(text):
    return parse(f"bbox(1,2,3,4).nodes{{{text}}}").statements[0].filter


# Tokens and their positions.
@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("//skip this\nbbox(1,2,3,4.56)\n//also skip this", [("bbox", 12), ("(", 16), ("1", 17), ("2", 19), ("3", 21), ("4.56", 23), (")", 27)]),
        ("123 // skip this\n234", [("123", 0), ("234", 17)]),
        ("{ 123 }\n// skip this", [("{", 0), ("123", 2), ("}", 6)]),
        ("=!=>>=<<=!<", [("=", 0), ("!=", 1), (">", 3), (">=", 4), ("<", 6), ("<=", 7), ("!", 9), ("<", 10)]),
        ("", []),
    ],
)
def test_tokens(text, found):
    assert [(t.lexeme, t.position) for t in tokens(text)] == found


def test_kinds():
    assert [t.kind for t in tokens("a=*")] == [Kind.KEYWORD, Kind.OPERATOR, Kind.WILDCARD]


@pytest.mark.parametrize("text", ["#%&", "a / b", "a;b", '"x"'])
def test_no_token(text):
    with pytest.raises(LexError):
        tokens(text)


def test_bbox_and_types():
    s = parse("bbox(1.1,2.2,3,4.567).ways{a=b}").statements[0]
    assert (s.location, s.type) == (Bbox(1.1, 2.2, 3.0, 4.567), ObjectType.WAYS)
    assert parse("bbox(-1.5, -2, 3, 4).nodes{a=*}").statements[0].location == Bbox(-1.5, -2, 3, 4)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("a=*", HasKey("a", True)),
        ("a!=*", HasKey("a", False)),
        ("a=b", Compare("a", "=", "b")),
        ("addr:housenumber>=2.5", Compare("addr:housenumber", ">=", "2.5")),
        ("a=b OR c=d AND e=f", Or(Compare("a", "=", "b"), And(Compare("c", "=", "d"), Compare("e", "=", "f")))),
        ("a=b AND c=d OR e=f", Or(And(Compare("a", "=", "b"), Compare("c", "=", "d")), Compare("e", "=", "f"))),
        ("(a=b OR c=d) AND e=f", And(Or(Compare("a", "=", "b"), Compare("c", "=", "d")), Compare("e", "=", "f"))),
        ("!(a=b)", Not(Compare("a", "=", "b"))),
    ],
)
def test_filters(text, found):
    assert first(text) == found


def test_related():
    f = first("this.ways{a=b}")
    assert isinstance(f, Related) and f.statement.type is ObjectType.WAYS
    assert isinstance(first("!this.ways{a=b}"), Not)
    assert "related" in explain(parse("bbox(1,2,3,4).nodes{this.ways{a=b} AND !(c=d)}"))


@pytest.mark.parametrize("text", ["!a=b", "!!(a=b)", "a=<", "!(a b)", "(a=b foo", "a>*", "a<=*", "5", "", "a", "a=", "a=-5", "this.nodes{a=b}", "this.child_relations{a=b}", "bbox(1,2,3,4).ways{a=b}", "a=b OR", "a=b AND AND c=d"])
def test_mistakes_in_filters(text):
    with pytest.raises(QueryError) as e:
        first(text)
    assert e.value.position >= 0 and e.value.as_json()["message"]


@pytest.mark.parametrize("text", ["bbox", "bbox(1,2", "bbox(1,2,3,4)", "bbox(1,2,3,4).", "bbox(1,2,3,4).nodes{a=b", "this.ways{a=b}", "bbox(1,2,3,4).child_relations{a=b}", "bbox(1,2,3,4).things{a=b}", "bbox(a,2,3,4).nodes{a=b}", "bbox(1.2.3,2,3,4).nodes{a=b}", "nodes"])
def test_mistakes_in_statements(text):
    with pytest.raises((UnexpectedEnd, UnexpectedToken)):
        parse(text)


def test_illegal_traversals():
    for context, inner in (("nodes", "nodes"), ("nodes", "child_relations"), ("ways", "ways"), ("ways", "child_relations")):
        with pytest.raises(IllegalTraversal):
            parse(f"bbox(1,2,3,4).{context}{{this.{inner}{{a=b}}}}")
    parse("bbox(1,2,3,4).relations{this.child_relations{this.nodes{a=b}} AND this.relations{a=b}}")


def test_many_statements():
    assert len(parse("bbox(1,2,3,4).nodes{a=b}\nbbox(1,2,3,4).ways{a=b}").statements) == 2
    assert parse("").statements == ()
