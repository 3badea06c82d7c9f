import random

import pytest
from pyspark.sql import functions as F

from fellgate.functions.ordering import compare, is_number, less, number, sorted_values


# Orders that must come out as they do elsewhere.
@pytest.mark.parametrize(
    ("given", "found"),
    [
        (["3", "2", "2.5", "1", "-1", "0"], ["-1", "0", "1", "2", "2.5", "3"]),
        (["1a", "1b", "2c", "1", "2"], ["1", "1a", "1b", "2", "2c"]),
        (["1a", "a", "b", "1", "2"], ["1", "1a", "2", "a", "b"]),
        (["a", "foo", "bar", "b"], ["a", "b", "bar", "foo"]),
    ],
)
def test_sorted(given, found):
    random.seed(0)
    assert sorted_values(given) == found


def test_numbers():
    cases = {"1": 1, "2.5": 2.5, "2.5 m": 2.5, "a1": 1, "12 ft 3": 123, "-1": None, ".": 0, "5-LOW": None, "yes": None, "": None, "1.2.3": None, "2.": 2}
    assert {k: number(k) for k in cases} == cases
    assert is_number("2.5") and not is_number("2.5 m") and not is_number("-1")


def test_white_space_around_values(spark):
    rows = [(" 3",), ("3\t",), ("\u00a03\n",), ("\u20035",), ("3 x",), (" 2 ",)]
    df = spark.createDataFrame(rows, "v string")
    got = df.select(compare(F.col("v"), ">=", "3").alias("a"), compare(F.col("v"), "<=", "3").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(True, True), (True, True), (True, True), (True, False), (True, False), (False, True)]


def test_columns_against_python(spark):
    rng = random.Random(3)
    values = ["", " ", "yes", "-1", "5-LOW", ".", "2.", "1.2.3", "é", "12 ft 3"] + [rng.choice(["{}", "{} m", "{}.5", "x{}", " {} "]).format(rng.randint(0, 60)) for _ in range(150)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    for literal in ("20", "20.5", "2.0", "m", "Z", "0", "yes"):
        found = df.select("v", *(compare(F.col("v"), op, literal).alias(op) for op in (">", ">=", "<", "<=", "=", "!="))).collect()
        for r in found:
            if r["v"] is None:
                assert all(x is None for x in r)
                continue
            v = r["v"].strip(" ")
            after = less(literal, v)
            assert r[">"] == (v != literal and after) and r["<"] == (v != literal and not after), (literal, v)
            assert r[">="] == (v == literal or after) and r["<="] == (v == literal or not after)
            assert r["="] == (r["v"] == literal) and r["!="] == (r["v"] != literal)
