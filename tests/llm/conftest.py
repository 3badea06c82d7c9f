import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, runs int, kept string"


def awkward(rows):
    """Rows with nulls, repeats and extra columns whose names the operators use inside."""
    return [(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in rows]


def make_texts(seed=5, n=70):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("re", "Thé", "in", "ou", "st") for b in ("a", "tion", "ß", "nd,", "er.")]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [line(60) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [line(rng.randint(1, 60)) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, rng.choice(["\n", " ", "\t"]).join(parts)))
    rows += [(n + k, rows[3 * k][1]) for k in range(6)]  # exact copies
    rows += [(n + 10 + k, rows[k][1].replace("tion", "Tion", 1)) for k in range(6)]  # near copies
    rows += [(n + 20, ""), (n + 21, None), (n + 22, " \n "), (n + 23, "one"), (n + 24, "Á é 中文 \U0001f600"), (n + 25, "ab " * 3000), (n + 26, passages[0] + " " + passages[0])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(awkward(rows), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and rows that repeat."""
    return spark.createDataFrame(awkward([(None, "a b c d"), (None, None), (5, "x y z " * 60), (5, "x y z " * 60), (7, None), (7, None)]), SCHEMA)
