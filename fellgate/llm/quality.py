"""Quality rules: a table of thresholds compiled into one Spark projection.

Method: counts of words, characters, symbols, stop words and lines are built-in
functions over the arrays of a text's words and lines; each row of RULES becomes
one comparison of whole numbers, and a document is kept if all hold.  There are
no user functions, and rows never leave their partition.

Words that lie in a 5-word window found twice are counted from hashes of the
windows: sorted with their positions, equal neighbours mark repeated windows, and
one pass over the sorted positions adds up what they cover.

Defined results: null text has no words (and fails the length rule); repeated
rows and null ids are judged like any others; other columns are kept by
``keep`` and ignored by ``measure``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of the four languages.
STOP_WORDS = ("the be to of and that have with for is in on it this are as was or "
              "der die und das den von mit ist ein eine zu auf für im nicht als sich "
              "de la le les des et un une que en est pour dans par sur au du qui "
              "el los las y del se por con para no una su es al lo").split()  # fmt: skip

#: (name, condition that rejects a document). The first two are the base.
RULES = (
    ("too few words", "n_words < 10"),
    ("repeated 5-word windows", "100 * n_repeat_words > 20 * n_words"),
    ("mean word too short", "10 * word_chars < 25 * n_words"),
    ("mean word too long", "word_chars > 15 * n_words"),
    ("symbols for each word", "100 * n_symbols > 20 * n_words"),
    ("no stop words", "n_words >= 50 AND n_stop_words < 2"),
    ("repeated lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("lines that end in an ellipsis", "n_lines >= 4 AND 100 * n_ellipsis_lines > 30 * n_lines"),
    ("lines that start with a bullet", "n_lines >= 4 AND 100 * n_bullet_lines > 90 * n_lines"),
)
BASE = 2
SPACE = r"[\\x20\\x09-\\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Each value is named by a lambda's variable, so that the optimizer, which copies what a projection has named into a
#: filter above it, computes each once for a row however often the later ones use it.
STEPS = (
    ("t", "coalesce(cast(text AS string), '')"),
    ("w", f"filter(split(t, '{SPACE}'), x -> x <> '')"),
    ("l", r"filter(split(t, '\\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"),
    ("h", "transform(w, x -> xxhash64(x))"),
    ("g", "CASE WHEN size(w) >= 5 THEN transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])) ELSE array() END"),
    ("s", "CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> struct(x AS x, i AS i))) ELSE array() END"),
)
COUNTS = {
    "n_words": "size(w)",
    "word_chars": "length(translate(t, ' \\u0009\\u000a\\u000b\\u000c\\u000d', ''))",
    "n_symbols": "length(t) - length(translate(t, '#*$%&|<>', ''))",
    "n_lines": "size(l)",
    "n_dup_lines": "size(l) - size(array_distinct(l))",
    "n_ellipsis_lines": r"size(filter(l, x -> x RLIKE '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))",
    "n_bullet_lines": r"size(filter(l, x -> x RLIKE '^[\\x20\\x09-\\x0D]*[-*•]'))",
    "n_stop_words": f"size(filter(w, x -> lower(x) IN ({', '.join(repr(x) for x in sorted(set(STOP_WORDS)))})))",
    "n_repeat_words": "aggregate(sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[i - 1].x = x.x) OR (i < size(s) - 1 AND s[i + 1].x = x.x)), x -> x.i)), struct(0L AS e, 0L AS n), (a, i) -> struct(i + 5L AS e, a.n + i + 5L - greatest(cast(i AS long), a.e) AS n), a -> a.n)",
}


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _verdicts(prefix: str = "") -> tuple[str, str]:
    """SQL of (base_failed, kept)."""
    conditions = ["(" + " ".join(prefix + x if x in COUNTS else x for x in sql.split()) + ")" for _, sql in RULES]
    return " OR ".join(conditions[:BASE]), f"NOT ({' OR '.join(conditions)})"


def _judged() -> str:
    """SQL of one struct: the counts, base_failed and kept, from the column text alone."""
    failed, kept = _verdicts("c.")
    counts = ", ".join(f"cast({sql} AS long) AS {name}" for name, sql in COUNTS.items())
    out = _let("c", f"struct({counts})", f"struct({', '.join(f'c.{m} AS {m}' for m in MEASURES)}, {failed} AS base_failed, {kept} AS kept)")
    for name, value in reversed(STEPS):
        out = _let(name, value, out)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(_judged()).alias("m")).select("doc_id", "m.*")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return docs.where(F.expr(_judged() + ".kept"))


def oracle(table: str = "documents") -> str:
    """measure() in DuckDB's SQL."""
    failed, kept = _verdicts()
    space = r"[\x20\x09-\x0D]"
    stops = ", ".join(repr(x) for x in sorted(set(STOP_WORDS)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
a AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM a WHERE len(w) >= 5),
g AS (SELECT r, i, w[i:i + 4] AS g FROM p),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
v AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, generate_series(0, 4) AS o(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…){space}*$'))) AS n_ellipsis_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^{space}*[-*•]'))) AS n_bullet_lines,
  len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words FROM a LEFT JOIN v USING (r))
SELECT doc_id, {', '.join(MEASURES)}, {failed} AS base_failed, {kept} AS kept FROM m"""
