"""Personal data in texts, by built-in functions alone.

Method: a regular expression of each kind proposes spans; validators (Luhn for
cards, mod 97 for bank accounts, ranges, counts of digits) confirm them; words
near a span move its score, and spans of 50 points or more stand.  Base kinds
(email, ip, card, phone) stand on their validator alone.

Places of spans: a text cut at the matches gives the stretches between them, and
prefix sums over the lengths of both, by doubling, give each match's place in
code points; m matches cost m log m steps.

Patterns are written so that no text makes them slow: repeats are possessive, and
a match only begins where a run of its characters begins (or the last match
ended), which leaves out starts that cannot match anyway.

Defined results: null text is empty; repeated rows and null ids are searched
like any others; other columns are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 50
#: Code points on either side that are searched for context words.
NEAR = 48


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    """From the right, every second digit counts twice (its digits summed); the total is a multiple of ten."""
    doubled = "translate(substring(d, i, 1), '0123456789', '0246813579')"
    one = f"cast(CASE WHEN (length(d) - i) % 2 = 1 THEN {doubled} ELSE substring(d, i, 1) END AS int)"
    return f"transform(array({_digits(m)}), d -> aggregate(sequence(1, greatest(1, length(d))), 0, (a, i) -> a + coalesce({one}, 0)) % 10 = 0)[0]"


def _mod97(m: str) -> str:
    """The first four characters go to the end, letters count from 10 on, and the number leaves 1 by 97."""
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN a * 10 + ascii(c) - 48 ELSE a * 100 + ascii(c) - 55 END"
    return f"transform(array(regexp_replace({m}, ' ', '')), s -> aggregate(filter(split(concat(substring(s, 5), left(s, 4)), ''), c -> c <> ''), 0, (a, c) -> ({value}) % 97) = 1)[0]"


def _context(words: str) -> str:
    """Does one of the words stand within NEAR code points of the match at x.s to x.e of the text {t}?"""
    before = f"substring({{t}}, cast(greatest(1, x.s + 1 - {NEAR}) AS int), cast(least(x.s, {NEAR}) AS int))"
    after = f"substring({{t}}, cast(x.e + 1 AS int), {NEAR})"
    return rf"(lower(concat({before}, ' ', {after})) RLIKE '(?<![a-z])({words})(?![a-z])')"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # without a match of this no match of the pattern
    points: str  # SQL score of a match m at x.s to x.e of the text {t}


# The patterns, as Java regular expressions.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "100"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", r"CASE WHEN m RLIKE '^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.|$)){4}$' THEN 100 ELSE 0 END"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9]", f"CASE WHEN length({_digits('m')}) BETWEEN 16 AND 19 AND {_luhn('m')} THEN 100 ELSE 0 END"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", f"CASE WHEN length({_digits('m')}) BETWEEN 8 AND 15 THEN 100 ELSE 0 END"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", f"CASE WHEN NOT {_mod97('m')} THEN 0 WHEN {_context('iban|account|konto|compte|cuenta|bank')} THEN 80 ELSE 60 END"),
    Kind("shortcard", r"(?<![0-9.-])[3-6][0-9]{3}(?:[\x20-]?[0-9]){9,11}(?![0-9.-])", r"[0-9]", f"CASE WHEN NOT {_luhn('m')} THEN 0 WHEN {_context('card|credit|amex|diners|visa|karte|carte|tarjeta')} THEN 70 ELSE 30 END"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"-[0-9]{2}-", f"CASE WHEN {_context('ssn|social security|social')} THEN 70 ELSE 30 END"),
)
BASE = ("email", "ip", "card", "phone")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: Kind, text: str) -> str:
    return f"CASE WHEN {text} RLIKE {_sql(kind.gate)} THEN regexp_extract_all({text}, {_sql(kind.pattern)}, 0) ELSE array() END"


def _gaps(kind: Kind, text: str, matches: str) -> str:
    """Lengths of the stretches before each match."""
    return f"CASE WHEN size({matches}) > 0 THEN transform(split({text}, {_sql(kind.pattern)}, -1), x -> length(x)) ELSE array(0) END"


def _placed(matches: str, gaps: str) -> str:
    """Array of (s, e, m): sums of the lengths of gaps and matches, by doubling."""
    lengths = f"zip_with({matches}, slice({gaps}, 1, size({matches})), (m, g) -> cast(g + length(m) AS long))"
    ends = f"aggregate(sequence(0, cast(ceil(log2(greatest(1, size({matches})))) AS int)), {lengths}, (v, d) -> transform(v, (x, i) -> x + CASE WHEN i >= shiftleft(1, d) THEN v[i - shiftleft(1, d)] ELSE 0L END))"
    return f"zip_with({ends}, {matches}, (e, m) -> struct(e - length(m) AS s, e AS e, m AS m))"


def _spans(kind: Kind, text: str, placed: str) -> str:
    """Array of (s, e) of the matches that stand."""
    points = kind.points.replace("{t}", text)
    scored = f"transform({placed}, x -> transform(array(x.m), m -> struct(x.s AS s, x.e AS e, {points} AS points))[0])"
    return f"transform(filter({scored}, x -> x.points >= {THRESHOLD}), x -> struct(x.s AS s, x.e AS e))"


def _found(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with the spans of each kind, by the kind's name behind the prefix."""
    for column, sql in (("m", lambda k, c: _matches(k, text)), ("g", lambda k, c: _gaps(k, text, c("m"))), ("x", lambda k, c: _placed(c("m"), c("g")))):
        df = df.withColumns({f"{prefix}{column}_{k.name}": F.expr(sql(k, lambda of, k=k: f"{prefix}{of}_{k.name}")) for k in KINDS})
    return df.withColumns({prefix + k.name: F.expr(_spans(k, text, f"{prefix}x_{k.name}")) for k in KINDS})


def find(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, an array of (s, e): code points, end exclusive."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _found(df, "text", "").select("doc_id", *(k.name for k in KINDS))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    listed = {k.name: f"transform({k.name}, x -> concat('{k.name}:', x.s, ':', x.e))" for k in KINDS}
    base = f"array_join(concat({', '.join(listed[k] for k in BASE)}), ',')"
    every = f"array_join(concat({', '.join(listed.values())}), ',')"
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with what ``find`` finds replaced by its kind in brackets; columns as they came.

    Spans that overlap go as one, by the kind of the first of them (the longest of those that start together)."""
    df = _found(docs.withColumn("__p_t", F.expr("coalesce(cast(text AS string), '')")), "__p_t", "__p_")
    every = "concat(" + ", ".join(f"transform(__p_{k.name}, x -> struct(x.s AS s, -x.e AS e, '[{k.name.upper()}]' AS k))" for k in KINDS) + ")"
    # the end of all spans before it tells whether a span starts a new one
    ends = "aggregate(__p_all, struct(cast(array() AS array<bigint>) AS v, 0L AS e), (a, x) -> struct(array_append(a.v, a.e) AS v, greatest(a.e, -x.e) AS e), a -> a.v)"
    df = df.withColumn("__p_all", F.expr(f"array_sort({every})")).withColumn("__p_ends", F.expr(f"array_append({ends}, 0L)"))
    heads = "filter(transform(__p_all, (x, i) -> struct(x.s AS s, x.k AS k, __p_ends[i] AS b, i AS i)), x -> x.i = 0 OR x.s >= x.b)"
    df = df.withColumn("__p_heads", F.expr(heads)).withColumn("__p_last", F.expr("aggregate(__p_all, 0L, (a, x) -> greatest(a, -x.e))"))
    pieces = "transform(__p_heads, x -> concat(substring(__p_t, cast(x.b + 1 AS int), cast(x.s - x.b AS int)), x.k))"
    new = f"concat(array_join({pieces}, ''), substring(__p_t, cast(__p_last + 1 AS int)))"
    return df.withColumn("text", F.expr(f"CASE WHEN size(__p_all) > 0 THEN {new} ELSE text END")).select(*docs.columns)
