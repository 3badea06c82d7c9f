import hashlib
import random
import re

from fellgate.llm import pii, quality

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c.isdigit()]


def luhn(s):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(digits(s)))) % 10 == 0


def base(t):
    tests = (("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(x) < 256 for x in s.split("."))), ("card", CARD, lambda s: 16 <= len(digits(s)) <= 19 and luhn(s)), ("phone", PHONE, lambda s: 8 <= len(digits(s)) <= 15))
    return [[f"{k}:{m.start()}:{m.end()}" for m in p.finditer(t) if ok(m[0])] for k, p, ok in tests]


def test_pii_against_regular_expressions(spark):
    rng = random.Random(5)
    pool = ["a@b.c", " a.b@x-y.co.uk", "_", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "1.2.3.4", ".5", "999.1.1.1", "0001.2.3.4", " ", "@", "é", "\U0001f600", "x", "1", "- ", "+49-30-1234", "a.b", "+", "\n", "4799134681044206", "%"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    rows += [(9001, None), (None, "q@w.e"), (9002, "1 " * 20000), (9003, "a" * 20000 + "@"), (9004, "a@b.c " * 2000), (9005, "+1" * 5000), (9005, "+1" * 5000)]
    for r in pii.digest(pii.find(spark.createDataFrame([(*x, "m") for x in rows], "doc_id long, text string, m_email string"))).collect():
        found = base(dict(rows)[r["doc_id"]] or "") if r["doc_id"] != 9003 else [[]] * 4
        assert [r[f"n_{k}"] for k in pii.BASE] == [len(x) for x in found]
        joined = ",".join(sum(found, []))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in pii.BASE) == joined


def test_pii_added_kinds_and_redaction(spark, empty):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00."), (2, "DE89 3704 0044 0532 0130 01"), (3, "my card is 378282246310005 ok"), (4, "number 378282246310005"), (5, "ssn 123-45-6789"), (6, "part 123-45-6789"), (7, "mail é x@y.org, call +49 30 123456"), (8, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, extra int")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    assert spans == {1: "iban:5:32", 2: "", 3: "shortcard:11:26", 4: "", 5: "ssn:4:15", 6: "", 7: "email:7:14,phone:21:34", 8: ""}
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert text[7] == "mail é [EMAIL], call [PHONE]" and text[1] == "IBAN [IBAN]." and text[6] == "part 123-45-6789" and text[8] is None
    assert pii.digest(pii.find(empty)).count() == 0 and pii.redact(df).columns == df.columns


def test_redaction_follows_the_spans(spark):
    rng = random.Random(6)
    pool = ["a@b.c", "+1 (555) 123-4567", "4111 1111 1111 1111", "378282246310005", " card ", "1.2.3.4", "ssn ", "123-45-6789", ", ", " x é ", "\U0001f600", "DE89 3704 0044 0532 0130 00"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(400)]
    rows += [(1001, "SSN: 123-45-6789, 987-65-4321 or 321-54-9876"), (1002, "4111111111111111, ref 378282246310005 end"), (1003, "a@b.c " * 900), (1004, None), (1005, "+4111 1111 1111 1111"), (None, "x a@b.c"), (None, "x a@b.c")]
    df = spark.createDataFrame([(*r, "t", "p") for r in rows], "doc_id long, text string, __t string, email string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    out = pii.redact(df)
    assert out.columns == df.columns
    seen = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(seen) == len(rows)
    texts = dict(rows)
    for doc, text in seen:
        found = sorted(((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans[doc].split(",") if x)), key=lambda x: x[:2])
        left, at = [], 0
        for s, e, k in found:
            if s >= at:
                left += [texts[doc][at:s], f"[{k.upper()}]"]
            at = max(at, -e)
        assert text == (None if texts[doc] is None else "".join(left) + texts[doc][at:])
    assert spans[1001] == "ssn:5:16,ssn:33:44" and dict(seen)[1002].endswith("ref 378282246310005 end")


def test_pii_is_native(docs):
    plan = pii.digest(pii.find(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, docs, rows, empty):
    more = [(900, "fluff " * 30 + "\n" + "fluff"), (901, "a b c d e f g h i j k\n" * 3), (902, "w### x$$$ y%% " * 10), (903, "\f\v\r\n x  y\t z"), (904, None)]
    given = [r for r in rows if len(r[1] or "") < 5000] + more
    df = spark.createDataFrame([(*r, 0) for r in given], "doc_id long, text string, n_words int")
    for r in quality.measure(df).collect():
        assert tuple(r)[1:7] == brute_quality(dict(given)[r["doc_id"]]), r
        assert not (r["base_failed"] and r["kept"])
    clean = "The house is old and the garden is small. A cat sleeps on the wall that we built for it in spring."
    kept = quality.keep(spark.createDataFrame([(1, clean, 3), (2, "word ### $$$ %%% " * 9, 4)], "doc_id long, text string, n_words int"))
    assert [tuple(r) for r in kept.collect()] == [(1, clean, 3)]
    assert quality.measure(empty).count() == 0


def test_quality_oracle(spark, rows):
    import duckdb

    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    for r in rows:
        db.execute("INSERT INTO documents VALUES (?, ?)", r)
    want = sorted(db.sql(quality.oracle()).fetchall(), key=str)
    assert sorted((tuple(r) for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


def test_keep_computes_each_value_once(docs):
    """A filter on named values must not copy what names them: the plan stays as small as the rules are."""
    for df in (quality.keep(docs), quality.measure(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 4 and plan.count("xxhash64(") <= 4


def test_long_texts_with_repeated_windows(spark):
    import time

    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 999)} and the" for _ in range(6700))) for i in range(3)]  # 20,100 words each
    rows += [(9, " ".join(f"w{i} and the" for i in range(6700)))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, c string")
    began = time.perf_counter()
    got = {r["doc_id"]: tuple(r) for r in quality.measure(df).collect()}
    kept = {r["doc_id"] for r in quality.keep(df).collect()}
    assert time.perf_counter() - began < 60
    assert kept == {9} == {i for i, r in got.items() if r[7]}
    for i, t in rows:
        w = t.split()
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        assert got[i][1] == len(w) and got[i][5] == len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)})


def test_keep_over_the_sample(spark):
    import time

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    began = time.perf_counter()
    kept = {r["doc_id"] for r in quality.keep(docs).select("doc_id").collect()}
    assert time.perf_counter() - began < 60
    assert kept == {r["doc_id"] for r in quality.measure(docs).where("kept").collect()}
    assert quality.keep(docs).columns == docs.columns
