import collections
import hashlib
import random

from fellgate.llm import rlz_dedup, suffix_dedup


def brute_bytes(rows, size):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, size):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = b"\1" * size
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_suffix_array(docs, rows):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.dedup(docs)).collect()}
    assert got == brute_bytes(rows, 200) and any(v[1] for v in got.values())


def test_suffix_array_short_threshold(docs, rows):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.dedup(docs, 30)).collect()}
    assert got == brute_bytes(rows, 30)


def test_relative_lempel_ziv(docs, rows):
    got = {r[0]: tuple(r)[1:] for r in rlz_dedup.digest(rlz_dedup.dedup(docs)).collect()}
    assert got == brute_words(rows, 13) and any(v[1] for v in got.values())


def test_relative_lempel_ziv_short_window(docs, rows):
    got = {r[0]: tuple(r)[1:] for r in rlz_dedup.digest(rlz_dedup.dedup(docs, 4)).collect()}
    assert got == brute_words(rows, 4)


def test_factors_name_their_sources(docs, rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    found = 0
    for r in rlz_dedup.dedup(docs).collect():
        covered, before = set(), -1
        for f in r["factors"]:
            own = words[r["doc_id"]][f["start"] : f["start"] + f["length"]]
            assert f["source"] < r["doc_id"] and len(own) == f["length"] >= 13
            assert own == words[f["source"]][f["at"] : f["at"] + f["length"]]
            assert f["start"] > before
            before = f["start"]
            covered |= set(range(f["start"], f["start"] + f["length"]))
            found += f["length"] > 40
        assert len(covered) == r["n_removed"]
    assert found > 10


def test_rows_that_share_a_doc_id(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(f"v{rng.randint(0, 9999)}" for _ in range(n))
    first, other, alone = line(40), line(40), line(25)
    rows = [(1, first), (1, other), (5, alone), (5, first[: len(first) // 2]), (5, alone), (6, other + " " + alone)]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in rlz_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    half = len(first[: len(first) // 2].split())
    # the last word of the half may be cut short, which leaves it and no window with it
    assert [g for g in got if g[0] != 5] == [(1, 40, 0), (1, 40, 0), (6, 65, 65)]
    assert [g for g in got if g[0] == 5 and g[1] == 25] == [(5, 25, 0)] * 2
    assert [g[2] for g in got if g[0] == 5 and g[1] == half][0] >= half - 1


def test_a_passage_that_most_documents_share(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20)) + " " + passage * (i % 3 > 0) + " " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r)[1:] for r in rlz_dedup.digest(rlz_dedup.dedup(df)).collect()} == brute_words(rows, 13)
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.dedup(df)).collect()} == brute_bytes(rows, 200)


def test_edges(empty, odd):
    assert suffix_dedup.dedup(empty).count() == rlz_dedup.dedup(empty).count() == 0
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, 7, 0), (None, 0, 0), (5, 360, 360), (5, 360, 360), (7, 0, 0), (7, 0, 0)], key=str)
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in rlz_dedup.dedup(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, 4, 0), (None, 0, 0), (5, 180, 0), (5, 180, 0), (7, 0, 0), (7, 0, 0)], key=str)
