"""The pipeline stage by stage against brute force, over a small corpus."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_dedup import brute_bytes
from tests.llm.test_jaccard import brute
from tests.llm.test_rules_and_pii import brute_quality


def corpus():
    rng = random.Random(9)
    stop = ["the", "of", "and", "is", "in"]
    text = lambda n: " ".join(rng.choice(stop) if rng.random() < 0.3 else f"w{rng.randint(0, 99999)}x" for _ in range(n))
    passage = text(60)
    rows = [(i, text(rng.randint(30, 200))) for i in range(40)]
    rows += [(50 + i, text(40) + " " + passage + " " + text(30)) for i in range(5)]
    rows += [(60, rows[3][1]), (61, rows[4][1] + " end"), (62, "short"), (63, None), (64, text(30) + " mail me@there.org now"), (65, "junk ### " * 30)]
    return rows


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = [(i, t) for i, t in rows if not brute_quality(t)[5] and brute_quality(t)[2] <= 0.2 * brute_quality(t)[0]]
    keep = {c for _, _, c in brute(rows)}
    rows = [r for r in rows if r[0] in keep]
    assert 60 not in keep and 61 not in keep and {62, 63, 65}.isdisjoint(keep)
    removed = brute_bytes(rows, 200)
    assert sum(v[1] > 0 for v in removed.values()) == 5
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    seen = collections.Counter()
    for i, t in rows:
        b = t.encode()
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    lengths = collections.Counter()
    for r in got:
        lengths[r["doc_id"]] += r["length"]
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        left = bytes(x for x, g in zip(b, gone) if not g).decode().replace("me@there.org", "[EMAIL]")
        ids = [*lib.encode(left, add_special_tokens=False).ids, 0]
        assert lengths[i] == len(ids)
        if len(ids) <= 2048:
            assert [r["ids_crc32"] for r in got if r["doc_id"] == i] == [zlib.crc32(np.array(ids, "<u4").tobytes())]
    assert set(lengths) == {i for i, _ in rows}


def test_stages_keep_columns(spark, docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def near_components(rows, n=5, num=8, den=10):
    """Least doc_id of each document's component, by an inverted index over shared shingles."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else {tuple(w)} if w else set()
    places = collections.defaultdict(list)
    for i, own in sets.items():
        for x in own:
            places[x].append(i)
    both = collections.Counter()
    for own in places.values():
        if len(own) > 1:
            both.update((a, b) for a in own for b in own if a < b)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in both.items():
        if den * k >= num * (len(sets[a]) + len(sets[b]) - k):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


def without_repeats(rows, size=200):
    seen = collections.Counter(hash(b[k : k + size]) for b in ((t or "").encode() for _, t in rows) for k in range(len(b) - size + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[hash(b[k : k + size])] > 1:
                gone[k : k + size] = b"\1" * size
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_each_stage_over_the_sample(spark):
    """Whole tables of sf0.01, each stage on all that the one before kept, within a time limit."""
    import time

    import corpus_pipeline
    from fellgate.llm import pii

    sf_dir = "/root/testdata/sf0.01"
    began = time.perf_counter()
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    scratch = corpus_pipeline.Scratch(spark)
    for _, stage in corpus_pipeline.STAGES:
        tables.append(docs)
        docs = scratch.keep(stage(spark, docs, sf_dir))
    assert time.perf_counter() - began < 240
    packed = docs.collect()
    raw, kept, alone, cut, clean = ([(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()] for t in tables)
    verdict = {r["doc_id"]: r["kept"] for r in corpus_pipeline.quality.measure(tables[0]).collect()}
    assert {i for i, _ in kept} == {i for i, v in verdict.items() if v} and len(kept) < len(raw)
    component = near_components(kept)
    assert {i for i, _ in alone} == set(component.values()) and len(alone) < len(kept)
    want = without_repeats(alone)
    assert dict(cut) == want and any(len(want[i]) < len(t) for i, t in alone)
    spans = {r["doc_id"]: [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.digest(pii.find(tables[3])).collect()}
    for i, text in clean:
        if not spans[i]:
            assert text == want[i]
        for s, e, _ in spans[i]:
            assert e - s < 6 or want[i][s:e] not in text or want[i].count(want[i][s:e]) > 1
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths, fill = collections.Counter(), collections.Counter()
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert lengths == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean}
    assert max(fill.values()) <= 2048


def test_awkward_documents(spark, tmp_path):
    """No documents; repeated rows, null ids and texts; columns that the stages use inside."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, runs int, fp string, key int, kept string, __q_t int, m string"
    good = " ".join(f"{w} the of and" for w in (f"w{i}" for i in range(40)))
    other = " ".join(f"{w} und der die" for w in (f"v{i}" for i in range(40)))
    row = lambda i, t: (i, t, "en", "s", len(t or ""), "x", 1, "f", 2, "k", 3, "m")
    cases = {"empty": [], "odd": [row(1, good), row(1, good), row(None, good), row(None, None), row(2, None), row(3, ""), row(None, other), row(None, other), row(4, "short")]}
    for name, rows in cases.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").schema.names == docs.schema.names
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert sorted((r["doc_id"] for r in got), key=str) == ([] if name == "empty" else [1, None])
