import collections
import math
import random
import zlib

import numpy as np

from fellgate.llm import ann, ppm


def trie(rows):
    out = collections.defaultdict(collections.Counter)
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            b = bytes([254] * 4) + (t or "").encode() + b"\xff"
            for j in range(4, len(b)):
                for k in range(5):
                    out[b[j - k : j]][b[j]] += 1
    return out


def log_p(tables, context, symbol):
    excluded, total = set(), 0.0
    for k in range(5):
        seen = tables.get(context[k:])
        left = {s: n for s, n in (seen or {}).items() if s not in excluded}
        if not left:
            continue
        size = sum(left.values()) + len(left)
        if symbol in left:
            return total + math.log10(left[symbol] / size)
        total += math.log10(len(left) / size)
        excluded |= set(seen)
    return total - math.log10(256 - len(tables.get(b"", ())))


def check_scores(df, rows):
    tables, words, learned = trie(rows), collections.Counter(), 0
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            words.update([*(t or "").encode().lower().split(), 0])
    learned, kinds = sum(words.values()), len(words)
    for r in ppm.score(df).collect():
        text = dict(rows)[r["doc_id"]] or ""
        own = [*text.encode().lower().split(), 0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(words[w] > 0 for w in own), learned)
        assert math.isclose(r["base_score"], sum(math.log10((words[w] + 1) / (learned + kinds + 1)) for w in own), rel_tol=1e-9)
        b = bytes([254] * 4) + text.encode() + b"\xff"
        assert math.isclose(r["score"], sum(log_p(tables, b[j - 4 : j], b[j]) for j in range(4, len(b))), rel_tol=1e-9)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_ppm(docs, rows):
    check_scores(docs, rows)


def test_ppm_in_shards(docs, rows, monkeypatch):
    for name, value in (("SHARD", 300), ("LISTS", 3), ("BLOCK", 2000), ("CHUNK", 700)):
        monkeypatch.setattr(ppm, name, value)
    check_scores(docs, rows)


def test_ppm_edges(empty, odd):
    assert ppm.score(empty).count() == 0
    got = ppm.score(odd).collect()
    assert len(got) == 6 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)


def test_probabilities_add_up():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd ") for _ in range(400))
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    keys = np.concatenate([k for _, k, _ in ppm._grams(data, offsets)])
    grams, counts = np.unique(ppm._in_order(keys), return_counts=True)
    pairs = ppm._sum_by(grams & np.uint64(0xFFFF), counts.astype(float))
    model = ppm.Trie(grams, counts.astype(float), pairs)
    for context in (b"abcd", b"zzzz", b"zzab", b"\xfe\xfe\xfea"):
        base = int.from_bytes(context, "big") << 8
        assert math.isclose((10 ** model.score(np.array([base + s for s in range(256)], np.uint64))).sum(), 1.0, rel_tol=1e-9)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24))
    x[700:1000] = x[5]  # a third is one vector
    rows = [(int(i), [float(v) for v in x[i]], 0) for i in range(1500)]
    rows += [(3000, None, 0), (3001, [0.0] * 24, 0), (3002, [float("nan")] * 24, 0), (3003, [], 0), (3004, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0), (3050, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    found = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    size = np.linalg.norm(x, axis=1)
    hit = total = 0
    for q in range(0, 1500, 50):
        near = x @ x[q] / (size * size[q])
        near[q] = -9
        best = sorted(range(1500), key=lambda i: (-round(near[i], 12), i))[:5]
        assert [r for r, _, _ in found[q]] == [1, 2, 3, 4, 5]
        assert all(abs(near[i] - s) < 1e-12 for _, i, s in found[q])
        hit, total = hit + len({i for _, i, _ in found[q]} & set(best)), total + 5
        if near[5] > 1 - 1e-12:
            assert [i for _, i, _ in found[q]] == best
    assert hit / total >= 0.9 and 3000 not in found and 3001 not in found
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert ann.search(few, few.where("vec_id = 0")).count() == 2


def recall(spark, x, step):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6).cache()
    asked = df.where(F.col("vec_id") % step == 0)
    found = collections.defaultdict(list)
    for r in ann.search(df, asked).collect():
        found[r["query_id"]].append(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, len(x), step):
        near = unit @ unit[q]
        near[q] = -9
        hit += len(set(np.argpartition(-near, 5)[:5].tolist()) & set(found[q]))
    scratch = ann.Scratch(spark)
    index, questions, rows, n = ann.prepared(df, asked, 5, "vec_id", "embedding", scratch)
    offered = ann.candidates(index, questions, rows, n, scratch).agg(F.sum(F.size("keys"))).first()[0]
    df.unpersist()
    return hit / (5 * n), offered / (n * rows)


def test_few_candidates_and_recall_over_fifty_thousand_vectors(spark):
    x = np.random.default_rng(5).standard_normal((50_000, 64))  # the hardest case: nothing is near
    found, share = recall(spark, x, 500)
    assert found >= 0.9 and share < 0.1


def test_buckets_and_chunks(spark, monkeypatch):
    for name, value in (("BUCKET", 200), ("CHUNK", 300), ("TOGETHER", 7)):
        monkeypatch.setattr(ann, name, value)
    found, share = recall(spark, np.random.default_rng(6).standard_normal((2500, 16)), 50)
    assert found >= 0.9 and share < 0.9


def test_a_repeated_id_and_other_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, df.where("vec_id = 2")).orderBy("rank").collect()]
    assert got == [(2, 1, 1), (2, 2, 5), (2, 3, 3)]  # an id with two vectors is as near as its nearer one; ties go to the smaller id
