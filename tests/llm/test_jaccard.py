import collections
import random

import numpy as np
import pytest

from fellgate.llm import jaccard


def brute(rows, num=9, den=10):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < 3 else frozenset(zip(w, w[1:], w[2:])))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return collections.Counter((doc, len(sets[i]), least.get(find(i)) if doc is not None else None) for i, (doc, _) in enumerate(rows))


def got(df):
    return collections.Counter(tuple(r) for r in jaccard.groups(df).select("doc_id", "n_shingles", "component_id").collect())


def test_against_all_pairs(docs, rows):
    assert got(docs) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(420):  # more than a block, and more than a pivot may have before it counts as common
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 99999)}"
        rows.append((9000 - i, " ".join(w)))
    rows += [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a"), (None, "a b"), (6, "a b c"), (6, "a b c")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_edges(empty, odd):
    assert got(empty) == {}
    assert got(odd) == {(None, 2, None): 1, (None, 0, None): 1, (5, 3, 5): 2, (7, 0, 7): 2}


def test_representatives(docs, rows):
    kept = {r["doc_id"] for r in jaccard.representatives(docs).collect()}
    assert kept == {c for _, _, c in brute(rows)}
    assert jaccard.representatives(docs).columns == docs.columns


def test_chain_components(spark):
    from fellgate.llm.scratch import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200)], "a long, b long")
    found = {r["node"]: r["component"] for r in jaccard.components(edges, Scratch(spark)).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100}


def test_near_pairs_against_all_pairs():
    rng = np.random.default_rng(1)
    for trial in range(40):
        counts = rng.integers(2, (3, 9, 14, 200)[trial % 4], size=rng.integers(1, 12))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        n = offsets[-1]
        size, side, group = rng.integers(20, 40, n), rng.integers(0, 2, n), rng.integers(0, n, n)
        if trial % 2:
            side[:] = 2
        bits = np.zeros((n, 8), np.uint64)
        bits[:, 0] = rng.integers(0, 16, n)
        want = {
            (x, y)
            for lo, hi in zip(offsets[:-1], offsets[1:])
            for x in range(lo, hi)
            for y in range(x + 1, hi)
            if group[x] != group[y]
            and (side[x] == 2 or side[x] != side[y])
            and 9 * max(size[x], size[y]) <= 10 * min(size[x], size[y])
            and int(bits[x, 0] ^ bits[y, 0]).bit_count() <= (size[x] + size[y]) // 19
        }
        found = [(int(a), int(b)) for x, y in jaccard.near_pairs(offsets, size, group, side, bits, 9, 10) for a, b in zip(x, y)]
        assert len(found) == len(set(found)) and set(found) == want
        assert [k for lo, hi in jaccard._slices(offsets) for k in range(lo, hi)] == list(range(len(counts)))


def crowd(rng, copies, strangers, edits):
    """Near copies of one text, some beyond the threshold of each other, and texts that share a phrase with them."""
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 99999)}"
        rows.append((9_000_000 - i, " ".join(w)))
    for i in range(strangers):
        rows.append((i, " ".join([*base[50:60], *(f"q{rng.randint(0, 999999)}" for _ in range(rng.randint(0, 40)))])))
    return rows


def components_of(rows):
    """brute() for many rows: intersections by one matrix product."""
    sets = [set(zip(w, w[1:], w[2:])) for w in (t.lower().split() for _, t in rows)]
    index = {}
    seen = collections.Counter(x for s in sets for x in s)
    for s in sets:
        for x in s:
            if seen[x] > 1:
                index.setdefault(x, len(index))
    m = np.zeros((len(sets), len(index)), np.float32)
    for i, s in enumerate(sets):
        m[i, [index[x] for x in s if x in index]] = 1
    size = np.array([len(s) for s in sets])
    root = np.arange(len(rows))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for lo in range(0, len(sets), 500):
        both = (m[lo : lo + 500] @ m.T).astype(np.int64)
        for i, j in zip(*np.nonzero(10 * both >= 9 * (size[lo : lo + 500, None] + size[None, :] - both))):
            root[find(lo + i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return collections.Counter((doc, int(size[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "depth", "centres"), [(16, 3, 4), (8, 0, 4), (16, 2, 1), (32, 1, 16)])
def test_large_regions_are_cut(spark, monkeypatch, block, depth, centres):
    """Voronoi regions, rings and blocks lose no link, and no part is larger than two blocks or so."""
    for name, value in (("BLOCK", block), ("DEPTH", depth), ("CENTRES", centres)):
        monkeypatch.setattr(jaccard, name, value)
    largest = []
    candidates = jaccard._candidates

    def watched(members, num, den):
        largest.append(members.groupBy("key").count().agg({"count": "max"}).first()[0])
        return candidates(members, num, den)

    monkeypatch.setattr(jaccard, "_candidates", watched)
    rows = crowd(random.Random(block + depth), 150, 150, 9)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == components_of(rows) == brute(rows)
    assert max(largest) <= 4 * block


def test_five_thousand_near_copies(spark):
    rows = crowd(random.Random(8), 5000, 500, 7)
    want = components_of(rows)
    assert 20 < len({c for _, _, c in want}) < 5000
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == want


def test_representatives_take_five_words_and_four_fifths(spark):
    rng = random.Random(4)
    rows = []
    for i in range(10, 60):
        w = [f"{i // 5}v{k}" for k in range(90)]
        for _ in range(i % 5):
            w[rng.randrange(90)] = f"e{rng.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    kept = sorted(r["doc_id"] for r in jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(set(least.values())) != sorted({c for _, _, c in brute(rows)})


def test_representatives_leave_one_row_of_each_component(spark):
    from fellgate.llm import suffix_dedup

    long, other, third = (" ".join(f"{c}{i}" for i in range(90)) for c in "abc")
    rows = [(1, long), (1, long), (2, long + " end"), (None, long), (3, other), (3, third), (None, third), (4, third), (None, "p q r"), (None, "p q r"), (5, None), (5, None), (6, " "), (None, None)]
    kept = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter([(1, long), (3, other), (3, third), (None, "p q r"), (5, None), (6, " "), (None, None)])
    assert {tuple(r) for r in suffix_dedup.cut_texts(kept).collect()} >= {(1, long), (3, other), (3, third)}


def test_dense_groups_take_few_rows(spark, monkeypatch):
    """Sets that are all about as far from each other as the radius: parts have no more rows than dealing strangers to the largest component takes."""
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    taken = []
    candidates = jaccard._candidates

    def watched(members, num, den):
        taken.append(members.count())
        return candidates(members, num, den)

    monkeypatch.setattr(jaccard, "_candidates", watched)
    rows = crowd(random.Random(11), 700, 20, 7)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == components_of(rows)
    assert sum(taken) < 60 * len(rows)


def test_texts_that_share_nothing_stay_where_they_are(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(400))) for i in range(1500)]
    rows += [(2000 + i, t + " end") for i, t in rows[:3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()

    def shuffled():
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    assert sorted((d, c) for d, _, c in got(docs)) == [(i, i) for i in range(1500)] + [(2000 + i, i) for i in range(3)]
    assert shuffled() - before < sum(len(t) for _, t in rows)


def test_turns_lose_nothing(spark, monkeypatch):
    """Many turns, more hubs, and texts that a join moves give the same."""
    for name, value in (("BLOCK", 16), ("ENOUGH", 0), ("TURN_ROWS", 500), ("ROWS_SHARE", 0), ("TURN_SHINGLES", 4000), ("SHINGLES_SHARE", 0), ("PICKED", 10)):
        monkeypatch.setattr(jaccard, name, value)
    rows = crowd(random.Random(13), 150, 50, 9)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == components_of(rows)


def test_rows_of_candidates_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """What parts hand on, and what joins take: no row for each pair, nor for each region that a pair shares."""
    made, joined = [], []
    candidates, merged = jaccard._candidates, jaccard._merged

    def watched(members, num, den):
        found = candidates(members, num, den)
        made.append(found.count())
        return found

    def watched_links(star, found, scratch):
        joined.append(found.count())
        return merged(star, found, scratch)

    monkeypatch.setattr(jaccard, "_candidates", watched)
    monkeypatch.setattr(jaccard, "_merged", watched_links)
    for copies in (125, 500):
        rows = crowd(random.Random(14), copies, 0, 8)
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == components_of(rows)
    assert made[1] <= 6 * made[0] and joined[1] <= 6 * joined[0]
    assert made[1] <= 3 * 500


def test_parts_of_many_shingles_are_held_in_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("HELD", 800), ("TURN_SHINGLES", 9000), ("SHINGLES_SHARE", 0)):
        monkeypatch.setattr(jaccard, name, value)
    rows = crowd(random.Random(15), 150, 50, 9)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == components_of(rows)
