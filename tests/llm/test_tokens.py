import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fellgate.llm import bpe, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), bpe.loaded(BYTES), packing.WordIds(WORDS)


TEXTS = st.lists(st.sampled_from(["a", "B", "é", "é", " ", "\n", "\x1c", "\x85", "9", "²", "'s", "'LL", "ß", "İ", "Σ", "<|endoftext|>", "<|", "中", "\U0001f600", "!!", "​", "ǅ"]) | st.text(max_size=3), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_ids_are_the_librarys(libraries, text):
    by_bytes, by_words, mine, words = libraries
    text = text.encode("utf-8", "replace").decode()
    ids = by_bytes.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids and mine.decode(ids) == by_bytes.decode(ids, skip_special_tokens=False)
    assert list(np.frombuffer(words.of(text.encode()), "<u4")) == by_words.encode(text, add_special_tokens=False).ids


def test_round_trip(docs, rows, libraries, empty, odd):
    lib = libraries[0]
    for r in bpe.round_trip(docs, BYTES).collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(empty, BYTES).count() == 0 and bpe.round_trip(odd, BYTES).count() == 6
    first = bpe.encode(docs, BYTES).where("doc_id = 0").first()
    assert first["decoded"] == dict(rows)[0] and first["ids"] == lib.encode(dict(rows)[0], add_special_tokens=False).ids


def filled(plan):
    out = collections.defaultdict(list)
    for size, start, stop, first, each, offset in plan:
        for i in range(stop - start):
            out[first + i // each].append((offset + i % each * size, size))
    return out


def test_plan():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([8, 20, 64, 300])
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 150)))
        sequences = filled(packing.plan(dict(counts), capacity))
        assert collections.Counter(s for own in sequences.values() for _, s in own) == counts
        for own in sequences.values():
            at = 0
            for offset, size in sorted(own):
                assert offset == at
                at += size
            assert at <= capacity and sum(3 * s > capacity for _, s in own) <= 2
        total = sum(s * c for s, c in counts.items())
        assert len(sequences) <= 1.5 * max(-(-total // capacity), sum(c for s, c in counts.items() if 2 * s > capacity)) + 1


def test_packing(docs, rows, libraries, empty, odd):
    lib, found = libraries[1], packing.pack(docs, WORDS).collect()
    by_doc = collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), 2048))
        for r in parts:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert len(own) == r["length"] <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    places = collections.defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in found) // 2048) + 1
    assert packing.pack(empty, WORDS).count() == 0 and packing.pack(odd, WORDS).count() == 6


def test_ids_of_every_code_point(libraries):
    """Each code point alone, between letters, before a combining mark and beside white space has the library's ids."""
    _, library, _, words = libraries
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4096):
        texts = [f"a{chr(c)}B {chr(c)}\u0301 x\n{chr(c)}" for c in points[lo : lo + 4096]]
        want = library.encode_batch(texts, add_special_tokens=False)
        for text, ids in zip(texts, want):
            assert words.of(text.encode()) == np.array(ids.ids, "<u4").tobytes(), ascii(text)


def test_one_pretoken_of_megabytes(libraries):
    _, library, _, words = libraries
    for text in ("ab" * 500_000, "\u00e9" * 200_000, "!" * 300_000):
        assert words.of(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(map(len, words._stretches)) <= packing.LONGEST and max(map(len, words._pieces)) <= packing.LONGEST


def best_fit_decreasing(sizes, capacity):
    import bisect

    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, size)
        new = i == len(gaps)
        gap = capacity if new else gaps.pop(i)
        n += new
        bisect.insort(gaps, gap - size)
    return n


def test_no_more_sequences_than_best_fit_decreasing():
    rng = random.Random(1)
    for trial in range(200):
        capacity = rng.choice([64, 300, 2048])
        draw = (lambda: rng.randint(1, capacity), lambda: min(capacity, 1 + int(rng.expovariate(4 / capacity))), lambda: rng.randint(capacity // 3, capacity // 2 + 5), lambda: rng.choice([capacity // 2, capacity // 3 + 1, capacity // 4, capacity // 7, capacity - 1, 1]))[trial % 4]
        sizes = [draw() for _ in range(rng.randint(1, 1500))]
        assert len(filled(packing.plan(dict(collections.Counter(sizes)), capacity))) <= best_fit_decreasing(sizes, capacity) + 1
