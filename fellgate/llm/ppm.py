"""Language-model scores of texts: prediction by partial matching over bytes, beside a unigram base.

Method: a trie of byte contexts (up to ORDER bytes before a symbol) is counted
over all training texts.  A symbol is predicted by the longest context seen;
if it never followed that context, the model escapes (method C: as likely as
the number of distinct symbols seen there) to the next shorter one, where the
symbols of the longer context are excluded.  Below order 0 all symbols left are
alike.  The log10 probabilities of a text's bytes and of its end add up to its score.

How it is spread out: what a symbol and its context are worth depends on the five
bytes (a gram) alone, and a block of texts has far fewer distinct grams than bytes.

1. Texts are dealt into blocks of BLOCK bytes or so; each block lists its distinct grams
   and words, with how often its training texts hold them.
2. Lists are cut into shards: grams by the two bytes before the symbol (a context and
   all longer ones of it fall into one shard, so a shard can score its grams alone),
   words by their hash.  Each shard adds up its lists: that is the model.  Counts of
   byte pairs (65,536 at most) are what shards share.
3. Each shard gives every entry of every list its value: log10 p of a gram, the count of a word.
4. Lists with values go back to the texts of their block, which add them up.

Two passes over the texts, however large the model is; no task holds more than one
shard's trie (SHARD grams, or one two-byte context) or one block's list, and the driver
holds numbers of the 65,536 pairs.  A shard's lists are merged and valued by up to
LISTS at a time.

Defined results: null text is empty (its end is its one token); a null doc_id is
neither learned from nor held out; repeated rows are learned from once each and
scored alike; no training text gives a model that knows nothing (all escapes).
Other columns are ignored.  Words are told apart by 63-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellgate.llm.hashing import mix, ranges
from fellgate.llm.memory import releasing
from fellgate.llm.scratch import Scratch
from fellgate.llm.words import hash_words, texts

ORDER = 4
#: Neither byte occurs in UTF-8: one stands before a text, the other for its end.
START, END = 0xFE, 0xFF
BLOCK = 16 << 20
SHARD = 1 << 19
LISTS = 256
#: Symbols, or words, that are looked at together.
CHUNK = 1 << 20
#: The end of a text among the words (no word hashes to it but by chance of 2**-63).
END_WORD = 0
FOLDS, HELD_OUT = 7, 2

Runs = Iterator[tuple[int, np.ndarray, np.ndarray]]


def _grams(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """(first row, grams, row of each) of runs of rows.

    From the highest byte: the two before the symbol, the two before those, the symbol."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = min(rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1))
        sizes = np.diff(offsets[i : j + 1]) + ORDER + 1
        starts = np.cumsum(sizes) - sizes
        padded = np.full(int(sizes.sum()), START, np.uint8)
        padded[ranges(starts + ORDER, sizes - ORDER - 1)] = data[offsets[i] : offsets[j]]
        padded[starts + sizes - 1] = END
        wide = padded.astype(np.uint64)
        key = wide.copy()
        for back, shift in ((1, 24), (2, 32), (3, 8), (4, 16)):
            key[back:] |= wide[:-back] << np.uint64(shift)
        yield i, key[ranges(starts + ORDER, sizes - ORDER)], np.repeat(np.arange(i, j), sizes - ORDER)
        i = j


def _in_order(grams: np.ndarray) -> np.ndarray:
    """Grams with their bytes in the order of the text, the symbol lowest (as Trie takes them)."""
    return (grams & np.uint64(0xFF)) | ((grams >> np.uint64(24)) & np.uint64(0xFFFF)) << np.uint64(8) | ((grams >> np.uint64(8)) & np.uint64(0xFFFF)) << np.uint64(24)


def _words(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """(first row, hashes of the lower-cased words and of the end, row of each) of runs of rows."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        first, parts, size = i, [], 0
        while i < rows and size < CHUNK:
            parts.append(hash_words(data[offsets[i] : offsets[i + 1]].tobytes().lower().split()) >> np.uint64(1))
            parts.append(np.full(1, END_WORD, np.uint64))
            size += len(parts[-2]) + 1
            i += 1
        sizes = [len(a) + 1 for a in parts[::2]]
        yield first, np.concatenate(parts), np.repeat(np.arange(first, i), sizes)


def _bytes_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(name)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8), offsets


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class _Tally:
    """Distinct keys with counts, merged whenever as many have come as there are."""

    def __init__(self) -> None:
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = self._new = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._parts.append((keys, counts))
        self._new += len(keys)
        if self._new > max(self._held, CHUNK):
            self.sums()

    def learn(self, keys: np.ndarray, learned: np.ndarray) -> None:
        """Keys as they come, some of texts that are not learned from."""
        flagged = np.sort(keys << np.uint64(1) | learned)
        keys = flagged >> np.uint64(1)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.add(keys[at], np.add.reduceat((flagged & np.uint64(1)).astype(np.int64), at))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys and their counts so far."""
        if len(self._parts) != 1:
            keys, counts = (np.concatenate(x) for x in zip(*self._parts)) if self._parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            self._parts = [_sum_by(keys, counts)]
        self._held, self._new = len(self._parts[0][0]), 0
        return self._parts[0]


def _dense(x: np.ndarray, ordered: bool) -> bytes:
    """Whole numbers as bytes: differences of ordered ones, all lowest bytes first, then the next ones, so that zeros lie together and compress."""
    d = np.diff(x, prepend=x.dtype.type(0)) if ordered else x
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, ordered: bool) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : len(planes)] = planes.T
    x = wide.view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if ordered else x


LISTED = "block long, doc_id long, held_out boolean, data binary, grams binary, gram_counts binary, words binary, word_counts binary"


def _listed(source: DataFrame) -> DataFrame:
    """The texts, each with its block, and for each block one row of lists."""
    names = [c.split()[0] for c in LISTED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 5]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, grams, words = TaskContext.get().partitionId() << 32, 0, _Tally(), _Tally()

        def lists() -> pa.RecordBatch:
            cells = [x for keys, counts in (grams.sums(), words.sums()) for x in (_dense(keys, True), _dense(counts.astype(np.uint64), False))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([block, None, None, None, *cells], kinds)], names=names)

        for batch in batches:
            data, offsets = _bytes_of(batch, "data")
            learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(np.uint64)
            i = 0
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK - size, "right")) - 1))
                for read, into in ((_grams, grams), (_words, words)):
                    for _, keys, row in read(data, offsets[i : j + 1]):
                        into.learn(keys, learned[i:j][row])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, block)), part.column("doc_id"), part.column("held_out"), part.column("data"), *[pa.nulls(j - i, pa.binary())] * 4], names=names)
                size += int(offsets[j] - offsets[i])
                if size >= BLOCK:
                    yield lists()
                    block, size, grams, words = block + 1, 0, _Tally(), _Tally()
                i = j
        if size or len(words.sums()[0]):
            yield lists()

    return source.select("doc_id", "held_out", "learned", "data").mapInArrow(run, LISTED)


class _Index:
    """Place of a key among distinct keys, by an open-addressing table."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self._at = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slots(keys)
        while len(left):
            free = self._keys[slot] == np.uint64(2**64 - 1)
            self._keys[slot[free]] = keys[left[free]]
            done = self._keys[slot] == keys[left]
            self._at[slot[done]] = left[done]
            left, slot = left[~done], (slot[~done] + 1) & self._mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self._shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Place of each, or -1."""
        slot = self._slots(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._at[slot], -1)
        left = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self._mask
            found = self._keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self._at[slot[hit]]
            go = ~hit & (found != np.uint64(2**64 - 1))
            left, slot = left[go], slot[go]
        return out


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1))


class Trie:
    """The contexts of one shard with all that scoring needs, as arrays."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> None:
        """grams: of ORDER + 1 bytes, with counts; pairs: all grams of two bytes, of the whole corpus."""
        self.levels: list[dict] = [None] * (ORDER + 1)  # type: ignore[list-item]
        tables = {k: _sum_by(grams & np.uint64(256 ** (k + 1) - 1), counts) for k in range(2, ORDER + 1)}
        tables[1] = pairs
        tables[0] = _sum_by(pairs[0] & np.uint64(255), pairs[1])
        for k in range(ORDER + 1):
            keys, n = tables[k]
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(float)
            level = {"index": _Index(keys), "contexts": _Index(contexts), "log_n": _log(n), "log_top": _log(n) - _log(total + kinds)[of], "escape": _log(kinds) - _log(total + kinds), "total": total, "kinds": kinds}
            if k:
                below = self.levels[k - 1]
                low = np.uint64(256**k - 1)
                there = below["n"][below["index"].of(keys & low)]
                down = below["contexts"].of((contexts & (low >> np.uint64(8))) if k > 1 else np.zeros(len(contexts), np.uint64))
                fresh = below["kinds"][down] - kinds  # symbols that the shorter context has beside those excluded
                size = below["total"][down] - np.bincount(of, there, len(contexts)) + fresh
                level["under_den"] = _log(size)
                level["under_escape"] = np.where(fresh > 0, _log(fresh) - _log(size), 0.0)
            level["n"] = n.astype(float)
            self.levels[k] = level
        self.floor = -math.log10(max(1, 256 - len(tables[0][0])))

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each gram, given its context."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        above = np.full(len(grams), -1, np.int32)  # context one longer, if it was seen
        for k in range(ORDER, -1, -1):
            level, longer = self.levels[k], self.levels[k + 1] if k < ORDER else None
            keys = grams[left] & np.uint64(256 ** (k + 1) - 1)
            at = level["index"].of(keys)
            found, below_seen = at >= 0, above >= 0
            top = found & ~below_seen
            out[left[top]] += level["log_top"][at[top]]
            if longer is not None:
                under = found & below_seen
                out[left[under]] += level["log_n"][at[under]] - longer["under_den"][above[under]]
            miss = ~found
            left, above, keys = left[miss], above[miss], keys[miss]
            if not len(left):
                return out
            here = level["contexts"].of(keys >> np.uint64(8))
            if longer is not None:
                seen = above >= 0
                out[left[seen]] += longer["under_escape"][above[seen]]
            first = (above < 0) & (here >= 0)
            out[left[first]] += level["escape"][here[first]]
            above = here
        out[left] += self.floor
        return out


def _shards(sizes: list[tuple[int, int]]) -> list[int]:
    """First two-byte contexts of shards of at most SHARD entries, or of one context."""
    out, room = [0], SHARD
    for context, n in sorted(sizes):
        if n > room and context > out[-1]:
            out.append(context)
            room = SHARD
        room -= n
    return out


def _context_sizes(lists: DataFrame) -> DataFrame:
    """context (-1: words), n: entries of all lists, added up in each task first."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            for grams, own in zip(batch.column("grams"), batch.column("words")):
                total += np.bincount((_numbers(grams.as_py(), True) >> np.uint64(24)).astype(np.int64), minlength=1 << 16)
                words += len(_numbers(own.as_py(), False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], words))], names=["context", "n"])

    return lists.select("grams", "words").mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))


def _pieces(lists: DataFrame, grams: list[int], words: int, salts: int) -> DataFrame:
    """shard, salt, block, keys, counts: lists cut at the shards' borders; word shards come after gram shards."""
    starts = {"grams": np.array(grams, np.uint64) << np.uint64(24), "words": np.array([k * 2**63 // words for k in range(words)], np.uint64)}

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, number = batch.column("block")[row].as_py(), 0
                for kind, counts in (("grams", "gram_counts"), ("words", "word_counts")):
                    keys = _numbers(batch.column(kind)[row].as_py(), True)
                    n = _numbers(batch.column(counts)[row].as_py(), False)
                    cuts = np.append(np.searchsorted(keys, starts[kind]), len(keys))
                    some = np.flatnonzero(np.diff(cuts))
                    cells = [[_dense(x[cuts[k] : cuts[k + 1]], x is keys) for k in some] for x in (keys, n)]
                    yield pa.RecordBatch.from_arrays([pa.array((some + number).astype(np.int32)), pa.array(np.full(len(some), block)), *(pa.array(x, pa.binary()) for x in cells)], names=["shard", "block", "keys", "counts"])
                    number += len(starts[kind])

    pieces = lists.select("block", "grams", "gram_counts", "words", "word_counts").mapInArrow(run, "shard int, block long, keys binary, counts binary")
    return pieces.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))


def _added(pieces: DataFrame) -> DataFrame:
    """shard, keys, counts (of those learned), total, kinds: one row for each shard and salt."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tally = None, _Tally()

        def row() -> pa.RecordBatch:
            keys, counts = tally.sums()
            seen = counts > 0
            cells = [here[0], _dense(keys[seen], True), _dense(counts[seen].astype(np.uint64), False), int(counts.sum()), int(seen.sum())]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, kinds)], names=["shard", "keys", "counts", "total", "kinds"])

        for batch in batches:
            for shard, salt, keys, counts in zip(batch.column("shard").to_pylist(), batch.column("salt").to_pylist(), batch.column("keys"), batch.column("counts")):
                if here != (shard, salt):
                    if here:
                        yield row()
                    here, tally = (shard, salt), _Tally()
                tally.add(_numbers(keys.as_py(), True), _numbers(counts.as_py(), False).astype(np.int64))
        if here:
            yield row()

    rows = pieces.select("shard", "salt", "keys", "counts").repartition("shard", "salt").sortWithinPartitions("shard", "salt")
    return rows.mapInArrow(run, "shard int, keys binary, counts binary, total long, kinds long")


def _pairs(model: DataFrame, grams: int) -> DataFrame:
    """pair (a byte and the symbol after it), n."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                pair = _in_order(_numbers(keys.as_py(), True)) & np.uint64(0xFFFF)
                np.add.at(total, pair.astype(np.int64), _numbers(counts.as_py(), False).astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return model.where(F.col("shard") < grams).select("keys", "counts").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _valued(pieces: DataFrame, model: DataFrame, grams: int, salts: int, pairs) -> DataFrame:
    """block, shard, keys, worth: log10 p of each gram, the count of each word."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = None

        def prepared(shard: int, keys: np.ndarray, counts: np.ndarray):
            if shard < grams:
                trie = Trie(_in_order(keys), counts.astype(float), pairs.value)
                return lambda asked: trie.score(_in_order(asked)).tobytes()
            index, found = _Index(keys), np.append(counts, np.uint64(0))
            return lambda asked: _dense(found[index.of(asked)], False)

        for batch in batches:
            for side, shard, block, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("side", "shard", "block")), batch.column("keys"), batch.column("counts")):
                own = _numbers(keys.as_py(), True)
                if side == 0:
                    worth = prepared(shard, own, _numbers(counts.as_py(), False))
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([shard], pa.int32()), pa.array([keys.as_py()], pa.binary()), pa.array([worth(own)], pa.binary())], names=["block", "shard", "keys", "worth"])

    columns = ["shard", "salt", "side", "block", "keys", "counts"]
    models = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumns({"side": F.lit(0), "block": F.lit(-1).cast("long")})
    both = models.select(*columns).unionByName(pieces.withColumn("side", F.lit(1)).select(*columns))
    return both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "side").mapInArrow(run, "block long, shard int, keys binary, worth binary")


def _summed(listed: DataFrame, valued: DataFrame, grams: int, missing: float) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score: each block's lists first, then its texts."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists, tables = None, {False: [], True: []}, {}

        def table(words: bool) -> tuple[_Index, np.ndarray]:
            keys = [np.zeros(0, np.uint64), *(_numbers(k, True) for k, _ in lists[words])]
            worth = [np.zeros(0), *(np.log10(_numbers(w, False) + 1.0) if words else np.frombuffer(w) for _, w in lists[words])]
            lists[words].clear()
            return _Index(np.concatenate(keys)), np.concatenate(worth)

        for batch in batches:
            blocks, sides = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (sides[1:] != sides[:-1]), [True]])) if len(blocks) else []
            for i, j in zip(edges[:-1], edges[1:]):
                if blocks[i] != block:
                    block, lists, tables = blocks[i], {False: [], True: []}, {}
                part = batch.slice(i, j - i)
                if sides[i] == 0:
                    for shard, keys, worth in zip(part.column("shard").to_pylist(), part.column("data"), part.column("worth")):
                        lists[shard >= grams].append((keys.as_py(), worth.as_py()))
                    continue
                tables = tables or {words: table(words) for words in lists}
                data, offsets = _bytes_of(part, "data")
                n = j - i
                score, gain, tokens, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                index, worth = tables[False]
                for _, keys, row in _grams(data, offsets):
                    score += np.bincount(row, worth[index.of(keys)], n)
                index, worth = tables[True]
                for _, keys, row in _words(data, offsets):
                    own = worth[index.of(keys)]
                    gain += np.bincount(row, own, n)
                    tokens += np.bincount(row, minlength=n)
                    known += np.bincount(row[own > 0], minlength=n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *map(pa.array, (tokens, known, gain - tokens * missing, score))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    none = F.lit(None)
    of_texts = listed.where("data IS NOT NULL").select("block", F.lit(1).alias("side"), none.cast("int").alias("shard"), "doc_id", "held_out", "data", none.cast("binary").alias("worth"))
    of_lists = valued.select("block", F.lit(0).alias("side"), "shard", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), F.col("keys").alias("data"), "worth")
    both = of_lists.unionByName(of_texts).repartition("block").sortWithinPartitions("block", "side", "shard")
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    held_out = F.coalesce(fold == HELD_OUT, F.lit(False))
    source = texts(docs).select("doc_id", held_out.alias("held_out"), F.coalesce(fold != HELD_OUT, F.lit(False)).alias("learned"), F.col("text").cast("binary").alias("data"))
    listed = scratch.keep(_listed(source))
    lists = listed.where("grams IS NOT NULL")

    sizes = {r["context"]: r["n"] for r in _context_sizes(lists).collect()}  # 65,537 rows at most
    words = max(1, -(-sizes.pop(-1, 0) // SHARD))
    shards = _shards(list(sizes.items()))
    salts = max(1, -(-lists.count() // LISTS))
    pieces = _pieces(lists, shards, words, salts)
    model = scratch.keep(_added(pieces))
    if salts > 1:
        more = scratch.keep(_added(model.withColumn("salt", F.lit(0))))
        scratch.drop(model)
        model = more
    known = model.where(F.col("shard") >= len(shards)).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    table = _pairs(model, len(shards)).toPandas().sort_values("pair")  # 65,536 rows at most
    pairs = spark.sparkContext.broadcast((table["pair"].to_numpy().astype(np.uint64), table["n"].to_numpy().astype(float)))
    valued = scratch.keep(_valued(pieces, model, len(shards), salts, pairs))
    scratch.drop(model)
    scratch.collect()
    out = _summed(listed, valued, len(shards), math.log10(int(known[0]) + int(known[1]) + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(known[0])).cast("long").alias("train_tokens"), "base_score", "score")
