"""Best-fit packing of documents into sequences of a fixed number of tokens, by large-item matching.

Method: pieces above a third of the capacity go at most two to a sequence, so
they are matched in pairs: the largest first, each with the largest partner that
still fits.  The smaller pieces then go, in decreasing size, each to the
sequence with the least gap that holds it, or to a new one.

Lengths are whole numbers up to the capacity, so the plan is made from the count
of pieces of each length (2048 numbers, whatever the corpus): sequences that hold
the same lengths are one *group* with a count.  Best fit treats equal gaps alike,
so it moves whole groups at a time and splits a few; the plan stays in the order
of the capacity.  Pieces then find their place from their number within their length.

Defined results: null text is empty (its one token is the end id 0); repeated
rows and null ids are pieces like any others; other columns are ignored; no
documents make no sequences.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fellgate.llm.bpe import byte_alphabet
from fellgate.llm.memory import releasing
from fellgate.llm.scratch import Scratch
from fellgate.llm.words import texts

CAPACITY = 2048
# Letters that stand for themselves whatever stands beside them, with stable lower case (no I with a dot, no
# n after an apostrophe), and how the word vocabulary cuts a lower-cased text of these and ASCII that has no white space.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
PRETOKEN = f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z{LATIN}0-9]+"
_ALPHABET = byte_alphabet()
_SYMBOLS = {c: "".join(_ALPHABET[x] for x in chr(c).encode()) for c in (*range(0x80), *range(0xC0, 0x180))}
#: Entries of a cache, and the bytes of the longest text that it holds.
MOST, LONGEST = 1 << 19, 64


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    """What ``make`` gives for a text. It holds no long ones, and when it is full its entries become the old ones, which
    stay if they are asked for again until it is full once more: frequent texts stay, and its memory is bounded."""

    def __init__(self, make) -> None:
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, key: str | bytes) -> bytes:
        ids = self._old.get(key)
        if ids is None:
            ids = self._make(key)
        if len(key) <= LONGEST:
            if len(self) >= MOST:
                self._old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class WordIds:
    """Ids of a text by the tokenizers library, as little-endian unsigned 32-bit numbers.

    Neither normalizer nor pre-tokenizer looks across white space, so a text is cut at it (ASCII alone) and each
    distinct stretch is encoded once: of ASCII and LATIN pretoken by pretoken by the library's model, all others, and
    what may hold a special token, by the library as a whole."""

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        self._plain, self._pretokens = re.compile(f"[\\x00-\\x7f{LATIN}]+"), re.compile(PRETOKEN)
        self._pieces, self._stretches = _Cache(self._piece), _Cache(self._stretch)

    def _piece(self, piece: str) -> bytes:
        return _packed([t.id for t in self._model.tokenize(piece.translate(_SYMBOLS))])

    def _stretch(self, stretch: bytes) -> bytes:
        text = stretch.decode()
        if b"<|" in stretch or not self._plain.fullmatch(text):
            return _packed(self._tokenizer.encode(text, add_special_tokens=False).ids)
        text = text.lower()
        return self._pieces[text] if text.isalpha() else b"".join(map(self._pieces.__getitem__, self._pretokens.findall(text)))

    def of(self, data: bytes) -> bytes:
        """Of a text in UTF-8."""
        return b"".join(map(self._stretches.__getitem__, data.split()))


_LOADED: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task and nth (number within its length and task); with_ids: ids binary."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _LOADED.get(path) or _LOADED.setdefault(path, WordIds(path))
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = words.of(text.as_buffer().to_pybytes()) + b"\0\0\0\0"
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc, i, at // 4, n, zlib.crc32(part), task, seen[n], part)[: 8 if with_ids else 7])
                    seen[n] += 1
            names = [f.split()[0] for f in fields.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    return texts(docs).mapInArrow(run, fields)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, from, to, sequence, each, offset).

    The pieces number from <= i < to of that length: piece i stands in sequence
    number ``sequence + (i - from) // each`` at ``offset + (i - from) % each * length``.
    """
    used, rows, groups = dict.fromkeys(counts, 0), [], []  # groups: [first sequence, sequences, gap]
    left = {n: c for n, c in counts.items() if c > 0}
    sequences = 0

    def place(size: int, first: int, number: int, each: int, offset: int) -> None:
        n = number * each
        rows.append((size, used[size], used[size] + n, first, each, offset))
        used[size] += n
        left[size] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for size in large:
        while left[size]:
            mate = next((m for m in large if m <= size and m <= capacity - size and left[m] > (m == size)), None)
            if mate is None:
                number = left[size]
                place(size, sequences, number, 1, 0)
                groups.append((sequences, number, capacity - size))
            elif mate == size:
                number = left[size] // 2
                place(size, sequences, number, 2, 0)
                groups.append((sequences, number, capacity - 2 * size))
            else:
                number = min(left[size], left[mate])
                place(size, sequences, number, 1, 0)
                place(mate, sequences, number, 1, size)
                groups.append((sequences, number, capacity - size - mate))
            sequences += number
    gaps: dict[int, list[tuple[int, int]]] = {}
    for first, number, gap in groups:
        gaps.setdefault(gap, []).append((first, number))
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        fitting = [g for g in gaps if g >= size]
        heapq.heapify(fitting)
        while left[size]:
            if not fitting:  # new sequences, as many as the rest fills; at most the last one partly
                gaps.setdefault(capacity, []).append((sequences, -(-left[size] // (capacity // size))))
                sequences += gaps[capacity][-1][1]
                heapq.heappush(fitting, capacity)
            gap = fitting[0]
            if not gaps.get(gap):
                gaps.pop(gap, None)
                heapq.heappop(fitting)
                continue
            first, number = gaps[gap].pop()
            each = gap // size
            whole = min(number, left[size] // each)
            if whole:
                place(size, first, whole, each, capacity - gap)
                gaps.setdefault(gap - each * size, []).append((first, whole))
            if whole < number:
                if rest := min(left[size], each):  # one sequence takes what is left, the others stay as they are
                    place(size, first + whole, 1, rest, capacity - gap)
                    gaps.setdefault(gap - rest * size, []).append((first + whole, 1))
                    whole += 1
                if whole < number:
                    gaps.setdefault(gap, []).append((first + whole, number - whole))
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset; with_ids: and the ids themselves."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    cut = scratch.keep(pieces(docs, path, capacity, with_ids))
    # one number for each task and length: where its pieces start among all of that length
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begin = scratch.keep(by_task.withColumn("begin", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long"))))
    counts = {r["length"]: r["n"] for r in begin.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows = sorted(plan(counts, capacity))
    table = {size: [np.array(x, np.int64) for x in zip(*((r[1], r[3], r[4], r[5]) for r in own))] for size, own in groupby(rows, key=lambda r: r[0])}
    shared = spark.sparkContext.broadcast(table)  # in the order of the capacity, not of the corpus
    numbered = cut.join(begin.select("task", "length", "begin").hint("merge"), ["task", "length"])  # it grows with the tasks
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            number = batch.column("begin").to_numpy() + batch.column("nth").to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                start, first, each, offset = shared.value[int(n)]
                k = np.searchsorted(start, number[at], "right") - 1
                i = number[at] - start[k]
                seq[at], off[at] = first[k] + i // each[k], offset[k] + i % each[k] * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off), *([batch.column("ids")] if with_ids else [])], names=[*names, "sequence_id", "offset", *(["ids"] if with_ids else [])])

    return numbered.mapInArrow(run, out)
