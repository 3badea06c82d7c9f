"""Exact search for repeated windows by prefix doubling over sampled positions; equal rows take part once each.

Task: given sequences (bytes of a text, or words of it) and a window length L,
find every window of L consecutive values that also starts elsewhere.  Sorting
all positions costs a row per byte, so only *anchors* take part (hashing.anchors):
equal windows have equal anchors at equal offsets, hence

* a rank (hash of the k values at an anchor) that is unique ends the search for
  all windows of that anchor;
* two anchors with equal rank and equal ``full`` (all that their windows cover)
  repeat each other in every window;
* what remains, anchors with a shared rank but surroundings of their own, goes on
  with a longer k: windows are cut into finer runs, until k is L itself.

So rank and position pairs are sorted by Spark at growing lengths; positions drop
out once unique, and the doubling stops at the threshold.  Of a class of equal
anchors only one representative goes on, as a reference for the others.

Nothing is sampled away: the result is exact up to 128-bit hash collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellgate.llm.hashing import anchors
from fellgate.llm.memory import releasing
from fellgate.llm.scratch import Scratch
from fellgate.llm.words import hash_words

ANCHORS = "rank long, full long, id long, doc long, base long, first long, n long"
#: Values hashed at once; bounds the memory of a task whatever the batch.
BUFFER = 1 << 21


def _pieces(batch: pa.RecordBatch, words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first row, values, starts, ends) of runs of rows; a row is never cut."""
    col = batch.column("data")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buffer = col.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BUFFER * (3 if words else 1), "right")) - 1)
        j = min(j, len(col))
        if words:
            parts = [hash_words(data[offsets[x] : offsets[x + 1]].tobytes().split()) for x in range(i, j)]
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            starts = ends - np.array([len(p) for p in parts], np.int64)
            yield i, np.concatenate(parts), starts, ends
        else:
            yield i, data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def ranks(contexts: DataFrame, k: int, length: int, words: bool) -> DataFrame:
    """rank, doc: of the anchors of (id, doc, base, data), each rank once for a row of them."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for i, values, starts, ends in _pieces(batch, words):
                a = anchors(values, starts, ends, k, length, whole=False)
                yield pa.RecordBatch.from_arrays([pa.array(a.rank.view(np.int64)), pa.array(docs[a.row + i])], names=["rank", "doc"])

    return contexts.select("doc", "data").mapInArrow(run, "rank long, doc long")


def anchor_rows(contexts: DataFrame, k: int, length: int, words: bool) -> DataFrame:
    """Anchors of (id, doc, base, data): base is the offset of data in its document."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs, bases = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "doc", "base"))
            for i, values, starts, ends in _pieces(batch, words):
                a = anchors(values, starts, ends, k, length)
                row = a.row + i
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.rank.view(np.int64), a.full.view(np.int64), ids[row], docs[row], bases[row], a.first + bases[row], a.count)], names=[c.split()[0] for c in ANCHORS.split(", ")])

    return contexts.select("id", "doc", "base", "data").mapInArrow(run, ANCHORS)


def _cut(contexts: DataFrame, wanted: DataFrame, length: int, words: bool) -> DataFrame:
    """The stretches of the contexts that the wanted runs of windows cover."""
    lists = wanted.groupBy("id", "base").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    joined = contexts.select("id", "doc", "base", "data").join(lists, ["id", "base"])
    names, kinds = ["id", "doc", "base", "data"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                data = row["data"].split() if words else row["data"]
                for r in row["runs"]:
                    a = r["first"] - row["base"]
                    part = data[a : a + r["n"] - 1 + length]
                    out.append((row["id"], row["doc"], r["first"], b" ".join(part) if words else part))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return joined.mapInArrow(run, "id long, doc long, base long, data binary")


def repeated_windows(texts: DataFrame, lengths: list[int], words: bool, earlier: bool, scratch: Scratch) -> DataFrame:
    """Runs of repeated windows: id, first (offset of the first window), n (windows in a row);
    with ``earlier`` also where they repeat: source (doc), at (offset there of the first window).

    texts: id long (one for each text; equal rows may share it), doc long (what documents are ordered by), data binary;
    lengths: growing k, the last one is the window length.  earlier=False: a window counts if it starts anywhere else
    too.  earlier=True: it counts if it also starts in a text with a smaller doc, the first place of which is its source.
    """
    length, found = lengths[-1], []
    contexts = texts.select("id", "doc", F.lit(0).cast("long").alias("base"), "data")
    for level, k in enumerate(lengths):
        shared = ranks(contexts, k, length, words).groupBy("rank").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("c"))
        shared = scratch.keep(shared.where(F.col("lo") < F.col("hi") if earlier else F.col("c") > 1).select("rank"))
        rows = scratch.keep(anchor_rows(contexts, k, length, words).join(shared, "rank"))
        kinds = rows.groupBy("rank", "full").agg(F.count("*").alias("c"), F.min(F.struct("doc", "id", "first", "base", "n")).alias("rep"))
        kinds = scratch.keep(kinds.select("rank", "full", "c", "rep.*"))
        if earlier:
            hit = rows.join(kinds.select("rank", "full", F.col("doc").alias("lo"), F.col("first").alias("at")), ["rank", "full"]).where("doc > lo")
            hit = hit.select("id", "first", "n", F.col("lo").alias("source"), "at")
        else:
            hit = rows.join(kinds.where("c > 1").select("rank", "full"), ["rank", "full"]).select("id", "first", "n")
        found.append(scratch.keep(hit))
        if k == length:
            scratch.drop(shared, rows, kinds)
            break
        groups = kinds.groupBy("rank").agg(F.count("*").alias("kinds"), F.max((F.col("c") == 1).cast("int")).alias("open"))
        groups = scratch.keep(groups.where("kinds > 1" if earlier else "kinds > 1 AND open = 1").select("rank"))
        wanted = kinds.join(groups, "rank")
        if earlier:  # other places of a representative's document that look the same share its fate, so they go on too
            wanted = rows.join(wanted.select("rank", "full", F.col("doc").alias("lo")), ["rank", "full"]).where("doc = lo")
        wanted = scratch.keep(wanted.select("id", "base", "first", "n"))
        scratch.drop(shared, rows, kinds, groups)
        cut = scratch.keep(_cut(contexts, wanted, length, words))
        scratch.drop(wanted, *([contexts] if level else []))
        contexts = cut
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def apply_runs(docs: DataFrame, runs: DataFrame, cut, schema: str) -> DataFrame:
    """docs (id, data and others) with all runs of each, given to ``cut`` batch by batch."""
    lists = runs.groupBy("id").agg(F.collect_set(F.struct(*(c for c in runs.columns if c != "id"))).alias("runs"))
    return docs.join(lists, "id", "left").mapInArrow(cut, schema)


def union(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Sorted disjoint [start, stop) that the windows of the runs cover; touching ones are joined."""
    out: list[list[int]] = []
    for a, n in sorted((r["first"], r["n"]) for r in runs or ()):
        b = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
