"""Substring deduplication by relative Lempel-Ziv factors: words of a document that an earlier one has in the same order.

Method: all documents are the reference.  Its index (repeats.py) holds, for each
stretch of windows of WINDOW words between two content-defined anchors, the first
place where it stands, by hash: five-word anchors first, single windows where
stretches are alike only in part.  Every stretch of every document is looked up, so
windows across the ends of factors are, too, and the result is exact.  A document
is then parsed from left to right: a factor begins with a window that an earlier
document has, and goes on as long as the first place of each next window lies one
word further in the same source; the next factor begins with the next window found.
Factors are WINDOW words or longer; the words that they cover are duplicate spans.

A factor follows the *first* place of its windows; where another document has a
longer match that is not first, the parse has two factors instead of one.  What is
covered is the same.

Defined results: null text has no words; texts under WINDOW words lose nothing;
rows that repeat a doc_id are told apart by their text, and none of them is
smaller than the other; a null doc_id is smaller than none and none is smaller
than it, so that row keeps all.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellgate.llm.memory import releasing
from fellgate.llm.repeats import apply_runs, repeated_windows
from fellgate.llm.scratch import Scratch
from fellgate.llm.words import texts

WINDOW = 13
FACTOR = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("at", pa.int64())])


def lengths(window: int) -> list[int]:
    """Words of the ranks: five (or all) at first, then the whole window."""
    return [min(5, window), window] if window > 5 else [window]


def parse(runs: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, source, place there) of one document's runs of windows found, from left to right."""
    out: list[list[int]] = []
    for first, n, source, at in sorted((r["first"], r["n"], r["source"], r["at"]) for r in runs):
        if out and out[-1][2] == source and at - first == out[-1][3] - out[-1][0] and first <= out[-1][0] + out[-1][1] - window + 1:
            out[-1][1] = first + n - 1 + window - out[-1][0]
        else:
            out.append([first, n - 1 + window, source, at])
    return [tuple(f) for f in out]


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, factors (start, length, doc_id of the source, place there; in words), kept (the words left, joined by one space)."""
    scratch = Scratch(docs.sparkSession)
    source = texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("id"), F.col("text").cast("binary").alias("data"))
    runs = repeated_windows(source.where("doc_id IS NOT NULL").withColumn("doc", F.col("doc_id")), lengths(window), True, True, scratch)

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, data, own in zip(batch.column("doc_id").to_pylist(), batch.column("data"), batch.column("runs").to_pylist()):
                words, factors = data.as_py().split(), parse(own or [], window)
                kept, at = [], 0
                for start, length, _, _ in factors:
                    kept += words[at:start]
                    at = max(at, start + length)
                kept += words[at:]
                out.append((doc, len(words), len(words) - len(kept), factors, b" ".join(kept)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(FACTOR), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["doc_id", "n_words", "n_removed", "factors", "kept"])

    schema = "doc_id long, n_words long, n_removed long, factors array<struct<start:bigint,length:bigint,source:bigint,at:bigint>>, kept binary"
    return apply_runs(source, runs, cut, schema).withColumn("kept", F.col("kept").cast("string"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
