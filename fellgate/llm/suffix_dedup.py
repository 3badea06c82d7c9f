"""Suffix-array deduplication: remove bytes of strings that occur twice.

Method: distributed prefix doubling (repeats.py): Spark sorts pairs of rank and
position at growing lengths, reranks those that still share a rank, and stops
when a position is unique or the threshold of 200 bytes is reached.

Defined results: null text is empty; texts shorter than the threshold lose
nothing; repeated rows are copies of each other and lose all that is long
enough; a null doc_id is kept as null; other columns are ignored.  Rows that
share a doc_id but not the text are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellgate.llm.memory import releasing
from fellgate.llm.repeats import apply_runs, repeated_windows, union
from fellgate.llm.scratch import Scratch
from fellgate.llm.words import texts

MIN_BYTES = 200


def lengths(window: int) -> list[int]:
    """Growing lengths of the ranks: a third, two thirds, all of the window."""
    return [max(1, window // 3), max(1, 2 * window // 3), window]


def dedup(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    scratch = Scratch(docs.sparkSession)
    source = texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("id"), F.col("text").cast("binary").alias("data"))
    runs = repeated_windows(source.withColumn("doc", F.lit(0).cast("long")), lengths(min_bytes), False, False, scratch)

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data, spans = row["data"], union(row["runs"], min_bytes)
                at, kept = 0, []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((row["doc_id"], len(data), len(data) - len(kept), len(spans), kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return apply_runs(source, runs, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(result: DataFrame) -> DataFrame:
    """The result with the kept bytes as a SHA-256."""
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))




def cut_texts(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs, columns as they came, with the repeated bytes cut out of text (and halves of characters with them); null stays null."""
    scratch = Scratch(docs.sparkSession)
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    source = texts(docs).select(F.xxhash64("doc_id", "text").alias("id"), F.col("text").cast("binary").alias("data"))
    runs = repeated_windows(source.withColumn("doc", F.lit(0).cast("long")), lengths(min_bytes), False, False, scratch)
    lists = runs.groupBy("id").agg(F.collect_set(F.struct("first", "n")).alias("__s_runs")).withColumnRenamed("id", "__s_id")
    joined = docs.withColumn("__s_key", key).join(lists, F.col("__s_key") == F.col("__s_id"), "left")
    names = docs.columns
    at = names.index("text")

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(at), batch.column("__s_runs").to_pylist()):
                text = text.as_py()
                if runs:
                    data, done, kept = text.encode(), 0, []
                    for a, b in union(runs, min_bytes):
                        kept.append(data[done:a])
                        done = b
                    text = b"".join([*kept, data[done:]]).decode("utf-8", "ignore")
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*names, "__s_runs").mapInArrow(cut, docs.schema)
