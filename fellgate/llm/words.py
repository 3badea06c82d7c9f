"""Words of a text, as the operators on words take them: runs of bytes other than 0x20 and 0x09-0x0D.

``bytes.split()`` without arguments cuts at just these bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Hashes(dict):
    """Word to 64-bit hash; forgets all when full, so that its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def texts(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id and text (null: empty) of documents, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)
