"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by the vocabulary.

Method: the symbols of a pretoken form a doubly linked list; a heap holds the
merge rank of each pair of neighbours.  The least rank is popped first (leftmost
among equals) and its pair merged, unless one of its symbols has changed since:
such stale entries are skipped.  Decoding joins the vocabulary's strings.

Each distinct pretoken is encoded once per worker (a cache with a bound), so a
text costs little more than cutting it into pretokens.

Defined results: null text is empty and has no tokens; the strings of special
tokens inside a text are those tokens, as the vocabulary file says; repeated
rows and null ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fellgate.llm.words import texts

# Fixed value: how byte-level vocabularies cut a text into pretokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Cache(dict):
    """Pretoken to its ids as text; forgets all when full."""

    def __init__(self, encode, most: int = 1 << 20) -> None:
        super().__init__()
        self._encode, self._most = encode, most

    def __missing__(self, piece: str) -> str:
        if len(self) >= self._most:
            self.clear()
        ids = self[piece] = ",".join(map(str, self._encode(piece)))
        return ids


class ByteBpe:
    """Encoder and decoder of one vocabulary file (the tokenizers library's JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.alphabet = byte_alphabet()
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.bytes_of = {str(i): bytes(back[c] for c in s) for s, i in self.vocab.items() if all(c in back for c in s)}
        self.bytes_of |= {str(i): s.encode() for s, i in self.special.items()}
        self._first = [self.vocab[c] for c in self.alphabet]
        self._pretokens = regex.compile(PRETOKEN)
        self._marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._cache = _Cache(self.encode_piece)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pretoken."""
        symbols = [self._first[b] for b in piece.encode()]
        n = len(symbols)
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        queue = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # stale: one of the two was merged meanwhile
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if m := merges.get((made, symbols[k])):
                    heapq.heappush(queue, (m[0], i, made, symbols[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], made))):
                heapq.heappush(queue, (m[0], h, symbols[h], made, m[1]))
        return [s for s in symbols if s >= 0]

    def encode_joined(self, text: str) -> str:
        """Ids of a whole text, in decimal, joined by commas."""
        if self._marks is None or not any(s in text for s in self.special):
            return ",".join(map(self._cache.__getitem__, self._pretokens.findall(text)))
        parts = []
        for part in self._marks.split(text):
            if part in self.special:
                parts.append(str(self.special[part]))
            elif part:
                parts.append(",".join(map(self._cache.__getitem__, self._pretokens.findall(part))))
        return ",".join(parts)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined(",".join(map(str, ids))).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and texts themselves never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            count, ids_hash, text_hash = [], [], []
            for text in batch.column("text"):
                joined = bpe.encode_joined(text.as_py())
                count.append(joined.count(",") + 1 if joined else 0)
                ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode_joined(joined).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
