"""Approximate nearest neighbours by cosine: a forest of hash-prefix trees.

Method: each tree has a hash string for every vector (BITS signs of random
projections), kept as a sorted array, so that vectors with a common prefix stand
together.  A query descends each tree to its longest matching prefix; then all
trees ascend in step, one bit at a time, until the ranges under the prefixes offer
OFFER entries together.  Vectors that VOTES trees offer are candidates, and ranked by
their exact cosine.  What a query looks at so is bounded, whatever the table's size.

How it is spread out: a tree's array is cut into buckets by the first bits of the
strings, as many bits as it takes for BUCKET entries each, and a query visits one
bucket of each tree, its own.  There the numbers of entries under its prefixes are
taken; their sums over the trees give each query its length of prefix; the buckets
then name the entries, and the chunks that hold the named vectors compare them.

Recall: for neighbours at an angle a, a tree of n vectors agrees with probability
(1 - a / pi) ** length.  The preset numbers give 0.95 over 50,000 nearly random vectors of
64 numbers (cosines of neighbours around 0.5), 6 % of which become candidates; tables
of far more vectors that are no closer need more trees.

Equal vectors are indexed once, with their smallest ids (as many as a query can
return), so a vector that a third of all rows share makes no group of its own.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
number take no part; vectors of another dimension than a query's are no
candidates for it; ties go to the smaller id; a repeated id is one row (equal
vectors) or as many as it has vectors; a null id takes no part; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellgate.llm.hashing import mix, ranges
from fellgate.llm.memory import releasing
from fellgate.llm.scratch import Scratch

K = 5
TREES, BITS = 512, 24
OFFER, VOTES = 12_000, 2
#: Entries of a tree's bucket, vectors of a chunk, queries whose candidates are gathered together.
BUCKET, CHUNK, TOGETHER = 1 << 16, 1 << 15, 128
SEED = 20240611


@lru_cache(maxsize=4)
def planes(dim: int) -> np.ndarray:
    """The random projections of all trees, the same on every worker."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, TREES * BITS), np.float32)


def strings(x: np.ndarray) -> np.ndarray:
    """Hash strings (TREES, rows), each BITS bits, the first bit highest."""
    out = np.empty((TREES, len(x)), np.uint32)
    unit = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)
    for t in range(0, TREES, 16):
        bits = (unit @ planes(x.shape[1])[:, t * BITS : (t + 16) * BITS] > 0).reshape(len(x), -1, BITS)
        octets = np.packbits(bits, axis=2).astype(np.uint32)
        out[t : t + 16] = sum(octets[:, :, i] << np.uint32(BITS - 8 - 8 * i) for i in range(BITS // 8)).T
    return out


def _order(codes: np.ndarray) -> np.ndarray:
    """Places of the codes in their order: sorting code and place in one number is faster than sorting places."""
    both = np.sort(codes.astype(np.uint64) << np.uint64(32) | np.arange(len(codes), dtype=np.uint64))
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _by_dim(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each dimension."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    flat, size = vectors.values.to_numpy(), np.diff(offsets)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, flat[offsets[at][:, None] + np.arange(dim)]


ENTRIES = "dim int, tree int, bucket int, side int, codes binary, keys binary, lengths binary"


def _entries(rows: DataFrame, side: int, coarse: int) -> DataFrame:
    """Sorted strings and keys of (key, v, length) by tree and bucket; side 0: the index, 1: queries."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_keys, all_lengths = batch.column("key").to_numpy(), batch.column("length").to_numpy().astype(np.uint8)
            for at, x in _by_dim(batch.column("v")):
                keys, lengths, cells = all_keys[at], all_lengths[at], []
                for tree, codes in enumerate(strings(x)):
                    order = _order(codes)
                    codes = codes[order]
                    bucket = codes >> np.uint32(BITS - coarse)
                    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        own = order[lo:hi]
                        cells.append((x.shape[1], tree, int(bucket[lo]), side, codes[lo:hi].tobytes(), keys[own].tobytes(), lengths[own].tobytes()))
                    if len(cells) > 4096 or (tree == TREES - 1 and cells):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), [pa.int32()] * 4 + [pa.binary()] * 3)], names=names)
                        cells = []

    return rows.select("key", "v", "length").mapInArrow(run, ENTRIES)


def _visits(index: DataFrame, asked: DataFrame, coarse: int, visit, schema: str) -> DataFrame:
    """What ``visit`` makes of each bucket's (codes, keys) and the (codes, keys, lengths) of queries that come to it."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, own = None, [], None
        for batch in batches:
            for dim, tree, bucket, side, codes, keys, lengths in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if here != (dim, tree, bucket):
                    here, parts, own = (dim, tree, bucket), [], None
                codes, keys = np.frombuffer(codes, np.uint32), np.frombuffer(keys, np.int64)
                if side == 0:
                    parts.append((codes, keys))
                    continue
                if own is None and parts:
                    own = [np.concatenate(x) for x in zip(*parts)]
                    order = _order(own[0])
                    own, parts = (own[0][order].astype(np.uint64), own[1][order]), []
                if own is not None:
                    yield from visit(*own, codes, keys, np.frombuffer(lengths, np.uint8))

    both = _entries(index, 0, coarse).unionByName(_entries(asked, 1, coarse))
    both = both.repartition("dim", "tree", "bucket").sortWithinPartitions("dim", "tree", "bucket", "side")
    return both.mapInArrow(run, schema)


def _range(codes: np.ndarray, asked: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries with the queries' prefixes of these lengths stand."""
    shift = (BITS - length).astype(np.uint64)
    start = asked.astype(np.uint64) >> shift << shift
    return np.searchsorted(codes, start), np.searchsorted(codes, start + (np.uint64(1) << shift))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _split(number: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(number, columns) of the rows of each number."""
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order], prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = order[lo:hi]
        yield int(number[own[0]]), *(c[own] for c in columns)


def _batch(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


def _lengths(index: DataFrame, asked: DataFrame, coarse: int, parts: int) -> DataFrame:
    """key, length: the longest prefix of each query under which all trees together offer enough."""
    every = np.arange(BITS, coarse - 1, -1)

    def count(codes: np.ndarray, _: np.ndarray, asked_: np.ndarray, keys: np.ndarray, __: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.empty((len(keys), len(every)), np.int32)
        for i, length in enumerate(every):
            low, high = _range(codes, asked_, np.full(len(keys), length))
            n[:, i] = high - low
        rows = [(part, k.tobytes(), own.tobytes()) for part, k, own in _split(_part(keys, parts), keys, n)]
        yield _batch(rows, ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()))

    @releasing
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, counts = None, [], []

        def merge() -> None:
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros((len(known), len(every)), np.int64)
            np.add.at(sums, at, np.concatenate(counts))
            keys[:], counts[:] = [known], [sums]

        def out() -> pa.RecordBatch:
            merge()
            enough = counts[0] >= OFFER
            length = np.where(enough.any(axis=1), every[enough.argmax(axis=1)], coarse)
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(length.astype(np.int32))], names=["key", "length"])

        for batch in batches:
            for part, k, n in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts"))):
                if part != here:
                    if keys:
                        yield out()
                    here, keys, counts = part, [], []
                keys.append(np.frombuffer(k, np.int64))
                counts.append(np.frombuffer(n, np.int32).reshape(-1, len(every)))
                if len(keys) > 64:
                    merge()
        if keys:
            yield out()

    found = _visits(index, asked, coarse, count, "part int, keys binary, counts binary")
    return found.repartition("part").sortWithinPartitions("part").mapInArrow(total, "key long, length int")


def _classes(vectors: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors (v) with their smallest ids: first within each task, then over all."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            pairs = [(np.frombuffer(v, np.float64), ids) for v, ids in own.items()]
            own.clear()
            return pa.RecordBatch.from_arrays([pa.array([v for v, _ in pairs], pa.list_(pa.float64())), pa.array([i for _, i in pairs], pa.list_(pa.int64()))], names=["v", "ids"])

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
                ids = own.setdefault((np.asarray(v.values, np.float64) + 0.0).tobytes(), [])
                if i not in ids:
                    ids.append(i)
                    ids.sort()
                    del ids[keep:]
            if len(own) > 20_000:
                yield out()
        yield out()

    tasks = vectors.mapInArrow(run, "v array<double>, ids array<bigint>")
    return tasks.groupBy("v").agg(F.collect_set("ids").alias("ids")).select("v", F.expr(f"slice(array_sort(array_distinct(flatten(ids))), 1, {keep})").alias("ids"))


def candidates(index: DataFrame, asked: DataFrame, rows: int, n_asked: int, scratch: Scratch) -> DataFrame:
    """chunk, id, v, keys: the vectors of each chunk that VOTES trees offer to each query.

    index: key, v; asked: key, id, v."""
    coarse, parts, chunks = max(0, (rows // BUCKET).bit_length()), max(1, -(-n_asked // TOGETHER)), max(1, -(-rows // CHUNK))
    index = index.select("key", "v", F.lit(0).alias("length"))
    lengths = _lengths(index, asked.withColumn("length", F.lit(0)), coarse, parts)
    asked = scratch.keep(asked.join(lengths, "key"))

    def offer(codes: np.ndarray, keys: np.ndarray, asked_: np.ndarray, asked_keys: np.ndarray, lengths_: np.ndarray) -> Iterator[pa.RecordBatch]:
        low, high = _range(codes, asked_, lengths_)
        given, of = keys[ranges(low, high - low)], np.repeat(asked_keys, high - low)
        rows_ = [(part, q.tobytes(), k.tobytes()) for part, q, k in _split(_part(of, parts), of, given)]
        yield _batch(rows_, ("part", pa.int32()), ("asked", pa.binary()), ("keys", pa.binary()))

    @releasing
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, vectors, pairs = None, {}, []

        def out() -> Iterator[pa.RecordBatch]:
            q, k = (np.concatenate(x) for x in zip(*pairs))
            asked_here, of = np.unique(q, return_inverse=True)
            rows_ = []
            for i, own in _split(of, k):
                own = np.sort(own)
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                own = own[first[np.diff(np.append(first, len(own))) >= VOTES]]
                id_, v = vectors[int(asked_here[i])]
                rows_ += [(chunk, id_, v, some) for chunk, some in _split(_part(own, chunks), own)]
            yield _batch(rows_, ("chunk", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("keys", pa.list_(pa.int64())))

        for batch in batches:
            for part, side, key, id_, v, q, k in zip(*(batch.column(c).to_pylist() for c in ("part", "side", "key", "id")), batch.column("v"), batch.column("asked"), batch.column("keys")):
                if part != here:
                    if pairs:
                        yield from out()
                    here, vectors, pairs = part, {}, []
                if side == 0:
                    vectors[key] = (id_, v.values.to_numpy())
                else:
                    pairs.append((np.frombuffer(q.as_py(), np.int64), np.frombuffer(k.as_py(), np.int64)))
        if pairs:
            yield from out()

    @releasing
    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_part(batch.column("key").to_numpy(), parts)), *batch.columns], names=["part", "key", "id", "v"])

    none = F.lit(None)
    offered = _visits(index, asked, coarse, offer, "part int, asked binary, keys binary")
    offered = offered.select("part", F.lit(1).alias("side"), none.cast("long").alias("key"), none.cast("long").alias("id"), none.cast("array<double>").alias("v"), "asked", "keys")
    of_queries = asked.select("key", "id", "v").mapInArrow(part_of, "part int, key long, id long, v array<double>")
    of_queries = of_queries.select("part", F.lit(0).alias("side"), "key", "id", "v", none.cast("binary").alias("asked"), none.cast("binary").alias("keys"))
    both = of_queries.unionByName(offered).repartition("part").sortWithinPartitions("part", "side")
    return both.mapInArrow(vote, "chunk int, id long, v array<double>, keys array<bigint>")


def _compared(index: DataFrame, found: DataFrame, rows: int, k: int) -> DataFrame:
    """query_id, id, score: the nearest of each chunk for each query."""
    chunks = max(1, -(-rows // CHUNK))

    @releasing
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, tables = None, [], {}

        def table(dim: int) -> tuple | None:
            """Keys in order, with vectors, their lengths and ids, of one dimension."""
            if dim not in tables:
                own = [(keys[at], x, at, ids) for keys, vectors, ids in parts for at, x in _by_dim(vectors) if x.shape[1] == dim]
                if own:
                    keys, x = np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own])
                    order = np.argsort(keys)
                    places = [(ids, i) for _, _, at, ids in own for i in at.tolist()]
                    tables[dim] = keys[order], x[order], np.sqrt((x * x).sum(axis=1))[order], [places[i] for i in order.tolist()]
                else:
                    tables[dim] = None
            return tables[dim]

        for batch in batches:
            chunk, side = batch.column("chunk").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (side[1:] != side[:-1]), [True]])) if batch.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if chunk[lo] != here:
                    here, parts, tables = chunk[lo], [], {}
                own = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    parts.append((own.column("key").to_numpy(), own.column("v"), own.column("keys")))
                    continue
                out = []
                for query, v, named in zip(own.column("key").to_pylist(), own.column("v"), own.column("keys")):
                    q, keys = v.values.to_numpy(), named.values.to_numpy()
                    there = table(len(q))
                    if there is None:
                        continue
                    known, x, size, places = there
                    at = np.searchsorted(known, keys)
                    near = x[at] @ q / (size[at] * np.sqrt((q * q).sum()))
                    if len(near) > k + 1:
                        least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                        at, near = at[near >= least], near[near >= least]
                    ids = [places[i][0][places[i][1]].as_py() for i in at.tolist()]
                    out += [(query, j, -s) for s, j in sorted((-s, j) for s, some in zip(near.tolist(), ids) for j in some if j != query)[:k]]
                yield _batch(out, ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))

    @releasing
    def chunk_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_part(batch.column("key").to_numpy(), chunks)), *batch.columns], names=["chunk", "key", "v", "keys"])

    vectors = index.select("key", "v", F.col("ids").alias("keys")).mapInArrow(chunk_of, "chunk int, key long, v array<double>, keys array<bigint>")
    both = vectors.withColumn("side", F.lit(0)).unionByName(found.withColumnRenamed("id", "key").withColumn("side", F.lit(1)))
    both = both.select("chunk", "side", "key", "v", "keys").repartition("chunk").sortWithinPartitions("chunk", "side")
    return both.mapInArrow(compare, "query_id long, id long, score double")


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return df.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


def prepared(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, int, int]:
    """Distinct vectors (key, v, ids), queries (key, id, v), and how many there are."""
    index = scratch.keep(_classes(_valid(vectors, id_col, vector_col), k + 1).withColumn("key", F.xxhash64("v")))
    asked = scratch.keep(_valid(queries, id_col, vector_col).distinct().withColumn("key", F.xxhash64("id", "v")))
    return index, asked, index.count(), asked.count()


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, <id_col>, score: the k nearest found of each query among vectors, itself left out."""
    scratch = Scratch(vectors.sparkSession)
    index, asked, rows, n_asked = prepared(vectors, queries, k, id_col, vector_col, scratch)
    found = candidates(index, asked, rows, n_asked, scratch)
    near = _compared(index, found, rows, k).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
