"""Exact n-gram Jaccard join and its groups: documents whose shingle sets are alike to a threshold.

Method: a metric-space join (1 - J is a metric).  Pivots cut the space into Voronoi
regions, a document is copied into every region where a partner within the radius
may lie, and large regions are cut again by pivots of their own.

* First pivots: the one-shingle sets.  (With documents as pivots of the whole space,
  unrelated texts lie at distance 1 from all of them, so every window would hold
  everything.)  {s} is at distance 1 - 1/|x| from each x that holds s, and at 1 from
  all others, so x's nearest pivots are its own shingles; ties go by one global
  order: long shingles first, because they are rare, common ones last.
* Their windows: a partner within the radius misses at most |x| - ceil(t |x|) of x's
  shingles, so the nearest pivot of both is among x's first |x| - ceil(t |x|) + 1.
* Further pivots: where dealing a region into blocks (below) takes more than COPIES rows
  for each set, up to CENTRES of its sets become pivots,
  of different components, the largest first.  Distances are taken between
  parity sketches (SKETCH bits): their Hamming distance is a metric that never exceeds
  the number of shingles in which two sets differ, so sets within the radius lie
  within some bits a of each other.  A set lives with its nearest pivot p, in the ring
  of its distance from p; by the triangle inequality a partner of another region lies
  at most 2 a farther from p than from its own pivot, and in rings at most a away, so
  it visits those.  This recurs up to DEPTH times, where it takes fewer rows than dealing
  does (among sets that are all about as far from each other as the radius it takes more).
  What is still larger than BLOCK is dealt into pairs of blocks; sets of the region's largest
  component meet only those of other components.  So no part has more than 2 BLOCK rows or so.
* Before regions are cut, each set meets the least one of its region, and, while large
  regions need more than ENOUGH rows, CENTRES more.  That joins dense
  groups by stars; pairs within a component cannot change the result and are left out,
  and regions whose sets are one component are done.
* Parts, and the sets that decide links, are taken in turns that each take no more disk
  than a share of the input, however dense its groups are.
* Two sets that share several regions are compared in the first of them, as far as the FIRST
  regions of each tell.  A part hands on those of its rows that have a partner which sizes and
  sketches do not part from them, not the pairs, whose number grows with the square of a group.
* What is left is decided by the sets themselves, each text cut into shingles once.  With hubs,
  sets travel to the partner that most pairs have in common; else they travel to their
  parts, which join components as they find links and give one link for each join.

Equal sets are one class from the start, and classes are joined, not documents.
Links make components by alternating stars (large and small), in as many rounds
as the logarithm of the component's size.

Defined results: null, empty and wordless texts have an empty set, are linked
with nothing and are their own component; fewer words than n make one shingle;
repeated rows get equal results; a null doc_id is linked with nothing and its
component is null; other columns are ignored.  Shingles are compared by 56-bit
hash and byte length, sets by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellgate.llm.hashing import mix, ranges
from fellgate.llm.memory import releasing
from fellgate.llm.scratch import Scratch
from fellgate.llm.words import texts

N, NUMERATOR, DENOMINATOR = 3, 9, 10
#: A pivot found in more regions' worth of rows than COMMON, and than a share of all rows so that there are at most MOST of them.
COMMON, MOST = 64, 1 << 20
#: Regions of more sets are cut: by so many pivots, so often, into rings of so many bits.
BLOCK, CENTRES, DEPTH, RING = 512, 16, 3, 32
#: Regions are cut where dealing them takes more rows for each set; while large regions take more rows than ENOUGH in all, up to ROUNDS times more of their sets become hubs.
COPIES, ENOUGH, ROUNDS = 4, 1 << 17, 2
#: Rows of parts that are written at once, and shingles of sets that decide links: so many, or that share of all shingles of the input.
TURN_ROWS, ROWS_SHARE, TURN_SHINGLES, SHINGLES_SHARE = 1 << 20, 0.05, 1 << 22, 0.4
#: Texts wanted by so many ids at most are picked before they are moved.
PICKED = 1 << 20
#: Regions up to FEW rows are compared together, as many as have ROWS rows.
FEW, ROWS = 8, 1 << 15
#: Partners of one set that a task verifies, and shingles of the sets of a part that a task holds (of a pair of blocks: twice as many or so).
PARTNERS, HELD = 256, 1 << 21
SKETCH = 512
_LOW = np.uint64((1 << 56) - 1)
BITS = [f"s{k}" for k in range(SKETCH // 64)]
#: The least regions that a set shares with others; a row of a part has them beside its own region p.
FIRST = [f"q{k}" for k in range(4)]
#: Columns of a set's row in a region, and in a part.
MEMBER = ["fp", "n", "c", "p", *FIRST, *BITS]
PART = ["key", "side", *MEMBER]
PART_TYPES = ", ".join(f"{c} {'int' if c == 'side' else 'long'}" for c in PART)


class _Codes(dict):
    """Word to its length (high byte) and 56-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        code = self[word] = min(len(word), 255) << 56 | xxhash.xxh3_64_intdigest(word) >> 8
        return code


_CODES = _Codes()
#: Words of texts that are hashed at once.
TOGETHER = 1 << 17


def _together(words: list[list[bytes]], n: int) -> Iterator[np.ndarray]:
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    codes = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(words)), np.uint64, total)
    sizes, hashes = codes >> np.uint64(56), codes & _LOW
    key, size = mix(hashes), sizes.copy()
    for k in range(1, n):  # what runs over the end of a text is not used
        key[: total - k] = mix(key[: total - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
        size[: total - k] += sizes[k:]
    tokens = ((np.uint64(255) - np.minimum(size, np.uint64(255))) << np.uint64(56)) | (key & _LOW)
    at = 0
    for own_words, count in zip(words, counts.tolist()):
        if count >= n:
            own = np.sort(tokens[at : at + count - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif count:  # the whole text is one shingle
            yield from _together([own_words], count)
        else:
            yield np.zeros(0, np.uint64)
        at += count


def shingle_sets(texts_: Iterator[bytes], n: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text as sorted numbers: the longest come first."""
    words: list[list[bytes]] = []
    size = 0
    for data in texts_:
        words.append(data.lower().split())
        size += len(words[-1])
        if size >= TOGETHER:
            yield from _together(words, n)
            words, size = [], 0
    yield from _together(words, n)


def _name(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0].view(np.int64))


def _rows(data: pa.Array) -> Iterator[bytes]:
    return (x.as_py() for x in data)


def _reach(size, num: int, den: int):
    """How many of its nearest pivots a set is copied to."""
    return size + num * size // -den + 1


def _widest(size, num: int, den: int):
    """Most tokens in which a set of this size differs from any partner."""
    return (den - num) * size // num


def sketch(tokens: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Parity of the set's tokens in each of ``size`` cells: sets that differ in d tokens have sketches that differ in d bits at most."""
    cells = np.bincount((mix(tokens) >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(cells.astype(np.uint8))


def _wide(tokens: np.ndarray) -> np.ndarray:
    """A sketch that grows with the set. Sizes are powers of two: the halves of one, laid over each other, are the next smaller one."""
    return sketch(tokens, max(SKETCH, 1 << (2 * len(tokens)).bit_length()))


def _wide_apart(x: np.ndarray, y: np.ndarray) -> int:
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _classes(source: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, id, n_shingles, fp, the sketch and twice as many of the nearest pivots as are needed, of every document."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, heads, sketches = [], [], [], []
            for s in shingle_sets(_rows(batch.column("data")), n):
                sizes.append(len(s))
                names.append(_name(s))
                heads.append(s[: 2 * _reach(len(s), num, den)].tobytes() if len(s) else b"")
                sketches.append(sketch(s).view(np.int64))
            bits = np.array(sketches, np.int64).reshape(-1, len(BITS))
            columns = [batch.column("doc_id"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(heads, pa.binary()), *(pa.array(bits[:, k]) for k in range(len(BITS)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "id", "n_shingles", "fp", "head", *BITS])

    return source.select("doc_id", "id", "data").mapInArrow(run, "doc_id long, id long, n_shingles long, fp long, head binary, " + ", ".join(f"{b} long" for b in BITS))


def _head_pivots(sets: DataFrame) -> DataFrame:
    """pivot, n: how often each pivot stands in the heads, counted within batches first."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivots, counts = np.unique(np.frombuffer(b"".join(_rows(batch.column("head"))), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pivots.view(np.int64)), pa.array(counts.astype(np.int64))], names=["pivot", "n"])

    return sets.select("head").mapInArrow(run, "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n"))


def _is_late(tokens: np.ndarray, late: np.ndarray) -> np.ndarray:
    return late[np.minimum(np.searchsorted(late, tokens), len(late) - 1)] == tokens if len(late) else np.zeros(len(tokens), bool)


def _head_regions(sets: DataFrame, num: int, den: int, common) -> DataFrame:
    """pivot, fp: the regions that each set is copied into, from its head; pivot null where the head has too few that are not common."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value
        for batch in batches:
            size, fp = batch.column("n").to_numpy(), batch.column("fp").to_numpy()
            tokens = np.frombuffer(b"".join(_rows(batch.column("head"))), np.uint64)
            reach = _reach(size, num, den)
            held = np.minimum(size, 2 * reach)
            of = np.repeat(np.arange(len(size)), held)
            last = np.cumsum(held)

            def nth(flag: np.ndarray) -> np.ndarray:
                """Number of each flagged token among those of its set, from 1."""
                total = np.concatenate([[0], np.cumsum(flag)])
                return total[1:] - total[last - held][of]

            common_ = _is_late(tokens, late)
            number = nth(~common_)
            keep = ~common_ & (number <= reach[of])
            lacking = reach - np.bincount(of[keep], minlength=len(size))
            short = (lacking > 0) & (held < size)
            keep |= common_ & (nth(common_) <= lacking[of])
            keep &= ~short[of]
            pivots, names = tokens[keep].view(np.int64), fp[of[keep]]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(pivots), pa.nulls(int(short.sum()), pa.int64())]), pa.array(np.concatenate([names, fp[short]]))], names=["pivot", "fp"])

    return sets.select("fp", "n", "head").mapInArrow(run, "pivot long, fp long")


def _text_regions(bodies: DataFrame, num: int, den: int, common) -> DataFrame:
    """The same from whole sets (fp, tokens)."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value
        for batch in batches:
            for name, data in zip(batch.column("fp").to_pylist(), _rows(batch.column("tokens"))):
                s = np.frombuffer(data, np.uint64)
                is_late = _is_late(s, late)
                s = np.concatenate([s[~is_late], s[is_late]])[: _reach(len(s), num, den)]
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), name, np.int64))], names=["pivot", "fp"])

    return bodies.mapInArrow(run, "pivot long, fp long")


def _bodies(source: DataFrame, sets: DataFrame, wanted: DataFrame, scratch: Scratch, n: int, wide: bool = False) -> DataFrame:
    """fp and tokens, or (wide) size n and wide sketch, of the sets that are wanted (fp), each cut from a text once."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, data = [], []
            for s in shingle_sets(_rows(batch.column("data")), n):
                sizes.append(len(s))
                data.append((_wide(s) if wide else s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["fp", "n", "tokens"])

    ids = scratch.keep(wanted.join(sets.select("fp", "id"), "fp"))
    found = source.select("id", "data")
    if ids.count() <= PICKED:  # else the join moves all texts
        found = found.join(F.broadcast(ids.select("id")), "id", "left_semi")
    # repeated rows share an id, so the groups lie where the join has put them
    found = found.join(ids, "id").groupBy("id", "fp").agg(F.first("data").alias("data"))
    bodies = found.select("fp", "data").mapInArrow(run, "fp long, n long, tokens binary")
    bodies = scratch.keep(bodies.withColumnRenamed("tokens", "wide") if wide else bodies.drop("n"))
    scratch.drop(ids)
    return bodies


def _apart(na, nb, num: int, den: int):
    """Most tokens in which sets of these sizes differ if J >= num / den."""
    return (den - num) * (na + nb) // (den + num)


def _near(num: int, den: int) -> Column:
    """Neither sizes (m, n) nor sketches part the sets x and y."""
    hamming = F.expr(" + ".join(f"bit_count(x.{b} ^ y.{b})" for b in BITS))
    near = (F.col("m") * den >= F.col("n") * num) & (F.col("m") * num <= F.col("n") * den)
    return near & (hamming <= F.floor(F.col("m") * (den - num) + F.col("n") * (den - num)) / (den + num))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by key, handed on in whole groups of a key."""
    carried: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if carried:
            own = {c: np.concatenate([carried[c], x]) for c, x in own.items()}
        done = int(np.searchsorted(own["key"], own["key"][-1]))
        if done:
            yield {c: x[:done] for c, x in own.items()}
        carried = {c: x[done:] for c, x in own.items()}
    if carried and len(carried["key"]):
        yield carried


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of regions that have at most ROWS rows together, or of one region."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + ROWS, "right")) - 1)
        yield lo, hi
        lo = hi


def near_pairs(offsets: np.ndarray, size: np.ndarray, group: np.ndarray, side: np.ndarray, bits: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y), x < y, of one region that neither sizes nor sketches part, of different components; region i has the rows offsets[i] to offsets[i + 1].

    Sides 0 and 1 meet each other only, side 2 meets all.  Regions of as many rows, up to FEW, are compared together;
    larger ones on their own, 64 rows at a time."""

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= _apart(size[x], size[y], num, den)
        return x[ok], y[ok]

    def meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = (group[x] != group[y]) & ((side[x] != side[y]) | (side[x] == 2))
        return ok & (den * size[y] >= num * size[x]) & (num * size[y] <= den * size[x])

    counts = np.diff(offsets)
    for g in range(2, FEW + 1):
        at = offsets[:-1][counts == g, None]
        if len(at):
            i, j = np.triu_indices(g, 1)
            x, y = (at + i).ravel(), (at + j).ravel()
            ok = meet(x, y)
            yield near(x[ok], y[ok])
    for k in np.flatnonzero(counts > FEW):
        every = np.arange(offsets[k], offsets[k + 1])
        if (group[every] == group[every[0]]).all():
            continue
        for lo in range(0, len(every), 64):
            some, after = every[lo : lo + 64], every[lo:]
            i, j = np.nonzero(meet(some[:, None], after[None, :]) & (some[:, None] < after[None, :]))
            yield near(some[i], after[j])


def _unmet(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows x and y are not known to meet in a region before their own."""
    met = np.zeros(len(x), bool)
    for a in FIRST:
        q = rows[a][x]
        early = q < rows["p"][x]
        for b in FIRST:
            met |= early & (q == rows[b][y])
    return ~met


def _met(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[tuple[dict[str, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Rows of some whole parts, and those pairs of them that sizes and sketches do not part."""
    for rows in _runs(batches):
        edges = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1], [True]]))
        for lo, hi in _slices(edges):
            own = {c: x[edges[lo] : edges[hi]] for c, x in rows.items()}
            bits = np.stack([own[b] for b in BITS], axis=1).view(np.uint64)
            pairs = near_pairs(edges[lo : hi + 1] - edges[lo], own["n"], own["c"], own["side"], bits, num, den)
            yield own, ((x[new], y[new]) for x, y in pairs for new in [_unmet(own, x, y)])


def _some(rows: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c][keep]) for c in PART], names=PART)


def _candidates(members: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of each part (key) that sizes and sketches do not part from all others of other components; parts have 2 BLOCK rows or so at most."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pairs in _met(batches, num, den):
            keep = np.zeros(len(rows["key"]), bool)
            for x, y in pairs:
                keep[x] = keep[y] = True
            if keep.any():
                yield _some(rows, keep)

    return members.select(*PART).repartition("key").sortWithinPartitions("key").mapInArrow(run, PART_TYPES)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of parts whose sets have more than HELD shingles dealt into pairs of blocks that have so many."""
    sizes = rows.groupBy("key").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("blocks"))
    rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "k"), F.greatest("own", "k")))
    side = F.when((F.col("side") < 2) | (F.col("own") == F.col("k")), F.col("side")).when(F.col("own") < F.col("k"), 0).otherwise(1)
    return rows.select(key.alias("key"), side.cast("int").alias("side"), *MEMBER)


def _cut(large: DataFrame, level: int, num: int, den: int) -> DataFrame:
    """Rows (key, parent, MEMBER) of large regions (parent), copied into the Voronoi regions and rings of their own pivots."""
    groups = large.groupBy("key", "c").agg(F.count("*").alias("g"), F.min(F.struct(F.xxhash64("fp", F.lit(level)).alias("h"), *BITS)).alias("own"))
    place = Window.partitionBy("key").orderBy(F.col("g").desc(), "own.h")
    first = groups.withColumn("r", F.row_number().over(place)).where(F.col("r") <= CENTRES)
    centres = first.groupBy("key").agg(F.collect_list(F.struct(*(F.col(f"own.{b}").alias(b) for b in BITS))).alias("centres"))  # CENTRES at most

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("centres")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            count, first_ = np.diff(offsets), offsets[:-1] - offsets[0]
            there = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            of = np.repeat(np.arange(batch.num_rows), count)
            far = np.zeros(len(of), np.int64)
            for b in BITS:
                far += np.bitwise_count(batch.column(b).to_numpy().view(np.uint64)[of] ^ there.field(b).to_numpy().view(np.uint64))
            if not len(of):
                continue
            cell = np.arange(len(of)) - first_[of]
            nearest = np.minimum.reduceat(far, first_)
            home = np.minimum.reduceat(np.where(far == nearest[of], cell, CENTRES), first_)[of]
            widest = _widest(batch.column("n").to_numpy(), num, den)[of]
            at = np.flatnonzero((cell == home) | ((cell < home) & (far <= nearest[of] + 2 * widest)))
            low = np.maximum(0, far[at] - widest[at]) // RING
            high = np.where(cell[at] == home[at], far[at], np.minimum(SKETCH, far[at] + widest[at])) // RING
            times = high - low + 1
            row, cells, rings = np.repeat(of[at], times), np.repeat(cell[at], times), ranges(low, times)
            key = mix(batch.column("key").to_numpy()[row].view(np.uint64) + mix((np.uint64(level + 1) << np.uint64(40)) + (cells.astype(np.uint64) << np.uint64(20)) + rings.astype(np.uint64)))
            rest = batch.select(["key", *MEMBER]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *rest.columns], names=["key", "parent", *rest.schema.names[1:]])

    joined = large.select("key", *MEMBER).join(centres, "key")
    return joined.mapInArrow(run, "key long, parent long, " + ", ".join(f"{c} long" for c in MEMBER))


def _sizes(rows: DataFrame, *more: str) -> DataFrame:
    """key, g, main, m, s, cost of each region that has sets of several components: its rows, its largest component, the
    blocks of that one's rows and of the others, and the rows that its parts have."""
    of_component = rows.groupBy("key", *more, "c").agg(F.count("*").alias("k"))
    sizes = of_component.groupBy("key", *more).agg(F.sum("k").alias("g"), F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("cs")).where("cs > 1")
    most, rest = F.col("top.k"), F.col("g") - F.col("top.k")
    sizes = sizes.withColumn("m", F.ceil(most / BLOCK).cast("int")).withColumn("s", F.ceil(rest / BLOCK).cast("int"))
    cost = F.when(F.col("g") <= BLOCK, F.col("g")).otherwise(most * F.col("s") + rest * (F.col("m") + F.col("s")))
    return sizes.select("key", *more, "g", F.col("top.c").alias("main"), "m", "s", cost.alias("cost"))


def _sum(rows: DataFrame, column: str) -> int:
    return rows.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def _dealt(large: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of regions in parts, by hash: one for each block of the largest component and block of the others, one for each pair of blocks of the others."""
    rows = large.join(sizes.select("key", "main", "m", "s"), "key").withColumn("of_main", F.col("c") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.when(F.col("of_main"), F.col("m")).otherwise(F.col("s"))).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("of_main"), F.col("s")).otherwise(F.col("m") + F.col("s")) - 1)))
    to_main = ~F.col("of_main") & (F.col("k") < F.col("m"))
    other = F.col("k") - F.col("m")
    a = F.when(F.col("of_main"), F.col("own")).when(to_main, F.col("k")).otherwise(F.least("own", other))
    b = F.when(F.col("of_main"), F.col("k")).when(to_main, F.col("own")).otherwise(F.greatest("own", other))
    part = F.xxhash64("key", F.col("of_main") | to_main, a, b)
    # rows of a block meet in its part with itself; in a part with another block they meet that block's rows only
    side = F.when(F.col("of_main"), 0).when(to_main, 1).when(F.col("own") == other, 2).when(F.col("own") < other, 0).otherwise(1)
    return rows.select(part.alias("key"), side.cast("int").alias("side"), *MEMBER)


def _parts(rows: DataFrame, scratch: Scratch, num: int, den: int) -> tuple[DataFrame, int]:
    """Rows (key, g, MEMBER) of all regions, the large ones cut or dealt until each part (key) has 2 BLOCK rows or so at most; how many."""
    columns = ["key", *MEMBER]
    whole = F.lit(2).alias("side")
    done = [rows.where(F.col("g") <= BLOCK).select(*columns, whole)]
    amount = done[0].count()
    large = rows.where(F.col("g") > BLOCK).select(*columns)
    sizes = scratch.keep(_sizes(large))
    for level in range(DEPTH + 1):
        if level:
            small = sizes.where(F.col("g") <= BLOCK)
            done.append(large.join(small.select("key"), "key").select(*columns, whole))
            amount += _sum(small, "g")
        sizes = sizes.where(F.col("g") > BLOCK)
        if sizes.isEmpty():
            break
        large = scratch.keep(large.join(sizes.select("key"), "key"))
        dear = sizes.where(F.col("cost") > COPIES * F.col("g"))
        cut = None
        if level < DEPTH and not dear.isEmpty():
            below = scratch.keep(_sizes(_cut(large.join(dear.select("key"), "key"), level, num, den), "parent"))
            after = below.groupBy(F.col("parent").alias("key")).agg(F.sum("cost").alias("after"))
            cut = scratch.keep(dear.join(after, "key", "left").where(F.coalesce("after", F.lit(0)) < F.col("cost")).select("key"))
        dealt = sizes if cut is None else sizes.join(cut, "key", "left_anti")
        done.append(_dealt(large, dealt))
        amount += _sum(dealt, "cost")
        if cut is None or cut.isEmpty():
            break
        large = scratch.keep(_cut(large.join(cut, "key"), level, num, den).select(*columns))
        sizes = scratch.keep(below.join(cut.select(F.col("key").alias("parent")), "parent").drop("parent"))
    return reduce(DataFrame.unionByName, done), amount


def _hub_pairs(large: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Pairs (hub, fp) of each region's sets and CENTRES of them, of different components, that sizes and sketches do not part."""
    h = F.xxhash64("fp", F.lit(turn))  # regions of the same sets have the same hubs
    hubs = large.groupBy("key", F.pmod(h, F.lit(CENTRES)).alias("cell")).agg(F.min(F.struct(h.alias("h"), "fp", "n", "c", *BITS)).alias("hub"))
    hubs = hubs.select("key", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("m"), F.col("hub.c").alias("d"), *(F.col(f"hub.{b}").alias(b) for b in BITS))
    met = large.alias("y").join(hubs.alias("x"), "key").where(F.col("c") != F.col("d"))
    return met.where(_near(num, den)).select("hub", "fp").distinct()


def _merged(star: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """fp, label of the sets that star (fp, label) or the links found (a, b) join: the least of those they are linked with."""
    # links between the stars' components, not between their members
    a, b = (star.select(F.col("fp").alias(c), F.col("label").alias(f"c{c}")) for c in "ab")
    found = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(found, scratch)
    over = scratch.keep(over.select(F.col("node").alias("label"), "component"))
    members = star.join(over, "label", "left").select("fp", F.coalesce("component", "label").alias("label"))
    alone = over.join(star.select(F.col("fp").alias("label")), "label", "left_anti").select(F.col("label").alias("fp"), F.col("component").alias("label"))
    return members.unionByName(alone)


def _linked(pairs: DataFrame, source: DataFrame, sets: DataFrame, scratch: Scratch, n: int, num: int, den: int, turn: float) -> DataFrame:
    """The pairs (hub, fp) whose sets are alike. Wide sketches leave little to decide; then each hub's set goes once to
    every PARTNERS of its partners (hubs are few for each set, so pairs are). Both in turns that take so many shingles or so, a wide sketch as much as an eighth of its set."""
    sized = sets.select("fp", "n")

    def ends(some: DataFrame) -> DataFrame:
        return some.select("fp").unionByName(some.select(F.col("hub").alias("fp"))).distinct()

    def turns(some: DataFrame, shingles: int) -> list[DataFrame]:
        count = max(1, -int(-shingles // turn))
        return [some.where(F.pmod(F.xxhash64("fp"), F.lit(count)) == k) for k in range(count)]

    def union(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables)

    @releasing
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = _apart(batch.column("n").to_numpy(), batch.column("m").to_numpy(), num, den)
            cells = ([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c)] for c in ("wide", "other"))
            keep = [_wide_apart(x, y) <= d for x, y, d in zip(*cells, most.tolist())]
            yield batch.select(["hub", "fp"]).filter(pa.array(keep, pa.bool_()))

    wide = _bodies(source, sets, ends(pairs), scratch, n, wide=True)
    other = wide.select(F.col("fp").alias("hub"), F.col("wide").alias("other"), F.col("n").alias("m"))
    left = (x.join(wide, "fp").join(other, "hub").select("hub", "fp", "wide", "other", "n", "m") for x in turns(pairs, _sum(pairs.join(sized, "fp"), "n") // 8))
    close = [scratch.keep(x.mapInArrow(near, "hub long, fp long")) for x in left]
    scratch.drop(wide)
    pairs = union(close)
    most = max(_sum(some.join(sized, "fp"), "n") for some in (ends(pairs), pairs))
    found = union([_alike(x, source, sets, scratch, n, num, den) for x in turns(pairs, most)])
    scratch.drop(*close)
    return found


def _alike(pairs: DataFrame, source: DataFrame, sets: DataFrame, scratch: Scratch, n: int, num: int, den: int) -> DataFrame:
    """The pairs (hub, fp) whose sets are alike, as (a, b)."""
    ends = pairs.select("fp").unionByName(pairs.select(F.col("hub").alias("fp"))).distinct()
    bodies = _bodies(source, sets, ends, scratch, n)
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    place = F.xxhash64("hub", "salt").alias("key")
    partners = pairs.join(salts, "hub").withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    partners = partners.select(place, F.lit(1).alias("side"), "hub", "fp").join(bodies.select("fp", "tokens"), "fp")
    hubs = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hubs = hubs.select(place, F.lit(0).alias("side"), "hub", F.col("hub").alias("fp")).join(bodies.select("fp", "tokens"), "fp")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for side, a, b, tokens in zip(batch.column("side").to_pylist(), batch.column("hub").to_pylist(), batch.column("fp").to_pylist(), batch.column("tokens")):
                other = np.frombuffer(tokens.as_buffer(), np.uint64)
                if side == 0:
                    hub, own = a, other.copy()
                    continue
                assert a == hub, "the hub's set comes before those of its partners"
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int((own[at] == other).sum())
                if den * both >= num * (len(own) + len(other) - both):
                    found.append((a, b))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = ("key", "side", "hub", "fp", "tokens")
    both = hubs.select(*columns).unionByName(partners.select(*columns)).repartition("key").sortWithinPartitions("key", "hub", "side")
    found = scratch.keep(both.mapInArrow(run, "a long, b long"))
    scratch.drop(bodies)
    return found


def _joined(near: DataFrame, source: DataFrame, sets: DataFrame, scratch: Scratch, n: int, num: int, den: int, turn: float) -> DataFrame:
    """Links (a, b) that join all components which links within the parts join, one for each join of a part. Wide sketches, then
    whole sets go to each row of a part that is left, in turns as above."""

    def turns(rows: DataFrame, shingles: int) -> list[DataFrame]:
        count = max(1, -int(-shingles // turn))
        return [rows.where(F.pmod(F.xxhash64("key"), F.lit(count)) == k) for k in range(count)]

    def dealt(rows: DataFrame, bodies: DataFrame) -> DataFrame:
        return rows.select(*PART).join(bodies, "fp").repartition("key").sortWithinPartitions("key")

    @releasing
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pairs in _met(batches, num, den):
            cells = [np.frombuffer(x, np.uint8) for x in rows["wide"]]
            keep = bytearray(len(cells))
            for x, y in pairs:
                most = _apart(rows["n"][x], rows["n"][y], num, den)
                for i, j, d in zip(x.tolist(), y.tolist(), most.tolist()):
                    if not (keep[i] and keep[j]) and _wide_apart(cells[i], cells[j]) <= d:
                        keep[i] = keep[j] = 1
            yield _some(rows, np.frombuffer(keep, bool))

    @releasing
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pairs in _met(batches, num, den):
            own = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
            label, root = np.unique(rows["c"], return_inverse=True)[1].tolist(), list(range(len(own)))

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            x_, y_ = [], []
            for x, y in pairs:
                for i, j in zip(x.tolist(), y.tolist()):
                    a, b = find(label[i]), find(label[j])
                    if a != b:
                        at = np.minimum(np.searchsorted(own[i], own[j]), len(own[i]) - 1)
                        both = int((own[i][at] == own[j]).sum())
                        if den * both >= num * (len(own[i]) + len(own[j]) - both):
                            root[a] = b
                            x_.append(i)
                            y_.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(rows["fp"][np.array(k, np.int64)]) for k in (x_, y_)], names=["a", "b"])

    wide = _bodies(source, sets, near.select("fp").distinct(), scratch, n, wide=True)
    left = [scratch.keep(dealt(x, wide.select("fp", "wide")).mapInArrow(close, PART_TYPES)) for x in turns(near, _sum(near, "n") // 8)]
    scratch.drop(wide)
    blocks = scratch.keep(_in_blocks(reduce(DataFrame.unionByName, left)))
    scratch.drop(*left)
    found = []
    for some in turns(blocks, _sum(blocks, "n")):
        bodies = _bodies(source, sets, some.select("fp").distinct(), scratch, n)
        found.append(scratch.keep(dealt(some, bodies).mapInArrow(join, "a long, b long")))
        scratch.drop(bodies)
    scratch.drop(blocks)
    return reduce(DataFrame.unionByName, found)


def _sets(source: DataFrame, scratch: Scratch, n: int, num: int, den: int, part: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id, n_shingles and fp of each document; the distinct sets of those that meet the condition: fp, id, n, head, bits)."""
    known = scratch.keep(_classes(source, n, num, den))
    sets = known.where(part).groupBy("fp").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("head").alias("head"), *(F.first(b).alias(b) for b in BITS))
    sets, slim = scratch.keep(sets), scratch.keep(known.select("doc_id", "id", "n_shingles", "fp"))
    scratch.drop(known)
    return slim, sets


def clusters(source: DataFrame, sets: DataFrame, scratch: Scratch, n: int, num: int, den: int) -> DataFrame:
    """fp, component (the least fp linked with it, over any number of links) of the sets that are linked with another.

    source: id, data; sets: what _sets gave, used up."""
    spark = source.sparkSession
    total, shingles = sets.agg(F.coalesce(F.sum(F.length("head")) / 8, F.lit(0)).cast("long"), F.coalesce(F.sum("n"), F.lit(0))).first()
    turn = max(TURN_SHINGLES, SHINGLES_SHARE * shingles)
    late = _head_pivots(sets).where((F.col("n") > COMMON) & (F.col("n") > total // MOST)).select("pivot").toPandas()["pivot"].to_numpy()  # MOST rows at most
    common = spark.sparkContext.broadcast(np.sort(late.astype(np.int64).view(np.uint64)))
    scratch.collect()

    of_heads = scratch.keep(_head_regions(sets, num, den, common))
    whole = _bodies(source, sets, of_heads.where("pivot IS NULL").select("fp"), scratch, n)  # kept, as two functions in one stage take two workers for each task
    of_texts = scratch.keep(_text_regions(whole.select("fp", "tokens"), num, den, common))
    with_heads, sets = sets, scratch.keep(sets.drop("head"))
    scratch.drop(with_heads)
    regions = of_heads.where("pivot IS NOT NULL").unionByName(of_texts)
    shared = regions.groupBy("pivot").agg(F.count("*").alias("g"), F.min("fp").alias("hub")).where("g > 1")
    first = scratch.keep(regions.join(shared, "pivot"))
    scratch.drop(of_heads, of_texts, whole)
    scratch.collect()

    sized = sets.select("fp", "n", *BITS)
    star = first.where("fp <> hub").select("hub", "fp").distinct().join(sized.alias("y"), "fp")
    star = star.join(sized.select(F.col("fp").alias("hub"), F.col("n").alias("m"), *(F.col(b) for b in BITS)).alias("x"), "hub")
    pairs = scratch.keep(star.where(_near(num, den)).select("hub", "fp"))
    scratch.collect()
    linked = _linked(pairs, source, sets, scratch, n, num, den, turn)
    star = components(linked, scratch)
    star = scratch.keep(star.select(F.col("node").alias("fp"), F.col("component").alias("label")))
    scratch.drop(pairs)

    def labelled(rows: DataFrame) -> DataFrame:
        of_set = sized.join(star, "fp", "left").withColumn("c", F.coalesce("label", "fp")).drop("label")
        return rows.select(F.col("pivot").alias("key"), "g", "fp").join(of_set, "fp")

    own = Scratch(spark)
    for k in range(ROUNDS):
        large = own.keep(labelled(first.where(F.col("g") > BLOCK)))
        mixed = own.keep(_sizes(large))
        if _sum(mixed, "cost") <= ENOUGH:
            break
        pairs = own.keep(_hub_pairs(large.join(mixed.select("key"), "key"), k, num, den))
        linked = _linked(pairs, source, sets, own, n, num, den, turn)
        star = scratch.keep(_merged(star, linked, own))
        own.clear()
    least = first.groupBy("fp").agg(F.sort_array(F.collect_list("pivot")).alias("r"))
    least = least.select("fp", *(F.coalesce(F.get("r", F.lit(k)), F.lit((1 << 63) - 1)).alias(q) for k, q in enumerate(FIRST)))
    rows = scratch.keep(labelled(first).withColumn("p", F.col("key")).join(least, "fp"))
    scratch.drop(first)
    parts, amount = _parts(rows, own, num, den)
    turns = max(1, -int(-amount // max(TURN_ROWS, ROWS_SHARE * shingles)))
    some = (parts.where(F.pmod(F.xxhash64("key"), F.lit(turns)) == k) for k in range(turns))
    some = [scratch.keep(_candidates(x, num, den)) for x in some]
    own.clear()
    scratch.drop(rows)
    scratch.collect()
    found = _joined(reduce(DataFrame.unionByName, some), source, sets, scratch, n, num, den, turn)
    scratch.drop(*some)
    return _merged(star, found, scratch).withColumnRenamed("label", "component")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its least node) of the nodes on edges (a, b), by alternating large and small stars."""
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        for large in (True, False):
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            moved = both.join(least, "u")
            if large:  # neighbours above a node go to its least neighbour
                moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:  # neighbours below a node, and itself
                moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            new = scratch.keep(moved.where("u <> v").distinct())
            scratch.drop(edges)
            edges = new
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def groups(docs: DataFrame, n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id with an equal set)."""
    scratch = Scratch(docs.sparkSession)
    source = texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("id"), F.col("text").cast("binary").alias("data"))
    part = "doc_id IS NOT NULL AND n_shingles > 0"
    known, sets = _sets(source, scratch, n, num, den, part)
    found = scratch.keep(clusters(source.where("doc_id IS NOT NULL"), sets, scratch, n, num, den))
    scratch.clear(known, found)
    least = known.where(part).groupBy("fp").agg(F.min("doc_id").alias("class_id")).join(found, "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    least = scratch.keep(least)
    ids = least.groupBy("c").agg(F.min("class_id").alias("component_id"))
    least = scratch.keep(least.join(ids, "c").select("fp", "class_id", "component_id"))
    out = known.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("fp")).alias("fp")).join(least, "fp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def representatives(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with exactly one row of each component left, that of the least doc_id (one without a doc_id comes last).

    Near copies of a corpus share 80 % of their five-word shingles; N and its threshold are those of op5 alone.
    Sets are joined by name, so rows without a doc_id take part, and texts that share a doc_id are told apart.
    Texts without words are linked with nothing; of those, as of all rows, equal ones (doc_id and text) leave one."""
    scratch = Scratch(docs.sparkSession)
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    source = texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("id"), F.col("text").cast("binary").alias("data"))
    known, sets = _sets(source, scratch, n, num, den, "n_shingles > 0")
    found = scratch.keep(clusters(source, sets, scratch, n, num, den))
    scratch.clear(known, found)
    rows = known.groupBy("doc_id", "id", "n_shingles", "fp").agg(F.count("*").alias("k"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "id", "k")).alias("row")
    of_set = rows.where("n_shingles > 0").groupBy("fp").agg(first)
    chosen = of_set.join(found, "fp", "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("row").alias("row")).select("row.id", "row.k")
    chosen = scratch.keep(chosen.unionByName(rows.where("n_shingles = 0").select("id", "k")))
    keyed = docs.withColumn("__j_key", key)
    once, often = (keyed.join(chosen.where(w).select(F.col("id").alias("__j_id")), F.col("__j_key") == F.col("__j_id"), "left_semi") for w in ("k = 1", "k > 1"))
    return once.unionByName(often.dropDuplicates(["__j_key"])).select(*docs.columns)
