"""OSM files as raw objects: XML by Spark's own source, PBF blocks decoded on the executors.

A PBF file is a row of blobs behind headers that give their sizes.  Tasks take
ranges of its bytes, find the first header in theirs, and read, unpack and decode
the blobs that begin there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fellgate.functions.geometry import CELL
from fellgate.sources import importer
from fellgate.sources.catalog import Catalog
from fellgate.sources.shared import delete

_TAG = T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))
_ND = T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))
_MEMBER = T.ArrayType(T.StructType([T.StructField("_type", T.StringType()), T.StructField("_ref", T.LongType())]))
_OBJECT = "kind string, id long, lon double, lat double, tags map<string,string>, refs array<long>, members array<struct<type:string,ref:long>>"


def _tags_of(tag: str) -> F.Column:
    entries = F.transform(F.coalesce(tag, F.array().cast(_TAG)), lambda t: F.struct(t["_k"], t["_v"]))
    return F.map_from_entries(entries)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Raw objects of an .osm file: kind, id, lon, lat, tags, refs, members."""

    def rows(name: str, *extra: T.StructField) -> DataFrame:
        schema = T.StructType([T.StructField("_id", T.LongType()), *extra, T.StructField("tag", _TAG)])
        return spark.read.format("xml").option("rowTag", name).schema(schema).load(path).where("_id IS NOT NULL")

    none = {"lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double"), "refs": F.lit(None).cast("array<long>"), "members": F.lit(None).cast("array<struct<type:string,ref:long>>")}
    order = ("kind", "id", "lon", "lat", "tags", "refs", "members")
    nodes = rows("node", T.StructField("_lon", T.DoubleType()), T.StructField("_lat", T.DoubleType())).select(F.lit("node").alias("kind"), F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags_of("tag").alias("tags"))
    ways = rows("way", T.StructField("nd", _ND)).select(F.lit("way").alias("kind"), F.col("_id").alias("id"), _tags_of("tag").alias("tags"), F.transform("nd", lambda n: n["_ref"]).alias("refs"))
    relations = rows("relation", T.StructField("member", _MEMBER)).select(F.lit("relation").alias("kind"), F.col("_id").alias("id"), _tags_of("tag").alias("tags"), F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"))).alias("members"))
    parts = [df.withColumns({c: none[c] for c in order if c not in df.columns}).select(*order) for df in (nodes, ways, relations)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        match key & 7:
            case 0:
                value, at = _varint(data, at)
                yield key >> 3, value
            case 2:
                size, at = _varint(data, at)
                yield key >> 3, data[at : at + size]
                at += size
            case 1:
                at += 8
            case 5:
                at += 4
            case other:
                raise ValueError(f"wire type {other}")


def _numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def _signed(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _int64(value: int) -> int:
    """A number that is not zigzag: negative ones are written modulo 2**64."""
    return value - (1 << 64) if value >> 63 else value


def _running(values: list[int]) -> list[int]:
    """Sums of zigzag differences."""
    out, total = [], 0
    for v in values:
        total += _signed(v)
        out.append(total)
    return out


def _unpacked(blob: bytes) -> bytes:
    for number, value in _fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
    raise ValueError("a blob that is neither raw nor packed by zlib")


def decode_block(data: bytes) -> Iterator[tuple]:
    """Rows of _OBJECT of one primitive block."""
    strings: list[str] = []
    groups, granularity, lat0, lon0 = [], 100, 0, 0
    for number, value in _fields(data):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for n, v in _fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat0 = _int64(value)
        elif number == 20:
            lon0 = _int64(value)

    def degrees(v: int, origin: int) -> float:
        return (origin + granularity * v) / 1e9

    def tags(keys: list[int], values: list[int]) -> dict[str, str]:
        return {strings[k]: strings[v] for k, v in zip(keys, values)}

    for group in groups:
        for number, message in _fields(group):
            if number == 2:  # dense nodes
                parts = dict(_fields(message))
                ids, lats, lons = (_running(_numbers(parts.get(k, b""))) for k in (1, 8, 9))
                pairs = iter(_numbers(parts.get(10, b"")))
                for id_, lat, lon in zip(ids, lats, lons):
                    own = {}
                    while k := next(pairs, 0):
                        own[strings[k]] = strings[next(pairs)]
                    yield ("node", id_, degrees(lon, lon0), degrees(lat, lat0), own, None, None)
            elif number in (1, 3, 4):
                parts = dict(_fields(message))
                own = tags(_numbers(parts.get(2, b"")), _numbers(parts.get(3, b"")))
                if number == 1:
                    yield ("node", _signed(parts[1]), degrees(_signed(parts[9]), lon0), degrees(_signed(parts[8]), lat0), own, None, None)
                elif number == 3:
                    yield ("way", _int64(parts[1]), None, None, own, _running(_numbers(parts.get(8, b""))), None)
                else:
                    kinds = ("node", "way", "relation")
                    members = [(kinds[t], ref) for ref, t in zip(_running(_numbers(parts.get(9, b""))), _numbers(parts.get(10, b"")))]
                    yield ("relation", _int64(parts[1]), None, None, own, None, members)


MARK = b"\x0a\x07OSMData"  # how the header of a data blob begins, after its length
RANGE = 64 << 20


def _header(content: bytes) -> tuple[int, dict] | None:
    """(length, fields) of the blob header at the start of the bytes, if one stands there."""
    if len(content) < 4:
        return None
    (size,) = struct.unpack(">i", content[:4])
    if not 0 < size <= 1 << 16 or len(content) < 4 + size:
        return None
    try:
        header = dict(_fields(content[4 : 4 + size]))
    except (IndexError, ValueError):
        return None
    return (4 + size, header) if isinstance(header.get(1), bytes) and isinstance(header.get(3), int) else None


def blobs(content: bytes) -> Iterator[bytes]:
    """Data blobs of a PBF file's bytes."""
    at = 0
    while at < len(content):
        size, header = _header(content[at : at + 4 + (1 << 16)])
        at += size
        if header[1] == b"OSMData":
            yield content[at : at + header[3]]
        at += header[3]


def blobs_in(file, start: int, stop: int, length: int) -> Iterator[bytes]:
    """Data blobs whose headers begin in [start, stop) of an open file of this length."""

    def header(at: int) -> tuple[int, dict] | None:
        file.seek(at)
        return _header(file.read(min(length - at, 4 + (1 << 16)))) if at < length else None

    def first() -> int:
        """The first header at or after start: one behind which the next one, or the end, stands where it says."""
        at = start
        while start and at < min(stop, length):
            file.seek(at)
            window = file.read(min(length, stop + len(MARK) + 4) - at)[: 1 << 20]
            found = window.find(MARK, 4)
            if found < 0:
                at += max(1, len(window) - len(MARK) - 3)
                continue
            at += found - 4
            own = header(at)
            if own and ((end := at + own[0] + own[1][3]) == length or (end < length and header(end))):
                return at
            at += 1
        return at if start else 0

    at = first()
    while at < min(stop, length):
        size, fields = header(at)
        if fields[1] == b"OSMData":
            file.seek(at + size)
            yield file.read(fields[3])
        at += size + fields[3]


def _opened(path: str):
    """(file system, path there) by Arrow, which reads parts of files; None if it does not know this kind of path."""
    from pyarrow import ArrowInvalid, fs

    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    try:
        found, name = fs.FileSystem.from_uri(uri)
        return (found, name) if found.get_file_info(name).is_file else None
    except (ArrowInvalid, OSError, NotImplementedError):
        return None


def read_pbf(spark: SparkSession, path: str, span: int = RANGE) -> DataFrame:
    """Raw objects of .pbf files, of any size where Arrow can open the path on the executors: each task then reads and
    decodes a range of bytes. Where only Spark's readers open it, a file (of 2 GB at most) is read by one task and its blobs are dealt out."""
    import pyarrow as pa

    files = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]  # names alone

    def whole(batches):
        for batch in batches:
            for content in batch.column("content"):
                for blob in blobs(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    def ranges(batches):
        for batch in batches:
            for name, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
                system, inner = _opened(name)
                with system.open_input_file(inner) as file:
                    for blob in blobs_in(file, start, start + span, length):
                        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    def decode(batches):
        import pandas as pd

        names = [f.split(" ")[0] for f in ("kind", "id", "lon", "lat", "tags", "refs", "members")]
        for batch in batches:
            for blob in batch["blob"]:
                rows = [(*r[:6], None if r[6] is None else [{"type": t, "ref": x} for t, x in r[6]]) for r in decode_block(_unpacked(blob))]
                yield pd.DataFrame(rows, columns=names).astype({"refs": object, "members": object, "tags": object})

    if all(_opened(name) for name, _ in files):
        parts = [(name, start, length) for name, length in files for start in range(0, length, span)]
        found = spark.createDataFrame(parts, "path string, start long, length long").repartition(max(1, len(parts))).mapInArrow(ranges, "blob binary")
    else:
        found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, "blob binary")
    return found.repartition(spark.sparkContext.defaultParallelism).mapInPandas(decode, _OBJECT)


def catalog_of(objects: DataFrame, width: float = CELL, precision: str = "float64", depth: int | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Catalog:
    """Canonical tables of raw objects; depth and keep as in importer.build."""
    of = {k: objects.where(F.col("kind") == k) for k in ("node", "way", "relation")}
    member = of["relation"].select(F.col("id").alias("rel_id"), F.explode("members").alias("m"))

    def members(kind: str, name: str) -> DataFrame:
        return member.where(F.col("m.type") == kind).select("rel_id", F.col("m.ref").alias(name))

    way_nodes = of["way"].select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))
    rel_rels = members("relation", "child_id").withColumnRenamed("rel_id", "parent_id")
    return importer.build(of["node"].select("id", "lon", "lat", "tags"), of["way"].select("id", "tags"), way_nodes, of["relation"].select("id", "tags"), members("node", "node_id"), members("way", "way_id"), rel_rels, width, precision, depth, keep)


def import_osm(spark: SparkSession, source: str, target: str, width: float = CELL, precision: str = "float64", depth: int | None = None) -> Catalog:
    """Read an .osm or .pbf file, write the canonical tables to target and load them from there.

    The file is decoded once, into raw objects by kind; each table is then built from written ones."""
    if not source.endswith((".osm", ".pbf")):
        raise ValueError(f"neither .osm nor .pbf: {source}")
    objects = read_xml(spark, source) if source.endswith(".osm") else read_pbf(spark, source)
    raw = f"{target}/raw"
    objects.write.mode("overwrite").partitionBy("kind").parquet(raw)

    def keep(name: str, df: DataFrame) -> DataFrame:
        Catalog.write(df, name, target)
        return Catalog.read(spark, name, target)

    catalog_of(spark.read.schema(objects.schema).parquet(raw), width, precision, depth, keep).save_edges(target)
    delete(spark, raw)
    return Catalog.load(spark, target)
