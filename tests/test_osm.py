import struct
import zlib

from fellgate.__main__ import main
from fellgate.engine import Engine
from fellgate.sources.osm import import_osm

XML = """<?xml version='1.0' encoding='UTF-8'?>
<osm version='0.6'>
  <node id='1' lat='53.587' lon='9.9330'><tag k='height' v='10.5' /><tag k='natural' v='tree' /></node>
  <node id='2' lat='53.587' lon='9.9331'><tag k='amenity' v='bench' /><tag k='backrest' v='no' /></node>
  <node id='3' lat='53.687' lon='9.9332' />
  <way id='4'><nd ref='1' /><nd ref='3' /><nd ref='1' /><tag k='highway' v='path' /></way>
  <relation id='5'><member type='way' ref='4' role='' /><member type='node' ref='2' role='x' /><tag k='type' v='route' /></relation>
  <relation id='6'><member type='relation' ref='5' role='' /></relation>
</osm>"""
BOX = "bbox(9.9,53.5,10,53.7)"


def held(engine):
    def ids(text):
        return sorted(r["id"] for r in engine.query(text).select("id").collect())

    assert ids(BOX + ".nodes{height>10}") == [1]
    assert ids(BOX + ".nodes{this.ways{highway=*}}") == [1, 3]
    assert ids(BOX + ".ways{this.relations{type=route}}") == [4]
    assert ids(BOX + ".relations{x!=*}") == [5, 6]
    assert ids(BOX + ".relations{this.child_relations{this.nodes{amenity=bench}}}") == [6]
    way = engine.catalog.ways.first()
    assert [n["id"] for n in way["nodes"]] == [1, 3, 1] and len(way["cells"]) == 2


def test_xml(spark, tmp_path):
    (tmp_path / "x.osm").write_text(XML)
    held(Engine(import_osm(spark, str(tmp_path / "x.osm"), str(tmp_path / "index"))))


def varint(n):
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def deltas(values):
    return b"".join(varint(zigzag(b - a)) for a, b in zip([0, *values], values))


def pbf():
    words = ["", "height", "10.5", "natural", "tree", "amenity", "bench", "highway", "path", "type", "route"]
    at = {w: i for i, w in enumerate(words)}
    table = b"".join(field(1, w.encode()) for w in words)
    lat, lon = [535870000, 535870000, 536870000], [99330000, 99331000, 99332000]
    keys = [at["height"], at["10.5"], at["natural"], at["tree"], 0, at["amenity"], at["bench"], 0, 0]
    dense = field(1, deltas([1, 2, 3])) + field(8, deltas(lat)) + field(9, deltas(lon)) + field(10, b"".join(map(varint, keys)))
    way = field(1, 4) + field(2, varint(at["highway"])) + field(3, varint(at["path"])) + field(8, deltas([1, 3, 1]))
    rel = field(1, 5) + field(2, varint(at["type"])) + field(3, varint(at["route"])) + field(9, deltas([4, 2])) + field(10, bytes([1, 0]))
    parent = field(1, 6) + field(9, deltas([5])) + field(10, bytes([2]))
    block = field(1, table) + field(2, field(2, dense)) + field(2, field(3, way)) + field(2, field(4, rel) + field(4, parent))
    out = b""
    for kind, data in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = field(2, len(data)) + field(3, zlib.compress(data))
        header = field(1, kind) + field(3, len(blob))
        out += struct.pack(">i", len(header)) + header + blob
    return out


def test_pbf_and_command_line(spark, tmp_path):
    (tmp_path / "x.osm.pbf").write_bytes(pbf())
    index = str(tmp_path / "index")
    assert main(["--index", index, "import", str(tmp_path / "x.osm.pbf")]) == 0
    held(Engine.load(spark, index))
    out = tmp_path / "out.geojson"
    assert main(["--index", index, "query", BOX + ".nodes{amenity=bench}", "--output", str(out)]) == 0
    assert '"@osm_id":2' in out.read_text()
    assert main(["--index", index, "query", "bbox(1"]) == 1


def test_bounds_reach_the_top_of_a_chain_within_one_cell(spark):
    from fellgate.sources import importer

    nodes = spark.createDataFrame([(i, 9.91 + i / 100, 53.55, {}) for i in range(1, 6)], "id long, lon double, lat double, tags map<string,string>")
    relations = spark.createDataFrame([(i, {}) for i in range(1, 6)], "id long, tags map<string,string>")
    pairs = lambda rows, a, b: spark.createDataFrame(rows, f"{a} long, {b} long")
    none = spark.createDataFrame([], "id long, tags map<string,string>")
    made = importer.build(nodes, none, spark.createDataFrame([], "way_id long, pos int, node_id long"), relations, pairs([(i, i) for i in range(1, 6)], "rel_id", "node_id"), pairs([], "rel_id", "way_id"), pairs([(i, i + 1) for i in range(1, 5)], "parent_id", "child_id"))
    assert {r["id"]: round(r["max_lon"], 6) for r in made.relations.collect()} == {i: 9.96 for i in range(1, 6)}


def test_negative_offsets_and_ids():
    from fellgate.sources.osm import decode_block

    wrap = lambda v: varint(v % 2**64)
    dense = field(1, deltas([-7])) + field(8, deltas([-100])) + field(9, deltas([200])) + field(10, bytes([0]))
    block = field(1, field(1, b"")) + field(2, field(2, dense)) + field(2, field(3, varint(1 << 3) + wrap(-4) + field(8, deltas([-7])))) + field(2, field(4, varint(1 << 3) + wrap(-5)))
    block += varint(19 << 3) + wrap(-1_000_000_000) + varint(20 << 3) + wrap(-2_000_000_000)
    node, way, relation = decode_block(block)
    assert node[:4] == ("node", -7, -2 + 2e-5, -1 - 1e-5) and way[:2] == ("way", -4) and way[5] == [-7] and relation[:2] == ("relation", -5)


def test_a_file_is_decoded_once(spark, tmp_path, monkeypatch):
    from fellgate.sources import osm

    (tmp_path / "x.osm.pbf").write_bytes(pbf())
    counter = tmp_path / "decoded"
    counter.mkdir()
    read = osm.read_pbf

    def slow(spark_, path):
        from pyspark.sql import functions as F

        def seen(batches, folder=str(counter)):
            import uuid

            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield from batches

        objects = read(spark_, path).coalesce(1)
        return objects.mapInPandas(seen, objects.schema).select(*map(F.col, objects.columns))

    monkeypatch.setattr(osm, "read_pbf", slow)
    osm.import_osm(spark, str(tmp_path / "x.osm.pbf"), str(tmp_path / "index"))
    assert len(list(counter.iterdir())) == 1
    held(Engine.load(spark, str(tmp_path / "index")))


def test_ranges_of_a_file_give_each_blob_once(spark, tmp_path):
    import io
    import random

    from fellgate.sources.osm import MARK, blobs, blobs_in

    rng = random.Random(2)
    out = pbf()
    for _ in range(40):  # blobs that hold what looks like headers
        blob = field(1, rng.randbytes(rng.randint(0, 300)) + MARK + rng.choice([b"", b"\x18\x05", b"\0\0\0\x0d" + MARK + b"\x18\x05"]) + rng.randbytes(rng.randint(0, 40)))
        header = field(1, b"OSMData") + field(3, len(blob))
        out += struct.pack(">i", len(header)) + header + blob
    want = list(blobs(out))
    for span in (1, 7, 50, 333, 5000, 10**6):
        got = [b for start in range(0, len(out), span) for b in blobs_in(io.BytesIO(out), start, start + span, len(out))]
        assert got == want, span


def test_pbf_by_ranges(spark, tmp_path):
    from fellgate.sources import osm

    (tmp_path / "x.osm.pbf").write_bytes(pbf())
    path = str(tmp_path / "x.osm.pbf")
    rows = [sorted(map(str, osm.read_pbf(spark, path, span).collect())) for span in (16, 1 << 20)]
    assert rows[0] == rows[1] and len(rows[0]) == 6
