"""Plans that must not carry more than their statement reads, and places of relations against plain Python."""

import random
from pathlib import Path

import pytest

from fellgate.functions.geometry import Extent
from fellgate.sources import importer
from fellgate.sources.catalog import Catalog

DATA = Path("/root/testdata/sf0.001")
#: Statements that need bounds and whether a cell lies in a box, but no list of cells or nodes.
LEAN = (
    "key_absent", "relation_bbox", "validate", "relations_open_depth", "relation_children", "node_relations", "way_relations", "relation_ways", "relation_parents", "or_sub", "relation_nodes",
    "geojson_polygons", "cmp_negative", "key_present", "nested_sub",
)


def _plan(spark, name):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", LEAN)
def test_no_lists_where_bounds_are_enough(spark, name):
    plan = _plan(spark, name)
    assert "collect_list" not in plan and "explode" not in plan


def _hierarchy(seed):
    """Relations 0..19 with nodes, ways and children at random, cycles among them; some have no place."""
    rng = random.Random(seed)
    nodes = [(i, rng.randrange(100) / 10 + 0.05, rng.randrange(100) / 10 + 0.05, {}) for i in range(30)]
    way_nodes = [(w, p, rng.randrange(30)) for w in range(10) for p in range(3)]
    some = lambda n, m, k: sorted({(rng.randrange(n), rng.randrange(m)) for _ in range(k)})
    return nodes, way_nodes, some(20, 30, 8), some(20, 10, 8), some(20, 20, 22)


@pytest.mark.parametrize("depth", [0, 1, 2, None])
def test_places_of_relations_at_any_depth(spark, depth):
    nodes, way_nodes, rel_nodes, rel_ways, rel_rels = _hierarchy(5)
    tags, frame = "map<string,string>", spark.createDataFrame
    catalog = importer.build(
        frame(nodes, f"id long, lon double, lat double, tags {tags}"), frame([(w, {}) for w in range(10)], f"id long, tags {tags}"), frame(way_nodes, "way_id long, pos int, node_id long"),
        frame([(r, {}) for r in range(20)], f"id long, tags {tags}"), frame(rel_nodes, "rel_id long, node_id long"), frame(rel_ways, "rel_id long, way_id long"), frame(rel_rels, "parent_id long, child_id long"),
        depth=depth,
    )
    place = {i: (x, y) for i, x, y, _ in nodes}
    points = {r: {place[n] for a, n in rel_nodes if a == r} | {place[n] for a, w in rel_ways if a == r for v, _, n in way_nodes if v == w} for r in range(20)}
    first = dict(points)
    for _ in range(20 if depth is None else depth):
        points = {r: first[r].union(*(points[c] for p, c in rel_rels if p == r)) for r in first}
    want = {r: (min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p), sorted({(int(x / 0.1), int(y / 0.1)) for x, y in p})) for r, p in points.items() if p}
    got = {r["id"]: (*(r[c] for c in ("min_lon", "min_lat", "max_lon", "max_lat")), [tuple(c) for c in r["cells"]]) for r in catalog.relations.collect()}
    assert got == want and 0 < len(got) < 20
    extent = Extent(20, 20, 60, 60)
    relations = importer.locate_relations(frame([(r, {}) for r in range(20)], f"id long, tags {tags}"), catalog, depth, extent)
    assert {r["id"]: r["within"] for r in relations.select("id", "within").collect()} == {r: any(extent.has(*c) for c in p[4]) for r, p in want.items()}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_a_save_builds_each_table_on_written_ones(spark, tmp_path, monkeypatch):
    from fellgate.sources import star
    from fellgate.sources.catalog import EDGES, TABLES

    read, write = {}, Catalog.write

    def noted(df, name, path, partitions=None):
        read[name] = {f.split(str(tmp_path))[-1].split("/")[1] if str(tmp_path) in f else f.split("/")[-1] for f in df.inputFiles()}
        write(df, name, path, partitions)

    monkeypatch.setattr(Catalog, "write", staticmethod(noted))
    star.catalog(spark, str(DATA)).save(str(tmp_path))
    assert not read["relations"] & {"lineitem.parquet", "orders.parquet", "part.parquet"} and "ways" in read["relations"]
    assert read.keys() == {*TABLES, *(f"{a}_to_{b}" for a, b in EDGES)}
    assert all(not any(f.endswith(".parquet") for f in read[f"{a}_to_{b}"]) for a, b in EDGES)
    loaded = Catalog.load(spark, str(tmp_path))
    assert {r["id"] for r in loaded.relations.collect()} == {r["id"] for r in star.catalog(spark, str(DATA)).relations.select("id").collect()}
