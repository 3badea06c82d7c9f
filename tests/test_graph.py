"""A small hand-made graph, and random filters held against a plain evaluator."""

import json
import random
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer
from threading import Thread

import pytest

from fellgate.engine import Engine
from fellgate.functions.geometry import Extent
from fellgate.functions.ordering import less
from fellgate.lang.parser import parse
from fellgate.lang.syntax import And, Compare, HasKey, Not, Or, Related
from fellgate.operators import geojson, inspect
from fellgate.plans.compiler import Compiler
from fellgate.sources import importer
from fellgate.sources.catalog import Catalog

NODES = [(1, 0.05, 0.05, {"a": "2"}), (2, 0.15, 0.05, {"a": "2.5 m", "b": "yes"}), (3, 0.15, 0.15, {}), (4, -0.05, 0.05, {"a": "-1"}), (5, 0.45, 0.45, {"a": "5-LOW", "b": "no"}), (6, 0.06, 0.05, None)]
WAYS = [(10, {"w": "closed", "a": "2.2"}), (11, {"w": "cross"}), (12, {"w": "empty"}), (13, None)]
WAY_NODES = [(10, 0, 1), (10, 1, 2), (10, 2, 3), (10, 3, 1), (11, 0, 3), (11, 1, 5), (13, 0, 6)]
RELATIONS = [(20, {"r": "nodes"}), (21, {"r": "ways", "a": "7"}), (22, {"r": "parent"}), (23, {"r": "nowhere"}), (24, {"r": "cycle"}), (25, {"r": "cycle", "b": "yes"})]
REL_NODES, REL_WAYS, REL_RELS = [(20, 1), (20, 1), (20, 5)], [(21, 10), (24, 11)], [(22, 20), (22, 21), (24, 25), (25, 24)]


@pytest.fixture(scope="module")
def catalog(spark):
    tags = "map<string,string>"
    frame = spark.createDataFrame
    return importer.build(
        frame(NODES, f"id long, lon double, lat double, tags {tags}"), frame(WAYS, f"id long, tags {tags}"), frame(WAY_NODES, "way_id long, pos int, node_id long"),
        frame(RELATIONS, f"id long, tags {tags}"), frame(REL_NODES, "rel_id long, node_id long"), frame(REL_WAYS, "rel_id long, way_id long"), frame(REL_RELS, "parent_id long, child_id long"),
    )


@pytest.fixture(scope="module")
def saved(spark, catalog, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("saved"))
    catalog.save(path, 2)
    return Catalog.load(spark, path)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


ALL = "bbox(-10,-10,10,10)"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("bbox(0,0,0.15,0.05).nodes{zz!=*}", [1, 2, 6]),
        (ALL + ".nodes{a!=*}", [3, 6]),
        (ALL + ".nodes{!(a=2)}", [2, 3, 4, 5, 6]),
        (ALL + ".nodes{a>2}", [2, 5]),
        (ALL + ".ways{w=*}", [10, 11]),
        ("bbox(0.2,0.2,0.3,0.3).ways{w=*}", []),
        ("bbox(0.12,0.16,0.19,0.19).ways{w=*}", [11]),
        (ALL + ".relations{r=*}", [20, 21, 22, 24, 25]),
        ("bbox(0.41,0.41,0.49,0.49).relations{r=*}", [20, 22, 24, 25]),
        (ALL + ".nodes{this.ways{w=closed}}", [1, 2, 3]),
        (ALL + ".nodes{this.relations{r=nodes}}", [1, 5]),
        (ALL + ".ways{this.nodes{b=no}}", [11]),
        (ALL + ".ways{this.relations{r=ways}}", [10]),
        (ALL + ".relations{this.nodes{a=2}}", [20]),
        (ALL + ".relations{this.ways{a>2}}", [21]),
        (ALL + ".relations{this.relations{r=parent}}", [20, 21]),
        (ALL + ".relations{this.child_relations{a=7}}", [22]),
        (ALL + ".relations{this.child_relations{b=yes} OR this.nodes{a=2}}", [20, 24]),
        (ALL + ".nodes{!this.ways{w=*}}", [4, 6]),
        (ALL + ".nodes{this.ways{this.nodes{b=no}}}", [3, 5]),
        ("bbox(1,1,-1,-1).nodes{zz!=*}", []),
        (ALL + ".nodes{a=2} " + ALL + ".nodes{a=2} " + ALL + ".ways{w=closed}", [1, 1, 10]),
        ("", []),
    ],
)
def test_statements(catalog, text, found):
    assert ids(Engine(catalog).query(text)) == found


def test_placeholder_and_cells(catalog):
    assert ids(Engine(catalog).query("bbox({{bbox}}).nodes{a=2}", bbox=(-1, -1, 1, 1))) == [1]
    assert ids(Engine(catalog, multiplicity="per_cell").query(ALL + ".ways{w=*}")) == [10, 10, 10, 11, 11]
    assert [r["cell_x"] for r in catalog.nodes.where("id = 4").collect()] == [0]


def test_float32(spark):
    df = importer.locate_nodes(spark.createDataFrame([(1, 9.9331, 53.5, {})], "id long, lon double, lat double, tags map<string,string>"), precision="float32")
    assert df.first()["lon"] == 9.933099746704102


def _holds(f, table, row, data):
    match f:
        case HasKey(k, present):
            return (k in row["tags"]) == present
        case Compare(k, op, v):
            if k not in row["tags"]:
                return False
            x = row["tags"][k]
            after = less(v, x)
            return {"=": x == v, "!=": x != v, ">": x != v and after, ">=": x == v or after, "<": x != v and not after, "<=": x == v or not after}[op]
        case And(a, b):
            return _holds(a, table, row, data) and _holds(b, table, row, data)
        case Or(a, b):
            return _holds(a, table, row, data) or _holds(b, table, row, data)
        case Not(a):
            return not _holds(a, table, row, data)
        case Related(s):
            near = data["edges"][table, s.type.value].get(row["id"], ())
            return any(_holds(s.filter, s.type.table, data[s.type.table][i], data) for i in near if i in data[s.type.table])


def _random_filter(rng, table, depth):
    kind = rng.random()
    if depth and kind < 0.3:
        options = {"nodes": ["ways", "relations"], "ways": ["nodes", "relations"], "relations": ["nodes", "ways", "relations", "child_relations"]}[table]
        to = rng.choice(options)
        return f"{rng.choice(['', '!'])}this.{to}{{{_random_filter(rng, to.replace('child_', ''), depth - 1)}}}"
    if kind < 0.6:
        return f"{_random_filter(rng, table, max(0, depth - 1))} {rng.choice(['AND', 'OR'])} {_random_filter(rng, table, max(0, depth - 1))}" if depth else "a=*"
    if kind < 0.75:
        return f"{rng.choice(['', '!'])}({_random_filter(rng, table, max(0, depth - 1))})"
    return rng.choice(["a", "b", "w", "r", "zz"]) + rng.choice(["=*", "!=*", "=2", "!=2", ">2", ">=2.2", "<5", "<=yes", "=yes", "!=no"])


def test_random_filters(catalog):
    data = {t: {r["id"]: {"id": r["id"], "tags": r["tags"] or {}} for r in catalog.table(t).collect()} for t in ("nodes", "ways", "relations")}
    data["edges"] = {}
    for a, b in [("nodes", "ways"), ("nodes", "relations"), ("ways", "nodes"), ("ways", "relations"), ("relations", "nodes"), ("relations", "ways"), ("relations", "relations"), ("relations", "child_relations")]:
        found = data["edges"].setdefault((a, b), {})
        for r in catalog.edges(a, b).collect():
            found.setdefault(r["ctx_id"], []).append(r["target_id"])
    rng = random.Random(11)
    for _ in range(25):
        table = rng.choice(["nodes", "ways", "relations"])
        s = parse(f"{ALL}.{table}{{{_random_filter(rng, table, 2)}}}").statements[0]
        want = sorted(i for i, row in data[table].items() if _holds(s.filter, table, row, data))
        assert ids(Compiler(catalog).statement(s)) == want, s


def test_plans_semi_join_and_pruning(catalog, tmp_path):
    engine = Engine(catalog)
    plan = engine.query(ALL + ".nodes{this.ways{w=*} AND !this.relations{r=*}}")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan
    plan = engine.query(ALL + ".nodes{a=2 OR this.ways{w=*}}")._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" in plan
    catalog.save(str(tmp_path))
    loaded = Catalog.load(catalog.nodes.sparkSession, str(tmp_path))
    found = Engine(loaded).query("bbox(0,0,0.15,0.05).nodes{zz!=*}")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell_x" in plan and "PushedFilters: [IsNotNull(cell_y)" in plan
    assert ids(found) == [1, 2, 6] and ids(Engine(loaded).query(ALL + ".relations{r=*}")) == [20, 21, 22, 24, 25]


def test_inspection(catalog):
    faults = {r["fault"]: r["n"] for r in inspect.validate(catalog).collect()}
    assert faults["relation child without relation"] == 0 and faults["way node without way"] == 0
    assert {(r["cell_x"], r["cell_y"]): r["n"] for r in inspect.density(catalog).collect()}[0, 0] == 3
    assert ("a", "2", 1) in [tuple(r) for r in inspect.tag_dictionary(catalog).collect()]
    assert inspect.inverse(catalog, "nodes", "ways").where("id = 3").first()["related"] == [10, 11]
    assert inspect.nodes_of_ways(catalog).count() == 7


def test_extent():
    e = Extent(10, 10, 20, 20)
    assert e.has(10, 20) and not e.has(9, 15) and e.has_lon_lat(1.05, 2.05) and not e.has_lon_lat(2.15, 1.5)
    assert e.expanded(5, 30) == Extent(5, 10, 20, 30) and len(Extent(1, 1, 2, 3).cells()) == 6
    assert e.polygon(1.0)[0] == e.polygon(1.0)[-1] == (10, 10)


def test_geojson(catalog, tmp_path):
    text = ALL + ".nodes{b=yes} " + ALL + ".ways{w=closed} " + ALL + ".relations{r=nodes}"
    got = json.loads("".join(Engine(catalog).geojson(text)))
    assert got["type"] == "FeatureCollection" and len(got["features"]) == 3
    node, way, relation = got["features"]
    assert node == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0.15, 0.05]}, "properties": {"@osm_id": 2, "@osm_type": "node", "a": "2.5 m", "b": "yes"}}
    assert way["geometry"]["type"] == "LineString" and len(way["geometry"]["coordinates"]) == 4
    assert relation["geometry"]["coordinates"][0][2] == [0.45, 0.45]
    geojson.write(Engine(catalog).query(text), str(tmp_path / "out"))
    assert catalog.nodes.sparkSession.read.text(str(tmp_path / "out")).count() == 3


def test_web(catalog):
    from fellgate.web import handler

    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(Engine(catalog)))
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/query"
    got = json.loads(urllib.request.urlopen(url, (ALL + ".nodes{a=2}").encode()).read())
    assert got["features"][0]["properties"]["@osm_id"] == 1
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(url, b"bbox(1,2")
    assert e.value.code == 400 and "position" in json.loads(e.value.read())["details"]
    server.shutdown()


SUBS = [
    "bbox(0,0,0.2,0.2).nodes{this.ways{w=closed}}",
    "bbox(0.4,0.4,0.5,0.5).nodes{this.ways{this.nodes{a=*}}}",
    "bbox(0,0,0.1,0.1).nodes{!this.relations{r=nodes}}",
    "bbox(0,0,0.1,0.1).ways{this.nodes{b=no} OR this.relations{r=ways}}",
    "bbox(0.4,0.4,0.5,0.5).relations{this.child_relations{r=nodes} OR this.ways{w=cross}}",
    "bbox(0,0,0.3,0.3).relations{this.relations{r=parent}}",
    "bbox(0,0,0.1,0.1).nodes{this.ways{this.relations{this.relations{this.nodes{b=no} OR r=parent}}}}",
]


@pytest.mark.parametrize("text", SUBS)
def test_a_box_leaves_out_nothing_that_a_sub_statement_needs(catalog, saved, text):
    assert ids(Engine(saved).query(text)) == ids(Engine(catalog).query(text))


def test_a_box_reaches_the_scans_of_edges_and_targets(spark, saved):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = Engine(saved).query("bbox(0,0,0.2,0.2).nodes{this.ways{w=closed AND this.relations{r=ways}}}")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 5  # nodes, two tables of edges, ways, relations
    bounded = [line for line in scans if "LessThanOrEqual(min_lon,0.2)" in line and "GreaterThanOrEqual(max_lon,0.0)" in line]
    assert len(bounded) == 4 and any("nodes_to_ways" in x for x in bounded) and any("ways_to_relations" in x for x in bounded)
    assert any("PartitionFilters" in x and "cell_x" in x for x in scans)
    # members may lie anywhere: going down, the box cuts the edges alone
    plan = Engine(saved).query("bbox(0,0,0.2,0.2).ways{this.nodes{a=*}}")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("LessThanOrEqual(min_lon,0.2)" in x for x in scans) == 2 and not any("lon,0.2" in x for x in scans if "/nodes]" in x)


def test_web_sends_pieces_and_a_page(catalog, monkeypatch):
    from fellgate import web

    monkeypatch.setattr(web, "PIECE", 40)
    server = ThreadingHTTPServer(("127.0.0.1", 0), web.handler(Engine(catalog)))
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    with urllib.request.urlopen(urllib.request.Request(f"{base}/query", data=(ALL + ".nodes{a=*}").encode())) as answer:
        assert answer.headers["Transfer-Encoding"] == "chunked" and len(json.load(answer)["features"]) == 4
    with urllib.request.urlopen(f"{base}/app") as answer:
        assert "text/html" in answer.headers["Content-Type"] and "{{bbox}}" in answer.read().decode()
    with pytest.raises(urllib.error.HTTPError) as missing:
        urllib.request.urlopen(f"{base}/other")
    assert missing.value.code == 404
    server.shutdown()
