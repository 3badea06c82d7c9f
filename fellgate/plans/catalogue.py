"""Queries over the star-schema tables, one for each operator, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellgate.engine import Engine
from fellgate.operators import geojson, inspect
from fellgate.plans import oracle
from fellgate.plans.compiler import common
from fellgate.sources import star
from fellgate.sources.shared import fresh_path

BOX = "bbox(9.1, 53.0, 9.75, 53.15)"
WIDE = "bbox(9, 53, 10, 54)"

TEXTS = {
    "node_bbox": BOX + ".nodes{ type=* }",
    "node_bbox_inverted": "bbox(9.75, 53.0, 9.1, 53.15).nodes{ type=* }",
    "key_present": WIDE + ".relations{ segment=* }",
    "key_absent": WIDE + ".relations{ segment!=* }",
    "tag_eq": BOX + ".nodes{ type=PROMO }",
    "tag_eq_unknown": BOX + ".nodes{ type=nothing }",
    "tag_ne": BOX + ".nodes{ type!=PROMO }",
    "tag_ne_unknown": BOX + ".nodes{ type!=nothing }",
    "cmp_gt": BOX + ".nodes{ size>20 }",
    "cmp_ge": BOX + ".nodes{ size>=20 }",
    "cmp_lt": BOX + ".nodes{ size<20 }",
    "cmp_le": BOX + ".nodes{ size<=20 }",
    "cmp_missing_literal": BOX + ".nodes{ size>=20.5 }",
    "cmp_mixed_units": BOX + ".nodes{ width>20 AND width<=30 }",
    "cmp_string_order": WIDE + ".ways{ priority>=3 AND priority<Z }",
    "cmp_negative": WIDE + ".relations{ balance<5 }",
    "cmp_unknown_key": BOX + ".nodes{ absent>3 OR absent<3 OR absent=3 OR absent!=3 }",
    "logical_and": BOX + ".nodes{ type=PROMO AND size>10 }",
    "logical_or": BOX + ".nodes{ type=PROMO OR size>40 }",
    "precedence": BOX + ".nodes{ type=PROMO OR type=SMALL AND size>25 OR size<3 AND type=LARGE }",
    "parens": BOX + ".nodes{ (type=PROMO OR type=SMALL) AND size>25 }",
    "not_group": BOX + ".nodes{ !(type=PROMO OR absent=x) }",
    "way_bbox": "bbox(9.3, 53.02, 9.32, 53.04).ways{ status=F }",
    "relation_bbox": "bbox(9.3, 53.02, 9.32, 53.04).relations{ balance>5000 }",
    "node_ways": BOX + ".nodes{ this.ways{ status=F AND priority>=5 } }",
    "node_relations": BOX + ".nodes{ this.relations{ balance>9000 } }",
    "way_nodes": WIDE + ".ways{ this.nodes{ type=PROMO AND size=7 } }",
    "way_relations": WIDE + ".ways{ this.relations{ segment=BUILDING AND balance<500 } }",
    "relation_nodes": WIDE + ".relations{ this.nodes{ size=50 AND type=LARGE } }",
    "relation_ways": WIDE + ".relations{ this.ways{ price>490000 } }",
    "relation_parents": WIDE + ".relations{ this.relations{ kind=nation AND name!=NATION } AND segment=MACHINERY }",
    "relation_children": WIDE + ".relations{ this.child_relations{ kind=supplier AND balance>9000 } }",
    "not_sub": BOX + ".nodes{ !this.ways{ status=F } }",
    "or_sub": WIDE + ".ways{ price>480000 OR this.nodes{ size=7 AND type=SMALL } OR !this.relations{ segment!=BUILDING } }",
    "nested_sub": WIDE + ".ways{ this.nodes{ type=PROMO AND size>45 AND this.relations{ balance>7000 AND this.relations{ kind=nation } } } }",
    "two_subs": WIDE + ".ways{ (status=F OR status=O) AND this.nodes{ this.ways{ status=F AND price>400000 } } AND this.nodes{ this.ways{ status=O AND price<100000 } } }",
    "nested_or_not": WIDE + ".ways{ status=P AND (price>450000 OR !this.nodes{ size<25 OR this.ways{ price<20000 } }) }",
    "multi_statement": "// two statements\n" + BOX + ".nodes{ type=PROMO }\nbbox(9.3, 53.02, 9.32, 53.04).ways{ status=F }",
}


PER_CELL = "bbox(9.25, 53.05, 9.45, 53.15).ways{ status=F AND price>480000 }"


def _columns(found: DataFrame) -> DataFrame:
    return found.select("type", "id", "min_lon", "min_lat", "max_lon", "max_lat")


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _columns(Engine(star.catalog(spark, sf_dir)).query(text))


def per_cell_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(Engine(star.catalog(spark, sf_dir), multiplicity="per_cell").query(PER_CELL))


def substituted_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(Engine(star.catalog(spark, sf_dir)).query("bbox({{bbox}}).nodes{ type=PROMO }", bbox=(9.1, 53.0, 9.75, 53.15)))


def _saved(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A statement over the tables written as Parquet, edges with places, and loaded again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _saves:
            path = fresh_path(spark)
            star.catalog(spark, sf_dir).save(path)
            _saves[key] = path
        return _columns(Engine.load(spark, _saves[key]).query(TEXTS[name]))

    return run


#: Where this session has saved the tables of a folder.
_saves: dict[tuple[str, str], str] = {}


def relations_open_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of relations over all levels of children, gone through until nothing changes."""
    return _columns(common(star.catalog(spark, sf_dir, depth=None).relations, "relations"))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.density(star.catalog(spark, sf_dir))


def cell_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.extent(star.catalog(spark, sf_dir))


def tag_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.tag_dictionary(star.catalog(spark, sf_dir))


def inverse_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.inverse(star.catalog(spark, sf_dir), "nodes", "ways").select("id", F.size("related").cast("long").alias("n"), F.element_at("related", 1).alias("first"))


def nodes_of_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.nodes_of_ways(star.catalog(spark, sf_dir)).select("way_id", "pos", "node_id", "lon", "lat", F.col("tags")["type"].alias("t_type"))


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.validate(star.catalog(spark, sf_dir))


def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features read back by Spark's JSON reader functions."""
    found = geojson.features(Engine(star.catalog(spark, sf_dir)).query(TEXTS["tag_eq"]))
    read = F.from_json("feature", "type string, geometry struct<type:string, coordinates:array<double>>, properties map<string,string>")
    return found.select(read.alias("f")).select(F.col("f.geometry.type").alias("shape"), F.element_at("f.geometry.coordinates", 1).alias("lon"), F.element_at("f.geometry.coordinates", 2).alias("lat"), F.col("f.properties")["@osm_id"].cast("long").alias("id"), F.col("f.properties")["@osm_type"].alias("type"), F.col("f.properties")["width"].alias("width"))


def geojson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geojson.features(Engine(star.catalog(spark, sf_dir)).query(TEXTS["way_bbox"]))
    read = F.from_json("feature", "geometry struct<type:string, coordinates:array<array<double>>>, properties map<string,string>")
    point = lambda i: F.element_at("f.geometry.coordinates", i)
    return found.select(read.alias("f")).select(
        F.col("f.properties")["@osm_id"].cast("long").alias("id"), F.col("f.geometry.type").alias("shape"), F.size("f.geometry.coordinates").cast("long").alias("n"),
        point(1)[0].alias("first_lon"), point(1)[1].alias("first_lat"), point(-1)[0].alias("last_lon"), point(-1)[1].alias("last_lat"), F.col("f.properties")["status"].alias("status"),
    )


def geojson_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation is drawn as its bound, a closed ring."""
    found = geojson.features(Engine(star.catalog(spark, sf_dir)).query(TEXTS["relation_bbox"]))
    read = F.from_json("feature", "geometry struct<type:string, coordinates:array<array<array<double>>>>, properties map<string,string>")
    ring = F.col("f.geometry.coordinates")[0]
    coordinate = lambda i: lambda p: p[i]
    return found.select(read.alias("f")).select(
        F.col("f.properties")["@osm_id"].cast("long").alias("id"), F.col("f.geometry.type").alias("shape"), F.size("f.geometry.coordinates").cast("long").alias("rings"), F.size(ring).cast("long").alias("n"),
        *(f(F.transform(ring, coordinate(i))).alias(c) for c, f, i in (("min_lon", F.array_min, 0), ("min_lat", F.array_min, 1), ("max_lon", F.array_max, 0), ("max_lat", F.array_max, 1))), (ring[0] == ring[4]).alias("closed"),
    )


_OTHERS = (geojson_lines, geojson_polygons, relations_open_depth, per_cell_multiplicity, substituted_bbox, density, cell_extent, tag_dictionary, inverse_ways, nodes_of_ways, validate, geojson_points)
SAVED = ("way_bbox", "node_ways", "node_relations", "way_relations", "relation_children", "not_sub", "or_sub", "nested_sub")
QUERIES = {name: _statement(text) for name, text in TEXTS.items()} | {f.__name__: f for f in _OTHERS} | {f"saved_{name}": _saved(name) for name in SAVED}

_TAGS = " UNION ALL ".join(f"SELECT '{k}' AS key, t_{k} AS value FROM {t}" for t, keys in oracle.KEYS.items() for k in keys)
ORACLE_SQL = {name: oracle.query(text) for name, text in TEXTS.items()} | oracle.BY_HAND | {
    "geojson_lines": oracle.PRELUDE + f"""SELECT f.id, 'LineString' AS shape, count(*) AS n, first(lon ORDER BY pos, node_id) AS first_lon, first(lat ORDER BY pos, node_id) AS first_lat,
      last(lon ORDER BY pos, node_id) AS last_lon, last(lat ORDER BY pos, node_id) AS last_lat, any_value(o_orderstatus) AS status
      FROM ({oracle.statement(oracle.parse(TEXTS['way_bbox']).statements[0])}) f JOIN orders ON o_orderkey = f.id JOIN way_nodes e ON e.way_id = f.id JOIN placed p ON p.id = e.node_id GROUP BY f.id""",
    "geojson_polygons": oracle.PRELUDE + f"""SELECT id, 'Polygon' AS shape, 1::BIGINT AS rings, 5::BIGINT AS n, min_lon, min_lat, max_lon, max_lat, true AS closed
      FROM ({oracle.statement(oracle.parse(TEXTS['relation_bbox']).statements[0])})""",
    "relations_open_depth": oracle.PRELUDE + "SELECT 'relation' AS type, id, min_lon, min_lat, max_lon, max_lat FROM relations",
    "per_cell_multiplicity": oracle.query(PER_CELL, per_cell=True),
    "substituted_bbox": oracle.query(TEXTS["tag_eq"]),
    "density": oracle.PRELUDE + "SELECT cx AS cell_x, cy AS cell_y, count(*) AS n FROM placed GROUP BY cx, cy",
    "cell_extent": oracle.PRELUDE + "SELECT min(cx) AS min_x, min(cy) AS min_y, max(cx) AS max_x, max(cy) AS max_y FROM placed",
    "tag_dictionary": oracle.PRELUDE + f"SELECT key, value, count(*) AS n FROM ({_TAGS}) WHERE value IS NOT NULL GROUP BY key, value",
    "inverse_ways": oracle.PRELUDE + "SELECT node_id AS id, count(DISTINCT way_id) AS n, min(way_id) AS first FROM way_nodes GROUP BY node_id",
    "nodes_of_ways": oracle.PRELUDE + "SELECT way_id, pos, node_id, lon, lat, t_type FROM way_nodes JOIN placed ON node_id = id",
    "validate": oracle.PRELUDE + """SELECT * FROM (VALUES
      ('node without place', (SELECT count(*) FROM nodes WHERE lon IS NULL OR lat IS NULL)),
      ('node without id', (SELECT count(*) FROM nodes WHERE id IS NULL)),
      ('way with inverted bound', (SELECT count(*) FROM ways WHERE min_lon > max_lon OR min_lat > max_lat)),
      ('relation with inverted bound', (SELECT count(*) FROM relations WHERE min_lon > max_lon OR min_lat > max_lat)),
      ('way node without node', (SELECT count(*) FROM way_nodes WHERE node_id NOT IN (SELECT id FROM nodes))),
      ('way node without way', (SELECT count(*) FROM way_nodes WHERE way_id NOT IN (SELECT id FROM ways))),
      ('relation node without node', (SELECT count(*) FROM rel_nodes WHERE node_id NOT IN (SELECT id FROM nodes))),
      ('relation way without way', (SELECT count(*) FROM rel_ways WHERE way_id NOT IN (SELECT id FROM ways))),
      ('relation child without relation', (SELECT count(*) FROM rel_rels WHERE child_id NOT IN (SELECT id FROM relations))),
      ('relation parent without relation', (SELECT count(*) FROM rel_rels WHERE parent_id NOT IN (SELECT id FROM relations)))) v(fault, n)""",
    "geojson_points": oracle.PRELUDE + f"SELECT 'Point' AS shape, o.lon, o.lat, o.id, 'node' AS type, o.t_width AS width FROM placed o JOIN ({oracle.statement(oracle.parse(TEXTS['tag_eq']).statements[0])}) f ON o.id = f.id",
}
ORACLE_SQL |= {f"saved_{name}": ORACLE_SQL[name] for name in SAVED}
