"""Statements over the star-schema tables as DuckDB SQL: an evaluation of its own, by EXISTS over plain tables."""

from __future__ import annotations

from fellgate.functions.geometry import Extent
from fellgate.functions.ordering import is_number, number
from fellgate.lang.parser import parse
from fellgate.lang.syntax import And, Compare, Filter, HasKey, Not, Or, Related, Statement

PRELUDE = """
WITH nodes AS (
  SELECT p_partkey AS id, 9.0::DOUBLE + (p_partkey % 100) * 0.01::DOUBLE AS lon,
    53.0::DOUBLE + ((p_partkey - p_partkey % 100) / 100)::DOUBLE * 0.01::DOUBLE AS lat,
    p_type AS t_type, p_size::VARCHAR AS t_size, p_name AS t_name, p_brand AS t_brand,
    p_size::VARCHAR || CASE WHEN p_partkey % 2 = 1 THEN ' m' ELSE '' END AS t_width FROM part),
placed AS (SELECT *, trunc(lon / 0.1::DOUBLE)::INTEGER AS cx, trunc(lat / 0.1::DOUBLE)::INTEGER AS cy FROM nodes),
way_nodes AS (SELECT l_orderkey AS way_id, l_linenumber AS pos, l_partkey AS node_id FROM lineitem),
way_cells AS (SELECT DISTINCT way_id AS id, cx, cy FROM way_nodes JOIN placed ON node_id = id),
way_bounds AS (SELECT way_id AS id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat
  FROM way_nodes JOIN placed ON node_id = id GROUP BY way_id),
ways AS (SELECT o_orderkey AS id, o_orderstatus AS t_status, o_orderpriority AS t_priority,
  floor(o_totalprice)::BIGINT::VARCHAR AS t_price, min_lon, min_lat, max_lon, max_lat FROM orders JOIN way_bounds ON o_orderkey = id),
rel_nodes AS (SELECT DISTINCT l_suppkey + 1000 AS rel_id, l_partkey AS node_id FROM lineitem),
rel_ways AS (SELECT o_custkey + 1000000 AS rel_id, o_orderkey AS way_id FROM orders),
rel_rels AS (SELECT c_nationkey::BIGINT + 100 AS parent_id, c_custkey + 1000000 AS child_id FROM customer
  UNION ALL SELECT s_nationkey::BIGINT + 100, s_suppkey + 1000 FROM supplier
  UNION ALL SELECT n_regionkey::BIGINT + 1, n_nationkey::BIGINT + 100 FROM nation),
rel_tags AS (SELECT r_regionkey::BIGINT + 1 AS id, r_name AS t_name, 'region' AS t_kind, NULL::VARCHAR AS t_segment, NULL::VARCHAR AS t_balance FROM region
  UNION ALL SELECT n_nationkey::BIGINT + 100, n_name, 'nation', NULL, NULL FROM nation
  UNION ALL SELECT s_suppkey + 1000, s_name, 'supplier', NULL, floor(s_acctbal)::BIGINT::VARCHAR FROM supplier
  UNION ALL SELECT c_custkey + 1000000, c_name, 'customer', c_mktsegment, floor(c_acctbal)::BIGINT::VARCHAR FROM customer),
own_place AS (SELECT rel_id, lon AS min_lon, lat AS min_lat, lon AS max_lon, lat AS max_lat, cx, cy FROM rel_nodes JOIN placed ON node_id = id
  UNION ALL SELECT rel_id, min_lon, min_lat, max_lon, max_lat, cx, cy FROM rel_ways JOIN way_bounds b ON way_id = b.id JOIN way_cells c ON c.id = b.id),
reach AS (SELECT id AS rel_id, id AS from_id FROM rel_tags
  UNION SELECT parent_id, child_id FROM rel_rels
  UNION SELECT a.parent_id, b.child_id FROM rel_rels a JOIN rel_rels b ON a.child_id = b.parent_id),
rel_place AS (SELECT DISTINCT r.rel_id, min_lon, min_lat, max_lon, max_lat, cx, cy FROM reach r JOIN own_place o ON r.from_id = o.rel_id),
rel_cells AS (SELECT DISTINCT rel_id AS id, cx, cy FROM rel_place),
relations AS (SELECT t.*, min_lon, min_lat, max_lon, max_lat FROM rel_tags t JOIN (SELECT rel_id, min(min_lon) AS min_lon, min(min_lat) AS min_lat,
  max(max_lon) AS max_lon, max(max_lat) AS max_lat FROM rel_place GROUP BY rel_id) ON id = rel_id)
"""
KEYS = {"nodes": ("type", "size", "name", "brand", "width"), "ways": ("status", "priority", "price"), "relations": ("name", "kind", "segment", "balance")}
EDGES = {
    ("nodes", "ways"): ("way_nodes", "node_id", "way_id"), ("nodes", "relations"): ("rel_nodes", "node_id", "rel_id"),
    ("ways", "nodes"): ("way_nodes", "way_id", "node_id"), ("ways", "relations"): ("rel_ways", "way_id", "rel_id"),
    ("relations", "nodes"): ("rel_nodes", "rel_id", "node_id"), ("relations", "ways"): ("rel_ways", "rel_id", "way_id"),
    ("relations", "relations"): ("rel_rels", "child_id", "parent_id"), ("relations", "child_relations"): ("rel_rels", "parent_id", "child_id"),
}


def _before(literal: str, v: str) -> str:
    text, x = f"'{literal}' < {v}", number(literal)
    if x is None:
        return f"({text})"
    kept = rf"regexp_replace({v}, '[^0-9.\-]', '', 'g')"
    y = rf"CASE WHEN regexp_full_match({kept}, '[0-9]+\.?[0-9]*|\.[0-9]*') THEN coalesce(try_cast({kept} AS DOUBLE), 0) END"
    return f"(CASE WHEN {y} IS NULL THEN {text} WHEN {y} = {x} THEN {str(is_number(literal)).lower()} ELSE {x} < {y} END)"


def condition(f: Filter, table: str, alias: str, depth: int = 0) -> str:
    match f:
        case HasKey(key, present):
            there = f"{alias}.t_{key} IS NOT NULL" if key in KEYS[table] else "false"
            return f"({there})" if present else f"(NOT ({there}))"
        case Compare(key, op, value):
            if key not in KEYS[table]:
                return "false"
            v = f"{alias}.t_{key}"
            if op in ("=", "!="):
                return f"coalesce({v} {'=' if op == '=' else '<>'} '{value}', false)"
            t = f"trim({v})"
            test = {">": f"{t} <> '{value}' AND {_before(value, t)}", ">=": f"{t} = '{value}' OR {_before(value, t)}", "<": f"{t} <> '{value}' AND NOT {_before(value, t)}", "<=": f"{t} = '{value}' OR NOT {_before(value, t)}"}[op]
            return f"coalesce({test}, false)"
        case And(a, b):
            return f"({condition(a, table, alias, depth)} AND {condition(b, table, alias, depth)})"
        case Or(a, b):
            return f"({condition(a, table, alias, depth)} OR {condition(b, table, alias, depth)})"
        case Not(a):
            return f"(NOT {condition(a, table, alias, depth)})"
        case Related(s):
            edges, ctx, target = EDGES[table, s.type.value]
            e, t = f"e{depth}", f"x{depth}"
            return f"EXISTS (SELECT 1 FROM {edges} {e} JOIN {s.type.table} {t} ON {e}.{target} = {t}.id WHERE {e}.{ctx} = {alias}.id AND {condition(s.filter, s.type.table, t, depth + 1)})"
    raise TypeError(f)


def statement(s: Statement, per_cell: bool = False) -> str:
    """SELECT of type, id and bound."""
    box, table = s.location, s.type.table
    cells = Extent.around(box)
    rectangle = f"cx BETWEEN {cells.min_x} AND {cells.max_x} AND cy BETWEEN {cells.min_y} AND {cells.max_y}"
    if table == "nodes":
        where = f"{rectangle} AND o.lon BETWEEN {box.min_lon}::DOUBLE AND {box.max_lon}::DOUBLE AND o.lat BETWEEN {box.min_lat}::DOUBLE AND {box.max_lat}::DOUBLE"
        columns, source = "o.lon AS min_lon, o.lat AS min_lat, o.lon AS max_lon, o.lat AS max_lat", "placed o"
    else:
        in_cells = f"FROM {table[:3]}_cells c WHERE c.id = o.id AND {rectangle}"
        where = f"o.min_lon <= {box.max_lon}::DOUBLE AND o.max_lon >= {box.min_lon}::DOUBLE AND o.min_lat <= {box.max_lat}::DOUBLE AND o.max_lat >= {box.min_lat}::DOUBLE AND EXISTS (SELECT 1 {in_cells})"
        columns, source = "o.min_lon, o.min_lat, o.max_lon, o.max_lat", f"{table} o"
        if per_cell:
            source += f" JOIN {table[:3]}_cells c ON c.id = o.id AND {rectangle.replace('cx', 'c.cx').replace('cy', 'c.cy')}"
    return f"SELECT '{table[:-1]}' AS type, o.id AS id, {columns} FROM {source} WHERE {where} AND {condition(s.filter, table, 'o')}"


def query(text: str, per_cell: bool = False) -> str:
    return PRELUDE + "\nUNION ALL\n".join(statement(s, per_cell) for s in parse(text).statements)


#: Written without this package's parser, order or cells, so that a mistake there does not stand on both sides.
_BY_HAND_NODES = """SELECT 'node' AS type, id, lon AS min_lon, lat AS min_lat, lon AS max_lon, lat AS max_lat FROM placed JOIN part ON id = p_partkey
  WHERE cx BETWEEN trunc(9.1::DOUBLE / 0.1::DOUBLE) AND trunc(9.75::DOUBLE / 0.1::DOUBLE) AND cy BETWEEN trunc(53.0::DOUBLE / 0.1::DOUBLE) AND trunc(53.15::DOUBLE / 0.1::DOUBLE)
  AND lon >= 9.1::DOUBLE AND lon <= 9.75::DOUBLE AND lat >= 53.0::DOUBLE AND lat <= 53.15::DOUBLE AND """
_BY_HAND_WIDE = """SELECT 'way' AS type, w.id, min_lon, min_lat, max_lon, max_lat FROM ways w JOIN orders ON w.id = o_orderkey
  WHERE max_lon >= 9 AND min_lon <= 10 AND max_lat >= 53 AND min_lat <= 54
  AND EXISTS (SELECT 1 FROM way_cells c WHERE c.id = w.id AND cx BETWEEN trunc(9::DOUBLE / 0.1::DOUBLE) AND trunc(10::DOUBLE / 0.1::DOUBLE) AND cy BETWEEN trunc(53::DOUBLE / 0.1::DOUBLE) AND trunc(54::DOUBLE / 0.1::DOUBLE)) AND """
BY_HAND = {
    "node_bbox": PRELUDE + _BY_HAND_NODES + "p_type IS NOT NULL",
    "precedence": PRELUDE + _BY_HAND_NODES + "(p_type = 'PROMO' OR (p_type = 'SMALL' AND p_size > 25) OR (p_size < 3 AND p_type = 'LARGE'))",
    "parens": PRELUDE + _BY_HAND_NODES + "p_type IN ('PROMO', 'SMALL') AND p_size > 25",
    "not_group": PRELUDE + _BY_HAND_NODES + "p_type <> 'PROMO'",
    "cmp_ge": PRELUDE + _BY_HAND_NODES + "p_size >= 20",
    "cmp_lt": PRELUDE + _BY_HAND_NODES + "p_size < 20",
    "cmp_missing_literal": PRELUDE + _BY_HAND_NODES + "p_size > 20",
    "cmp_mixed_units": PRELUDE + _BY_HAND_NODES + "(p_size > 20 OR (p_size = 20 AND p_partkey % 2 = 1)) AND (p_size < 30 OR (p_size = 30 AND p_partkey % 2 = 0))",
    "cmp_string_order": PRELUDE + _BY_HAND_WIDE + "left(o_orderpriority, 1) IN ('3', '4', '5')",
    "nested_or_not": PRELUDE + _BY_HAND_WIDE + """o_orderstatus = 'P' AND (floor(o_totalprice) > 450000 OR w.id NOT IN (
      SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 25 OR p_partkey IN (
        SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE floor(o_totalprice) < 20000)))""",
}
