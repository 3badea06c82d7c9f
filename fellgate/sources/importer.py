"""From OSM objects to canonical tables: places of ways and relations, cells, edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellgate.functions.geometry import CELL, Extent, bounds, cell
from fellgate.sources.catalog import Catalog
from fellgate.sources.shared import shared_folder

_BOUND = ("min_lon", "min_lat", "max_lon", "max_lat")


def locate_nodes(nodes: DataFrame, width: float = CELL, precision: str = "float64") -> DataFrame:
    """nodes (id, lon, lat, tags) with their cells. precision float32 rounds coordinates as a compact index would."""
    if precision == "float32":
        nodes = nodes.withColumns({c: F.col(c).cast("float").cast("double") for c in ("lon", "lat")})
    return nodes.select("id", "lon", "lat", "tags", cell(F.col("lon"), width).alias("cell_x"), cell(F.col("lat"), width).alias("cell_y"))


def locate_ways(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame, width: float = CELL) -> DataFrame:
    """ways (id, tags) with nodes in order, bound and cells; ways without a located node are left out."""
    placed = way_nodes.join(nodes.select(F.col("id").alias("node_id"), "lon", "lat"), "node_id")
    inner = F.sort_array(F.collect_list(F.struct("pos", F.col("node_id").alias("id"), "lon", "lat")))
    found = placed.groupBy("way_id").agg(inner.alias("n"), *bounds(F.col("lon"), F.col("lat")))
    found = found.select(F.col("way_id").alias("id"), F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("nodes"), *_BOUND)
    cells = F.array_distinct(F.transform("nodes", lambda x: F.struct(cell(x["lon"], width).alias("x"), cell(x["lat"], width).alias("y"))))
    return ways.join(found, "id").select("id", "tags", "nodes", *_BOUND, cells.alias("cells"))


def _ancestors(rel_rels: DataFrame, depth: int | None) -> DataFrame:
    """Pairs (above_id, rel_id): rel_id stands up to depth levels below above_id, or (None) at any level, in cycles too."""
    pairs = found = rel_rels.where("parent_id IS NOT NULL AND child_id IS NOT NULL").select(F.col("parent_id").alias("above_id"), F.col("child_id").alias("rel_id"))

    def further(first: DataFrame, then: DataFrame) -> DataFrame:
        below = then.select(F.col("above_id").alias("mid_id"), F.col("rel_id").alias("low_id"))
        return first.join(below, first["rel_id"] == below["mid_id"]).select("above_id", F.col("low_id").alias("rel_id"))

    if depth is not None:
        for _ in range(depth - 1):
            found = pairs.unionByName(further(found, pairs))
        return found.distinct() if depth else found.where(F.lit(False))
    _checkpoints(rel_rels.sparkSession)
    found, before = found.distinct().checkpoint(), None
    while (size := found.count()) != before:  # each round doubles the levels
        found, before = found.unionByName(further(found, found)).distinct().checkpoint(), size
    return found


def _with_inner(own: DataFrame, above: DataFrame, *columns: str) -> DataFrame:
    """Rows of own, and once more for each relation above the one that they belong to."""
    return own.select("rel_id", *columns).unionByName(own.join(above, "rel_id").select(F.col("above_id").alias("rel_id"), *columns))


def _lists(cells: DataFrame, name: str) -> DataFrame:
    """id and its distinct cells in order, from rows (rel_id, x, y)."""
    return cells.distinct().groupBy(F.col("rel_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias(name))


def locate_relations(relations: DataFrame, catalog: Catalog, depth: int | None = None, extent: Extent | None = None) -> DataFrame:
    """relations (id, tags) with bound and cells over all members, child relations included.

    A relation takes the places of all that stand below it, depth levels or (None) as many as there are; the pairs of ids
    alone decide which, so that places are found once.  Relations without a place are left out.  Lists of cells are joined to
    the left, which Spark leaves out of plans that do not read them.  extent: adds what Catalog.marked says.
    """
    above = _ancestors(catalog.rel_rels, depth)
    to_nodes = catalog.edges("relations", "nodes").select(F.col("ctx_id").alias("rel_id"), F.col("target_id").alias("node_id"))
    nodes = to_nodes.join(catalog.nodes.select(F.col("id").alias("node_id"), "lon", "lat", F.col("cell_x").alias("x"), F.col("cell_y").alias("y")), "node_id")
    ways = catalog.marked("ways", extent) if extent else catalog.ways
    ways = catalog.rel_ways.join(ways.withColumnRenamed("id", "way_id"), "way_id")

    # of each relation first, as few have others above them or below
    found = {c: f for c, f in zip(_BOUND, (F.min, F.min, F.max, F.max))} | ({"within": F.max} if extent else {})
    point = dict(zip(_BOUND, ("lon", "lat", "lon", "lat")))
    inside = [extent.contains(F.col("x"), F.col("y")).alias("within")] if extent else []
    own = nodes.select("rel_id", *(F.col(v).alias(k) for k, v in point.items()), *inside).unionByName(ways.select("rel_id", *found))
    own = own.where("rel_id IS NOT NULL").groupBy("rel_id").agg(*(f(c).alias(c) for c, f in found.items()))
    bound = _with_inner(own, above, *found).groupBy("rel_id").agg(*(f(c).alias(c) for c, f in found.items()))

    inner = ways.select("rel_id", F.explode("cells").alias("c")).select("rel_id", "c.x", "c.y")
    cells = nodes.select("rel_id", "x", "y").unionByName(inner).where("rel_id IS NOT NULL").repartition("rel_id")
    below = cells.join(above, "rel_id").select(F.col("above_id").alias("rel_id"), "x", "y")
    placed = relations.join(bound.withColumnRenamed("rel_id", "id"), "id").join(_lists(cells, "own"), "id", "left").join(_lists(below, "below"), "id", "left")
    both = F.when(F.col("below").isNull(), F.col("own")).when(F.col("own").isNull(), F.col("below")).otherwise(F.sort_array(F.array_union("own", "below")))
    return placed.select("id", "tags", *_BOUND, both.alias("cells"), *(["within"] if extent else []))


def build(nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame, relations: DataFrame, rel_nodes: DataFrame, rel_ways: DataFrame, rel_rels: DataFrame, width: float = CELL, precision: str = "float64", depth: int | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Catalog:
    """Catalog of raw objects (id, tags; nodes with lon, lat) and edges; edges to relations are made distinct.

    keep: what to do with each table before others are built on it (an import writes it and reads it again)."""
    nodes = keep("nodes", locate_nodes(nodes, width, precision))
    way_nodes = keep("way_nodes", way_nodes)
    ways = keep("ways", locate_ways(ways, way_nodes, nodes, width))
    edges = [keep(name, e.distinct()) for name, e in (("rel_nodes", rel_nodes), ("rel_ways", rel_ways), ("rel_rels", rel_rels))]
    part = Catalog(nodes, ways, relations, way_nodes, *edges)
    return Catalog(nodes, ways, keep("relations", locate_relations(relations, part, depth)), way_nodes, *edges)


def _checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
