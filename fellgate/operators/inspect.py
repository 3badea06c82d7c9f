"""Tables about a catalog: density, extent, tag values, inverse lists, faults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellgate.sources.catalog import Catalog


def density(catalog: Catalog) -> DataFrame:
    """cell_x, cell_y, n: nodes of each cell."""
    return catalog.nodes.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))


def extent(catalog: Catalog) -> DataFrame:
    """One row: the rectangle of all nodes' cells."""
    return catalog.nodes.agg(F.min("cell_x").alias("min_x"), F.min("cell_y").alias("min_y"), F.max("cell_x").alias("max_x"), F.max("cell_y").alias("max_y"))


def tag_dictionary(catalog: Catalog) -> DataFrame:
    """key, value, n: how often each value stands, over objects of all types."""
    tags = [catalog.table(t).select(F.explode("tags").alias("key", "value")) for t in ("nodes", "ways", "relations")]
    return reduce(DataFrame.unionAll, tags).where("value IS NOT NULL").groupBy("key", "value").agg(F.count("*").alias("n"))


def inverse(catalog: Catalog, context: str, to: str) -> DataFrame:
    """id and the sorted ids of its related objects, for each object that has some."""
    return catalog.edges(context, to).groupBy(F.col("ctx_id").alias("id")).agg(F.array_sort(F.collect_set("target_id")).alias("related"))


def nodes_of_ways(catalog: Catalog) -> DataFrame:
    """way_id, pos and the whole node."""
    return catalog.way_nodes.join(catalog.nodes.withColumnRenamed("id", "node_id"), "node_id").select("way_id", "pos", "node_id", "lon", "lat", "tags")


def validate(catalog: Catalog) -> DataFrame:
    """fault, n: how often each fault stands in the catalog (all of them, zeros too)."""

    def dangling(edges: DataFrame, column: str, table: str) -> DataFrame:
        return edges.join(catalog.table(table).select(F.col("id").alias(column)), column, "left_anti")

    c = catalog
    faults = {
        "node without place": c.nodes.where("lon IS NULL OR lat IS NULL"),
        "node without id": c.nodes.where("id IS NULL"),
        "way with inverted bound": c.ways.where("min_lon > max_lon OR min_lat > max_lat"),
        "relation with inverted bound": c.relations.where("min_lon > max_lon OR min_lat > max_lat"),
        "way node without node": dangling(c.way_nodes, "node_id", "nodes"),
        "way node without way": dangling(c.way_nodes, "way_id", "ways"),
        "relation node without node": dangling(c.rel_nodes, "node_id", "nodes"),
        "relation way without way": dangling(c.rel_ways, "way_id", "ways"),
        "relation child without relation": dangling(c.rel_rels, "child_id", "relations"),
        "relation parent without relation": dangling(c.rel_rels, "parent_id", "relations"),
    }
    return reduce(DataFrame.unionAll, (df.agg(F.lit(name).alias("fault"), F.count("*").alias("n")) for name, df in faults.items()))
