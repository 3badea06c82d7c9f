"""The star-schema tables seen as nodes, ways and relations, to run statements on them.

part: nodes on a grid; orders with their line items: ways over parts; customers,
suppliers, nations and regions: relations, two levels deep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fellgate.functions.geometry import Extent, bounds, cell
from fellgate.lang.syntax import Bbox
from fellgate.sources import importer
from fellgate.sources.catalog import EDGES, Catalog

REGION, NATION, SUPPLIER, CUSTOMER = 1, 100, 1000, 1_000_000


def _place(key: Column) -> tuple[Column, Column]:
    rest = key % 100
    return F.lit(9.0) + rest * F.lit(0.01), F.lit(53.0) + ((key - rest) / 100) * F.lit(0.01)


def _tags(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


class _OnDemand(Catalog):
    """A catalog that builds each table when it is first asked for: a statement plans only what it reads."""

    def __init__(self, makers: dict[str, Callable[..., DataFrame]]) -> None:
        object.__setattr__(self, "_makers", makers)
        object.__setattr__(self, "placed", {})

    def __getattr__(self, name: str) -> DataFrame:
        makers = object.__getattribute__(self, "_makers")
        if name not in makers:
            raise AttributeError(name)
        object.__setattr__(self, name, makers[name](self))
        return object.__getattribute__(self, name)

    def marked(self, name: str, extent: Extent) -> DataFrame:
        return self._makers[name](self, extent)

    def _to_save(self, name: str, written: dict[str, DataFrame]) -> DataFrame:
        return self._makers[name](Catalog(relations=None, **written)) if name == "relations" else self.table(name)

    def edges(self, context: str, to: str, box: Bbox | None = None) -> DataFrame:
        if EDGES[context, to][0] != "rel_nodes":
            return super().edges(context, to, box)
        _, a, b = EDGES[context, to]
        return self.supplied.select(F.col(a).alias("ctx_id"), F.col(b).alias("target_id"))


def catalog(spark: SparkSession, sf_dir: str, depth: int | None = 2) -> Catalog:
    """depth: levels of child relations; these tables have two, so None (as many as there are) gives the same."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    makers = {
        "nodes": lambda c: _nodes(read("part")),
        "ways": lambda c, extent=None: _ways(read("orders"), read("lineitem"), extent),
        "relations": lambda c, extent=None: importer.locate_relations(_relations(read("region"), read("nation"), read("supplier"), read("customer")), c, depth, extent),
        "way_nodes": lambda c: read("lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("node_id")),
        "supplied": lambda c: read("lineitem").select((F.col("l_suppkey") + SUPPLIER).alias("rel_id"), F.col("l_partkey").alias("node_id")),
        "rel_nodes": lambda c: c.supplied.distinct(),
        "rel_ways": lambda c: read("orders").select((F.col("o_custkey") + CUSTOMER).alias("rel_id"), F.col("o_orderkey").alias("way_id")),
        "rel_rels": lambda c: _children(read("nation"), read("supplier"), read("customer")),
    }
    return _OnDemand(makers)


def _nodes(part: DataFrame) -> DataFrame:
    lon, lat = _place(F.col("p_partkey"))
    size = F.col("p_size").cast("string")
    width = F.when(F.col("p_partkey") % 2 == 1, F.concat(size, F.lit(" m"))).otherwise(size)
    return importer.locate_nodes(part.select(F.col("p_partkey").alias("id"), lon.alias("lon"), lat.alias("lat"), _tags(type=F.col("p_type"), size=size, name=F.col("p_name"), brand=F.col("p_brand"), width=width).alias("tags")))


def _ways(orders: DataFrame, lines: DataFrame, extent: Extent | None = None) -> DataFrame:
    """Bounds are found apart from the lists of nodes and cells, which are joined to the left: Spark leaves them out of plans that do not read them."""
    lines = lines.select(F.col("l_orderkey").alias("id"), "l_partkey", "l_linenumber").where("id IS NOT NULL")
    lon, lat = _place(F.col("l_partkey"))
    within = [F.max(extent.contains(cell(F.col("lon")), cell(F.col("lat")))).alias("within")] if extent else []
    placed = lines.repartition("id").select("id", lon.alias("lon"), lat.alias("lat"))
    bound = placed.groupBy("id").agg(*bounds(F.col("lon"), F.col("lat")), *within)
    lists = lines.repartition("id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("n"))
    nodes = F.transform("n", lambda x: F.struct(x["l_partkey"].alias("id"), *(c.alias(k) for k, c in zip(("lon", "lat"), _place(x["l_partkey"])))))
    lists = lists.select("id", nodes.alias("nodes"))
    lists = lists.select("id", "nodes", F.array_distinct(F.transform("nodes", lambda x: F.struct(cell(x["lon"]).alias("x"), cell(x["lat"]).alias("y")))).alias("cells"))
    tags = _tags(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"), price=F.floor("o_totalprice"))
    ways = orders.select(F.col("o_orderkey").alias("id"), tags.alias("tags")).join(bound, "id").join(lists, "id", "left")
    return ways.select("id", "tags", "nodes", "min_lon", "min_lat", "max_lon", "max_lat", "cells", *(["within"] if extent else []))


def _relations(region: DataFrame, nation: DataFrame, supplier: DataFrame, customer: DataFrame) -> DataFrame:
    return (
        region.select((F.col("r_regionkey") + REGION).cast("long").alias("id"), _tags(name=F.col("r_name"), kind=F.lit("region")).alias("tags"))
        .unionByName(nation.select((F.col("n_nationkey") + NATION).cast("long").alias("id"), _tags(name=F.col("n_name"), kind=F.lit("nation")).alias("tags")))
        .unionByName(supplier.select((F.col("s_suppkey") + SUPPLIER).alias("id"), _tags(name=F.col("s_name"), kind=F.lit("supplier"), balance=F.floor("s_acctbal")).alias("tags")))
        .unionByName(customer.select((F.col("c_custkey") + CUSTOMER).alias("id"), _tags(name=F.col("c_name"), kind=F.lit("customer"), segment=F.col("c_mktsegment"), balance=F.floor("c_acctbal")).alias("tags")))
    )


def _children(nation: DataFrame, supplier: DataFrame, customer: DataFrame) -> DataFrame:
    return (
        customer.select((F.col("c_nationkey") + NATION).cast("long").alias("parent_id"), (F.col("c_custkey") + CUSTOMER).alias("child_id"))
        .unionByName(supplier.select((F.col("s_nationkey") + NATION).cast("long").alias("parent_id"), (F.col("s_suppkey") + SUPPLIER).alias("child_id")))
        .unionByName(nation.select((F.col("n_regionkey") + REGION).cast("long").alias("parent_id"), (F.col("n_nationkey") + NATION).cast("long").alias("child_id")))
    )
