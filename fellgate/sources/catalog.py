"""The canonical tables: objects of three types and the membership edges between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fellgate.functions.geometry import Extent, intersects
from fellgate.lang.syntax import Bbox

TAGS = T.MapType(T.StringType(), T.StringType())
CELLS = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))
_BOUND = [T.StructField(c, T.DoubleType()) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("tags", TAGS), T.StructField("cell_x", T.IntegerType()), T.StructField("cell_y", T.IntegerType())])
WAY_NODE = T.StructType([T.StructField("id", T.LongType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
WAYS = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", TAGS), T.StructField("nodes", T.ArrayType(WAY_NODE)), *_BOUND, T.StructField("cells", CELLS)])
RELATIONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", TAGS), *_BOUND, T.StructField("cells", CELLS)])


BOUND = ("min_lon", "min_lat", "max_lon", "max_lat")
#: (context, word of the language): the table of edges, its column of the context and that of the target.
EDGES = {
    ("nodes", "ways"): ("way_nodes", "node_id", "way_id"),
    ("nodes", "relations"): ("rel_nodes", "node_id", "rel_id"),
    ("ways", "nodes"): ("way_nodes", "way_id", "node_id"),
    ("ways", "relations"): ("rel_ways", "way_id", "rel_id"),
    ("relations", "nodes"): ("rel_nodes", "rel_id", "node_id"),
    ("relations", "ways"): ("rel_ways", "rel_id", "way_id"),
    ("relations", "relations"): ("rel_rels", "child_id", "parent_id"),
    ("relations", "child_relations"): ("rel_rels", "parent_id", "child_id"),
}
#: Of these the target's bound holds the context's, so it meets whatever box the context meets.
UPWARD = {("nodes", "ways"), ("nodes", "relations"), ("ways", "relations"), ("relations", "relations")}
#: In this order each can be built from those before it.
TABLES = ("nodes", "way_nodes", "ways", "rel_nodes", "rel_ways", "rel_rels", "relations")


@dataclass(frozen=True)
class Catalog:
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    way_nodes: DataFrame  # way_id, pos, node_id
    rel_nodes: DataFrame  # rel_id, node_id
    rel_ways: DataFrame  # rel_id, way_id
    rel_rels: DataFrame  # parent_id, child_id
    #: ctx_id, target_id and the context's bound, by (context, to); of a saved catalog.
    placed: dict[tuple[str, str], DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def marked(self, name: str, extent: Extent) -> DataFrame:
        """Ways or relations with a column within: does a cell of theirs lie in extent?"""
        return self.table(name).withColumn("within", extent.has_any(F.col("cells")))

    def edges(self, context: str, to: str, box: Bbox | None = None) -> DataFrame:
        """(ctx_id, target_id) from a table's objects to related ones; to: the word of the language.

        box: only contexts whose bound meets it are asked for; others may be left out."""
        if (context, to) in self.placed:
            df = self.placed[context, to]
            return (df.where(intersects(box)) if box else df).select("ctx_id", "target_id")
        edges, a, b = EDGES[context, to]
        return self.table(edges).select(F.col(a).alias("ctx_id"), F.col(b).alias("target_id"))

    def _placed_edges(self, context: str, to: str) -> DataFrame:
        """Edges with the bound of the context, which is what a query's box says something about."""
        bound = {"min_lon": "lon", "min_lat": "lat", "max_lon": "lon", "max_lat": "lat"} if context == "nodes" else {c: c for c in BOUND}
        where = self.table(context).select(F.col("id").alias("ctx_id"), *(F.col(v).alias(k) for k, v in bound.items()))
        return self.edges(context, to).join(where, "ctx_id").select("ctx_id", "target_id", *BOUND)

    def save(self, path: str, partitions: int | None = None) -> None:
        """Parquet by table. Nodes by cell column and sorted by cell row within, objects with bounds sorted by
        them, so that a bbox prunes partitions and row groups. Edges are written for each way to go along them, with
        the bound of where it begins and sorted by it, so that a box prunes them as it does the objects."""
        written: dict[str, DataFrame] = {}
        for name in TABLES:
            df = self._to_save(name, written)
            self.write(df, name, path, partitions)
            written[name] = self.read(df.sparkSession, name, path)
        Catalog(**written).save_edges(path, partitions)

    def _to_save(self, name: str, written: dict[str, DataFrame]) -> DataFrame:
        """A table, built from those that are written already where it can be."""
        return self.table(name)

    def save_edges(self, path: str, partitions: int | None = None) -> None:
        for context, to in EDGES:
            self.write(self._placed_edges(context, to), f"{context}_to_{to}", path, partitions)

    @staticmethod
    def write(df: DataFrame, name: str, path: str, partitions: int | None = None) -> None:
        by = ["cell_x", "cell_y"] if name == "nodes" else ["min_lon", "min_lat"] if "min_lon" in df.columns else []
        if by:
            df = (df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)).sortWithinPartitions(*by)
        out = df.write.mode("overwrite")
        (out.partitionBy("cell_x") if name == "nodes" else out).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        read = {name: cls.read(spark, name, path) for name in TABLES}
        placed = T.StructType([T.StructField("ctx_id", T.LongType()), T.StructField("target_id", T.LongType()), *_BOUND])
        return cls(**read, placed={(a, b): spark.read.schema(placed).parquet(f"{path}/{a}_to_{b}") for a, b in EDGES})

    @staticmethod
    def read(spark: SparkSession, name: str, path: str) -> DataFrame:
        schema = {"nodes": NODES, "ways": WAYS, "relations": RELATIONS}.get(name)
        df = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/{name}")
        return df.select(*schema.names) if schema else df
