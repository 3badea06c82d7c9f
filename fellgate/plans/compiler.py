"""Syntax tree and catalog to a lazy DataFrame.

Conjuncts of tags and places become filters; a sub-statement that is a conjunct
becomes a semi join over the membership edges, its negation an anti join; one
below OR or NOT becomes a correlated EXISTS, which Catalyst turns into an
existence join.  No join multiplies rows.  All tag tests are two-valued.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellgate.functions.geometry import CELL, Extent, intersects
from fellgate.functions.ordering import compare
from fellgate.lang.syntax import And, Bbox, Compare, Filter, HasKey, Not, Or, Related, Statement
from fellgate.sources.catalog import UPWARD, Catalog


def _two_valued(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _plain(f: Filter) -> bool:
    """Without sub-statements?"""
    match f:
        case Related():
            return False
        case And(a, b) | Or(a, b):
            return _plain(a) and _plain(b)
        case Not(a):
            return _plain(a)
    return True


def _conjuncts(f: Filter) -> list[Filter]:
    return _conjuncts(f.left) + _conjuncts(f.right) if isinstance(f, And) else [f]


class Compiler:
    def __init__(self, catalog: Catalog, width: float = CELL) -> None:
        self._catalog, self._width, self._names = catalog, width, count()

    def test(self, f: Filter, table: str, name: str, box: Bbox | None = None) -> Column:
        """The filter as a column over rows of the aliased table; box: what the rows are known to meet."""
        tags = F.col(f"{name}.tags")
        match f:
            case HasKey(key, present):
                has = _two_valued(F.map_contains_key(tags, F.lit(key)))
                return has if present else ~has
            case Compare(key, op, value):
                return _two_valued(compare(tags[key], op, value))
            case And(a, b):
                return self.test(a, table, name, box) & self.test(b, table, name, box)
            case Or(a, b):
                return self.test(a, table, name, box) | self.test(b, table, name, box)
            case Not(a):
                return ~self.test(a, table, name, box)
            case Related(statement):
                found = self._related(statement, table, box)
                return found.where(F.col("ctx_id") == F.col(f"{name}.id").outer()).exists()
        raise TypeError(f)

    def _related(self, statement: Statement, table: str, box: Bbox | None) -> DataFrame:
        """ctx_id of the table's objects around which the statement finds something; may repeat.

        box: what those objects meet. It cuts the edges, and going up also the targets, as their bounds hold the contexts';
        members of an object may lie anywhere."""
        word, target = statement.type.value, statement.type.table
        targets, further = self._catalog.table(target), box if (table, word) in UPWARD else None
        if further:
            targets = targets.where(intersects(further))
        targets = self.where(targets, statement.filter, target, further).select(F.col("id").alias("target_id"))
        return self._catalog.edges(table, word, box).join(targets, "target_id", "left_semi").select("ctx_id")

    def where(self, df: DataFrame, f: Filter, table: str, box: Bbox | None = None) -> DataFrame:
        """Rows of df, objects of the table, that pass; box: what they are known to meet."""
        name = f"o{next(self._names)}"
        df = df.alias(name)
        parts = _conjuncts(f)
        if plain := [self.test(p, table, name, box) for p in parts if _plain(p)]:
            df = df.where(reduce(lambda a, b: a & b, plain))
        for p in parts:
            if _plain(p):
                continue
            match p:
                case Related(statement):
                    df = self._joined(df, statement, table, "left_semi", box)
                case Not(Related(statement)):
                    df = self._joined(df, statement, table, "left_anti", box)
                case _:
                    df = df.where(self.test(p, table, name, box))
        return df

    def _joined(self, df: DataFrame, statement: Statement, table: str, how: str, box: Bbox | None) -> DataFrame:
        found = self._related(statement, table, box)
        return df.join(found, df["id"] == found["ctx_id"], how)

    def located(self, statement: Statement) -> DataFrame:
        """Objects of the statement's type in its box: in a cell of the box and with a bound that meets it."""
        box, table = statement.location, statement.type.table
        assert isinstance(box, Bbox)
        df = self._catalog.table(table)
        if box.min_lon > box.max_lon or box.min_lat > box.max_lat:
            return df.where(F.lit(False))
        extent = Extent.around(box, self._width)
        if table == "nodes":
            return df.where(extent.contains(F.col("cell_x"), F.col("cell_y")) & F.col("lon").between(box.min_lon, box.max_lon) & F.col("lat").between(box.min_lat, box.max_lat))
        return self._catalog.marked(table, extent).where(intersects(box)).where("within").drop("within")

    def statement(self, statement: Statement, multiplicity: str = "object") -> DataFrame:
        """multiplicity: 'object' gives each object once, 'per_cell' once for each of its cells in the box."""
        df = self.where(self.located(statement), statement.filter, statement.type.table, statement.location)
        if multiplicity == "per_cell" and statement.type.table != "nodes":
            extent = Extent.around(statement.location, self._width)
            df = df.withColumn("cell", F.explode(F.filter("cells", lambda c: extent.contains(c["x"], c["y"])))).drop("cell")
        return df


def common(df: DataFrame, table: str) -> DataFrame:
    """Objects of any table in one shape."""
    if table == "nodes":
        extra = {"min_lon": F.col("lon"), "min_lat": F.col("lat"), "max_lon": F.col("lon"), "max_lat": F.col("lat")}
    else:
        extra = {"lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double")}
    if table != "ways":
        extra["nodes"] = F.lit(None).cast("array<struct<id:bigint,lon:double,lat:double>>")
    df = df.withColumns(extra | {"type": F.lit(table.removesuffix("s"))})
    return df.select("type", "id", "tags", "lon", "lat", "nodes", "min_lon", "min_lat", "max_lon", "max_lat")
