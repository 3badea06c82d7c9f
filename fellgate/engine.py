"""Text to results: the entrance for programs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from fellgate.functions.geometry import CELL
from fellgate.lang.parser import parse
from fellgate.lang.syntax import explain
from fellgate.operators import geojson
from fellgate.plans.compiler import Compiler, common
from fellgate.sources.catalog import NODES, Catalog


class Engine:
    """Statements over one catalog. multiplicity: see Compiler.statement."""

    def __init__(self, catalog: Catalog, width: float = CELL, multiplicity: str = "object") -> None:
        self.catalog, self._width, self._multiplicity = catalog, width, multiplicity

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        return cls(Catalog.load(spark, path))

    @staticmethod
    def _text(text: str, bbox: tuple[float, float, float, float] | None) -> str:
        """The text with {{bbox}} replaced."""
        return text if bbox is None else text.replace("{{bbox}}", ", ".join(map(repr, map(float, bbox))))

    def query(self, text: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
        """Objects that the text asks for: type, id, tags, place; an empty text gives none."""
        compiler, found = Compiler(self.catalog, self._width), parse(self._text(text, bbox)).statements
        if not found:
            return common(self.catalog.nodes.sparkSession.createDataFrame([], NODES), "nodes")
        return reduce(DataFrame.unionByName, (common(compiler.statement(s, self._multiplicity), s.type.table) for s in found))

    def explain(self, text: str) -> str:
        """The syntax tree of a text."""
        return explain(parse(text))

    def geojson(self, text: str, bbox: tuple[float, float, float, float] | None = None):
        """The result as pieces of a GeoJSON FeatureCollection."""
        return geojson.collection(self.query(text, bbox))
