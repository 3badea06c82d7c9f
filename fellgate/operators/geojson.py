"""Objects as GeoJSON: points, lines and the boxes of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _json(text: Column) -> Column:
    """A string as JSON, by Spark's own writer."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def _point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("["), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]"))


def features(found: DataFrame) -> DataFrame:
    """One column, feature: a GeoJSON object for each row in the compiler's common shape.

    Properties: @osm_id (number), @osm_type, and each tag as text. Closed ways stay lines."""
    tags = F.transform(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>"))), lambda e: F.concat(_json(e["key"]), F.lit(":"), _json(e["value"])))
    head = F.array(F.concat(F.lit('"@osm_id":'), F.col("id").cast("string")), F.concat(F.lit('"@osm_type":"'), F.col("type"), F.lit('"')))
    line = F.array_join(F.transform("nodes", lambda n: _point(n["lon"], n["lat"])), ",")
    a, b, c, d = (F.col(x) for x in ("min_lon", "min_lat", "max_lon", "max_lat"))
    ring = F.concat_ws(",", _point(a, b), _point(c, b), _point(c, d), _point(a, d), _point(a, b))
    place = (
        F.when(F.col("type") == "node", F.concat(F.lit('{"type":"Point","coordinates":'), _point(F.col("lon"), F.col("lat")), F.lit("}")))
        .when(F.col("type") == "way", F.concat(F.lit('{"type":"LineString","coordinates":['), line, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")))
    )
    properties = F.array_join(F.concat(head, tags), ",")
    return found.select(F.concat(F.lit('{"type":"Feature","geometry":'), place, F.lit(',"properties":{'), properties, F.lit("}}")).alias("feature"))


def write(found: DataFrame, path: str) -> None:
    """A folder of newline-delimited features, written by all tasks."""
    features(found).write.mode("overwrite").text(path)


def collection(found: DataFrame):
    """Pieces of one FeatureCollection; rows come to the driver a partition at a time."""
    yield '{"type":"FeatureCollection","features":['
    for i, row in enumerate(features(found).toLocalIterator()):
        yield ("," if i else "") + row["feature"]
    yield "]}"
