"""python -m fellgate import FILE | query TEXT | server: the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from fellgate.engine import Engine
from fellgate.functions.geometry import CELL
from fellgate.lang.errors import QueryError
from fellgate.operators import geojson


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fellgate")
    parser.add_argument("--index", default="fellgate-index", help="folder of the canonical tables")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("import")
    one.add_argument("input")
    one.add_argument("--cell", type=float, default=CELL)
    one.add_argument("--precision", choices=("float64", "float32"), default="float64", help="float32 rounds coordinates")
    one.add_argument("--depth", type=int, help="levels of child relations whose places count for their parents (default: all)")
    one = commands.add_parser("query")
    one.add_argument("query")
    one.add_argument("--output", default="output.geojson")
    one = commands.add_parser("server")
    one.add_argument("--port", type=int, default=8080)
    one.add_argument("--ssl-cert-file", help="certificate for TLS")
    one.add_argument("--ssl-key-file", help="its key")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("fellgate").getOrCreate()
    if given.command == "import":
        from fellgate.sources.osm import import_osm

        import_osm(spark, given.input, given.index, given.cell, given.precision, given.depth)
    elif given.command == "query":
        try:
            found = Engine.load(spark, given.index).query(given.query)
        except QueryError as e:
            print(e.message, file=sys.stderr)
            return 1
        with open(given.output, "w", encoding="utf-8") as f:
            f.writelines(geojson.collection(found))
    else:
        from fellgate.web import serve

        serve(Engine.load(spark, given.index), given.port, given.ssl_cert_file, given.ssl_key_file)
    return 0


if __name__ == "__main__":
    sys.exit(main())
