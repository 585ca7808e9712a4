"""Commands: ``run``, ``validate``, ``init``, ``terrain``, ``info``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

import pyspark
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fernbrand import __version__, config
from fernbrand.operators import cells
from fernbrand.plans import simulation
from fernbrand.sources import rasters, tables


def main_arguments(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("config")
    parser.add_argument("-o", "--output")
    parser.add_argument("-s", "--seed", type=int)
    parser.add_argument("-n", "--iterations", type=int)
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("-q", "--quiet", action="store_true")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fernbrand", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "validate"):
        main_arguments(sub.add_parser(name))
    p = sub.add_parser("init")
    p.add_argument("-o", "--output", default="fernbrand.yaml")
    p.add_argument("-f", "--force", action="store_true")
    p = sub.add_parser("terrain")
    p.add_argument("dem", help="cells with elev, an ASCII grid or a GeoTIFF")
    p.add_argument("--crs")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--size", type=float, default=30.0)
    sub.add_parser("info")
    given = parser.parse_args(arguments)
    if given.command == "info":
        print(f"fernbrand {__version__}, Spark {pyspark.__version__}, Python {sys.version.split()[0]}")
        return 0
    if given.command == "init":
        if os.path.exists(given.output) and not given.force:
            print(f"{given.output} exists; use --force", file=sys.stderr)
            return 1
        with open(given.output, "w") as f:
            f.write(config.TEMPLATE)
        return 0
    if given.command == "terrain":
        spark = SparkSession.builder.getOrCreate()
        grid = rasters.read_grid(spark, given.dem, "elev")
        size_y = given.size
        size = given.size
        crs = given.crs or (rasters.crs_of(given.dem) if given.dem.lower().endswith((".tif", ".tiff")) else None)
        if cells.is_geographic(crs, given.size):
            middle = grid.agg(F.avg("y")).first()[0]
            size, size_y = (given.size * m for m in cells.metres_per_degree(middle))
        tables.write_cells(cells.slope_aspect(grid, "elev", size, size_y), given.output)
        return 0
    try:
        settings, unknown = config.load(given.config)
    except (OSError, config.ConfigError) as error:
        print(f"configuration: {error}", file=sys.stderr)
        return 1
    drawn = settings.ignition if given.iterations is None else replace(settings.ignition, n_iterations=given.iterations)
    settings = replace(settings, output=given.output or settings.output, seed=settings.seed if given.seed is None else given.seed, ignition=drawn)
    if not given.quiet:
        for note in [*(f"unknown setting: {name}" for name in unknown), *config.warnings(settings)]:
            print(note, file=sys.stderr)
    if problems := config.missing_inputs(settings):
        print("\n".join(problems), file=sys.stderr)
        return 1
    if given.command == "run":
        spark = SparkSession.builder.getOrCreate()
        if given.verbose:
            spark.sparkContext.setLogLevel("INFO")
        summary = simulation.run(spark, settings)
        if not given.quiet:
            total = summary.agg(F.count("*").alias("n"), F.sum("area_ha").alias("ha")).first()
            print(f"{total['n']} fires, {total['ha'] or 0.0:.2f} ha: {settings.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
