"""Shapes in files: shape files and GeoJSON, a row a part (point, line or ring)."""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SHAPES = "shape_id bigint, part int, kind string, vertices array<struct<x: double, y: double>>, properties map<string, string>"
# What a record's number says it is.
KINDS = {1: "point", 11: "point", 21: "point", 3: "line", 13: "line", 23: "line", 5: "ring", 15: "ring", 25: "ring", 8: "point", 18: "point", 28: "point"}


class _Records(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class ShapeSource(DataSource):
    """``spark.read.format("shapefile")``; option ``records``: how many records a task reads."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SHAPES

    def reader(self, schema) -> DataSourceReader:
        return _ShapeReader(self.options)


class _ShapeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.base = os.path.splitext(options["path"].removeprefix("file://"))[0]
        self.step = int(options.get("records", "10000"))

    def partitions(self) -> list[InputPartition]:
        n = (os.path.getsize(f"{self.base}.shx") - 100) // 8
        return [_Records(i, min(i + self.step, n)) for i in range(0, n, self.step)] or [_Records(0, 0)]

    def read(self, partition: _Records):
        first, last = partition.first, partition.last
        if last <= first:
            return
        with open(f"{self.base}.shx", "rb") as f:
            f.seek(100 + 8 * first)
            index = np.frombuffer(f.read(8 * (last - first)), ">i4").reshape(-1, 2) * 2
        rows = _attributes(f"{self.base}.dbf", first, last)
        with open(f"{self.base}.shp", "rb") as f:
            for number, ((at, size), properties) in enumerate(zip(index.tolist(), rows), first):
                f.seek(at + 8)
                for part, (kind, points) in enumerate(_parts(f.read(size))):
                    yield (number, part, kind, [(float(x), float(y)) for x, y in points], properties)


def _parts(data: bytes):
    """Kind and points of each part of a record."""
    number = struct.unpack("<i", data[:4])[0]
    kind = KINDS.get(number)
    if kind is None:
        return
    if number in (1, 11, 21):
        yield kind, np.frombuffer(data[4:20], "<f8").reshape(1, 2)
    elif kind == "point":
        n = struct.unpack("<i", data[36:40])[0]
        for p in np.frombuffer(data[40 : 40 + 16 * n], "<f8").reshape(n, 2):
            yield kind, p[None]
    else:
        parts, n = struct.unpack("<ii", data[36:44])
        begins = [*np.frombuffer(data[44 : 44 + 4 * parts], "<i4").tolist(), n]
        points = np.frombuffer(data[44 + 4 * parts : 44 + 4 * parts + 16 * n], "<f8").reshape(n, 2)
        for a, b in zip(begins[:-1], begins[1:]):
            yield kind, points[a:b]


def _attributes(path: str, first: int, last: int) -> list[dict[str, str | None]]:
    """Fields of records as text; empty where there is no table."""
    if not os.path.exists(path):
        return [{}] * (last - first)
    with open(path, "rb") as f:
        head = f.read(32)
        begin, size = struct.unpack("<HH", head[8:12])
        fields, at = [], 1
        for raw in (f.read(32) for _ in range((begin - 33) // 32)):
            fields.append((raw[:11].split(b"\0")[0].decode("latin-1"), at, at + raw[16]))
            at += raw[16]
        f.seek(begin + size * first)
        data = f.read(size * (last - first))
    out = []
    for i in range(last - first):
        row = data[i * size : (i + 1) * size]
        texts = {n: row[a:b].decode("utf-8", "replace").strip() for n, a, b in fields}
        out.append({n: t or None for n, t in texts.items()})
    return out


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Parts of a shape file (``.shp``) or of a GeoJSON file: ``SHAPES``. Rings keep their order; holes are rings of later parts."""
    if path.lower().endswith(".shp"):
        spark.dataSource.register(ShapeSource)
        return spark.read.format("shapefile").load(path)
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("shape_id", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    deep = {0: "array<double>", 1: "array<array<double>>", 2: "array<array<array<double>>>", 3: "array<array<array<array<double>>>>"}
    read = lambda n: F.from_json(raw, deep[n])
    parts = (
        F.when(kind == "Point", F.array(F.array(read(0)))).when(kind == "MultiPoint", F.transform(read(1), lambda p: F.array(p))).when(kind == "LineString", F.array(read(1)))
        .when(kind.isin("Polygon", "MultiLineString"), read(2)).when(kind == "MultiPolygon", F.flatten(read(3)))
    )
    each = features.select(F.col("shape_id").cast("long").alias("shape_id"), kind.alias("_k"), F.posexplode(parts).alias("part", "p"), F.col("f.properties").alias("properties"))
    name = F.when(F.col("_k").contains("Point"), "point").when(F.col("_k").contains("Line"), "line").otherwise("ring")
    points = F.transform("p", lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y")))
    return each.select("shape_id", "part", name.alias("kind"), points.alias("vertices"), "properties")


def points(shapes: DataFrame) -> DataFrame:
    """A point a shape: points themselves, of others the mean of the first part's vertices; cause, season and iteration as given."""
    first = shapes.where("kind = 'point' or part = 0")
    ring = F.when((F.col("kind") == "ring") & (F.size("vertices") > 1), F.slice("vertices", F.lit(1), F.size("vertices") - 1)).otherwise(F.col("vertices"))
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda a, v: a + v[c]) / F.size(ring)
    given = {n: F.coalesce(*[F.element_at("properties", k) for k in (n, n.upper(), n.capitalize())]) for n in ("cause", "season", "iteration")}
    return first.select(mean("x").alias("x"), mean("y").alias("y"), given["cause"].alias("cause"), given["season"].alias("season"), given["iteration"].try_cast("int").alias("iteration"))


def rings(shapes: DataFrame) -> DataFrame:
    """Outer rings as vertices: ``fire_id`` (the shape), ``vertex_id``, ``x``, ``y``, without the closing one."""
    outer = shapes.where("kind = 'ring' and part = 0")
    closed = (F.size("vertices") > 1) & (F.element_at("vertices", 1) == F.element_at("vertices", -1))
    open_ = F.when(closed, F.slice("vertices", F.lit(1), F.size("vertices") - 1)).otherwise(F.col("vertices"))
    each = outer.select(F.col("shape_id").alias("fire_id"), F.posexplode(open_).alias("vertex_id", "v"))
    return each.select("fire_id", F.col("vertex_id").cast("int").alias("vertex_id"), "v.x", "v.y")


def segments(shapes: DataFrame) -> DataFrame:
    """The straight pieces of lines and rings: ``ax``, ``ay``, ``bx``, ``by``."""
    pairs = F.arrays_zip(F.slice("vertices", F.lit(1), F.size("vertices") - 1).alias("a"), F.slice("vertices", F.lit(2), F.size("vertices") - 1).alias("b"))
    each = shapes.where("kind <> 'point' and size(vertices) > 1").select(F.explode(pairs).alias("s"))
    return each.select(F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def write_shapes(shapes: DataFrame, path: str) -> None:
    """A GeoJSON feature a line, for each part; rings are closed."""
    kind = F.initcap(F.when(F.col("kind") == "ring", "polygon").otherwise(F.col("kind")))
    places = F.transform("vertices", lambda v: F.array(v["x"], v["y"]))
    whole = F.when(F.element_at(places, 1) != F.element_at(places, -1), F.concat(places, F.slice(places, 1, 1))).otherwise(places)
    coordinates = F.when(F.col("kind") == "point", F.to_json(F.element_at(places, 1))).when(F.col("kind") == "line", F.to_json(places)).otherwise(F.to_json(F.array(whole)))
    name = F.when(kind == "Line", "LineString").otherwise(kind)
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), name, F.lit('","coordinates":'), coordinates, F.lit('},"properties":'), F.coalesce(F.to_json("properties"), F.lit("{}")), F.lit("}"))
    shapes.select(feature.alias("value")).write.mode("overwrite").text(path)
