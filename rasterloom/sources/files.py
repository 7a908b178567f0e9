"""Files as rasters and shapes: raw samples, GeoJSON, sidecars."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError


def read_raw(spark: SparkSession, path: str, width: int, depth: int) -> DataFrame:
    """(path, x, z, v) of little-endian 32-bit float files, x fastest; a file of another size is an error."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(data.as_buffer(), "<f4")
                if len(v) != width * depth:
                    raise PlanError("source", f"{name} holds {len(v)} samples, not {width} x {depth}")
                at = np.arange(len(v))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(at % width), pa.array(at // width), pa.array(v.astype("f4"))], names=["path", "x", "z", "v"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, x long, z long, v float")


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, kind, geometry, properties, point, x, z): the points of a FeatureCollection of points, lines and one-ring polygons; a ring's closing point is left out."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    schema = "struct<type string, features array<struct<geometry struct<type string, coordinates string>, properties map<string, string>>>>"
    f = text.select("path", F.from_json("text", schema).alias("c")).select("path", F.posexplode("c.features").alias("shape", "f"))
    point, line, ring = (F.from_json("f.geometry.coordinates", t) for t in ("array<double>", "array<array<double>>", "array<array<array<double>>>"))
    kind = F.col("f.geometry.type")
    points = F.when(kind == "Point", F.array(point)).when(kind == "LineString", line).when(kind == "Polygon", F.slice(ring[0], F.lit(1), F.size(ring[0]) - 1))
    out = f.select("path", "shape", F.col("f.properties")["kind"].alias("kind"), kind.alias("geometry"), F.col("f.properties").alias("properties"), F.posexplode(points).alias("point", "p"))
    return out.select("path", "shape", "kind", "geometry", "properties", "point", F.col("p")[0].alias("x"), F.col("p")[1].alias("z"))


def parameters(given: list[str]) -> dict[str, float | str]:
    """key=value texts; numeric text becomes a number, and a later key replaces an earlier one."""
    out: dict[str, float | str] = {}
    for item in given:
        key, eq, value = item.partition("=")
        if not eq or not key:
            raise PlanError("argument", f"{item!r} is not key=value")
        try:
            out[key] = float(value)
        except ValueError:
            out[key] = value
    return out


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """A sidecar as written by sinks.write_sidecar: one JSON object, however large the raster."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
