"""Pointwise fields as columns of a table of positions, in double precision.

Short plans become column expressions. Cells, tables of constants and noise of several octaves have
hundreds of intermediate results, more than generated code holds, and go through numpy in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..field import Field
from ..functions.lanes import Rows
from .blocks import columns_of
from .evaluate import evaluate, order
from .tables import with_arrays


def _long(node) -> bool:
    """Whether a node is better evaluated in numpy."""
    p = node.p
    return node.kind in ("cells", "grid") or node.kind == "noise" and (p["octaves"] > 1 or p["kind"].startswith("cellular"))


def with_fields(df: DataFrame, outputs: dict[str, Field], x: Column, z: Column, y: Column | None = None, seed: int = 0) -> DataFrame:
    """df with a column for each component of the outputs, evaluated at positions (x, z) or (x, y, z) in metres."""
    if y is None and any(_long(n) for n in order(outputs.values())):
        return with_arrays(df, outputs, x, z, seed)
    keep = df.columns
    lane = Rows(df)
    position = lane.lets(*(c.cast("double") for c in ((x, z) if y is None else (x, y, z))))
    fields = [f for _, f in sorted(outputs.items())]
    parts = [c for v in evaluate(fields, lane, position, 1.0, seed) for c in v]
    return lane.df.select(*keep, *(c.alias(n) for c, n in zip(parts, columns_of(outputs), strict=True)))


def sample_grid(spark, width: int, depth: int, x0: int = 0, z0: int = 0) -> DataFrame:
    """(sx, sz): whole-number sample coordinates of a region, x fastest."""
    return spark.range(width * depth).select((F.col("id") % width + x0).alias("sx"), (F.floor(F.col("id") / width) + z0).cast("long").alias("sz"))
