"""Fields over rasters that are tables, in numpy: pointwise in Arrow batches, neighbourhoods tile by tile.

Pointwise plans need no shuffle. A plan that reads neighbours sends each sample once to its tile and to
the tiles that see it in their border (as wide as the plan's reach), one shuffle whatever the plan's
length; a tile holds (section + 2 * reach)**2 samples at most. Positions are whole samples times the
spacing, so a value does not depend on how the table is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..field import Field
from ..functions.lanes import Blocks
from .blocks import columns_of
from .evaluate import evaluate, halo, order


def columns_read(outputs: dict[str, Field]) -> list[str]:
    return sorted({n.p["name"] for n in order(outputs.values()) if n.kind == "column"})


def _doubles(column) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def with_arrays(df: DataFrame, outputs: dict[str, Field], x: Column, z: Column, seed: int = 0) -> DataFrame:
    """df with a column for each component of the outputs at positions (x, z); plans without neighbourhoods."""
    if halo(list(outputs.values())):
        raise PlanError("plan", "the plan reads neighbours; use over_raster")
    fields, names, read = [f for _, f in sorted(outputs.items())], columns_of(outputs), columns_read(outputs)
    out = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])
    n = len(df.columns)

    def run(batches):
        for b in batches:
            at = tuple(_doubles(b.column(n + k)) for k in (0, 1))
            columns = {c: _doubles(b.column(b.schema.get_field_index(c))) for c in read}
            parts = [np.broadcast_to(c, at[0].shape) for v in evaluate(fields, Blocks, at, 1.0, seed, columns) for c in v]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(p.astype(float)) for p in parts)], names=[*b.schema.names[:n], *names])

    return df.select("*", x.cast("double").alias("__x"), z.cast("double").alias("__z")).mapInArrow(run, out)


def over_raster(df: DataFrame, outputs: dict[str, Field], section: int = 64, spacing: float = 1.0, seed: int = 0) -> DataFrame:
    """(x, z, ..) of a dense raster (x, z, columns that the plan reads): the outputs' components at each sample.

    What lies beyond the raster is missing, as at the edge of an exported array; a gap within a tile is an error.
    """
    reach = halo(list(outputs.values()))
    section = max(section, 2 * reach)  # so that a sample is in four tiles at most
    fields, names, read = [f for _, f in sorted(outputs.items())], columns_of(outputs), columns_read(outputs)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / section), F.floor((F.col(c) + reach) / section)))
    sent = df.select("x", "z", *(F.col(c).cast("double") for c in read)).withColumn("tx", tiles("x")).withColumn("tz", tiles("z"))

    def run(key, rows):
        tx, tz = (k.as_py() for k in key)
        x, z = rows["x"].to_numpy(), rows["z"].to_numpy()
        own = (x // section == tx) & (z // section == tz)
        if not own.any():
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * len(names), names=["x", "z", *names])
        x0, z0, width, depth = int(x.min()), int(z.min()), int(x.max() - x.min()) + 1, int(z.max() - z.min()) + 1
        if len(x) != width * depth:
            raise PlanError("source", f"the raster has gaps in tile {tx}, {tz}")
        line = np.argsort((z - z0) * width + x - x0)
        columns = {c: _doubles(rows[c])[line].reshape(depth, width) for c in read}
        az, ax = np.meshgrid(np.arange(z0, z0 + depth), np.arange(x0, x0 + width), indexing="ij")
        parts = [np.broadcast_to(c, ax.shape) for v in evaluate(fields, Blocks, (ax * float(spacing), az * float(spacing)), spacing, seed, columns) for c in v]
        mine = own[line].reshape(depth, width)
        return pa.table([pa.array(ax[mine]), pa.array(az[mine]), *(pa.array(p[mine].astype(float)) for p in parts)], names=["x", "z", *names])

    return sent.groupBy("tx", "tz").applyInArrow(run, "x long, z long, " + ", ".join(f"{n} double" for n in names))
