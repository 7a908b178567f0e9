"""Export of fields section by section: a table of samples, computed where it is needed.

The rows are sections; each is evaluated by itself, padded by the reach of the plan, from whole-number
sample coordinates. Nothing is shuffled and no border is exchanged, so the plan scales with the
number of sections, and a value does not depend on how the region is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import PlanError
from ..field import Field
from ..functions.lanes import Blocks
from .evaluate import evaluate, halo


def columns_of(outputs: dict[str, Field]) -> list[str]:
    return [c for name, f in sorted(outputs.items()) for c in ([name] if f.size == 1 else [f"{name}_{k}" for k in range(f.size)])]


def block(outputs: dict[str, Field], start: tuple[int, ...], size: tuple[int, ...], resolution: float, seed: int = 0, dtype=np.float32) -> tuple[np.ndarray, ...]:
    """The components of the outputs, in name order, over samples start .. start + size (x, z or x, y, z); arrays (z, x) or (y, z, x)."""
    fields = [f for _, f in sorted(outputs.items())]
    reach = halo(fields)
    axes = [np.arange(a - reach, a + n + reach) for a, n in zip(start, size, strict=True)]
    if len(axes) == 2:
        z, x = np.meshgrid(axes[1], axes[0], indexing="ij")
        at = (x, z)
    else:
        y, z, x = np.meshgrid(axes[1], axes[2], axes[0], indexing="ij")
        at = (x, y, z)
    position = tuple(a.astype(dtype) * dtype(resolution) for a in at)
    cut = tuple(slice(reach, s - reach) for s in position[0].shape)
    return tuple(np.broadcast_to(c, position[0].shape)[cut] for parts in evaluate(fields, Blocks, position, resolution, seed) for c in parts)


def export(spark: SparkSession, outputs: dict[str, Field], least: tuple[float, ...], most: tuple[float, ...], resolution: float = 1.0, section: int = 256, seed: int = 0, dtype: str = "f32") -> DataFrame:
    """One row a sample: sx, (sy,) sz and the outputs' components. least, most: bounds in metres, (x, z) or (x, y, z)."""
    if len({f.domain for f in outputs.values()}) != 1 or next(iter(outputs.values())).domain != len(least):
        raise PlanError("plan", "outputs and bounds are over different domains")
    lo = [round(v / resolution) for v in least]
    size = [round(b / resolution) - a for a, b in zip(lo, most, strict=True)]
    if min(size) <= 0:
        raise PlanError("plan", f"the region is empty: {size}")
    halo(list(outputs.values()))
    counts = [-(-n // section) for n in size]
    names, real = columns_of(outputs), np.float32 if dtype == "f32" else np.float64
    keys = ["sx", "sz"] if len(lo) == 2 else ["sx", "sy", "sz"]

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                tile = []
                for c in counts:
                    tile.append(t % c)
                    t //= c
                start = [a + k * section for a, k in zip(lo, tile, strict=True)]
                n = [min(section, s - k * section) for s, k in zip(size, tile, strict=True)]
                values = block(outputs, tuple(start), tuple(n), resolution, seed, real)
                axes = [np.arange(a, a + m) for a, m in zip(start, n, strict=True)]
                if len(axes) == 2:
                    z, x = np.meshgrid(axes[1], axes[0], indexing="ij")
                    at = (x, z)
                else:
                    y, z, x = np.meshgrid(axes[1], axes[2], axes[0], indexing="ij")
                    at = (x, y, z)
                yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in at] + [pa.array(v.ravel().astype(real)) for v in values], names=[*keys, *names])

    kind = "float" if dtype == "f32" else "double"
    tiles = int(np.prod(counts))
    return spark.range(0, tiles, 1, min(tiles, 4096)).mapInArrow(run, ", ".join([f"{k} long" for k in keys] + [f"{c} {kind}" for c in names]))
