"""Tiles on demand: a stream of requests is deduplicated and each tile computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..field import Field
from ..plans.blocks import block, columns_of


def ring(camera_x: float, camera_z: float, tile: float, radius: int) -> list[tuple[int, int]]:
    """The tiles around a camera, nearest first."""
    cx, cz = int(camera_x // tile), int(camera_z // tile)
    cells = [(cx + i, cz + j) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1)]
    return sorted(cells, key=lambda c: ((c[0] - cx) ** 2 + (c[1] - cz) ** 2, c[1], c[0]))


def evaluated(requests: DataFrame, outputs: dict[str, Field], size: int, resolution: float, seed: int = 0) -> DataFrame:
    """Samples of requested tiles (level, tx, tz); a level doubles the spacing. Works on a batch and on a stream."""
    import numpy as np
    import pyarrow as pa

    names = columns_of(outputs)

    def run(batches):
        for b in batches:
            for level, tx, tz in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                spacing = resolution * 2**level
                values = block(outputs, (tx * size, tz * size), (size, size), spacing, seed)
                z, x = np.meshgrid(np.arange(tz * size, (tz + 1) * size), np.arange(tx * size, (tx + 1) * size), indexing="ij")
                columns = [pa.array(np.full(x.size, k)) for k in (level, tx, tz)] + [pa.array(a.ravel()) for a in (x, z)] + [pa.array(v.ravel().astype(np.float32)) for v in values]
                yield pa.RecordBatch.from_arrays(columns, names=["level", "tx", "tz", "sx", "sz", *names])

    schema = "level long, tx long, tz long, sx long, sz long, " + ", ".join(f"{c} float" for c in names)
    return requests.select(*(F.col(c).cast("long").alias(c) for c in ("level", "tx", "tz"))).mapInArrow(run, schema)


def serve(requests: DataFrame, outputs: dict[str, Field], size: int, resolution: float, path: str, checkpoint: str, seed: int = 0):
    """A streaming query that writes each requested tile once: tiles asked for again are dropped by keyed state that outlives restarts."""
    new = requests.dropDuplicates(["level", "tx", "tz"])
    return evaluated(new, outputs, size, resolution, seed).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
