"""Values of a plan at given points, without a section around them.

Sampling reads through what needs a neighbourhood: blurs, windows, both erosions and gullies give their
input, their second channels 0. A gradient is taken from its input a spacing away on either side, a
displaced field is its input at the displaced place, exactly. Plans are over two dimensions.
"""

from __future__ import annotations

import numpy as np

from ..errors import PlanError
from ..field import Field, Node
from ..functions.lanes import Blocks
from .evaluate import evaluate

#: Kinds that are read through.
THROUGH = ("blur", "window", "thermal", "hydraulic", "gullies")


def sample(field: Field, x, z, spacing: float = 1.0, seed: int = 0) -> np.ndarray:
    """The field at points (x, z): an array like x, with one more axis for a field of several components."""
    if field.domain != 2:
        raise PlanError("plan", "only fields over R2 are sampled")
    x, z = np.broadcast_arrays(np.asarray(x, float), np.asarray(z, float))
    parts = _at(field, x, z, float(spacing), seed, {})
    return parts[0] if len(parts) == 1 else np.stack(parts, axis=-1)


def _at(field: Field, x, z, spacing, seed, done: dict) -> tuple:
    node = field.node
    if node not in done:
        done[node] = _node(node, x, z, spacing, seed, done)
    return done[node][field.channel]


def _node(node: Node, x, z, spacing, seed, done) -> list[tuple]:
    if node.kind in THROUGH:
        value = _at(node.inputs[0], x, z, spacing, seed, done)
        return [value] + [(np.zeros(x.shape),) * n for n in node.sizes[1:]]
    if node.kind == "gradient":
        ahead, behind = ([_at(node.inputs[0], x + dx * s, z + dz * s, spacing, seed, {})[0] for dx, dz in ((spacing, 0), (0, spacing))] for s in (1, -1))
        return [tuple((a - b) / (2 * spacing) for a, b in zip(ahead, behind, strict=True))]
    if node.kind == "displace":
        dx, dz = _at(node.inputs[1], x, z, spacing, seed, done)
        return [_at(node.inputs[0], x + dx, z + dz, spacing, seed, {})]
    # the others are pointwise: the node alone, over inputs that are there already
    inputs = [_at(i, x, z, spacing, seed, done) for i in node.inputs]
    values, fields = {}, []
    for k, parts in enumerate(inputs):
        columns = [Field(Node("column", (("name", f"{k}_{c}"),), (), 2, (1,), ("value",))) for c in range(len(parts))]
        values |= {f"{k}_{c}": np.broadcast_to(p, x.shape) for c, p in enumerate(parts)}
        fields.append(columns[0] if len(columns) == 1 else Field(Node("combine", (), tuple(columns), 2, (len(columns),), ("value",))))
    alone = Node(node.kind, node.params, tuple(fields), node.domain, node.sizes, node.names)
    found = evaluate([Field(alone, c) for c in range(len(node.sizes))], Blocks, (x, z), spacing, seed, values)
    return [tuple(np.broadcast_to(p, x.shape) for p in parts) for parts in found]


def sample_grid(field: Field, origin: tuple[float, float], size: tuple[int, int], cell: float, seed: int = 0) -> np.ndarray:
    """The field at size = (across, down) points from the origin, `cell` metres apart; array (z, x)."""
    z, x = np.mgrid[0 : size[1], 0 : size[0]] * float(cell)
    return sample(field, x + origin[0], z + origin[1], cell, seed)


def sampled(df, outputs: dict[str, Field], x: str = "x", z: str = "z", spacing: float = 1.0, seed: int = 0):
    """df with each output sampled at its points, in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from .blocks import columns_of

    fields, names, n = [f for _, f in sorted(outputs.items())], columns_of(outputs), len(df.columns)

    def run(batches):
        for b in batches:
            at = [b.column(n + k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            parts = [p for f in fields for p in _at(f, *at, float(spacing), seed, {})]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(np.broadcast_to(p, at[0].shape).astype(float)) for p in parts)], names=[*b.schema.names[:n], *names])

    schema = T.StructType(df.schema.fields + [T.StructField(c, T.DoubleType()) for c in names])
    return df.select("*", F.col(x).cast("double").alias("__x"), F.col(z).cast("double").alias("__z")).mapInArrow(run, schema)
