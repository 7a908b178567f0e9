"""Evaluation of a plan in a lane: each node once, channels as tuples of components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..errors import PlanError
from ..field import Field, Node
from ..functions import noise, pointwise as pw
from ..functions.lanes import Blocks
from ..operators import stencils


def order(fields) -> list[Node]:
    """The nodes that the fields need, inputs first."""
    out: dict[Node, None] = {}
    stack = [(f.node, False) for f in reversed(list(fields))]
    while stack:
        node, ready = stack.pop()
        if node in out:
            continue
        if ready:
            out[node] = None
        else:
            stack.append((node, True))
            stack += [(i.node, False) for i in reversed(node.inputs)]
    return list(out)


def halo(fields) -> int:
    """The longest sum of radii along a chain of operations."""
    reach: dict[Node, int] = {}
    for node in order(fields):
        reach[node] = node.radius + max((reach[i.node] for i in node.inputs), default=0)
    most = max((reach[f.node] for f in fields), default=0)
    if most > 255:
        raise PlanError("plan", f"the chain reads {most} samples around each, at most 255")
    return most


_ARITH = {
    "add": lambda lane, a, b, k: a + b, "sub": lambda lane, a, b, k: a - b, "mul": lambda lane, a, b, k: a * b, "div": lambda lane, a, b, k: lane.divide(a, b),
    "min": lambda lane, a, b, k: lane.least(a, b), "max": lambda lane, a, b, k: lane.greatest(a, b), "atan2": lambda lane, a, b, k: lane.atan2(a, b),
    "less": lambda lane, a, b, k: lane.where(a < b, 1.0, 0.0),
    "smooth_min": lambda lane, a, b, k: pw.smooth_min(lane, a, b, k), "smooth_max": lambda lane, a, b, k: pw.smooth_max(lane, a, b, k),
}


def _curve(lane, v, p):
    op = p["op"]
    if op == "clamp":
        return pw.clamp(lane, v, p["min"], p["max"])
    if op == "remap":
        return pw.remap(v, p["min"], p["max"])
    if op == "power":
        return pw.signed_power(lane, v, p["exponent"])
    if op == "smoothstep":
        return pw.smoothstep(lane, v, p["min"], p["max"])
    if op == "profile":
        return pw.profile(lane, v, p["profile"], p["a"], p["b"])
    if op == "terrace":
        return pw.terrace(lane, v, p["step"], p["sharpness"])
    return {"floor": lane.floor, "abs": lane.abs, "sqrt": lane.sqrt}[op](v)


def _shape(lane, x, z, p):
    if p["op"] == "Circle":
        return pw.circle(lane, x, z, p["radius"])
    if p["op"] == "Ellipse":
        return pw.ellipse(lane, x, z, *p["radii"])
    if p["op"] == "Rect":
        hx, hz = (s / 2 for s in p["size"])
        return pw.box(lane, x, z, hx, hz, p["rounding"]) if p["metric"] == "euclidean" else pw.box_chebyshev(lane, x, z, hx, hz)
    return pw.segments(lane, x, z, list(p["points"]), p["closed"])


def _grid(lane, x, z, p):
    """Catmull-Rom reading of a table of constants; blocks only."""
    if lane is not Blocks:
        raise PlanError("plan", "Terrain.Grid is read in blocks")
    (w, d), v = p["size"], np.array(p["values"], x.dtype).reshape(p["size"][1], p["size"][0])
    gx, gz = (x - p["origin"][0]) / p["cell"], (z - p["origin"][1]) / p["cell"]
    if not p["wrap"]:
        gx, gz = np.clip(gx, 0, w - 1), np.clip(gz, 0, d - 1)
    i, j = np.floor(gx).astype(int), np.floor(gz).astype(int)
    fold = (lambda k, n: k % n) if p["wrap"] else (lambda k, n: np.clip(k, 0, n - 1))
    rows = [pw.catmull_rom(*(v[fold(j + b, d), fold(i + a, w)] for a in (-1, 0, 1, 2)), gx - i) for b in (-1, 0, 1, 2)]
    return pw.catmull_rom(*rows, gz - j)


def evaluate(fields: list[Field], lane, position, spacing: float, seed: int, columns: dict | None = None) -> list[tuple]:
    """The components of each field. position: (x, z) or (x, y, z) in the lane's values; columns: those of a table, as arrays."""
    done: dict[Node, list[tuple]] = {}
    get = lambda f: done[f.node][f.channel]
    for node in order(fields):
        p, ins = node.p, [get(i) for i in node.inputs]
        if node.domain != len(position):
            raise PlanError("plan", f"{node.kind} is over R{node.domain}, the job over R{len(position)}")
        kind, out = node.kind, None
        if lane is not Blocks and (kind == "cells" or str(p.get("kind")).startswith("cellular")):
            raise PlanError("plan", "the nearest of 25 sites is a join in rows (queries.cells_*), or a field exported in blocks")
        if kind == "coords":
            out = [tuple(position)]
        elif kind == "column":
            if lane is Blocks and p["name"] not in (columns or {}):
                raise PlanError("plan", f"column {p['name']} is of a table; use rows")
            out = [(columns[p["name"]] if lane is Blocks else lane.let(F.col(p["name"]).cast("double")),)]
        elif kind == "const":
            out = [(position[0] * 0.0 + p["value"],)]
        elif kind == "arith":
            a, b = ins
            n = max(len(a), len(b))
            a, b = (x * n if len(x) < n else x for x in (a, b))
            out = [lane.lets(*(_ARITH[p["op"]](lane, x, y, p.get("k", 0.0)) for x, y in zip(a, b, strict=True)))]
        elif kind == "component":
            out = [(ins[0][p["index"]],)]
        elif kind == "combine":
            out = [tuple(i[0] for i in ins)]
        elif kind == "curve":
            out = [lane.lets(*(_curve(lane, v, p) for v in ins[0]))]
        elif kind == "blend":
            a, b, (m,) = ins
            n = max(len(a), len(b))
            a, b = (x * n if len(x) < n else x for x in (a, b))
            out = [lane.lets(*(pw.blend(lane, x, y, m) for x, y in zip(a, b, strict=True)))]
        elif kind == "noise":
            k = {x: v for x, v in p.items() if x != "seed"}
            value, *g = noise.fbm(lane, ins[0], seed=noise.job_seed(seed, p["seed"]), **k)
            out = [(value,), tuple(g)]
        elif kind == "cells":
            k = {x: v for x, v in p.items() if x != "seed"}
            value, *site = noise.cells(lane, ins[0], seed=noise.job_seed(seed, p["seed"]), **k)
            out = [(value,), tuple(site)]
        elif kind == "normals":
            gx, gz = (lane.let(g * -p["scale"]) for g in ins[0])
            size = lane.let(lane.sqrt(gx * gx + gz * gz + 1.0))
            out = [lane.lets(gx / size, 1.0 / size, gz / size)]
        elif kind == "slope":
            gx, gz = ins[0]
            out = [(lane.let(pw.smoothstep(lane, lane.let(lane.sqrt(gx * gx + gz * gz)), p["min"], p["max"])),)]
        elif kind == "transform":
            out = [lane.lets(*pw.place(*ins[0], p["at"], p["rotation"], p["scale"], p["pivot"]))]
        elif kind == "shape":
            out = [(lane.let(_shape(lane, *ins[0], p)),)]
        elif kind == "grid":
            out = [(_grid(lane, *ins[0], p),)]
        elif lane is not Blocks:
            raise PlanError("plan", f"{kind} reads neighbours; export the field in blocks")
        elif kind == "gullies":
            k = {x: v for x, v in p.items() if x not in ("seed", "strength")}
            stripes, drain = noise.gullies(lane, ins[2], ins[1], seed=noise.job_seed(seed, p["seed"]), **k)
            out = [(ins[0][0] + stripes * p["strength"],), (drain,)]
        elif kind == "gradient":
            out = [tuple(stencils.gradient(ins[0][0], spacing))]
        elif kind == "blur":
            out = [((stencils.box_mean if p["method"] == "mean" else stencils.median)(ins[0][0], p["r"]),)]
        elif kind == "window":
            f = stencils.expand if p["sign"] > 0 else stencils.shrink
            out = [(f(ins[0][0], p["r"], p["shape"], p["falloff"], p["slope"], spacing, ins[1][0] if len(ins) > 1 else None),)]
        elif kind == "displace":
            out = [(stencils.displace(ins[0][0], list(ins[1]), p["r"], spacing),)]
        elif kind == "thermal":
            h, loose = stencils.thermal(ins[0][0], spacing=spacing, strength_map=ins[1][0] if len(ins) > 1 else None, **p)
            out = [(h,), (loose,)]
        elif kind == "hydraulic":
            h, *flow = stencils.hydraulic(ins[0][0], spacing=spacing, hardness=ins[1][0] if len(ins) > 1 else None, **p)
            out = [(h,), tuple(flow)]
        else:
            raise PlanError("plan", f"unknown operation {kind}")
        done[node] = out
    return [get(f) for f in fields]
