"""Whole-raster algorithms.

Components, distances and drainage of tables are joins and aggregates; the sequential simulations
(stream power, wind, priority floods) take one raster as arrays and run as one group of a job, many
rasters in parallel.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The eight neighbours in the order in which ties are decided.
AROUND = [(dx, dz) for dz in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dz]


def label(df: DataFrame, checkpoint=None) -> DataFrame:
    """(x, z, land, cell, label): label is the smallest cell number of the 4-connected body of equal `land`.

    First runs along x are joined in windows, then labels spread over the joins of runs, the smallest
    first, with jumps to the label of the label, until none changes. checkpoint: called on each
    round's table (by default DataFrame.checkpoint where a folder is set, else as it is).
    """
    if checkpoint is None:
        checkpoint = (lambda d: d.checkpoint()) if df.sparkSession.sparkContext.getCheckpointDir() else (lambda d: d.cache())
    line = Window.partitionBy("z").orderBy("x")
    starts = F.coalesce((F.lag("land").over(line) != F.col("land")) | (F.lag("x").over(line) != F.col("x") - 1), F.lit(True))
    runs = df.withColumn("s", F.sum(starts.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = checkpoint(runs.withColumn("run", F.min("cell").over(Window.partitionBy("z", "s"))).drop("s"))
    below = runs.select("x", (F.col("z") - 1).alias("z"), F.col("land").alias("l"), F.col("run").alias("r"))
    edges = runs.join(below, ["x", "z"]).where("land = l").select(F.col("run").alias("a"), F.col("r").alias("b")).distinct()
    edges = checkpoint(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    names = checkpoint(runs.select(F.col("run").alias("v")).distinct().withColumn("c", F.col("v")))
    while True:
        near = edges.join(names.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = names.join(near, names["v"] == near["a"], "left").select("v", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = step.select(F.col("v").alias("w"), F.col("n").alias("far"))
        step = checkpoint(step.join(jump, step["n"] == jump["w"]).select("v", "c", F.least("n", "far").alias("n")))
        names = step.select("v", F.col("n").alias("c"))
        if step.where("n < c").isEmpty():
            return runs.join(names.select(F.col("v").alias("run"), F.col("c").alias("label")), "run").select("x", "z", "land", "cell", "label")


def bodies(labels: DataFrame, width: int, depth: int) -> DataFrame:
    """One row a body: land, label, cells, whether it touches the border, and its rank by size within its kind (ties: the first cell)."""
    edge = (F.col("x") == 0) | (F.col("z") == 0) | (F.col("x") == width - 1) | (F.col("z") == depth - 1)
    out = labels.groupBy("land", "label").agg(F.count(F.lit(1)).alias("cells"), F.max(edge.cast("int")).alias("edge"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("land").orderBy(F.desc("cells"), "label")).cast("long"))


def envelope(g2: np.ndarray) -> np.ndarray:
    """min over k of (i - k)**2 + g2[k] for every i, where g2 holds inf for no offer: the lower envelope of parabolas, in one pass."""
    at = np.flatnonzero(np.isfinite(g2))
    if not len(at):
        return np.full(len(g2), np.inf)
    kept, since = [int(at[0])], [-np.inf]
    for k in at[1:].tolist():
        while True:
            j = kept[-1]
            cross = (g2[k] - g2[j] + k * k - j * j) / (2.0 * (k - j))
            if cross > since[-1]:
                break
            kept.pop()
            since.pop()
        kept.append(k)
        since.append(cross)
    i = np.arange(len(g2))
    k = np.array(kept)[np.searchsorted(np.array(since), i, side="right") - 1]
    # at a crossing two parabolas are equal, so either is right
    return (i - k) ** 2 + g2[k]


def distance(df: DataFrame) -> DataFrame:
    """(x, z, d2): squared distance to the nearest source (`land`), exact; null without any source.

    Down each column the nearest source above and below, as windows; along each row the lower envelope
    of the columns' offers, a row a group: the work is one pass over the cells.
    """
    here = F.when(F.col("land"), F.col("z"))
    # running frames both ways: one that reaches to the end of the column would be read anew for each cell
    up, down = (F.last(here, ignorenulls=True).over(Window.partitionBy("x").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("z"), F.desc("z")))
    gap = df.select("x", "z", F.least(F.col("z") - up, down - F.col("z")).cast("double").alias("g"))

    def row(t: pa.Table) -> pa.Table:
        x, g = t["x"].to_numpy(), t["g"].to_numpy(zero_copy_only=False)
        offer = np.full(int(x.max() - x.min()) + 1, np.inf)
        offer[x - x.min()] = np.where(np.isnan(g), np.inf, g * g)
        d2 = envelope(offer)[x - x.min()]
        return pa.table([t["x"], t["z"], pa.array(np.where(np.isfinite(d2), d2, 0).astype(np.int64), mask=~np.isfinite(d2))], names=["x", "z", "d2"])

    return gap.groupBy("z").applyInArrow(row, "x long, z long, d2 long")


def manhattan(df: DataFrame, mask: str = "land") -> DataFrame:
    """(x, z, d1): steps along x and z to the nearest cell of the mask, by running minima in windows; null without any."""
    big = 1 << 40
    out = df.select("x", "z", F.when(F.col(mask), F.lit(0)).otherwise(F.lit(big)).cast("long").alias("d1"))
    for across, along in (("z", "x"), ("x", "z")):
        line = Window.partitionBy(across)
        # both are running frames, see distance
        before = F.min(F.col("d1") - F.col(along)).over(line.orderBy(F.asc(along)).rowsBetween(Window.unboundedPreceding, 0)) + F.col(along)
        after = F.min(F.col("d1") + F.col(along)).over(line.orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)) - F.col(along)
        out = out.select("x", "z", F.least(before, after).alias("d1"))
    return out.select("x", "z", F.when(F.col("d1") < big // 2, F.col("d1")).alias("d1"))


def receivers(df: DataFrame) -> DataFrame:
    """(x, z, v, rx, rz): the lower 8-neighbour of the steepest drop (diagonals over sqrt 2), the first in order on ties; null in pits."""
    taps = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dz).alias("dz"), F.lit(k).alias("k"), F.lit(math.sqrt(2.0) if dx and dz else 1.0).alias("far")) for k, (dx, dz) in enumerate(AROUND)])
    sent = df.withColumn("t", F.explode(taps)).select((F.col("x") + F.col("t.dx")).alias("x"), (F.col("z") + F.col("t.dz")).alias("z"), F.col("x").alias("nx"), F.col("z").alias("nz"), F.col("v").alias("nv"), "t.k", "t.far")
    drop = df.join(sent, ["x", "z"]).withColumn("drop", (F.col("v") - F.col("nv")) / F.col("far")).where("drop > 0")
    best = drop.groupBy("x", "z").agg(F.max_by(F.struct("nx", "nz"), F.struct("drop", -F.col("k"))).alias("r"))
    return df.join(best, ["x", "z"], "left").select("x", "z", "v", F.col("r.nx").alias("rx"), F.col("r.nz").alias("rz"))


def accumulate(flow: DataFrame, checkpoint=None) -> DataFrame:
    """(cell, cells): how many cells drain through each, itself included, for (cell, receiver), receiver null at outlets; no cycles.

    Each round doubles the distance that is summed over: as many rounds as the logarithm of the longest path.
    """
    if checkpoint is None:
        checkpoint = (lambda d: d.checkpoint()) if flow.sparkSession.sparkContext.getCheckpointDir() else (lambda d: d.cache())
    now = checkpoint(flow.select("cell", F.col("receiver").alias("far"), F.lit(1).cast("long").alias("cells")))
    while not now.where("far is not null").isEmpty():
        sent = now.where("far is not null").groupBy(F.col("far").alias("to")).agg(F.sum("cells").alias("more"))
        step = now.select(F.col("cell").alias("at"), F.col("far").alias("next"))
        now = now.join(sent, now["cell"] == sent["to"], "left").join(step, now["far"] == step["at"], "left")
        now = checkpoint(now.select("cell", F.col("next").alias("far"), (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells")))
    return now.select("cell", "cells")


# --- one raster as arrays -----------------------------------------------------------------------


def priority_flood(h: np.ndarray, epsilon: float = 0.0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Levels at which each cell drains to the border (or to `start`), and the order in which cells are reached; ties to the lower cell."""
    depth, width = h.shape
    flat, level, done = h.ravel().tolist(), h.ravel().astype(float).tolist(), [False] * h.size
    if start is None:
        start = np.zeros(h.shape, bool)
        start[[0, -1], :] = start[:, [0, -1]] = True
    heap = [(flat[i], i) for i in np.flatnonzero(start.ravel()).tolist()]
    for _, i in heap:
        done[i] = True
    heapq.heapify(heap)
    order = []
    while heap:
        at, i = heapq.heappop(heap)
        order.append(i)
        z, x = divmod(i, width)
        for dx, dz in AROUND:
            if 0 <= x + dx < width and 0 <= z + dz < depth:
                q = i + dz * width + dx
                if not done[q]:
                    done[q] = True
                    level[q] = max(flat[q], at + epsilon)
                    heapq.heappush(heap, (level[q], q))
    return np.array(level).reshape(h.shape), np.array(order)


def flow(filled: np.ndarray, order: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Steepest receiver of each inner cell (-1: none) and drained area."""
    depth, width = filled.shape
    best, receiver = np.zeros(filled.shape), np.full(filled.shape, -1)
    index = np.arange(filled.size).reshape(filled.shape)
    inner = (slice(1, -1), slice(1, -1))
    for dx, dz in AROUND:
        there = (slice(1 + dz, depth - 1 + dz), slice(1 + dx, width - 1 + dx))
        drop = (filled[inner] - filled[there]) / (cell * math.sqrt(2.0) if dx and dz else cell)
        on = drop > best[inner]
        best[inner] = np.where(on, drop, best[inner])
        receiver[inner] = np.where(on, index[there], receiver[inner])
    area, r = [cell * cell] * filled.size, receiver.ravel().tolist()
    for i in reversed(order.tolist()):
        if r[i] >= 0:
            area[r[i]] += area[i]
    return receiver, np.array(area).reshape(filled.shape)


def _toward(offset: tuple[int, int], shape: tuple[int, int]) -> tuple[tuple[slice, slice], tuple[slice, slice]]:
    """The part of an array whose neighbour at the offset (dx, dz) exists, and those neighbours."""
    (dx, dz), (depth, width) = offset, shape
    own = slice(max(0, -dz), depth - max(0, dz)), slice(max(0, -dx), width - max(0, dx))
    return own, (slice(max(0, dz), depth - max(0, -dz)), slice(max(0, dx), width - max(0, -dx)))


def tiers(receiver: np.ndarray) -> list[np.ndarray]:
    """The cells of a forest (receiver: flat, -1 at roots) by how many steps they are from their root, roots first."""
    n = len(receiver)
    steps, jump = (receiver >= 0).astype(np.int64), np.where(receiver >= 0, receiver, np.arange(n))
    while True:  # each round doubles the steps that are known
        more = steps + steps[jump]
        if (more == steps).all():
            break
        steps, jump = more, jump[jump]
    order = np.argsort(steps, kind="stable")
    return np.split(order, np.cumsum(np.bincount(steps))[:-1])


def gathered(receiver: np.ndarray, own: np.ndarray | float) -> np.ndarray:
    """What drains through each cell of a forest, its own share included."""
    total = np.broadcast_to(np.asarray(own, float), receiver.shape).copy()
    for cells in reversed(tiers(receiver)[1:]):
        np.add.at(total, receiver[cells], total[cells])
    return total


def capped(h: np.ndarray, slope: float, cell: float, held: np.ndarray) -> np.ndarray:
    """The highest surface not over h whose steps to neighbours rise by the slope at most; `held` cells stay."""
    h = h.copy()
    for _ in range(h.size):
        before = h.copy()
        for dx, dz in AROUND:
            here, there = _toward((dx, dz), h.shape)
            h[here] = np.minimum(h[here], h[there] + slope * cell * math.hypot(dx, dz))
        h[held] = before[held]
        if (h == before).all():
            break
    return h


#: Fixed value: drainage is found anew in each of this many first steps, then every `refresh` steps.
SETTLING = 20


def stream_power(h: np.ndarray, uplift: np.ndarray, cell=50.0, iterations=100, k=1e-4, m=0.5, talus=0.0, diffusion=0.0, refresh=1) -> np.ndarray:
    """Uplift against incision k * area**m * slope, with creep and a steepest slope, for a fixed rim.

    A step is implicit: the new height of a cell is a mean of its own and its receiver's new height,
    weighted by the rate over the distance, so all cells of one tier above the outlets are solved at once.
    """
    h = h.astype(float).copy()
    depth, width = h.shape
    rim = np.ones(h.shape, bool)
    rim[1:-1, 1:-1] = False
    z, x = np.divmod(np.arange(h.size), width)
    for step in range(iterations):
        h += np.where(rim, 0.0, uplift)
        if step < SETTLING or step % refresh == 0:
            filled, _ = priority_flood(h, 1e-6)
            to = flow(filled, np.array([], int), cell)[0].ravel()
            h = filled
            share = k * gathered(to, cell * cell) ** m / (cell * np.where(to >= 0, np.hypot(x - x[to], z - z[to]), 1.0))
            above = tiers(to)[1:]
        flat = h.ravel()
        for cells in above:
            base = flat[to[cells]]
            flat[cells] = np.where(flat[cells] > base, (flat[cells] + share[cells] * base) / (1.0 + share[cells]), flat[cells])
        if diffusion > 0:
            around = sum(np.roll(h, o, axis) for axis in (0, 1) for o in (-1, 1))
            h = np.where(rim, h, h + min(diffusion / cell**2, 0.2) * (around - 4 * h))
        if talus > 0:
            h = capped(h, talus, cell, rim)
    return h


def lee(sand: np.ndarray, drop: float) -> np.ndarray:
    """Whether a cell of a raster that repeats lies in the wind shadow of a higher one before it along +x; light falls `drop` a cell."""
    roof, reach = np.roll(sand, 1, 1) - drop, 1
    while reach < sand.shape[1]:
        roof = np.maximum(roof, np.roll(roof, reach, 1) - drop * reach)
        reach *= 2
    return roof > sand


def slumped(sand: np.ndarray, steepest: float, rounds: int = 64) -> np.ndarray:
    """Slabs slide to lower neighbours where a step is steeper than the angle of repose, all pairs along a direction at once; the sum stays."""
    sand = sand.copy()
    for _ in range(rounds):
        before = sand
        for dx, dz in AROUND:  # both ways of each pair, one after the other, so that a cell gives one slab at a time
            over = (sand - np.roll(sand, (-dz, -dx), (0, 1)) > steepest * math.hypot(dx, dz)).astype(sand.dtype)
            sand = sand - over + np.roll(over, (dz, dx), (0, 1))
        if (sand == before).all():
            break
    return sand


def wind(h: np.ndarray, cell=20.0, slab=3.0, iterations=10, hop=5, p_sand=0.6, p_bare=0.4, shadow=15.0, repose=33.0, creep=0.2, smooth=2, seed=0) -> np.ndarray:
    """Slabs of sand that the wind picks up, carries along +x and drops, on a raster that repeats (Werner's slab model).

    In each of `iterations` rounds every cell is picked once on average, in batches of an eighth of the
    cells drawn by chance. A batch moves together: slabs leave cells outside wind shadows, then hop until
    they fall into a shadow or stick (p_sand on sand, p_bare on bare ground), or creep one cell; steep
    places slump after each batch.
    """
    rng = np.random.default_rng(seed)
    depth, width = h.shape
    sand = np.maximum(0, np.rint(h / slab)).astype(np.int64)
    drop, rest = math.tan(math.radians(shadow)) * cell / slab, math.tan(math.radians(repose)) * cell / slab
    for _ in range(8 * iterations):
        z, x = np.nonzero((rng.random(sand.shape) < 0.125) & (sand > 0) & ~lee(sand, drop))
        np.subtract.at(sand, (z, x), 1)
        sand = slumped(sand, rest)
        crept = rng.random(len(x)) < creep
        shaded = lee(sand, drop)
        x = (x + np.where(crept, 1, hop)) % width
        falling = crept.copy()
        for _ in range(width):
            stick = rng.random(len(x)) < np.where(sand[z, x] > 0, p_sand, p_bare)
            falling |= shaded[z, x] | stick
            np.add.at(sand, (z[falling], x[falling]), 1)
            z, x = z[~falling], (x[~falling] + hop) % width
            falling = np.zeros(len(x), bool)
        np.add.at(sand, (z, x), 1)  # what has gone round falls where it is
        sand = slumped(sand, rest)
    out = sand * float(slab)
    for _ in range(smooth):
        for axis in (0, 1):
            out = (np.roll(out, 1, axis) + 2 * out + np.roll(out, -1, axis)) / 4
    return out


def coast_drain(land: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each land cell's downstream neighbour, itself at the coast and -1 where it has no way out, and how many cells drain through it.

    The flood rises from the coast (land beside water) over land only; the raster's rim is left out. A
    cell drains to that neighbour which the flood reached first.
    """
    inner = np.zeros(land.shape, bool)
    inner[1:-1, 1:-1] = True
    beside = np.zeros(land.shape, bool)
    for offset in ((1, 0), (-1, 0), (0, 1), (0, -1)):
        here, there = _toward(offset, land.shape)
        beside[here] |= ~land[there]
    dry = land & inner
    coast = (dry & beside).ravel()
    level, order = priority_flood(np.where(dry, height, np.inf), 0.0, coast.reshape(land.shape))
    when, order = np.full(land.size, land.size), order.astype(np.int64)
    reached = np.isfinite(level.ravel()[order]) if len(order) else np.zeros(0, bool)
    when[order[reached]] = np.flatnonzero(reached)
    when = when.reshape(land.shape)
    first, to, index = when.copy(), np.full(land.shape, -1), np.arange(land.size).reshape(land.shape)
    for offset in AROUND:
        here, there = _toward(offset, land.shape)
        sooner = when[there] < first[here]
        first[here] = np.where(sooner, when[there], first[here])
        to[here] = np.where(sooner, index[there], to[here])
    wet_or_lost = (when == land.size).ravel()
    root = np.where(wet_or_lost | coast, -1, to.ravel())
    area = np.where(wet_or_lost, 0.0, gathered(root, np.where(wet_or_lost, 0.0, 1.0)))
    return np.where(coast, index.ravel(), root).reshape(land.shape), area.reshape(land.shape)


def connected(mask: np.ndarray) -> list[np.ndarray]:
    """The cells of each 8-connected part of a mask, in the order of their first cells."""
    depth, width = mask.shape
    open_, out = mask.ravel().tolist(), []
    for first in np.flatnonzero(mask.ravel()).tolist():
        if not open_[first]:
            continue
        open_[first], part, at = False, [first], 0
        while at < len(part):
            z, x = divmod(part[at], width)
            at += 1
            for dx, dz in AROUND:
                if 0 <= x + dx < width and 0 <= z + dz < depth:
                    q = (z + dz) * width + x + dx
                    if open_[q]:
                        open_[q] = False
                        part.append(q)
        out.append(np.array(part))
    return out


def drain(h: np.ndarray, cell=50.0, sea_level=-1e30, breach=3.0, lake_area=2e5, lake_depth=2.0, channel_area=1e6, edges=True) -> dict[str, np.ndarray]:
    """How a raster drains: height (breached or filled), water level, drained area, receiver (-1: outlet), sea, lake and river cells.

    The sea is what lies at or below its level and touches the border through more of it. A depression
    no deeper than `breach` is cut through along its way out; one of at least lake_area and lake_depth is
    a lake and keeps its bed; any other is filled. `edges`: water can leave over the border.
    """
    depth, width = h.shape
    h = h.astype(float).copy()
    rim = np.zeros(h.shape, bool)
    rim[[0, -1], :] = rim[:, [0, -1]] = True
    sea = np.zeros(h.size, bool)
    for part in connected(h <= sea_level):
        sea[part] = rim.ravel()[part].any()
    sea = sea.reshape(h.shape)
    out = sea | rim if edges else sea
    if not out.any():
        raise ValueError("water has no way out")
    level, order = priority_flood(h, 1e-4, out)
    step: dict[int, int | None] = {}
    ground, lake = h.ravel(), np.zeros(h.size, bool)

    def way(c: int) -> int | None:
        """The lower neighbour of the steepest drop of the level."""
        if c not in step:
            z, x = divmod(c, width)
            best, step[c] = 0.0, None
            for dx, dz in AROUND:
                if 0 <= x + dx < width and 0 <= z + dz < depth:
                    drop = (level[z, x] - level[z + dz, x + dx]) / (math.sqrt(2.0) if dx and dz else 1.0)
                    if drop > best:
                        best, step[c] = drop, (z + dz) * width + x + dx
        return step[c]

    for part in connected(level > h + 1e-9):
        below = level.ravel()[part] - ground[part]
        if below.max() <= breach:
            c = int(part[np.lexsort((part, ground[part]))[0]])
            target, c = ground[c], way(c)
            while c is not None and not out.ravel()[c] and ground[c] >= target:
                ground[c] = target
                c = way(c)
        elif len(part) * cell * cell >= lake_area and below.max() >= lake_depth:
            lake[part] = True
        else:
            ground[part] = level.ravel()[part]
    filled, order = priority_flood(h, 1e-4, out)
    receiver, area = flow(np.pad(filled, 1, constant_values=np.inf), np.array([], int), cell)
    inner = receiver[1:-1, 1:-1].ravel()
    z, x = np.divmod(inner, width + 2)
    to = np.where((inner < 0) | out.ravel(), -1, (z - 1) * width + x - 1)
    area = [cell * cell] * h.size
    for i in reversed(order.tolist()):
        if to[i] >= 0:
            area[to[i]] += area[i]
    area, lake = np.array(area).reshape(h.shape), lake.reshape(h.shape)
    return {"height": h, "level": np.where(lake, filled, h), "area": area, "receiver": to.reshape(h.shape), "sea": sea, "lake": lake, "river": (area >= channel_area) & ~sea & ~lake}


def hillshade(h: np.ndarray, cell: float, azimuth: float = 315.0, altitude: float = 45.0) -> np.ndarray:
    """Lambert shading in [0, 1] with cast shadows; the light's direction is taken to the nearest of eight (degrees from north, clockwise; z grows southwards)."""
    turn = round(azimuth / 45.0) % 8
    sx, sz = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))[turn]  # towards the light
    gz, gx = np.gradient(h, cell)
    up = math.sin(math.radians(altitude))
    flat = math.cos(math.radians(altitude)) / math.hypot(sx, sz)
    light = (-gx * sx * flat - gz * sz * flat + up) / np.sqrt(1 + gx * gx + gz * gz)
    drop = math.tan(math.radians(altitude)) * cell * math.hypot(sx, sz)
    shadow = np.full(h.shape, -np.inf)
    rows = range(h.shape[0]) if sz <= 0 else range(h.shape[0] - 1, -1, -1)
    columns = range(h.shape[1]) if sx <= 0 else range(h.shape[1] - 1, -1, -1)
    # cells nearer to the light come first, so each sees the finished shadow of the one before it
    for z in rows if sz else [slice(None)]:
        for x in columns if sx else [slice(None)]:
            q, p = (z if not sz else z + sz), (x if not sx else x + sx)
            if (not sz or 0 <= q < h.shape[0]) and (not sx or 0 <= p < h.shape[1]):
                shadow[z, x] = np.maximum(shadow[q, p], h[q, p]) - drop
    return np.where(shadow > h, 0.0, np.clip(light, 0, 1))


def spectrum(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Ring numbers, mean power per ring of the detrended, windowed raster, and the slope of a log-log fit from ring 4 to a quarter of the side."""
    depth, width = h.shape
    z, x = np.mgrid[0:depth, 0:width]
    basis = np.stack([np.ones(h.size), x.ravel(), z.ravel()], axis=1)
    flat = (h.ravel() - basis @ np.linalg.lstsq(basis, h.ravel(), rcond=None)[0]).reshape(h.shape)
    power = np.abs(np.fft.fft2(flat * np.outer(np.hanning(depth), np.hanning(width)))) ** 2
    fz, fx = np.fft.fftfreq(depth) * depth, np.fft.fftfreq(width) * width
    ring = np.floor(np.hypot(*np.meshgrid(fx, fz)) + 0.5).astype(int)
    n = min(h.shape) // 2
    mean = np.bincount(ring.ravel(), power.ravel())[1:n] / np.bincount(ring.ravel())[1:n]
    k = np.arange(1, n)
    on = (k >= 4) & (k <= min(h.shape) // 4)
    return k, mean, float(np.polyfit(np.log(k[on]), np.log(mean[on]), 1)[0])


def square(mask: np.ndarray, radius: int, steps: list[int]) -> np.ndarray:
    """A mask grown (step > 0) or shrunk (step < 0) by squares of that many times the radius, in turn; what lies beyond the raster is left out."""
    from .stencils import expand, shrink

    out = mask.astype(float)
    for s in steps:
        out = (expand if s > 0 else shrink)(out, abs(s) * radius)
    return out > 0.5


def box3(values: np.ndarray, radius: int) -> np.ndarray:
    """Three box means, close to a Gaussian; windows are cut at the edge."""
    from .stencils import box_mean

    for _ in range(3):
        values = box_mean(values, radius)
    return values


def resample(values: np.ndarray, at_x: np.ndarray, at_z: np.ndarray, outside: float = 0.0, nearest: bool = False) -> np.ndarray:
    """values read at positions in their own samples, bilinearly or at the nearest; `outside` off the raster."""
    depth, width = values.shape
    if nearest:
        i, j = np.floor(at_x + 0.5).astype(int), np.floor(at_z + 0.5).astype(int)
        there = (i >= 0) & (j >= 0) & (i < width) & (j < depth)
        return np.where(there, values[np.clip(j, 0, depth - 1), np.clip(i, 0, width - 1)], outside)
    there = (at_x >= 0) & (at_z >= 0) & (at_x <= width - 1) & (at_z <= depth - 1)
    i, j = np.clip(np.floor(at_x).astype(int), 0, max(width - 2, 0)), np.clip(np.floor(at_z).astype(int), 0, max(depth - 2, 0))
    u, v = at_x - i, at_z - j
    i1, j1 = np.minimum(i + 1, width - 1), np.minimum(j + 1, depth - 1)
    top, bottom = values[j, i] * (1 - u) + values[j, i1] * u, values[j1, i] * (1 - u) + values[j1, i1] * u
    return np.where(there, top * (1 - v) + bottom * v, outside)


def wetness(area: np.ndarray, slope: np.ndarray, cell: float, lo: float = 4.0, hi: float = 14.0) -> np.ndarray:
    """Topographic wetness index, from lo to hi mapped to [0, 1]."""
    return np.clip((np.log((area / cell) / np.maximum(slope, 1e-3)) - lo) / (hi - lo), 0, 1)


def per_raster(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """Apply function(array v[z, x]) -> dict of arrays to each raster of a table (key, x, z, v); one group a raster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "x"])
        width, depth = pdf["x"].nunique(), pdf["z"].nunique()
        out = function(pdf["v"].to_numpy().reshape(depth, width))
        return pd.DataFrame({key: pdf[key].to_numpy(), "x": pdf["x"].to_numpy(), "z": pdf["z"].to_numpy(), **{k: a.ravel() for k, a in out.items()}})

    return df.groupBy(key).applyInPandas(run, schema)
