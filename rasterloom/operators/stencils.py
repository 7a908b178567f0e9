"""Neighbourhood and iterative operators on the array of one padded block.

Arrays are (z, x) or (y, z, x). Taps beyond the array are skipped; as blocks are padded by the reach
of the whole chain, what that touches is cut away, and a sample's value never depends on the block
it is computed in: sums run over taps in a fixed order, not over running totals.
"""

from __future__ import annotations

import numpy as np


def shifted(a: np.ndarray, offset: tuple[int, ...], fill) -> np.ndarray:
    """a read at index + offset; fill where that lies outside."""
    out = np.full_like(a, fill)
    to, source = [], []
    for o, n in zip(offset, a.shape, strict=True):
        if abs(o) >= n:
            return out
        to.append(slice(max(0, -o), n - max(0, o)))
        source.append(slice(max(0, o), n - max(0, -o)))
    out[tuple(to)] = a[tuple(source)]
    return out


def _along(axis: int, ndim: int, o: int) -> tuple[int, ...]:
    return tuple(o if k == axis else 0 for k in range(ndim))


def box_mean(a: np.ndarray, radius: int) -> np.ndarray:
    total, count = a, np.ones_like(a)
    for axis in range(a.ndim):
        taps = [_along(axis, a.ndim, o) for o in range(-radius, radius + 1)]
        total, count = (sum(shifted(x, t, 0) for t in taps) for x in (total, count))
    return total / count


def inside(shape: str, i: int, j: int, reach):
    """Whether the tap at (i, j) is in a window of this reach, a number or an array; under a map a reach is not whole."""
    i, j = abs(i), abs(j)
    return {
        "square": lambda: max(i, j) <= reach,
        "diamond": lambda: i + j <= reach,
        "octagon": lambda: (max(i, j) <= reach) & (i + j <= reach + reach // 2),
        "disk": lambda: i * i + j * j <= reach * (reach + 1),
    }[shape]()


def offsets(shape: str, radius: int) -> list[tuple[int, int]]:
    """(dz, dx) of a window, in fixed order."""
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if inside(shape, i, j, radius)]


def penalty(falloff: str, slope: float, spacing: float, radius: int, distance: float) -> float:
    """How far a tap at this distance (in samples) is lowered."""
    if falloff == "cone":
        return slope * spacing * distance
    if falloff == "round":  # a paraboloid whose slope at the rim is `slope`
        return slope * spacing * distance * distance / (2 * radius)
    return 0.0


def expand(a: np.ndarray, radius: int, shape="square", falloff="flat", slope=1.0, spacing=1.0, reach: np.ndarray | None = None) -> np.ndarray:
    """Greatest value in the window; reach: a map in [0, 1] of how much of the radius each sample uses."""
    limit = None if reach is None else radius * np.clip(reach, 0, 1)
    if shape == "square" and falloff == "flat" and limit is None:
        for axis in range(a.ndim):
            a = np.maximum.reduce([shifted(a, _along(axis, a.ndim, o), -np.inf) for o in range(-radius, radius + 1)])
        return a
    out = a.copy()
    for i, j in offsets(shape, radius):
        tap = shifted(a, (i, j), -np.inf) - a.dtype.type(penalty(falloff, slope, spacing, radius, float(np.hypot(i, j))))
        on = True if limit is None else inside(shape, i, j, limit)
        out = np.where(on, np.maximum(out, tap), out)
    return out


def shrink(a: np.ndarray, *args, **named) -> np.ndarray:
    return -expand(-a, *args, **named)


def median(a: np.ndarray, radius: int) -> np.ndarray:
    """The element at half the number of taps found, in order."""
    taps = np.stack([shifted(a, t, np.nan) for t in offsets("square", radius)])
    count = np.sum(~np.isnan(taps), axis=0)
    return np.take_along_axis(np.sort(taps, axis=0), (count // 2)[None], axis=0)[0]


def gradient(a: np.ndarray, spacing: float) -> list[np.ndarray]:
    """Central differences along x, (y,) z."""
    out = []
    for axis in (a.ndim - 1, *range(a.ndim - 1)):
        up, down = (shifted(a, _along(axis, a.ndim, o), np.nan) for o in (1, -1))
        both = (up - down) / a.dtype.type(2 * spacing)
        out.append(np.where(np.isnan(both), np.where(np.isnan(up), a - down, up - a) / a.dtype.type(spacing), both))
    return out


def displace(a: np.ndarray, by: list[np.ndarray], radius: int, spacing: float) -> np.ndarray:
    """a read bilinearly at each sample plus an offset in metres, at most radius samples long."""
    dx, dz = (b / a.dtype.type(spacing) for b in by)
    size = np.sqrt(dx * dx + dz * dz)
    scale = np.where(size > radius, radius / np.maximum(size, 1e-20), 1).astype(a.dtype)
    nz, nx = a.shape
    x, z = np.arange(nx)[None, :] + dx * scale, np.arange(nz)[:, None] + dz * scale
    i, j = np.floor(x).astype(int), np.floor(z).astype(int)
    # fractions from the offset alone, so that they do not depend on where the block begins
    ox, oz = dx * scale, dz * scale
    u, v = ox - np.floor(ox), oz - np.floor(oz)
    at = lambda p, q: a[np.clip(q, 0, nz - 1), np.clip(p, 0, nx - 1)]
    top, bottom = at(i, j) * (1 - u) + at(i + 1, j) * u, at(i, j + 1) * (1 - u) + at(i + 1, j + 1) * u
    return (top * (1 - v) + bottom * v).astype(a.dtype)


def _steps(ndim: int) -> list[tuple[int, ...]]:
    axes = (ndim - 1, *range(ndim - 1))
    return [_along(axis, ndim, o) for axis in axes for o in (1, -1)]


def thermal(h: np.ndarray, iterations=16, talus=0.7, strength=0.25, mass_balance=0.5, two_phase=False, rock=1.0, spacing=1.0, strength_map: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Material above the talus slope slides to axis neighbours; returns the height and what lies loose (two-phase)."""
    t = h.dtype.type
    hold, crack, give, take, steps = t(talus * spacing), t(rock * spacing), t(2 * (1 - mass_balance)), t(2 * mass_balance), _steps(h.ndim)
    k = t(len(steps))
    mine = np.full_like(h, strength) if strength_map is None else (np.clip(strength_map, 0, 1) * t(strength)).astype(h.dtype)
    loose = np.zeros_like(h)
    for _ in range(iterations):
        given, received, broken = np.zeros_like(h), np.zeros_like(h), np.zeros_like(h)
        top = h + loose
        for o in steps:
            down = top - shifted(top, o, np.nan)
            there = ~np.isnan(down)
            down = np.where(there, down, 0)
            out, back = np.maximum(down - hold, 0), np.maximum(-down - hold, 0)
            theirs = shifted(mine, o, 0)
            if two_phase:
                given += np.where(there, np.minimum(mine * out, loose / k), 0)
                received += np.where(there, np.minimum(theirs * back, shifted(loose, o, 0) / k), 0)
                broken += np.where(there, np.maximum(down - loose - crack, 0), 0)
            elif strength_map is None:
                given += np.where(there, out, 0)
                received += np.where(there, back, 0)
            else:
                given += np.where(there, mine * out, 0)
                received += np.where(there, theirs * back, 0)
        if two_phase:
            broken *= mine / k
            h = h - broken * min(give, t(1))
            loose = np.maximum(loose + received - given + broken * min(take, t(1)), 0)
        else:
            h = h + (t(strength) if strength_map is None else t(1)) * (take * received - give * given) / k
    return h + loose, loose


def hydraulic(h: np.ndarray, iterations=32, rain=0.02, evaporation=0.05, capacity=4.0, erosion_rate=0.3, deposition=0.3, flow_rate=0.15, spacing=1.0, hardness: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rain runs to lower x and z neighbours, carries sediment, cuts and drops it: height, water, sediment."""
    t = h.dtype.type
    steps = [o for o in _steps(h.ndim) if h.ndim == 2 or o[0] == 0]
    water, sediment = np.zeros_like(h), np.zeros_like(h)
    soft = t(1) if hardness is None else (1 - np.clip(hardness, 0, 1)).astype(h.dtype)
    tiny = t(1e-6)
    for _ in range(iterations):
        water = water + t(rain)
        level = h + water
        out, into, lost, won, steep, lowest = (np.zeros_like(h) for _ in range(6))
        lowest = h.copy()
        load = sediment / np.maximum(water, tiny)
        for o in steps:
            n_level, n_h, n_water, n_load = (shifted(x, o, np.nan) for x in (level, h, water, load))
            there = ~np.isnan(n_level)
            down = np.where(there, level - n_level, 0)
            lowest = np.where(there, np.minimum(lowest, n_h), lowest)
            moved = np.where(down > 0, t(flow_rate) * np.minimum(water, down), 0)
            out += moved
            lost += moved * load
            steep = np.where(down > 0, np.maximum(steep, (h - n_h) / t(spacing)), steep)
            moved = np.where(down < 0, t(flow_rate) * np.minimum(n_water, -down), 0)
            into += np.where(down < 0, moved, 0)
            won += np.where(down < 0, moved * n_load, 0)
        water = water - out + into
        sediment = sediment - lost + won
        holds = t(capacity) * np.maximum(out, into) * steep
        cut = np.minimum(soft * t(erosion_rate) * (holds - sediment), t(0.5) * np.maximum(h - lowest, 0))
        change = np.where(sediment < holds, -cut, t(deposition) * (sediment - holds))
        h = h + change
        sediment = sediment - change
        water = water * t(1 - evaporation)
    return h, water, sediment
