"""Pointwise formulas for either lane: arithmetic, curves, blends, shapes, placements."""

from __future__ import annotations

import math


def clamp(lane, v, lo, hi):
    return lane.least(lane.greatest(v, lo), hi)


def mix(a, b, t):
    return a * (1.0 - t) + b * t


def smoothstep(lane, v, lo, hi):
    """Hermite step; a plain step where the edges meet."""
    if lo == hi:
        return lane.where(v < lo, 0.0, 1.0)
    t = lane.let(clamp(lane, (v - lo) / (hi - lo), 0.0, 1.0))
    return t * t * (3.0 - 2.0 * t)


def smooth_min(lane, a, b, k):
    h = lane.let(clamp(lane, 0.5 + 0.5 * (b - a) / k, 0.0, 1.0))
    return mix(b, a, h) - h * (1.0 - h) * k


def smooth_max(lane, a, b, k):
    return -smooth_min(lane, -a, -b, k)


def remap(v, lo, hi):
    return (v * 0.5 + 0.5) * (hi - lo) + lo


def signed_power(lane, v, e):
    size = lane.power(lane.abs(v), max(e, 1e-4))
    return lane.where(v < 0, -size, size)


def rise(lane, distance, width):
    return clamp(lane, -distance / width, 0.0, 1.0)


def profile(lane, d, kind, a, b=0.0):
    """A signed distance as a weight: linear, smooth, dome (width a), gaussian (sigma a), plateau (edge a, falloff b)."""
    if kind == "linear":
        return rise(lane, d, a)
    if kind == "smooth":
        u = lane.let(rise(lane, d, a))
        return u * u * (3.0 - 2.0 * u)
    if kind == "dome":
        w = lane.let(1.0 - rise(lane, d, a))
        return lane.sqrt(lane.greatest(1.0 - w * w, 0.0))
    if kind == "gaussian":
        t = lane.let(lane.greatest(d, 0.0) / a)
        return lane.exp(t * t * -0.5)
    return 1.0 - smoothstep(lane, d, -a, b)


def terrace(lane, v, step, sharpness):
    whole = lane.let(lane.floor(v / step))
    f = lane.let(v / step - whole)
    s = 1.0 - sharpness
    riser = lane.where(f >= 0.5, 1.0, 0.0) if s < 1e-4 else smoothstep(lane, f, 0.5 - 0.5 * s, 0.5 + 0.5 * s)
    return (whole + riser) * step


def blend(lane, a, b, mask):
    return mix(a, b, lane.let(clamp(lane, mask, 0.0, 1.0)))


def length(lane, *xs):
    return lane.sqrt(sum(x * x for x in xs))


def place(x, z, at=(0.0, 0.0), rotation=0.0, scale=1.0, pivot=(0.0, 0.0)):
    """World position in the frame of a shape that is turned by `rotation` degrees, scaled and moved."""
    c, s = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    dx, dz = x - (at[0] + pivot[0]), z - (at[1] + pivot[1])
    return (dx * c + dz * s) / scale + pivot[0], (dz * c - dx * s) / scale + pivot[1]


def circle(lane, x, z, radius):
    return length(lane, x, z) - radius


def ellipse(lane, x, z, rx, rz):
    """The usual first-order bound, exact on the axes."""
    k0, k1 = lane.lets(length(lane, x / rx, z / rz), length(lane, x / (rx * rx), z / (rz * rz)))
    return lane.where(k1 > 0, lane.divide(k0 * (k0 - 1.0), k1), -min(rx, rz))


def box(lane, x, z, hx, hz, rounding=0.0):
    qx, qz = lane.lets(lane.abs(x) - (hx - rounding), lane.abs(z) - (hz - rounding))
    outside = length(lane, lane.greatest(qx, 0.0), lane.greatest(qz, 0.0))
    return outside + lane.least(lane.greatest(qx, qz), 0.0) - rounding


def box_chebyshev(lane, x, z, hx, hz):
    return lane.greatest(lane.abs(x) - hx, lane.abs(z) - hz)


def segments(lane, x, z, points, closed=True):
    """Distance to a polygon (negative inside, by the even-odd rule, half-open in z) or to a polyline."""
    pairs = list(zip(points, points[1:] + points[:1] if closed else points[1:], strict=False))
    nearest, crossings = None, None
    for (ax, az), (bx, bz) in pairs:
        ux, uz = bx - ax, bz - az
        square = ux * ux + uz * uz
        t = clamp(lane, ((x - ax) * ux + (z - az) * uz) / square, 0.0, 1.0) if square > 0 else 0.0 * x
        t = lane.let(t)
        d = lane.let(length(lane, x - ax - t * ux, z - az - t * uz))
        nearest = d if nearest is None else lane.let(lane.least(nearest, d))
        if closed and az != bz:
            between = lane.both(z >= min(az, bz), z < max(az, bz))
            hit = lane.let(lane.where(lane.both(between, x < ax + (z - az) * (ux / uz)), 1.0, 0.0))
            crossings = hit if crossings is None else lane.let(crossings + hit)
    if not closed:
        return nearest
    odd = crossings - 2.0 * lane.floor(crossings * 0.5) > 0.5
    return lane.where(odd, -nearest, nearest)


def catmull_rom(a, b, c, d, t):
    return b + t * 0.5 * (c - a + t * (2.0 * a - 5.0 * b + 4.0 * c - d + t * (3.0 * (b - c) + d - a)))
