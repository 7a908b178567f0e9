"""Lattice hashing, gradient noise, cellular noise and octave sums, for either lane.

Values come with their exact gradient. Bases take coordinates in lattice units and a 32-bit seed and
return (value, gradient components).
"""

from __future__ import annotations

from .lanes import MASK32, u32_mul

# Fixed values that results depend on: multipliers of the lattice hash and its mixer.
PHI, HASH_Z, HASH_Y3 = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
MIX1, MIX2 = 0x7FEB352D, 0x846CA68B
# Lattice gradients by hash value, and scales of the two simplex sums.
DIAGONAL = 0.70710678118654752
GRADIENTS2 = ((1, 0), (-1, 0), (0, 1), (0, -1), (DIAGONAL, DIAGONAL), (-DIAGONAL, DIAGONAL), (DIAGONAL, -DIAGONAL), (-DIAGONAL, -DIAGONAL))
GRADIENTS3 = ((1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (-1, 0, -1), (0, 1, 1), (0, -1, 1), (0, 1, -1), (0, -1, -1))
SCALE2, SCALE3 = 99.0, 78.0
SKEW2, UNSKEW2 = 0.36602540378443865, 0.21132486540518712
SKEW3, UNSKEW3 = 0.33333333333333333, 0.16666666666666666


def mix(lane, x):
    x = lane.let(lane.xor(x, lane.shr(x, 16)))
    x = lane.let(u32_mul(lane, x, MIX1))
    x = lane.let(lane.xor(x, lane.shr(x, 15)))
    x = lane.let(u32_mul(lane, x, MIX2))
    return lane.let(lane.xor(x, lane.shr(x, 16)))


def lattice(lane, cells, seed: int):
    """Hash of a lattice cell (2 or 3 whole-number coordinates as reals)."""
    h = seed & MASK32
    for c, factor in zip(cells, (PHI, HASH_Z, HASH_Y3), strict=False):
        h = mix(lane, lane.xor(u32_mul(lane, lane.let(lane.cell(c)), factor), h))
    return h


def unit(lane, h, like):
    """A hash as a real in [0, 1)."""
    return lane.real(lane.shr(h, 8), like) * (1.0 / 16777216.0)


def octave_seed(seed: int, octave: int) -> int:
    return (seed + octave * PHI) & MASK32


def job_seed(seed: int, salt: int) -> int:
    return (seed ^ (salt * PHI)) & MASK32


def _pick(lane, index, values):
    """values[index] as nested choices."""
    out = values[-1]
    for k in range(len(values) - 2, -1, -1):
        out = lane.where(index == k, values[k], out)
    return lane.let(out * 1.0)


def _corner(lane, d, g):
    """Value and gradient of one corner's kernel, zero outside its radius."""
    square = sum(x * x for x in d)
    w = lane.let(lane.greatest(0.5 - square, 0.0))
    w2 = w * w
    w3, w4 = w2 * w, w2 * w2
    w3, w4, gd = lane.lets(w3, w4, sum(a * b for a, b in zip(g, d, strict=True)))
    slope = lane.let(w3 * gd * -8.0)
    return [w4 * gd, *(slope * x + w4 * y for x, y in zip(d, g, strict=True))]


def simplex2(lane, p, seed: int):
    x, z = p
    skew = lane.let((x + z) * SKEW2)
    i, j = lane.lets(lane.floor(x + skew), lane.floor(z + skew))
    back = lane.let((i + j) * UNSKEW2)
    dx, dz = lane.lets(x - (i - back), z - (j - back))
    right = dx > dz
    si, sj = lane.lets(lane.where(right, 1.0, 0.0), lane.where(right, 0.0, 1.0))
    out = None
    for di, dj, k in ((0.0, 0.0, 0), (si, sj, 1), (1.0, 1.0, 2)):
        d = lane.lets(dx - di + k * UNSKEW2, dz - dj + k * UNSKEW2)
        h = lane.let(lane.land(lattice(lane, (i + di, j + dj), seed), 7))
        g = [_pick(lane, h, [v[c] for v in GRADIENTS2]) for c in (0, 1)]
        part = lane.lets(*_corner(lane, d, g))
        out = part if out is None else lane.lets(*(a + b for a, b in zip(out, part, strict=True)))
    return lane.lets(*(x * SCALE2 for x in out))


def simplex3(lane, p, seed: int):
    x, y, z = p
    skew = lane.let((x + y + z) * SKEW3)
    cell = lane.lets(*(lane.floor(c + skew) for c in p))
    back = lane.let((cell[0] + cell[1] + cell[2]) * UNSKEW3)
    d0 = lane.lets(*(c - (i - back) for c, i in zip(p, cell, strict=True)))
    # how many of the other offsets each one precedes; of equal ones the earlier axis goes first
    a, b, c = d0
    xy, yz, xz = (lane.let(lane.where(t, 1.0, 0.0)) for t in (a >= b, b >= c, a >= c))
    rank = lane.lets(xy + xz, (1.0 - xy) + yz, (1.0 - xz) + (1.0 - yz))
    out = None
    for k in range(4):
        step = [0.0] * 3 if k == 0 else [1.0] * 3 if k == 3 else lane.lets(*(lane.where(r >= 3 - k, 1.0, 0.0) for r in rank))
        d = lane.lets(*(u - s + k * UNSKEW3 for u, s in zip(d0, step, strict=True)))
        h = lattice(lane, [i + s for i, s in zip(cell, step, strict=True)], seed)
        h = lane.let(h % 12)
        g = [_pick(lane, h, [v[n] for v in GRADIENTS3]) for n in range(3)]
        part = lane.lets(*_corner(lane, d, g))
        out = part if out is None else lane.lets(*(u + v for u, v in zip(out, part, strict=True)))
    return lane.lets(*(v * SCALE3 for v in out))


def _derived(value_and_slope):
    """A base built on simplex: (lane, n) -> (value, factor of the gradient)."""

    def base(lane, p, seed: int):
        n, *g = (simplex2 if len(p) == 2 else simplex3)(lane, p, seed)
        v, s = value_and_slope(lane, n)
        s = lane.let(s)
        return lane.lets(v, *(s * x for x in g))

    return base


def _sign(lane, n):
    return lane.let(lane.where(n < 0, -1.0, 1.0))  # right-hand at 0


def _ridged(lane, n):
    s = _sign(lane, n)
    r = lane.let(1.0 - s * n)
    return r * r, r * s * -2.0


def _billow(lane, n):
    s = _sign(lane, n)
    return s * n * 2.0 - 1.0, s * 2.0


def _flat_middle(lane, n):
    return n * n * n, n * n * 3.0


def _terraced(lane, n):
    t = lane.let((n + 1.0) * 2.0)
    whole = lane.let(lane.floor(t))
    u = lane.let(t - whole)
    return (whole + u * u * u * (u * (u * 6.0 - 15.0) + 10.0)) * 0.5 - 1.0, u * u * 30.0 * (u - 1.0) * (u - 1.0)


def _simplex(lane, p, seed: int):
    return (simplex2 if len(p) == 2 else simplex3)(lane, p, seed)


def nearest_sites(lane, p, seed: int, count: int, site, metric):
    """The `count` nearest of the 25 sites around p in a fixed order of search, ties to the first: [(distance, x, z, hash)]."""
    best = [(1e9, 0.0, 0.0, 0)] * count
    for j in range(-2, 3):
        for i in range(-2, 3):
            x, z, h = site(i, j)
            d = lane.let(metric(p[0] - x, p[1] - z))
            new = (d, x, z, h)
            closer = [d < b[0] for b in best]
            shifted = []
            for k in range(count):
                if k == 0:
                    shifted.append(tuple(lane.where(closer[0], n, o) for n, o in zip(new, best[0], strict=True)))
                else:
                    shifted.append(tuple(lane.where(closer[k - 1], before, lane.where(closer[k], n, o)) for before, n, o in zip(best[k - 1], new, best[k], strict=True)))
            flat = lane.lets(*(x for s in shifted for x in s))
            best = [tuple(flat[4 * k : 4 * k + 4]) for k in range(count)]
    return best


def _cellular(nth: int, scale: float):
    def base(lane, p, seed: int):
        ci, cj = lane.lets(lane.floor(p[0]), lane.floor(p[1]))

        def site(i, j):
            a, b = lane.lets(ci + float(i), cj + float(j))
            h = lattice(lane, (a, b), seed)
            x, z = lane.lets(a + unit(lane, h, p[0]), b + unit(lane, mix(lane, lane.xor(h, PHI)), p[0]))
            return x, z, h

        best = nearest_sites(lane, p, seed, nth, site, lambda dx, dz: lane.sqrt(dx * dx + dz * dz))
        near, far = best[0], best[-1]
        f = lane.let(far[0] - near[0])
        slope = [(q - far[k + 1]) / lane.greatest(far[0], 1e-6) - (q - near[k + 1]) / lane.greatest(near[0], 1e-6) for k, q in enumerate(p)]
        return lane.lets(1.0 - f * scale, *(g * -scale for g in slope))

    return base


BASES = {
    "simplex": _simplex, "ridged": _derived(_ridged), "billow": _derived(_billow), "cellular": _cellular(2, 2.0), "cellular3": _cellular(3, 1.4),
    "flat_middle": _derived(_flat_middle), "terraced": _derived(_terraced),
}


def fbm(lane, p, *, kind="simplex", frequency=0.002, octaves=6, lacunarity=2.0, persistence=0.5, amplitude=1.0, offset=0.0, seed=0, normalize=True, multiscale="none", power=0.5):
    """Octave sum: (value, gradient components)."""
    base, total, a, f, norm = BASES[kind], None, 1.0, frequency, 0.0
    weight = (1.0, *(0.0 for _ in p))
    for o in range(octaves):
        n = base(lane, lane.lets(*(c * f for c in p)), octave_seed(seed, o))
        if multiscale == "none":
            part = [n[0] * a, *(g * (a * f) for g in n[1:])]
        else:
            n = lane.lets(n[0], *(g * f for g in n[1:]))
            if multiscale == "elevation" and o:
                e = lane.let(0.5 + 0.5 * total[0] / norm)
                inside = lane.both(e > 0.0, e < 1.0)
                weight = lane.lets(1.0 - power + power * lane.least(lane.greatest(e, 0.0), 1.0), *(lane.where(inside, g * (0.5 * power / norm), 0.0) for g in total[1:]))
            part = [n[0] * weight[0] * a, *((g * weight[0] + w * n[0]) * a for g, w in zip(n[1:], weight[1:], strict=True))]
        total = lane.lets(*part) if total is None else lane.lets(*(t + x for t, x in zip(total, part, strict=True)))
        if multiscale == "signal":
            s = lane.let(0.5 + 0.5 * n[0])
            inside = lane.both(s > 0.0, s < 1.0)
            m = lane.let(1.0 - power + power * lane.least(lane.greatest(s, 0.0), 1.0))
            weight = lane.lets(weight[0] * m, *(w * m + lane.where(inside, g * (0.5 * power), 0.0) * weight[0] for w, g in zip(weight[1:], n[1:], strict=True)))
        norm += a
        a *= persistence
        f *= lacunarity
    scale = amplitude / norm if normalize else amplitude
    return lane.lets(total[0] * scale + offset, *(g * scale for g in total[1:]))


METRICS = ("euclidean", "manhattan", "chebyshev", "octagonal")
STYLES = ("F1", "F2", "F3", "F4", "F2-F1", "F3-F2", "F3-F1", "F4-F3", "F4-F2", "F4-F1", "cell")
_DIFFERENCES = {"F2-F1": (1, 0), "F3-F2": (2, 1), "F3-F1": (2, 0), "F4-F3": (3, 2), "F4-F2": (3, 1), "F4-F1": (3, 0)}


def cells(lane, p, *, frequency=0.002, style="F1", metric="euclidean", hexagonal=False, jitter=1.0, amplitude=1.0, offset=0.0, seed=0):
    """Distances to the nearest of jittered sites: (value, site x, site z, random of the cell)."""
    q = lane.lets(*(c * frequency for c in p))
    step = 0.8660254 if hexagonal else 1.0
    ci, cj = lane.lets(lane.floor(q[0]), lane.floor(q[1] / step))

    def site(i, j):
        a, b = lane.lets(ci + float(i), cj + float(j))
        h = lattice(lane, (a, b), seed)
        rx, rz = lane.lets(unit(lane, h, q[0]) - 0.5, unit(lane, mix(lane, lane.xor(h, PHI)), q[0]) - 0.5)
        shift = lane.where(lane.land(lane.cell(b), 1) != 0, 0.5, 0.0) if hexagonal else 0.0
        x, z = lane.lets(a + 0.5 + shift + rx * jitter, (b + 0.5 + rz * jitter) * step)
        return x, z, h

    def measure(dx, dz):
        ax, az = lane.lets(lane.abs(dx), lane.abs(dz))
        if metric == "manhattan":
            return ax + az
        if metric == "chebyshev":
            return lane.greatest(ax, az)
        if metric == "octagonal":
            return lane.greatest(ax, az) + lane.least(ax, az) * 0.41421356
        return lane.sqrt(ax * ax + az * az)

    best = nearest_sites(lane, q, seed, 4, site, measure)
    cell = unit(lane, mix(lane, lane.xor(best[0][3], HASH_Z)), q[0])
    value = cell if style == "cell" else best[STYLES.index(style)][0] if style[2:] == "" else best[_DIFFERENCES[style][0]][0] - best[_DIFFERENCES[style][1]][0]
    return lane.lets(value * amplitude + offset, best[0][1] / frequency, best[0][2] / frequency, cell)


def gullies(lane, p, gradient, *, cell=450.0, octaves=5, gain=0.5, lacunarity=2.0, full=0.5, seed=0):
    """Stripes that run down the slope, each octave bent by the one before: (sum of stripes, drainage mask), both fading on flat ground."""
    gx, gz = gradient
    dx, dz = gz, -gx
    amplitude, frequency, total, bx, bz, drain = 0.5, 1.0, 0.0, 0.0, 0.0, 0.0
    for o in range(octaves):
        q = [c / cell * frequency for c in p]
        ci, cj = (lane.floor(c) for c in q)
        ux, uz = dx + bz, dz - bx
        value = sx = sz = weights = 0.0
        for i in range(-2, 2):
            for j in range(-2, 2):
                h = lattice(lane, (ci - i, cj - j), octave_seed(seed, o))
                jx, jz = unit(lane, h, q[0]), unit(lane, mix(lane, lane.xor(h, PHI)), q[0])
                ox, oz = q[0] - ci + i - jx * 0.5, q[1] - cj + j - jz * 0.5
                w = lane.exp((ox * ox + oz * oz) * -2.0)
                phase = (ox * ux + oz * uz) * 6.28318530718
                value, weights = value + lane.cos(phase) * w, weights + w
                wave = lane.sin(phase) * w
                sx, sz = sx - wave * ux, sz - wave * uz
        value = value / weights
        total = total + value * amplitude
        bx, bz = bx + sx / weights * (amplitude * frequency), bz + sz / weights * (amplitude * frequency)
        t = lane.least(lane.greatest((-value - 0.6) / (0.9 - 0.6), 0.0), 1.0)
        drain = lane.greatest(drain, t * t * (3.0 - 2.0 * t) * (amplitude * 2.0))
        amplitude *= gain
        frequency *= lacunarity
    steep = lane.least(lane.greatest(lane.sqrt(gx * gx + gz * gz) / full, 0.0), 1.0)
    return total * steep, drain * steep
