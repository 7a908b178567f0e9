"""Fields: lazy, typed handles on a plan of operations over continuous 2-D or 3-D positions.

A Field names one channel of a node; nodes are immutable and equal by value, so the same
sub-expression built twice is one node and is evaluated once. Building checks arguments and
mappings; nothing is computed until a field is exported (plans.blocks) or turned into columns
(plans.rows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from .errors import PlanError, checked
from .functions.noise import BASES, METRICS, STYLES

NUMBER = (int, float)


@dataclass(frozen=True)
class Node:
    kind: str
    params: tuple
    inputs: tuple[Field, ...]
    domain: int
    sizes: tuple[int, ...]  # components of each channel
    names: tuple[str, ...]  # of the channels
    radius: int = 0

    def __hash__(self):
        found = self.__dict__.get("_hash")
        if found is None:
            found = hash((self.kind, self.params, self.inputs, self.domain))
            object.__setattr__(self, "_hash", found)
        return found

    @property
    def p(self) -> dict:
        return dict(self.params)


@dataclass(frozen=True)
class Field:
    node: Node
    channel: int = 0

    @property
    def domain(self) -> int:
        return self.node.domain

    @property
    def size(self) -> int:
        return self.node.sizes[self.channel]

    def __repr__(self):
        return f"Field({self.node.kind}.{self.node.names[self.channel]}: R{self.domain}->R{self.size})"

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        node = object.__getattribute__(self, "node")
        if name in node.names:
            return Field(node, node.names.index(name))
        axes = {2: "xz", 3: "xyz"}.get(self.size, "xyzw")
        if name in axes and self.size > 1:
            return make("component", {"index": axes.index(name)}, (self,), self.domain)
        raise PlanError("mapping", f"{self!r} has no channel or component {name}; channels: {', '.join(node.names)}")

    def _with(self, op, other, swap=False):
        other = lift(other, self.domain)
        return arith(op, other, self) if swap else arith(op, self, other)

    def __add__(self, o): return self._with("add", o)  # noqa: E704
    def __radd__(self, o): return self._with("add", o, True)  # noqa: E704
    def __sub__(self, o): return self._with("sub", o)  # noqa: E704
    def __rsub__(self, o): return self._with("sub", o, True)  # noqa: E704
    def __mul__(self, o): return self._with("mul", o)  # noqa: E704
    def __rmul__(self, o): return self._with("mul", o, True)  # noqa: E704
    def __truediv__(self, o): return self._with("div", o)  # noqa: E704
    def __rtruediv__(self, o): return self._with("div", o, True)  # noqa: E704
    def __neg__(self): return self._with("sub", 0, True)  # noqa: E704


def make(kind, params, inputs, domain, sizes=(1,), names=("value",), radius=0) -> Field:
    return Field(Node(kind, tuple(sorted(params.items())), tuple(inputs), domain, tuple(sizes), tuple(names), radius))


def lift(value, domain: int) -> Field:
    """A number as a constant field of the other operand's domain."""
    if isinstance(value, Field):
        return value
    if isinstance(value, NUMBER) and not isinstance(value, bool):
        return make("const", {"value": float(value)}, (), domain)
    raise PlanError("argument", f"a field or a number is needed, not {type(value).__name__}")


def arith(op, a: Field, b: Field, **params) -> Field:
    if a.domain != b.domain:
        raise PlanError("mapping", f"operands have different domains: {a!r} and {b!r}")
    if a.size != b.size and 1 not in (a.size, b.size):
        raise PlanError("mapping", f"operands have {a.size} and {b.size} components")
    return make("arith", {"op": op, **params}, (a, b), a.domain, (max(a.size, b.size),))


def scalar(f, name: str, domain: int | None = None) -> Field:
    if not isinstance(f, Field) or f.size != 1 or domain and f.domain != domain:
        raise PlanError("mapping", f"{name} takes a field of one component{f' over R{domain}' if domain else ''}, not {f!r}")
    return f


def _position(given, name):
    if given is None:
        return Terrain.Coords()
    if not isinstance(given, Field) or given.domain != 2 or given.size != 2:
        raise PlanError("mapping", f"{name}: position is a field R2->R2, not {given!r}")
    return given


def _slope(f) -> Field:
    """The gradient that belongs to a value, or a gradient itself."""
    if isinstance(f, Field) and "gradient" in f.node.names and f.size == 1:
        f = f.gradient
    if not isinstance(f, Field) or f.domain != 2 or f.size != 2:
        raise PlanError("mapping", f"a gradient R2->R2 is needed, not {f!r}")
    return f


class Terrain:
    @staticmethod
    def Coords(**k):
        d = checked("Terrain.Coords", k, {"domain": (2, int, 2, 3)})["domain"]
        return make("coords", {}, (), d, (d,))

    @staticmethod
    def Const(**k):
        k = checked("Terrain.Const", k, {"value": (0.0, NUMBER, None, None), "domain": (2, int, 2, 3)})
        return lift(k["value"], k["domain"])

    @staticmethod
    def Column(name: str, domain: int = 2):
        """A numeric column of the table that a plan is evaluated over."""
        return make("column", {"name": name}, (), domain)

    @staticmethod
    def Gradient(**k):
        f = scalar(checked("Terrain.Gradient", k, {"input": (..., Field, None, None)})["input"], "Terrain.Gradient")
        return make("gradient", {}, (f,), f.domain, (f.domain,), ("gradient",), 1)

    @staticmethod
    def Normals(**k):
        k = checked("Terrain.Normals", k, {"input": (..., Field, None, None), "vertical_scale": (1.0, NUMBER, None, None)})
        return make("normals", {"scale": k["vertical_scale"] or 1.0}, (_slope(k["input"]),), 2, (3,))

    @staticmethod
    def Transform(**k):
        k = checked("Terrain.Transform", k, {"position": (None, Field, None, None), "at": ((0.0, 0.0), tuple, None, None), "rotation": (0.0, NUMBER, None, None), "scale": (1.0, NUMBER, None, None), "pivot": ((0.0, 0.0), tuple, None, None)})
        if k["scale"] == 0:
            raise PlanError("argument", "Terrain.Transform: scale is 0")
        p = _position(k.pop("position"), "Terrain.Transform")
        return make("transform", k, (p,), 2, (2,))

    @staticmethod
    def Grid(**k):
        """A table of constants (x fastest) read by Catmull-Rom."""
        k = checked("Terrain.Grid", k, {"values": (..., (list, tuple), None, None), "size": (..., tuple, None, None), "origin": ((0.0, 0.0), tuple, None, None), "cell": (1.0, NUMBER, 1e-9, None), "wrap": (False, bool, None, None), "position": (None, Field, None, None)})
        if len(k["values"]) != k["size"][0] * k["size"][1]:
            raise PlanError("argument", f"Terrain.Grid: {len(k['values'])} values for {k['size'][0]} x {k['size'][1]}")
        p = _position(k.pop("position"), "Terrain.Grid")
        return make("grid", {**k, "values": tuple(map(float, k["values"]))}, (p,), 2)


    @staticmethod
    def Sample(field, x, z, spacing=1.0, seed=0):
        """The field at points, as an array; neighbourhoods are read through (plans.sample)."""
        from .plans.sample import sample

        return sample(field, x, z, spacing, seed)

    @staticmethod
    def Mimic(input, reference, region, cell=32.0, radius=8, elevation=1.0, roughness=1.0, seed=0):
        """The input with the mean, spread and roughness of a reference, both measured on a grid over region (x0, z0, x1, z1)."""
        from .plans.sample import sample_grid

        x0, z0, x1, z1 = region
        size = (int((x1 - x0) // cell) + 1, int((z1 - z0) // cell) + 1)

        def measured(f):
            h = sample_grid(f, (x0, z0), size, cell, seed)
            bend = h[1:-1, 1:-1] - (h[:-2, 1:-1] + h[2:, 1:-1] + h[1:-1, :-2] + h[1:-1, 2:]) / 4
            return float(h.mean()), float(h.std()), float((bend**2).mean() ** 0.5) if bend.size else 0.0

        (mean, spread, rough), (mean2, spread2, rough2) = measured(input), measured(reference)
        gain = 1 + ((spread2 / spread if spread > 0 else 1) - 1) * elevation
        out = (input - mean) * gain + (mean + (mean2 - mean) * elevation)
        if roughness > 0 and rough > 0 and gain:
            low, high = Filters.FrequencySplit(out, radius)
            out = low + high * (1 + (rough2 / (rough * gain) - 1) * roughness)
        return out


class Noises:
    @staticmethod
    def fBm(**k):
        k = checked("Noises.fBm", k, {
            "domain": (2, int, 2, 3), "kind": ("simplex", tuple(BASES), None, None), "frequency": (0.002, NUMBER, None, None), "octaves": (6, int, 1, 32), "lacunarity": (2.0, NUMBER, None, None),
            "persistence": (0.5, NUMBER, None, None), "amplitude": (1.0, NUMBER, None, None), "offset": (0.0, NUMBER, None, None), "seed": (0, int, None, None), "normalize": (True, bool, None, None),
            "position": (None, Field, None, None), "multiscale": ("none", ("none", "signal", "elevation"), None, None), "power": (0.5, NUMBER, 0, 1),
        })
        p = k.pop("position")
        d = p.domain if p else k["domain"]
        k.pop("domain")
        if k["kind"].startswith("cellular") and d == 3:
            raise PlanError("argument", "Noises.fBm: cellular noise is over R2 only")
        if p and p.size != d:
            raise PlanError("mapping", f"Noises.fBm: position is {p!r}")
        return make("noise", k, (p or Terrain.Coords(domain=d),), d, (1, d), ("value", "gradient"))

    Ridged = staticmethod(lambda **k: Noises.fBm(kind="ridged", **k))
    Billow = staticmethod(lambda **k: Noises.fBm(kind="billow", **k))
    Cellular = staticmethod(lambda order=2, **k: Noises.fBm(kind="cellular" if order == 2 else "cellular3", **k))

    @staticmethod
    def Cells(**k):
        k = checked("Noises.Cells", k, {
            "frequency": (0.002, NUMBER, None, None), "style": ("F1", STYLES, None, None), "metric": ("euclidean", METRICS, None, None), "lattice": ("square", ("square", "hex"), None, None),
            "jitter": (1.0, NUMBER, 0, 1), "amplitude": (1.0, NUMBER, None, None), "offset": (0.0, NUMBER, None, None), "seed": (0, int, None, None), "position": (None, Field, None, None),
        })
        p = _position(k.pop("position"), "Noises.Cells")
        hexagonal = k.pop("lattice") == "hex"
        return make("cells", {**k, "hexagonal": hexagonal}, (p,), 2, (1, 3), ("value", "cell"))


class Combine:
    @staticmethod
    def _two(name, given, **more):
        return checked(f"Combine.{name}", given, {"a": (..., (Field, *NUMBER), None, None), "b": (..., (Field, *NUMBER), None, None), **more})

    @staticmethod
    def _pair(a, b):
        d = a.domain if isinstance(a, Field) else b.domain if isinstance(b, Field) else 2
        return lift(a, d), lift(b, d)

    @staticmethod
    def Min(**k):
        k = Combine._two("Min", k)
        return arith("min", *Combine._pair(k["a"], k["b"]))

    @staticmethod
    def Max(**k):
        k = Combine._two("Max", k)
        return arith("max", *Combine._pair(k["a"], k["b"]))

    @staticmethod
    def SmoothMin(**k):
        k = Combine._two("SmoothMin", k, k=(1.0, NUMBER, 1e-9, None))
        return arith("smooth_min", *Combine._pair(k["a"], k["b"]), k=float(k["k"]))

    @staticmethod
    def SmoothMax(**k):
        k = Combine._two("SmoothMax", k, k=(1.0, NUMBER, 1e-9, None))
        return arith("smooth_max", *Combine._pair(k["a"], k["b"]), k=float(k["k"]))

    @staticmethod
    def Atan2(**k):
        k = checked("Combine.Atan2", k, {"y": (..., (Field, *NUMBER), None, None), "x": (..., (Field, *NUMBER), None, None)})
        return arith("atan2", *Combine._pair(k["y"], k["x"]))

    @staticmethod
    def Blend(**k):
        k = Combine._two("Blend", k, mask=(..., Field, None, None))
        a, b = Combine._pair(k["a"], k["b"])
        m = scalar(k["mask"], "Combine.Blend", a.domain)
        return make("blend", {}, (a, b, m), a.domain, (max(a.size, b.size),))

    @staticmethod
    def HeightMatch(**k):
        """The mask moved towards the higher of two fields where it is undecided."""
        k = Combine._two("HeightMatch", k, mask=(..., Field, None, None), strength=(1.0, NUMBER, 1e-9, None))
        m = k["mask"]
        return Curves.Clamp(input=m + m * (1 - m) * 4 * (k["b"] - k["a"]) / k["strength"])


class Curves:
    @staticmethod
    def _of(kind, name, k, accepted, check=None):
        k = checked(f"Curves.{name}", k, {"input": (..., Field, None, None), **accepted})
        f = k.pop("input")
        if check and (wrong := check(k)):
            raise PlanError("argument", f"Curves.{name}: {wrong}")
        return make("curve", {"op": kind, **k}, (f,), f.domain, (f.size,))

    @staticmethod
    def Clamp(**k):
        return Curves._of("clamp", "Clamp", k, {"min": (0.0, NUMBER, None, None), "max": (1.0, NUMBER, None, None)}, lambda k: k["min"] > k["max"] and "min is over max")

    @staticmethod
    def Remap(**k):
        return Curves._of("remap", "Remap", k, {"min": (0.0, NUMBER, None, None), "max": (1.0, NUMBER, None, None)}, lambda k: k["min"] == k["max"] and "min is max")

    @staticmethod
    def Power(**k):
        return Curves._of("power", "Power", k, {"exponent": (1.0, NUMBER, 0, 64)})

    @staticmethod
    def Smoothstep(**k):
        return Curves._of("smoothstep", "Smoothstep", k, {"min": (0.0, NUMBER, None, None), "max": (1.0, NUMBER, None, None)}, lambda k: k["min"] >= k["max"] and "min is not below max")

    @staticmethod
    def Profile(**k):
        kinds = {"linear": ("width",), "smooth": ("width",), "dome": ("width",), "gaussian": ("sigma",), "plateau": ("edge", "falloff")}
        kind = k.pop("kind", "smooth")
        if kind not in kinds:
            raise PlanError("argument", f"Curves.Profile: kind is one of {', '.join(kinds)}")
        keys = {x: (0.0 if x == "edge" else ..., NUMBER, 0, None) for x in kinds[kind]}
        given = checked("Curves.Profile", k, {"input": (..., Field, None, None), **keys})
        a, b = (given[kinds[kind][0]], given.get("falloff", 0.0))
        if a + b <= 0:
            raise PlanError("argument", "Curves.Profile: its width is 0")
        return make("curve", {"op": "profile", "profile": kind, "a": float(a), "b": float(b)}, (given["input"],), given["input"].domain)

    @staticmethod
    def Terrace(**k):
        return Curves._of("terrace", "Terrace", k, {"step": (10.0, NUMBER, 1e-9, None), "sharpness": (0.5, NUMBER, 0, 1)})

    @staticmethod
    def SoftClamp(**k):
        k = checked("Curves.SoftClamp", k, {"input": (..., Field, None, None), "min": (0.0, NUMBER, None, None), "max": (1.0, NUMBER, None, None), "k": (0.1, NUMBER, 1e-9, None)})
        return Combine.SmoothMin(a=Combine.SmoothMax(a=k["input"], b=k["min"], k=k["k"]), b=k["max"], k=k["k"])

    @staticmethod
    def Ramp(**k):
        """Sawtooth or triangle in [0, 1]."""
        k = checked("Curves.Ramp", k, {"input": (..., Field, None, None), "period": (100.0, NUMBER, 1e-9, None), "mode": ("sawtooth", ("sawtooth", "triangle"), None, None), "offset": (0.0, NUMBER, None, None)})
        t = (k["input"] + k["offset"]) / k["period"]
        saw = t - make("curve", {"op": "floor"}, (t,), t.domain)
        return saw if k["mode"] == "sawtooth" else 1 - make("curve", {"op": "abs"}, (saw * 2 - 1,), t.domain)


    TABLE = 256

    @staticmethod
    def Table(input, points, smooth=True):
        """The value read off a curve through (x, y) points, x rising: monotone cubic or straight, flat beyond the ends; a table of 256 entries."""
        if len(points) < 2 or any(a[0] >= b[0] for a, b in zip(points, points[1:], strict=False)):
            raise PlanError("argument", "Curves.Table needs at least two points with x strictly rising")
        n, xs, ys = len(points), [float(p[0]) for p in points], [float(p[1]) for p in points]
        d = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(n - 1)]
        m = [d[0], *((d[i - 1] + d[i]) / 2 if d[i - 1] * d[i] > 0 else 0.0 for i in range(1, n - 1)), d[-1]]
        for i, slope in enumerate(d):  # slopes within three times the secant, so that a rising curve never dips
            if slope == 0:
                m[i] = m[i + 1] = 0.0
            elif (size := math.hypot(m[i], m[i + 1]) / abs(slope)) > 3:
                m[i], m[i + 1] = m[i] * 3 / size, m[i + 1] * 3 / size
        cell, values, k = (xs[-1] - xs[0]) / (Curves.TABLE - 1), [], 0
        for i in range(Curves.TABLE):
            x = xs[0] + cell * i
            while k < n - 2 and x > xs[k + 1]:
                k += 1
            h = xs[k + 1] - xs[k]
            t = min(max((x - xs[k]) / h, 0.0), 1.0)
            if smooth:
                u = 1 - t
                values.append(u * u * (1 + 2 * t) * ys[k] + t * u * u * h * m[k] + t * t * (3 - 2 * t) * ys[k + 1] - t * t * u * h * m[k + 1])
            else:
                values.append(ys[k] + (ys[k + 1] - ys[k]) * t)
        return Terrain.Grid(values=tuple(values * 2), size=(Curves.TABLE, 2), origin=(xs[0], 0.0), cell=cell, position=Vec.Combine(input, input * 0))

    @staticmethod
    def Equalize(input, quantiles, amount=1.0):
        """Values spread evenly over their range; quantiles: 65 of a sample, rising (metrics.ranked gives them)."""
        lo, hi, points = quantiles[0], quantiles[-1], []
        if hi <= lo:
            return input
        for k, x in enumerate(quantiles):
            if not points or x > points[-1][0]:
                points.append((x, x + (lo + (hi - lo) * k / (len(quantiles) - 1) - x) * amount))
        return Curves.Table(input, tuple(points), smooth=False)


class Strata:
    @staticmethod
    def Apply(input, step=30.0, tilt=0.0, heading=0.0, strength=1.0, sharpness=0.6, layers=1, bedding=None, mask=None, smoothness=4, flat=0.1, steep=0.6):
        """Tilted beds cut into slopes: (height, how far each sample moved, bed number)."""
        c, a = Terrain.Coords(), math.radians(heading)
        plane = (c.x * math.cos(a) + c.z * math.sin(a)) * math.tan(math.radians(tilt))
        plane = plane if bedding is None else plane + bedding
        weight = Masks.Slope(input=Terrain.Gradient(input=Filters.Blur(input=input, radius=smoothness)), min=flat, max=steep)
        weight = weight if mask is None else mask * weight
        out, thick, share = input, step, strength
        for _ in range(max(1, int(layers))):
            out = out + (Curves.Terrace(input=out + plane, step=thick, sharpness=sharpness) - plane - out) * (weight * share)
            thick, share = thick / 3, share / 2
        moved = make("curve", {"op": "abs"}, (out - input,), 2)
        return out, moved, Curves.Terrace(input=input + plane, step=step, sharpness=1.0) / step


class Masks:
    @staticmethod
    def Slope(**k):
        k = checked("Masks.Slope", k, {"input": (..., Field, None, None), "min": (0.0, NUMBER, None, None), "max": (1.0, NUMBER, None, None)})
        if k["min"] >= k["max"]:
            raise PlanError("argument", "Masks.Slope: min is not below max")
        return make("slope", {"min": k["min"], "max": k["max"]}, (_slope(k["input"]),), 2)

    @staticmethod
    def Convexity(**k):
        k = checked("Masks.Convexity", k, {"input": (..., Field, None, None), "radius": (4, int, 1, 32)})
        return k["input"] - Filters.Blur(input=k["input"], radius=k["radius"])

    @staticmethod
    def Aspect(**k):
        """(how much the ground faces a direction, 0 to 1; the downhill bearing in radians)."""
        k = checked("Masks.Aspect", k, {"input": (..., Field, None, None), "direction": (0.0, NUMBER, None, None)})
        g = _slope(k["input"]) if "gradient" in k["input"].node.names else Terrain.Gradient(input=k["input"])
        a = math.radians(k["direction"])
        steep = make("curve", {"op": "sqrt"}, (g.x * g.x + g.z * g.z,), 2)
        return (-(g.x * math.cos(a) + g.z * math.sin(a)) / steep) * 0.5 + 0.5, Combine.Atan2(y=-g.z, x=-g.x)

    @staticmethod
    def Curvature(**k):
        """Second-derivative measures: total (the Laplacian), profile (down the slope) and plan (across it)."""
        k = checked("Masks.Curvature", k, {"input": (..., Field, None, None), "kind": ("total", ("total", "profile", "plan"), None, None)})
        g = Terrain.Gradient(input=k["input"])
        xx, zz = Terrain.Gradient(input=g.x), Terrain.Gradient(input=g.z)
        if k["kind"] == "total":
            return xx.x + zz.z
        p, q, square = g.x, g.z, g.x * g.x + g.z * g.z
        if k["kind"] == "profile":
            return (xx.x * p * p + xx.z * p * q * 2 + zz.z * q * q) / square
        return (xx.x * q * q - xx.z * p * q * 2 + zz.z * p * p) / square


class Filters:
    @staticmethod
    def Blur(**k):
        k = checked("Filters.Blur", k, {"input": (..., Field, None, None), "radius": (1, int, 1, 32), "method": ("mean", ("mean", "median"), None, None)})
        f = scalar(k["input"], "Filters.Blur")
        if k["method"] == "median" and (k["radius"] > 3 or f.domain == 3):
            raise PlanError("argument", "Filters.Blur: the median is over R2, with a radius of 3 at most")
        return make("blur", {"method": k["method"], "r": k["radius"]}, (f,), f.domain, radius=k["radius"])

    @staticmethod
    def _window(sign, name, k):
        k = checked(name, k, {"input": (..., Field, None, None), "radius": (1, int, 1, 32), "shape": ("square", ("square", "octagon", "diamond", "disk"), None, None), "falloff": ("flat", ("flat", "cone", "round"), None, None), "slope": (1.0, NUMBER, 0, None), "radius_map": (None, Field, None, None)})
        f = scalar(k["input"], name, 2)
        more = () if k["radius_map"] is None else (scalar(k["radius_map"], name, 2),)
        return make("window", {"sign": sign, "r": k["radius"], "shape": k["shape"], "falloff": k["falloff"], "slope": float(k["slope"])}, (f, *more), 2, radius=k["radius"])

    Expand = staticmethod(lambda **k: Filters._window(1, "Filters.Expand", k))
    Shrink = staticmethod(lambda **k: Filters._window(-1, "Filters.Shrink", k))
    Open = staticmethod(lambda input, **k: Filters.Expand(input=Filters.Shrink(input=input, **k), **k))
    Close = staticmethod(lambda input, **k: Filters.Shrink(input=Filters.Expand(input=input, **k), **k))

    @staticmethod
    def FrequencySplit(input, radius=8):
        low = Filters.Blur(input=input, radius=radius)
        return low, input - low

    @staticmethod
    def Displace(**k):
        k = checked("Filters.Displace", k, {"input": (..., Field, None, None), "by": (..., Field, None, None), "radius": (8, int, 1, 32)})
        if k["by"].size != 2 or k["by"].domain != 2:
            raise PlanError("mapping", f"Filters.Displace: by is a field R2->R2, not {k['by']!r}")
        return make("displace", {"r": k["radius"]}, (scalar(k["input"], "Filters.Displace", 2), k["by"]), 2, radius=k["radius"] + 1)

    @staticmethod
    def DirectionalBlur(input, direction=0.0, length=100.0, taps=8, radius=16):
        a, total = math.radians(direction), None
        for k in range(taps):
            d = length * ((k + 0.5) / taps - 0.5)
            by = Vec.Combine(Terrain.Const(value=d * math.cos(a)), Terrain.Const(value=d * math.sin(a)))
            tap = Filters.Displace(input=input, by=by, radius=radius)
            total = tap if total is None else total + tap
        return total / taps


class Erosion:
    #: Iteration counts are written for samples this many metres apart.
    WRITTEN_AT = 2.0

    @staticmethod
    def Thermal(**k):
        k = checked("Erosion.Thermal", k, {
            "input": (..., Field, None, None), "iterations": (16, int, 1, 255), "talus": (0.7, NUMBER, 0, None), "strength": (0.25, NUMBER, 1e-9, 0.5), "mass_balance": (0.5, NUMBER, 0, 1),
            "two_phase": (False, bool, None, None), "rock": (1.0, NUMBER, 0, None), "strength_map": (None, Field, None, None),
        })
        f, m = scalar(k.pop("input"), "Erosion.Thermal"), k.pop("strength_map")
        return make("thermal", k, (f,) if m is None else (f, scalar(m, "Erosion.Thermal", f.domain)), f.domain, (1, 1), ("value", "talus"), k["iterations"])

    @staticmethod
    def Hydraulic(**k):
        k = checked("Erosion.Hydraulic", k, {
            "input": (..., Field, None, None), "iterations": (32, int, 1, 255), "rain": (0.02, NUMBER, 0, None), "evaporation": (0.05, NUMBER, 0, 1), "capacity": (4.0, NUMBER, 0, None), "erosion_rate": (0.3, NUMBER, 0, 1),
            "deposition": (0.3, NUMBER, 0, 1), "flow_rate": (0.15, NUMBER, 1e-9, 0.25), "hardness": (None, Field, None, None),
        })
        f, m = scalar(k.pop("input"), "Erosion.Hydraulic"), k.pop("hardness")
        return make("hydraulic", k, (f,) if m is None else (f, scalar(m, "Erosion.Hydraulic", f.domain)), f.domain, (1, 2), ("value", "flow"), k["iterations"])

    @staticmethod
    def Gullies(**k):
        """Stripes down the slopes; channel `channels` is how near a sample is to the bottom of a gully."""
        k = checked("Erosion.Gullies", k, {
            "input": (..., Field, None, None), "gradient": (None, Field, None, None), "position": (None, Field, None, None), "cell": (450.0, NUMBER, 1e-9, None), "octaves": (5, int, 1, 8), "strength": (60.0, NUMBER, None, None),
            "full": (0.5, NUMBER, 1e-9, None), "gain": (0.5, NUMBER, None, None), "lacunarity": (2.0, NUMBER, None, None), "seed": (0, int, None, None),
        })
        f, g = scalar(k.pop("input"), "Erosion.Gullies", 2), k.pop("gradient")
        g = Terrain.Gradient(input=f) if g is None else _slope(g)
        return make("gullies", k, (f, g, _position(k.pop("position"), "Erosion.Gullies")), 2, (1, 1), ("value", "channels"))

    @staticmethod
    def Accumulate(input, direction=0.0, lift=0.2, talus=0.6, iterations=32, strength=0.4):
        """Material on the side of every rise that faces away from a direction: tilt, deposit, tilt back."""
        c, a = Terrain.Coords(), math.radians(direction)
        plane = (c.x * math.cos(a) + c.z * math.sin(a)) * lift
        return Erosion.Thermal(input=input + plane, iterations=iterations, talus=talus, strength=strength, mass_balance=1.0) - plane

    @staticmethod
    def scaled(written: int, spacing: float) -> int:
        """Iterations at this spacing for a count written at 2 m: the square of the ratio, from 1 to the greater of the written count and 96."""
        return int(min(max(1, math.floor(written / (spacing / Erosion.WRITTEN_AT) ** 2 + 0.5)), max(written, 96)))


    @staticmethod
    def Coastal(input, level=0.0, beach=4.0, flatness=0.25, cliffs=0.0, cliff_height=20.0, lip=4.0, shelf=8.0, transition=1.0, smooth_underwater=0, depth=30.0):
        """A shore line at `level`: (height, beach mask, cliff mask).

        Within `beach` metres of the level the ground keeps `flatness` of its rise. Where `cliffs` is 1 it is
        a platform `shelf` below the water and, above it, a wall that rounds off at cliff_height as the
        ground has risen by `lip`; the two meet over `transition`. The sea floor is blurred, fully at `depth`.
        """
        if min(beach, lip, transition) <= 0:
            raise PlanError("argument", "Erosion.Coastal: beach, lip and transition are over 0")
        rise = input - level
        far = make("curve", {"op": "abs"}, (rise,), 2)
        shore = rise - Curves.Clamp(input=rise, min=-beach, max=beach) * (1 - flatness)
        left = 1 - Curves.Clamp(input=rise / lip)
        cliff = Combine.Blend(a=Combine.Min(a=rise, b=-shelf), b=Combine.Max(a=rise, b=(1 - left * left) * cliff_height), mask=Curves.Smoothstep(input=rise, min=-transition, max=transition))
        share = Curves.Clamp(input=lift(cliffs, 2) + rise * 0)
        height = Combine.Blend(a=shore, b=cliff, mask=share) + level
        if smooth_underwater:
            height = Combine.Blend(a=height, b=Filters.Blur(input=height, radius=smooth_underwater), mask=Curves.Smoothstep(input=level - height, min=0, max=depth))
        near = lambda width: 1 - Curves.Smoothstep(input=far, min=0, max=width)
        return height, (1 - share) * near(beach), share * near(cliff_height + shelf)

    @staticmethod
    def Snow(input, snowfall=2.0, line=None, taper=50.0, stickiness=0.6, iterations=24, melt=None):
        """Snow that falls above a line, less what melts, and slides off steep ground: (surface, depth)."""
        fallen = input * 0 + snowfall
        if line is not None:
            fallen = fallen * Curves.Smoothstep(input=input, min=line - taper, max=line + taper)
        if melt is not None:
            fallen = fallen * (1 - Curves.Clamp(input=melt))
        depth = Combine.Max(a=Erosion.Thermal(input=input + fallen, talus=stickiness, iterations=iterations, strength=0.4) - input, b=0)
        return input + depth, depth

    @staticmethod
    def Weathering(input, fracture=0.0, boulders=0.0, intensity=1.0, production=None, talus=0.7, rock=1.0, iterations=24, mass_balance=0.5, seed=0):
        """Rock that breaks in blocks, each at its rate, and lies below as talus with boulders: (surface, depth of talus)."""
        rate = input * 0 + 1 if production is None else production
        if fracture > 0:
            rate = rate * (Noises.Cells(frequency=1 / fracture, style="cell", seed=seed + 11) * 0.8 + 0.2)
        worn = Erosion.Thermal(input=input, two_phase=True, talus=talus, rock=rock, iterations=iterations, mass_balance=mass_balance, strength=min(0.5, 0.25 * intensity), strength_map=rate)
        if boulders <= 0:
            return worn, worn.talus
        round_ = Curves.Clamp(input=1 - Noises.Cells(frequency=1 / boulders, style="F1", seed=seed + 13) * 1.4)
        return worn + Combine.Min(a=worn.talus, b=boulders / 2) * round_, worn.talus

    @staticmethod
    def Multiscale(input, region, cell=50.0, iterations=40, k=0.004, talus=0.6, diffusion=None, amount=1.0, detail=16, hardness=None, seed=0):
        """Valleys from stream power on a coarse grid over region (x0, z0, x1, z1), channels from hydraulic erosion: (height, what the coarse pass cut)."""
        from .operators.raster import stream_power
        from .plans.sample import sample_grid

        import numpy as np

        x0, z0, x1, z1 = region
        size = (int((x1 - x0) // cell) + 1, int((z1 - z0) // cell) + 1)
        ground = sample_grid(input, (x0, z0), size, cell, seed)
        worn = stream_power(ground, np.zeros(ground.shape), cell, iterations, k, 0.5, talus, 0.012 * cell * cell if diffusion is None else diffusion, refresh=4)
        cut = Terrain.Grid(values=tuple(((worn - ground) * amount).ravel().tolist()), size=size, origin=(float(x0), float(z0)), cell=float(cell))
        beyond = Shapes.Rect(size=(float(x1 - x0), float(z1 - z0)), at=((x0 + x1) / 2, (z0 + z1) / 2), metric="chebyshev")
        cut = cut * (1 - Curves.Smoothstep(input=beyond, min=-cell, max=0))  # nothing at the region's edge and outside
        height = input + cut
        return (Erosion.Hydraulic(input=height, iterations=detail, hardness=hardness) if detail else height), cut


class Vec:
    @staticmethod
    def Combine(*fields):
        if not 2 <= len(fields) <= 4:
            raise PlanError("argument", "Vec.Combine takes 2 to 4 fields")
        return make("combine", {}, [scalar(f, "Vec.Combine", fields[0].domain) for f in fields], fields[0].domain, (len(fields),))


class Shapes:
    """Signed distances in metres, negative inside, with placement."""

    PLACE = {"position": (None, Field, None, None), "at": ((0.0, 0.0), tuple, None, None), "rotation": (0.0, NUMBER, None, None), "scale": (1.0, NUMBER, 1e-9, None), "pivot": ((0.0, 0.0), tuple, None, None)}

    @staticmethod
    def _shape(name, k, accepted):
        k = checked(f"Shapes.{name}", k, {**accepted, **Shapes.PLACE})
        where = {x: k.pop(x) for x in Shapes.PLACE}
        p = Terrain.Transform(**where)
        return make("shape", {"op": name, **k}, (p,), 2) * where["scale"]

    Circle = staticmethod(lambda **k: Shapes._shape("Circle", k, {"radius": (..., NUMBER, 0, None)}))
    Point = staticmethod(lambda **k: Shapes._shape("Circle", {"radius": 0.0, **k}, {"radius": (0.0, NUMBER, 0, 0)}))
    Ellipse = staticmethod(lambda **k: Shapes._shape("Ellipse", k, {"radii": (..., tuple, None, None)}))
    Rect = staticmethod(lambda **k: Shapes._shape("Rect", k, {"size": (..., tuple, None, None), "rounding": (0.0, NUMBER, 0, None), "metric": ("euclidean", ("euclidean", "chebyshev"), None, None)}))
    Polygon = staticmethod(lambda **k: Shapes._shape("Segments", {"closed": True, **k}, {"points": (..., tuple, None, None), "closed": (True, bool, None, None)}))
    Polyline = staticmethod(lambda **k: Shapes._shape("Segments", {"closed": False, **k}, {"points": (..., tuple, None, None), "closed": (False, bool, None, None)}))

    @staticmethod
    def Spline(points, subdivisions=8, closed=False, fill=False, **k):
        """A centripetal Catmull-Rom curve through the points, as segments."""
        n, out = len(points), []
        at = (lambda i: points[i % n]) if closed else (lambda i: points[min(max(i, 0), n - 1)])
        for i in range(n if closed else n - 1):
            p = [at(i - 1), at(i), at(i + 1), at(i + 2)]
            t = [0.0]
            for a, b in zip(p, p[1:], strict=False):
                t.append(t[-1] + max(math.dist(a, b) ** 0.5, 1e-6))
            for s in range(subdivisions):
                u = t[1] + (t[2] - t[1]) * s / subdivisions
                lerp = lambda a, b, lo, hi: tuple((x * (hi - u) + y * (u - lo)) / (hi - lo) for x, y in zip(a, b, strict=True))  # noqa: B023, E731
                a1, a2, a3 = (lerp(p[j], p[j + 1], t[j], t[j + 1]) for j in range(3))
                b1, b2 = lerp(a1, a2, t[0], t[2]), lerp(a2, a3, t[1], t[3])
                out.append(lerp(b1, b2, t[1], t[2]))
        if not closed:
            out.append(tuple(points[-1]))
        if len(out) > 128:
            raise PlanError("argument", f"Shapes.Spline: {len(out)} segments, at most 128")
        return (Shapes.Polygon if closed and fill else Shapes.Polyline)(points=tuple(out) + ((out[0],) if closed and not fill else ()), **k)

    @staticmethod
    def _fold(shapes, smooth, hard, soft):
        out = shapes[0]
        for s in shapes[1:]:
            out = hard(a=out, b=s) if smooth <= 0 else soft(a=out, b=s, k=smooth)
        return out

    @staticmethod
    def Union(*shapes, smooth=0.0):
        return Shapes._fold(shapes, smooth, Combine.Min, Combine.SmoothMin)

    @staticmethod
    def Intersect(*shapes, smooth=0.0):
        return Shapes._fold(shapes, smooth, Combine.Max, Combine.SmoothMax)

    @staticmethod
    def Subtract(a, *others, smooth=0.0):
        return Shapes._fold((a, *(-o for o in others)), smooth, Combine.Max, Combine.SmoothMax)

    @staticmethod
    def Mask(shape, feather=0.0):
        return Curves.Clamp(input=shape * -1e4) if feather <= 0 else Curves.Clamp(input=0.5 - shape / feather)

    @staticmethod
    def Warp(position=None, amplitude=10.0, frequency=0.01, octaves=3, seed=0):
        p = position or Terrain.Coords()
        n = [Noises.fBm(frequency=frequency, octaves=octaves, amplitude=amplitude, seed=s, position=p) for s in (seed, seed + 7919)]
        return p + Vec.Combine(*n)


class Lands:
    """Composition of land and water shapes in order."""

    @staticmethod
    def Compose(elements):
        """(signed distance to the coast, id of the nearest land counted from 1) of elements {role, shape, smooth}: land joins what is there, water cuts into it."""
        coast = nearest = ident = None
        for n, e in enumerate(elements, 1):
            e = checked("Lands.Compose", e, {"role": ("land", ("land", "water"), None, None), "shape": (..., Field, None, None), "smooth": (0.0, NUMBER, 0, None)})
            d, k = scalar(e["shape"], "Lands.Compose", 2), e["smooth"]
            if e["role"] == "water":
                if coast is None:
                    raise PlanError("argument", "Lands.Compose: water comes before any land")
                coast = Shapes.Subtract(coast, d, smooth=k)
                continue
            if coast is None:
                coast, nearest, ident = d, d, Terrain.Const(value=float(n))
                continue
            coast = Shapes.Union(coast, d, smooth=k)
            ident = Combine.Blend(a=ident, b=float(n), mask=arith("less", d, nearest))
            nearest = Combine.Min(a=nearest, b=d)
        if coast is None:
            raise PlanError("argument", "Lands.Compose needs an element")
        return coast, ident

    @staticmethod
    def Scatter(count, region, radius, seed=0, role="land", smooth=0.0):
        """Elements of `count` circles at jittered places of a lattice over region (x0, z0, x1, z1); radius is (least, most)."""
        x0, z0, x1, z1 = region
        across = max(1, math.ceil(math.sqrt(count * (x1 - x0) / max(z1 - z0, 1e-9))))
        down = -(-count // across)
        import numpy as np

        rng = np.random.default_rng(seed)
        out = []
        for k in range(count):
            j, i = divmod(k, across)
            u, v, w = rng.random(3)
            at = (float(x0 + (i + u) * (x1 - x0) / across), float(z0 + (j + v) * (z1 - z0) / down))
            out.append({"role": role, "shape": Shapes.Circle(radius=float(radius[0] + w * (radius[1] - radius[0])), at=at), "smooth": smooth})
        return out


class Landforms:
    """A profile of a shape times a height."""

    @staticmethod
    def _form(shape, height, kind, **profile):
        return Curves.Profile(input=shape, kind=kind, **profile) * height

    Cone = staticmethod(lambda radius, height, **k: Landforms._form(Shapes.Circle(radius=radius, **k), height, "linear", width=radius))
    Dome = staticmethod(lambda radius, height, **k: Landforms._form(Shapes.Circle(radius=radius, **k), height, "dome", width=radius))
    Bowl = staticmethod(lambda radius, depth, **k: -Landforms._form(Shapes.Circle(radius=radius, **k), depth, "dome", width=radius))
    Cylinder = staticmethod(lambda radius, height, falloff=1.0, **k: Landforms._form(Shapes.Circle(radius=radius, **k), height, "plateau", falloff=falloff))
    Plateau = staticmethod(lambda size, height, falloff=50.0, **k: Landforms._form(Shapes.Rect(size=size, **k), height, "plateau", falloff=falloff))
    Pyramid = staticmethod(lambda size, height, **k: Landforms._form(Shapes.Rect(size=size, metric="chebyshev", **k), height, "linear", width=min(size) / 2))
    Ridge = staticmethod(lambda points, height, width, **k: Landforms._form(Shapes.Polyline(points=points, **k) - width, height, "smooth", width=width))
    Trench = staticmethod(lambda points, depth, width, **k: -Landforms._form(Shapes.Polyline(points=points, **k) - width, depth, "smooth", width=width))
    UValley = staticmethod(lambda points, depth, width, **k: -Landforms._form(Shapes.Polyline(points=points, **k) - width, depth, "dome", width=width))
