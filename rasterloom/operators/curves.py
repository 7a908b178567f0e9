"""Fields around curves and polygons that are tables: nearest segments by bins, levels and widths along them.

A curve is rows (curve, i, x, z, level, half_width), a polygon rows (polygon, i, x, z) in order. Segments
join consecutive points. Each segment is put into the bins that its box, widened by the margin, meets;
cells look in their own bin only, so cells and segments meet by an equal key and not all with all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(points: DataFrame, curve: str = "curve", closed: bool = False) -> DataFrame:
    """(curve, i, ax, az, bx, bz and a_, b_ of every further column): from each point to the next of its curve."""
    line = Window.partitionBy(curve).orderBy("i")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = [c for c in points.columns if c not in (curve, "i", "x", "z")]

    def after(c):
        following = F.lead(c).over(line)
        return F.coalesce(following, F.first(c).over(whole)) if closed else following

    out = points.select(
        F.col(curve).alias("curve"), "i", F.col("x").alias("ax"), F.col("z").alias("az"), after("x").alias("bx"), after("z").alias("bz"),
        *[e for c in more for e in (F.col(c).alias(f"a_{c}"), after(c).alias(f"b_{c}"))],
    )
    return out.where("bx is not null")


def _along():
    """Where on its segment the point next to (x, z) is, 0 to 1."""
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    size = dx * dx + dz * dz
    t = ((F.col("x") - F.col("ax")) * dx + (F.col("z") - F.col("az")) * dz) / size
    return F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))


def curve_field(cells: DataFrame, points: DataFrame, margin: float, bin_size: float | None = None) -> DataFrame:
    """For each cell (x, z) within the margin of a curve: curve, i, d2, level and half_width at the nearest point of the nearest segment.

    Of equally near segments the first counts (curve, then i). Cells farther than the margin are left out.
    """
    size = float(bin_size or max(2.0 * margin, 1.0))
    seg = segments(points)
    reach = lambda lo, hi: F.explode(F.sequence(F.floor((lo - margin) / size), F.floor((hi + margin) / size)))
    seg = seg.withColumn("bin_x", reach(F.least("ax", "bx"), F.greatest("ax", "bx"))).withColumn("bin_z", reach(F.least("az", "bz"), F.greatest("az", "bz")))
    at = cells.select("x", "z").withColumn("bin_x", F.floor(F.col("x") / size)).withColumn("bin_z", F.floor(F.col("z") / size))
    met = at.join(seg, ["bin_x", "bin_z"]).withColumn("t", _along())
    px, pz = F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), F.col("az") + F.col("t") * (F.col("bz") - F.col("az"))
    met = met.withColumn("d2", (F.col("x") - px) * (F.col("x") - px) + (F.col("z") - pz) * (F.col("z") - pz)).where(F.col("d2") <= margin * margin)
    mixed = lambda c: (F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col("t")).alias(c)
    best = met.groupBy("x", "z").agg(F.min(F.struct("d2", "curve", "i", mixed("level"), mixed("half_width"))).alias("m"))
    return best.select("x", "z", "m.curve", "m.i", "m.d2", "m.level", "m.half_width")


def polygon_field(cells: DataFrame, points: DataFrame, margin: float) -> DataFrame:
    """(x, z, polygon, d): signed distance, negative inside, of cells within a polygon's box widened by the margin."""
    named = points.select(F.col("polygon").alias("curve"), "i", "x", "z")
    sides = segments(named, closed=True)
    polygons = sides.groupBy("curve").agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("az").alias("z0"), F.max("az").alias("z1"), F.collect_list(F.struct("ax", "az", "bx", "bz")).alias("sides"))  # a polygon's own sides
    inside = (F.col("x") >= F.col("x0") - margin) & (F.col("x") <= F.col("x1") + margin) & (F.col("z") >= F.col("z0") - margin) & (F.col("z") <= F.col("z1") + margin)
    met = cells.select("x", "z").join(F.broadcast(polygons), inside)

    def away(s):
        dx, dz = s["bx"] - s["ax"], s["bz"] - s["az"]
        size = dx * dx + dz * dz
        t = F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((F.col("x") - s["ax"]) * dx + (F.col("z") - s["az"]) * dz) / size, F.lit(0.0)), F.lit(1.0)))
        ex, ez = F.col("x") - s["ax"] - t * dx, F.col("z") - s["az"] - t * dz
        return ex * ex + ez * ez

    crossed = F.size(F.filter("sides", lambda s: ((s["az"] > F.col("z")) != (s["bz"] > F.col("z"))) & (F.col("x") < s["ax"] + (F.col("z") - s["az"]) * (s["bx"] - s["ax"]) / (s["bz"] - s["az"])))) % 2
    d = F.sqrt(F.array_min(F.transform("sides", away)))
    return met.select("x", "z", F.col("curve").alias("polygon"), F.when(crossed == 1, -d).otherwise(d).alias("d"))


def arc_length(points: DataFrame, curve: str = "curve") -> DataFrame:
    """points with s: metres along the curve up to the point."""
    line = Window.partitionBy(curve).orderBy("i")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(line), 2) + F.pow(F.col("z") - F.lag("z").over(line), 2))
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("step").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def falling(points: DataFrame, level: str = "level", curve: str = "curve") -> DataFrame:
    """points with the level never rising downstream (in the order of i)."""
    line = Window.partitionBy(curve).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(level, F.min(level).over(line))


def carve_channel(heights: DataFrame, field: DataFrame, depth: float, bank: float) -> DataFrame:
    """(x, z, v, water): heights (x, z, v) cut by channels: a bed `depth` under the level, rounded up to it at half_width, and banks that come down to the level over `bank` metres.

    water is the depth of the water where the bed lies under the level. Ground is never raised.
    """
    met = heights.join(field.select("x", "z", "d2", "level", "half_width"), ["x", "z"], "left")
    d = F.sqrt("d2")
    across = F.least(d / F.greatest("half_width", F.lit(1e-6)), F.lit(1.0))
    bed = F.col("level") - depth * (1.0 - across * across)
    out = F.least(F.greatest((d - F.col("half_width")) / bank, F.lit(0.0)), F.lit(1.0))
    shape = F.col("level") + (F.col("v") - F.col("level")) * out * out * (3.0 - 2.0 * out)
    cut = F.when(d <= F.col("half_width"), bed).otherwise(shape)
    v = F.coalesce(F.least("v", cut), F.col("v"))
    water = F.when(d <= F.col("half_width"), F.greatest(F.col("level") - v, F.lit(0.0))).otherwise(F.lit(0.0))
    return met.select("x", "z", v.alias("v"), F.coalesce(water, F.lit(0.0)).alias("water"))
