"""Measures of rasters: one pass of partial aggregates, windows or ranks each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import neighbours


def output_statistics(df: DataFrame, *columns: str) -> DataFrame:
    """min, max, mean of finite components, how many there are, and how many are not finite."""
    x = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v"))
    fine = ~(F.isnan("v") | (F.abs("v") == float("inf")))
    value = F.when(fine, F.col("v"))
    return x.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("samples"), F.count(F.when(~fine, 1)).alias("non_finite"))


def quantised(v, lo: float, hi: float):
    """A value as a 16-bit sample of [lo, hi]: clamped, half up."""
    return F.floor(F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * 65535.0 + 0.5).cast("int")


def land_fraction(df: DataFrame, level: float) -> DataFrame:
    return df.agg(F.count(F.when(F.col("v") > level, 1)).alias("land"), F.count(F.lit(1)).alias("cells"))


def coast_edges(df: DataFrame, level: float) -> DataFrame:
    """Pairs of neighbours along x and z of which one is land."""
    near = neighbours(df, "v")
    land = lambda c: (F.col(c) > level).cast("int")
    return near.agg(F.coalesce(F.sum(F.abs(land("v") - land("v_e"))), F.lit(0)).cast("long").alias("along_x"), F.coalesce(F.sum(F.abs(land("v") - land("v_s"))), F.lit(0)).cast("long").alias("along_z"))


def boundary_cells(df: DataFrame, level: float) -> DataFrame:
    """Land cells with a neighbour that is not."""
    near = neighbours(df, "v").where(F.col("v") > level)
    return near.where(F.least("v_e", "v_w", "v_s", "v_n") <= level).select("x", "z")


def box_counts(cells: DataFrame, steps: range = range(2, 8)) -> DataFrame:
    """(k, boxes): how many boxes of side 2**k hold a cell, all sizes in one aggregate."""
    each = cells.select("x", "z", F.explode(F.array(*map(F.lit, steps))).alias("k"))
    side = F.pow(F.lit(2.0), F.col("k"))
    return each.select("k", F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("z") / side).alias("bz")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("boxes"))


def box_dimension(counts: DataFrame) -> DataFrame:
    y, x = F.log("boxes"), -F.col("k") * F.log(F.lit(2.0))
    return counts.agg(F.regr_slope(y, x).alias("dimension"), F.regr_r2(y, x).alias("r2"))


def ranked(df: DataFrame, value: str, shares: dict[str, float], parts: int = 64) -> DataFrame:
    """Values at index trunc(share * n) of the sorted ones, at most the last: one row, nulls without any.

    Counts per value are ranked instead of rows. They are dealt to ranges of values; the ranges' totals,
    `parts` numbers, tell in which range each wanted rank lies, and only there ranks are counted.
    """
    held = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    kind = dict(held.dtypes)["v"]
    cuts = held.stat.approxQuantile("v", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bounds = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda c: c <= F.col("v"))) if bounds else F.lit(0)
    dealt = held.withColumn("part", part)
    totals = {r["part"]: r["c"] for r in dealt.groupBy("part").agg(F.sum("c").alias("c")).collect()}  # at most `parts` rows
    n, upto, before = sum(totals.values()), {}, 0
    for k in sorted(totals):
        upto[k] = before
        before += totals[k]
    spark = df.sparkSession
    if not n:
        return spark.range(1).select(*[F.lit(None).cast(kind).alias(k) for k in shares])
    wanted = {k: min(n - 1, int(math.floor(s * n))) for k, s in shares.items()}
    home = {k: max(p for p in upto if upto[p] <= i) for k, i in wanted.items()}
    inside = dealt.where(F.col("part").isin(sorted(set(home.values()))))
    to = F.sum("c").over(Window.partitionBy("part").orderBy("v")) + F.element_at(F.create_map(*[F.lit(x) for p in upto for x in (p, upto[p])]), F.col("part"))
    inside = inside.withColumn("to", to)
    return inside.agg(*[F.min(F.when((F.col("part") == home[k]) & (F.col("to") > i), F.col("v"))).alias(k) for k, i in wanted.items()])


def min_channel(df: DataFrame, a: str, b: str) -> DataFrame:
    """(steps): the fewest steps along x and z between a cell of mask a and one of mask b; null if either is empty."""
    from .raster import manhattan

    gap = manhattan(df.select("x", "z", F.col(a).alias("land")))
    return df.join(gap, ["x", "z"]).where(F.col(b)).agg(F.min("d1").alias("steps"))


def band_slope(df: DataFrame, lo: float, hi: float, spacing: float = 1.0) -> DataFrame:
    """(degrees, cells): the mean slope, by central differences, of inner cells with lo <= v < hi."""
    from .windows import gradient

    g = gradient(df, spacing).where((F.col("v") >= lo) & (F.col("v") < hi))
    steep = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz"))))
    return g.agg(F.avg(steep).alias("degrees"), F.count(F.lit(1)).alias("cells"))


def accepted(measures: DataFrame, ranges: list[tuple[str, float | None, float | None, bool]]) -> DataFrame:
    """(metric, value, least, most, ok) of measures (metric, value) for which there is a range; a range that only informs (last: True) is always ok."""
    wanted = measures.sparkSession.createDataFrame(ranges, "metric string, least double, most double, target boolean")
    inside = (F.col("value") >= F.coalesce("least", F.col("value"))) & (F.col("value") <= F.coalesce("most", F.col("value")))
    return measures.join(F.broadcast(wanted), "metric").select("metric", "value", "least", "most", (F.col("target") | F.coalesce(inside, F.lit(False))).alias("ok"))


def pits(h, cell: float, channel_area: float) -> dict[str, float]:
    """Of one raster as an array: how many inner cells lie under their spill level, their share, the deepest, and metres of channel a square metre."""
    import numpy as np

    from .raster import flow, gathered, priority_flood

    filled, _ = priority_flood(h, 1e-6)
    deep = (filled - h)[1:-1, 1:-1]
    under = deep > 1e-4
    to = flow(filled, np.array([], int), cell)[0].ravel()
    area = gathered(to, cell * cell)
    along = np.abs(np.arange(h.size) - to)
    length = np.where((along == 1) | (along == h.shape[1]), cell, cell * math.sqrt(2.0))
    channel = (to >= 0) & (area >= channel_area)
    return {"pits": float(under.sum()), "share": float(under.mean()), "deepest": float(deep.max(initial=0.0)), "density": float(length[channel].sum() / (h.size * cell * cell))}


def local_relief(df: DataFrame, block: int, level: float) -> DataFrame:
    """(bx, bz, relief): spread of heights in squares that are at least half land."""
    g = df.groupBy(F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("z") / block).alias("bz"))
    g = g.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v") > level, 1)).alias("land"))
    return g.where("land * 2 >= n").select("bx", "bz", (F.col("hi") - F.col("lo")).alias("relief"))


def by_id(df: DataFrame, region: str, width: int, depth: int) -> DataFrame:
    """Cells, sums of coordinates, box, top and contact with the border by region."""
    edge = (F.col("x") == 0) | (F.col("z") == 0) | (F.col("x") == width - 1) | (F.col("z") == depth - 1)
    return df.groupBy(F.col(region).alias("id")).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("x").alias("sum_x"), F.sum("z").alias("sum_z"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("z").alias("min_z"), F.max("z").alias("max_z"),
        F.max("v").alias("top"), F.max(edge.cast("int")).alias("edge"),
    )
