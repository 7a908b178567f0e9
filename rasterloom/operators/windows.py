"""Neighbourhood operators on rasters that are tables: (x, z, v), one row a sample.

Separable frames are two window passes over runs of equal z and equal x; other frames join each
sample with its taps by offset. Taps that are not in the table are skipped; a mean divides by the
taps found. Frames are by coordinate value, so gaps in the table are gaps in the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stencils import offsets, penalty


def _line(across: str, along: str):
    return Window.partitionBy(across).orderBy(along)


def box(df: DataFrame, radius: int, combine) -> DataFrame:
    """Window aggregates over the square frame: combine is F.sum, F.min or F.max, applied along x and then along z to `v` and `n`."""
    rows, columns = (_line(*k).rangeBetween(-radius, radius) for k in (("z", "x"), ("x", "z")))
    df = df.select("x", "z", combine("v").over(rows).alias("v"), F.sum("n").over(rows).alias("n"))
    return df.select("x", "z", combine("v").over(columns).alias("v"), F.sum("n").over(columns).alias("n"))


def blur_sums(df: DataFrame, radius: int) -> DataFrame:
    """(x, z, v, n): sum of the square frame's values and how many there are."""
    return box(df.select("x", "z", "v", F.lit(1).cast("long").alias("n")), radius, F.sum)


def blur(df: DataFrame, radius: int) -> DataFrame:
    return blur_sums(df, radius).select("x", "z", (F.col("v").cast("double") / F.col("n")).alias("v"))


def _extreme(df: DataFrame, radius: int, shape: str, falloff: str, slope: float, spacing: float, sign: int) -> DataFrame:
    if shape == "square" and falloff == "flat":
        return box(df.select("x", "z", "v", F.lit(1).alias("n")), radius, F.max if sign > 0 else F.min).select("x", "z", "v")
    taps = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dz).alias("dz"), F.lit(sign * penalty(falloff, slope, spacing, radius, (dx * dx + dz * dz) ** 0.5)).alias("p")) for dz, dx in offsets(shape, radius)])
    sent = df.withColumn("t", F.explode(taps)).select((F.col("x") + F.col("t.dx")).alias("x"), (F.col("z") + F.col("t.dz")).alias("z"), (F.col("v") if falloff == "flat" else F.col("v") - F.col("t.p")).alias("v"))
    best = sent.groupBy("x", "z").agg((F.max if sign > 0 else F.min)("v").alias("v"))
    return best.join(df.select("x", "z"), ["x", "z"], "left_semi")


def expand(df: DataFrame, radius: int, shape="square", falloff="flat", slope=1.0, spacing=1.0) -> DataFrame:
    return _extreme(df, radius, shape, falloff, slope, spacing, 1)


def shrink(df: DataFrame, radius: int, shape="square", falloff="flat", slope=1.0, spacing=1.0) -> DataFrame:
    return _extreme(df, radius, shape, falloff, slope, spacing, -1)


def median(df: DataFrame, radius: int) -> DataFrame:
    """The element at half the number of taps found, in order."""
    taps = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dz).alias("dz")) for dz, dx in offsets("square", radius)])
    sent = df.withColumn("t", F.explode(taps)).select((F.col("x") + F.col("t.dx")).alias("x"), (F.col("z") + F.col("t.dz")).alias("z"), "v")
    lists = sent.groupBy("x", "z").agg(F.sort_array(F.collect_list("v")).alias("s"))  # (2 * radius + 1)**2 at most
    return lists.join(df.select("x", "z"), ["x", "z"], "left_semi").select("x", "z", F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("v"))


def neighbours(df: DataFrame, *names: str) -> DataFrame:
    """df with, for each name, its values at x + 1, x - 1, z + 1, z - 1 as name_e, name_w, name_s, name_n; null where there is no such sample."""
    rows, columns = _line("z", "x"), _line("x", "z")

    def at(move, name: str, step: int, line, key: str) -> Column:
        return F.when(move(key, 1).over(line) == F.col(key) + step, move(name, 1).over(line))

    out = {}
    for n in names:
        out[f"{n}_e"], out[f"{n}_w"] = at(F.lead, n, 1, rows, "x"), at(F.lag, n, -1, rows, "x")
        out[f"{n}_s"], out[f"{n}_n"] = at(F.lead, n, 1, columns, "z"), at(F.lag, n, -1, columns, "z")
    return df.withColumns(out)


def gradient(df: DataFrame, spacing: float = 1.0) -> DataFrame:
    """(x, z, v, gx, gz) of samples that have all four axis neighbours."""
    near = neighbours(df, "v").where("v_e is not null and v_w is not null and v_s is not null and v_n is not null")
    d = lambda a, b: (F.col(a) - F.col(b)) / F.lit(2.0 * spacing)
    return near.select("x", "z", "v", d("v_e", "v_w").alias("gx"), d("v_s", "v_n").alias("gz"))


def thermal(df: DataFrame, iterations: int = 1, talus: float = 0.7, strength: float = 0.25, mass_balance: float = 0.5, spacing: float = 1.0) -> DataFrame:
    """A few iterations of thermal erosion as window passes (many: export in blocks)."""
    hold = float(talus * spacing)
    for _ in range(iterations):
        near = neighbours(df, "v")
        given = received = F.lit(0.0)
        for k in "ewsn":
            down = F.col("v") - F.col(f"v_{k}")
            given = given + F.coalesce(F.greatest(down - hold, F.lit(0.0)), F.lit(0.0))
            received = received + F.coalesce(F.greatest(-down - hold, F.lit(0.0)), F.lit(0.0))
        change = (received * (2.0 * mass_balance) - given * (2.0 * (1.0 - mass_balance))) * strength / 4.0
        df = near.select("x", "z", (F.col("v") + change).alias("v"))
    return df


def hydraulic(df: DataFrame, iterations: int = 1, rain=0.02, evaporation=0.05, capacity=4.0, erosion_rate=0.3, deposition=0.3, flow_rate=0.15, spacing=1.0) -> DataFrame:
    """(x, z, v, water, sediment): a few iterations of hydraulic erosion as window passes (many: export in blocks)."""
    df = df.select("x", "z", "v", F.lit(0.0).alias("water"), F.lit(0.0).alias("sediment"))
    lit = F.lit
    for _ in range(iterations):
        df = df.withColumn("water", F.col("water") + rain)
        df = df.withColumns({"level": F.col("v") + F.col("water"), "load": F.col("sediment") / F.greatest("water", lit(1e-6))})
        near = neighbours(df, "v", "water", "level", "load")
        out = into = lost = won = steep = lit(0.0)
        lowest = F.col("v")
        for k in "ewsn":
            down = F.coalesce(F.col("level") - F.col(f"level_{k}"), lit(0.0))
            away = F.when(down > 0, F.least("water", down) * flow_rate).otherwise(0.0)
            here = F.when(down < 0, F.least(F.col(f"water_{k}"), -down) * flow_rate).otherwise(0.0)
            out, into = out + away, into + here
            lost, won = lost + away * F.col("load"), won + F.when(down < 0, here * F.col(f"load_{k}")).otherwise(0.0)
            steep = F.when(down > 0, F.greatest(steep, (F.col("v") - F.col(f"v_{k}")) / spacing)).otherwise(steep)
            lowest = F.least(lowest, F.col(f"v_{k}"))
        near = near.select("x", "z", "v", (F.col("water") - out + into).alias("water"), (F.col("sediment") - lost + won).alias("sediment"), (F.greatest(out, into) * capacity * steep).alias("holds"), lowest.alias("lowest"))
        room = F.col("holds") - F.col("sediment")
        change = F.when(room > 0, -F.least(room * erosion_rate, F.greatest(F.col("v") - F.col("lowest"), lit(0.0)) * 0.5)).otherwise(-room * deposition)
        near = near.withColumn("change", change)
        df = near.select("x", "z", (F.col("v") + F.col("change")).alias("v"), (F.col("water") * (1.0 - evaporation)).alias("water"), (F.col("sediment") - F.col("change")).alias("sediment"))
    return df


def displace(df: DataFrame, dx: float, dz: float) -> DataFrame:
    """v read bilinearly at (x + dx, z + dz), where all four corners are there."""
    i, j = int(dx // 1), int(dz // 1)
    u, w = dx - i, dz - j
    taps = F.array(*[F.struct(F.lit(-(i + a)).cast("long").alias("dx"), F.lit(-(j + b)).cast("long").alias("dz"), F.lit((u if a else 1 - u) * (w if b else 1 - w)).alias("w")) for a in (0, 1) for b in (0, 1)])
    sent = df.withColumn("t", F.explode(taps)).select((F.col("x") + F.col("t.dx")).alias("x"), (F.col("z") + F.col("t.dz")).alias("z"), (F.col("v") * F.col("t.w")).alias("v"))
    got = sent.groupBy("x", "z").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")).where("n = 4")
    return got.join(df.select("x", "z"), ["x", "z"], "left_semi").select("x", "z", "v")


def soften(df: DataFrame) -> DataFrame:
    """3 x 3 weights 4, 2, 1 with the edge repeated, over a dense raster: the weighted sum and 16 as its divisor."""
    out = df
    for across, along in (("z", "x"), ("x", "z")):
        line = _line(across, along)
        before, after = F.coalesce(F.lag("v").over(line), F.col("v")), F.coalesce(F.lead("v").over(line), F.col("v"))
        out = out.select("x", "z", (before + F.col("v") * 2 + after).alias("v"))
    return out


def shadow(df: DataFrame, drop: float) -> DataFrame:
    """Whether a sample lies in the shadow cast along +x by light that falls `drop` a sample."""
    line = _line("z", "x").rowsBetween(Window.unboundedPreceding, -1)
    lifted = F.col("v") + F.col("x") * F.lit(float(drop))
    return df.select("x", "z", F.coalesce(F.max(lifted).over(line) > lifted, F.lit(False)).alias("shaded"))
