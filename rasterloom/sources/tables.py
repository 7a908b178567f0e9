"""Tables as rasters: a dense key becomes sample coordinates, x fastest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (table, key, width, value as SQL)
LIFTED = {
    "evt": ("events", "event_id", 100, "cast(round(value * 100) as bigint)"),
    "prt": ("part", "p_partkey", 50, "p_retailprice"),
    "ord": ("orders", "o_orderkey", 100, "o_totalprice"),
    "cus": ("customer", "c_custkey", 50, "c_acctbal"),
}


def lift(df: DataFrame, key: str, width: int, value: str) -> DataFrame:
    """(x, z, v): v at sample (key mod width, key div width)."""
    return df.select((F.col(key) % width).cast("long").alias("x"), F.floor(F.col(key) / width).cast("long").alias("z"), F.expr(value).alias("v"))


def raster(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, width, value = LIFTED[name]
    return lift(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key, width, value)


def raster_sql(name: str) -> str:
    table, key, width, value = LIFTED[name]
    return f"{name} AS (SELECT {key} % {width} AS x, {key} // {width} AS z, {value} AS v FROM {table})"
