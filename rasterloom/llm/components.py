"""Connected components of a table of links, by hooking and pointer jumping.

Each round every vertex hooks onto its smallest neighbour, chains are shortened by jumping, and
the links are drawn anew between what is left. All steps are joins and minimum aggregates, which
combine before the shuffle; no neighbour list is ever gathered, so a hub of any degree is fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, drop_written, hot_join, written


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of links (a, b: long): the smallest vertex of its component.

    Links may repeat or loop; those with a null end are left out. No links: an empty table. Tables of
    finished rounds are deleted.
    """
    spark, mark = links.sparkSession, len(WRITTEN)
    edges = written(links.select("a", "b").where("a is not null and b is not null").distinct(), "links")
    label = written(edges.selectExpr("explode(array(a, b)) as v").distinct().withColumn("comp", F.col("v")), "labels")
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        old = WRITTEN[mark:]
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        parent = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        while True:
            up = parent.selectExpr("a as x", "p as q")
            jumped = hot_join(parent, "p", up, "x").select("a", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") < F.col("p")).alias("moved"))
            jumped = written(jumped, "parents")
            parent = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        of = lambda end: parent.select(F.col("a").alias(f"{end}_v"), F.col("p").alias(f"{end}_p"))
        used = WRITTEN[mark:]
        label = written(hot_join(label, "comp", of("l"), "l_v").select("v", F.coalesce("l_p", "comp").alias("comp")), "labels")
        edges = written(hot_join(edges, "a", of("s"), "s_v", "inner").select("b", F.col("s_p").alias("a")), "links")
        half = WRITTEN[-1]
        edges = written(hot_join(edges, "b", of("t"), "t_v", "inner").select("a", F.col("t_p").alias("b")).where("a <> b").distinct(), "links")
        drop_written(spark, list(dict.fromkeys([*old, *used, half])))
    return label
