"""Line dedup by site-relative frequency, in DataFrame operations only.

A page is a row, its site the host column. For each (host, line) the pages of the host that hold
the line are counted, each page once; a line goes from all pages of the host when that count
exceeds `ratio` of the host's pages and reaches `min_held`, so that in small hosts a line that one
or two pages hold is no boilerplate.

Lines travel as 64-bit hashes: the text itself is neither shuffled nor grouped. The count is
combined on the map side, so a line on a third of all pages costs one row per task. Counts are dealt
by host and line; the totals of hot hosts are broadcast to them (at most 1 / `HOT_SHARE` hosts), those
of others are joined. A host has at most (lines a page) / ratio boilerplate lines, so the list per
host is bounded whatever the host's size; the lists of all hosts are broadcast only when their
counted size is below `broadcast_hashes`, else those of hot hosts are broadcast and the rest joined.

Defined cases: null text stays null; a null host is no host and its pages keep all lines; blank
lines stay and are never counted; repeated rows are pages of their own; a count equal to
ratio * pages stays; an empty table gives an empty result; columns of the input named as outputs
(`n_lines`, `n_dropped`, in any case) are replaced, all others pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, table, written

#: On scale 0.1 ordinary lines are on at most 4.8 % of a host's pages, the site-wide line on 8.6 % to 13.2 %: the ratio lies in this gap.
RATIO, MIN_HELD = 0.065, 3


def _hash(line):
    return F.xxhash64(line)


def _blank(line):
    return F.trim(line) == ""


def _of_host(df: DataFrame, hosts: DataFrame, hot: list[str], how: str) -> DataFrame:
    """df (__host, ..) joined with hosts (__h, ..): hot hosts by a broadcast of their rows, the others by a shuffle."""
    on = lambda a, b: a.join(b, a["__host"] == b["__h"], how)
    if not hot:
        return on(df, hosts)
    is_hot = lambda c: F.coalesce(F.col(c).isin(hot), F.lit(False))
    return on(df.where(is_hot("__host")), F.broadcast(hosts.where(is_hot("__h")))).unionByName(on(df.where(~is_hot("__host")), hosts.where(~is_hot("__h"))))


def _totals(docs: DataFrame, host: str) -> tuple[DataFrame, list[str]]:
    """(__h, pages) of all hosts, and the hosts that hold so many pages that their rows should not meet in one task."""
    total = written(docs.where(F.col(host).isNotNull()).groupBy(F.col(host).cast("string").alias("__h")).agg(F.count(F.lit(1)).alias("pages")), "hosts")
    rows = total.agg(F.sum("pages")).first()[0] or 0
    return total, [r[0] for r in total.where(F.col("pages") > max(HOT_ROWS, HOT_SHARE * rows)).select("__h").collect()]  # at most 1 / HOT_SHARE


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_held: int = MIN_HELD) -> DataFrame:
    """(host, drop): for each host that has any, the hashes of its boilerplate lines."""
    return _boilerplate(docs, text, host, ratio, min_held, *_totals(docs, host)).withColumnRenamed("__host", "host")


def _boilerplate(docs, text, host, ratio, min_held, total, hot):
    pages = docs.select(F.col(host).cast("string").alias("__host"), F.col(text).alias("__text")).where(F.col("__host").isNotNull())
    lines = F.filter(F.split("__text", "\n", -1), lambda x: ~_blank(x))
    held = pages.select("__host", F.explode(F.array_distinct(F.transform(lines, _hash))).alias("line"))
    held = held.groupBy("__host", "line").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= max(1, min_held))
    held = written(held, "held") if hot else held
    over = _of_host(held, total, hot, "inner").where(F.col("held") > F.lit(float(ratio)) * F.col("pages"))
    return over.groupBy("__host").agg(F.collect_set("line").alias("drop"))


def drop_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, broadcast_hashes: int = 2_000_000, min_held: int = MIN_HELD) -> DataFrame:
    """docs with boilerplate lines taken from the text, and the counts n_lines and n_dropped (null for null text)."""
    total, hot = _totals(docs, host)
    found = written(_boilerplate(docs, text, host, ratio, min_held, total, hot).withColumnRenamed("__host", "__h"), "boilerplate")
    size = found.agg(F.sum(F.size("drop") + 8)).first()[0] or 0
    # the row as one column, so that no name of the input can clash
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(host).cast("string").alias("__host"))
    out = rows.join(F.broadcast(found), rows["__host"] == found["__h"], "left") if size <= broadcast_hashes else _of_host(rows, found, hot, "left")
    lines = F.split(F.col("__row")[text], "\n", -1)
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains("drop", _hash(x)))
    out = out.select("__row", lines.alias("__lines"), F.when(F.col("drop").isNull(), lines).otherwise(kept).alias("__kept"))
    n = lambda c: F.when(F.col("__row")[text].isNotNull(), F.size(c).cast("long"))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(
        *[(F.array_join("__kept", "\n") if c == text else F.col("__row")[c]).alias(c) for c in names],
        n("__lines").alias("n_lines"), (n("__lines") - n("__kept")).alias("n_dropped"),
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


OP3_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls, row_number() OVER () AS r FROM documents),
l AS (SELECT DISTINCT r, source, line FROM (SELECT r, source, unnest(ls) AS line FROM d) WHERE trim(line) <> '' AND source IS NOT NULL),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
c AS (SELECT source, line, count(*) AS held FROM l GROUP BY source, line),
b AS (SELECT c.source, list(c.line) AS drops FROM c JOIN t USING (source)
      WHERE c.held >= {MIN_HELD} AND c.held > CAST({RATIO} AS DOUBLE) * t.pages GROUP BY c.source),
k AS (SELECT d.doc_id, d.ls, CASE WHEN b.drops IS NULL THEN d.ls
      ELSE list_filter(d.ls, lambda x: trim(x) = '' OR NOT list_contains(b.drops, x)) END AS kept FROM d LEFT JOIN b ON d.source = b.source)
SELECT doc_id, CASE WHEN ls IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped FROM k
"""
