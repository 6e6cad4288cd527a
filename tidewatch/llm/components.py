"""Connected components of a table of links, by large-star and small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_least, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large) or smaller (not large) neighbours, and itself, to its smallest."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = with_least(both, "a", "b", "m", "n").withColumn("m", F.least("a", "m"))
    moved = joined.filter("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(joined.select("a", F.col("m").alias("b")).distinct())
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in ``links`` (a, b); self-links and repeated links do no harm."""
    links = written(links.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "links")
    while True:
        new = written(_star(_star(links, True), False), "links")
        before, after = (d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first() for d in (links, new))
        links = new
        if tuple(before) == tuple(after):
            return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
