"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node (partial aggregates, so a hub is no hot spot) and an equi-join that AQE can
split; the links are written to the shared folder after each round and never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, save

#: Links in one file of a round.
ROWS = 200_000


def _large_star(e: DataFrame, near) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(near(least), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, near) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    to = down.join(near(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of its component, for every node with a link. Null ends and self-links are ignored."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")
    e = save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    now = e.agg(*state).first()
    while now.n:
        # a node's minimum for each node: a broadcast where the links, counted, are few
        near = F.broadcast if now.n * 48 <= BROADCAST_BYTES else lambda df: df
        e = save(_small_star(_large_star(e, near), near).where("u > v").distinct().coalesce(min(parts, 1 + now.n // ROWS)), "links")
        before, now = now, e.agg(*state).first()
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
