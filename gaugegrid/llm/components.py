"""Connected components of a graph given as a table of links, by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join; a node with very many links is one counted group and a join whose large side can be
split. The links of a round are written to the shared folder, so the plan stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugegrid.llm.common import discard, saved


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.select(F.count(F.lit(1)), total).first())


def components(links: DataFrame) -> DataFrame:
    """(u, root) of every node with a link to another: ``root`` is the smallest node it reaches. Links are (u, v), any direction."""
    now = saved(_small_star(links.where("u <> v").select("u", "v")))
    mark = _mark(now)
    while True:
        before, now = now, saved(_small_star(_large_star(now)))
        after = _mark(now)
        discard(before)
        if after == mark:
            break
        mark = after
    star = now.select("u", F.col("v").alias("root"))
    return star.unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
