"""Connected components by alternating large and small stars.

Every round is two shuffles of the links, pre-aggregated; a component's links become a star around
its smallest id after a number of rounds that grows with the logarithm of its diameter. Links are
cut from their lineage in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import drop_saved, saved


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    around = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return around.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id that has a link to another.

    Links with a null end and links of an id to itself are ignored; direction and repetition don't
    matter. No link gives an empty frame.
    """
    edge = links.where(F.col(a) != F.col(b))
    edge = edge.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edge = saved(edge, "links")
    before = _state(edge)
    while before[0]:
        after_large = saved(_large_star(edge), "links")
        after = saved(_small_star(after_large), "links")
        drop_saved(edge)
        drop_saved(after_large)
        edge, now = after, _state(after)
        if now == before:
            break
        before = now
    return edge.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edge.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
