"""Greatest positions of groups and low ones matched to them, without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.operators.ranks import cumulated
from auditframe.sources.scratch import saved


def hotspot_controls(df: DataFrame, group: str, pos: str, value: str, letter: str | None = None, *, hotspots: int = 5, controls: int = 5, quantile: float = 0.5, strict: bool = True) -> DataFrame:
    """The greatest positions of each group, and low ones matched to them one by one.

    Hotspots are the ``hotspots`` greatest values, at most half of the group and at least one, ties by position. Controls
    come from the other positions up to the value at ``quantile`` (the upper one of two), or, where fewer than ``controls``
    of these are left, from all others. Hotspot by hotspot, from the greatest, takes the nearest control left, of its own
    letter if there is any, ties to the smaller position.

    Returned are ``group``, ``pos``, ``kind`` ("hotspot" or "control"), ``value``, its ``rank`` in the group from the greatest,
    the share ``quantile`` of the group that isn't before it, the hotspot ``matched`` to it (a hotspot's own), whether the
    letters agree (null without ``letter``; a null letter agrees with none), and how far ``apart`` they are. Positions are
    unique in a group; rows with a null group, position or value don't count. A group of one position is an error,
    or without rows if not ``strict``.

    A group is never in one task: a control for one of k hotspots is among the k nearest of its letter or of the other
    letters, so tasks keep that many before anything is shuffled.
    """
    named = F.col(letter) if letter else F.lit(None).cast("string")
    rows = df.select(F.col(group).alias("g"), F.col(pos).alias("at"), F.col(value).alias("x"), named.alias("l")).where("g IS NOT NULL AND at IS NOT NULL AND x IS NOT NULL")

    counts = cumulated(rows.select("g", "x", F.lit(1).alias("n")), "x", ["n"], ["g"])
    size = F.sum("n").cast("long")
    checked = F.when(size > 1, size).otherwise(F.raise_error(F.lit("a group of one position has no control")).cast("long")) if strict else size
    sizes = counts.groupBy("g").agg(checked.alias("size")).where("size > 1")
    at_quantile = F.col("cum_n") >= F.ceil((F.col("size") - 1) * quantile) + 1
    cuts = counts.join(sizes, "g").where(at_quantile).groupBy("g", "size").agg(F.min("x").alias("cut"), F.min("cum_n").alias("low"))

    first = Window.partitionBy("g").orderBy(F.desc("x"), "at")
    top = rows.withColumn("no", F.row_number().over(first)).where(F.col("no") <= hotspots)
    top = top.join(cuts, "g").where(F.col("no") <= F.greatest(F.lit(1), F.floor(F.col("size") / 2)))
    own = F.struct("no", "at", "x", "l")
    hot = top.groupBy("g", "size", "cut").agg(F.array_sort(F.collect_list(own)).alias("hot"), (F.first("low") - F.sum((F.col("x") <= F.col("cut")).cast("int"))).alias("eligible"))
    enough = F.col("eligible") >= controls
    taken = F.least(F.lit(controls), F.size("hot"), F.when(enough, F.col("eligible")).otherwise(F.col("size") - F.size("hot"))).cast("int")
    hot = saved(hot.select("g", "size", "hot", F.when(enough, F.col("cut")).alias("cut"), taken.alias("taken")), "hotspots")

    last = F.element_at("hot", -1)
    after = (F.col("x") < last["x"]) | ((F.col("x") == last["x"]) & (F.col("at") > last["at"]))
    pool = rows.join(hot, "g").where(after & (F.col("cut").isNull() | (F.col("x") <= F.col("cut"))))
    each = pool.select("g", "at", "x", "l", F.explode(F.slice("hot", 1, F.col("taken"))).alias("h"))
    other = F.when(F.coalesce(F.col("l") == F.col("h")["l"], F.lit(False)), 0).otherwise(1)
    each = each.select("g", F.col("h")["no"].alias("no"), other.alias("other"), F.abs(F.col("at") - F.col("h")["at"]).alias("apart"), "at", "x")
    near = each.withColumn("place", F.row_number().over(Window.partitionBy("g", "no", "other").orderBy("apart", "at"))).where(F.col("place") <= controls)
    lists = near.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("no", "other", "apart", "at", "x"))).alias("near"))

    def take(done, no):
        free = F.filter("near", lambda c: (c["no"] == no) & ~F.exists(done, lambda d: d["at"] == c["at"]))
        return F.concat(done, F.slice(free, 1, 1))

    picked = hot.join(lists, "g").withColumn("picked", F.aggregate(F.sequence(F.lit(1), F.col("taken")), F.slice("near", 1, 0), take))
    picked = saved(picked.select("g", "size", "hot", "picked"), "hotspot-controls")

    def before(i):
        c = F.get("picked", i)
        return F.count_if((F.col("x") > c["x"]) | ((F.col("x") == c["x"]) & (F.col("at") < c["at"])))

    ranks = rows.join(picked.select("g", "picked"), "g").groupBy("g").agg(F.array(*(before(i) + 1 for i in range(controls))).alias("ranks"))
    found = picked.join(ranks, "g")
    greatest = found.select("g", "size", F.explode("hot").alias("h")).select("g", "size", "h.at", F.lit("hotspot").alias("kind"), "h.x", F.col("h.no").cast("long").alias("rank"), F.col("h.at").alias("matched"), F.lit(True).alias("same"), F.lit(0).alias("apart"))
    low = found.select("g", "size", "hot", "ranks", F.posexplode("picked").alias("i", "c")).select(
        "g", "size", "c.at", F.lit("control").alias("kind"), "c.x", F.get("ranks", F.col("i")).alias("rank"), F.get("hot", F.col("c.no") - 1)["at"].alias("matched"), (F.col("c.other") == 0).alias("same"), F.col("c.apart").alias("apart")
    )
    same = F.col("same") if letter else F.lit(None).cast("boolean")
    share = (F.col("size") - F.col("rank") + 1) / F.col("size")
    return greatest.unionByName(low).select(F.col("g").alias(group), F.col("at").alias(pos), "kind", F.col("x").alias("value"), "rank", share.alias("quantile"), "matched", same.alias("letter_matched"), "apart")
