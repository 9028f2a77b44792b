"""Ranks, curves and adjustments over whole tables.

A window without partitions would send all rows to one task. Where a rank over a whole table is
needed, values are aggregated first and cumulated in two levels: inside stretches of the value range,
then over the stretches' totals, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCHES = 64


def stretched(df: DataFrame, value: str) -> DataFrame:
    """``df`` with a number ``stretch`` that rises with ``value``; equal values share one."""
    edges = df.select(F.percentile_approx(value, F.lit([i / STRETCHES for i in range(1, STRETCHES)]), F.lit(1000))).first()[0] or []
    edges = sorted({e for e in edges if e is not None})
    place = F.size(F.filter(F.lit(edges) if edges else F.array().cast("array<double>"), lambda e: e < F.col(value)))
    return df.withColumn("stretch", place)


def cumulated(df: DataFrame, value: str, sums: list[str], keys: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Running totals ``cum_*`` of ``sums`` up to and with each distinct ``value`` (one row each)."""
    keys = keys or []
    grouped = df.groupBy(*keys, value).agg(*(F.sum(s).alias(s) for s in sums))
    grouped = stretched(grouped, value)
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    within = Window.partitionBy(*keys, "stretch").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    inner = grouped.select("*", *(F.sum(s).over(within).alias(f"in_{s}") for s in sums))
    totals = grouped.groupBy(*keys, "stretch").agg(*(F.sum(s).alias(f"t_{s}") for s in sums))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "stretch", *(F.coalesce(F.sum(f"t_{s}").over(before), F.lit(0)).alias(f"b_{s}") for s in sums))
    # Null-safe, so that groups with a null key have ranks too; the right side's names are its own.
    other = totals.select(*(F.col(k).alias(f"__{k}") for k in (*keys, "stretch")), *(f"b_{s}" for s in sums))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, "stretch")]
    joined = inner.join(F.broadcast(other) if not keys else other, same)
    return joined.select(*keys, value, *sums, *((F.col(f"in_{s}") + F.col(f"b_{s}")).alias(f"cum_{s}") for s in sums))


def average_ranks(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Each distinct value with its number ``n`` and average rank ``rank`` within ``keys``."""
    counted = cumulated(df.withColumn("n", F.lit(1)), value, ["n"], keys)
    return counted.select(*(keys or []), value, "n", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("rank"))


def numbered(df: DataFrame, key: str, tie: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """``df`` with its row's place (from 1) within ``keys`` in the order of a hexadecimal hash ``key`` and ``tie``.

    Rows are numbered inside 4096 stretches of the hash, and the stretches' sizes are cumulated.
    """
    keys = keys or []
    placed = df.withColumn("__stretch", F.substring(key, 1, 3))
    own = F.row_number().over(Window.partitionBy(*keys, "__stretch").orderBy(key, tie))
    sizes = placed.groupBy(*keys, "__stretch").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "__stretch", before.alias("__before"))  # 4096 rows at most for each of keys
    starts = starts if keys else F.broadcast(starts)
    return placed.withColumn("__own", own).join(starts, [*keys, "__stretch"]).withColumn(out, F.col("__own") + F.col("__before")).drop("__own", "__before", "__stretch")


def rank_within(order: Column, *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order))


def top_n(df: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("place") <= n)


def top_fraction(df: DataFrame, fraction: float, keys: list[str], *order: Column) -> DataFrame:
    """Marks the first ceil(fraction * size) rows, one at least, of each group."""
    sizes = Window.partitionBy(*keys)
    ranked = df.select("*", F.row_number().over(sizes.orderBy(*order)).alias("place"), F.count("*").over(sizes).alias("size"))
    return ranked.withColumn("is_top", F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("size") * fraction)))


def sparse_average_ranks(active: DataFrame, lengths: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Average ranks of positive entries among L of which the rest are zeros, and the zeros' rank.

    ``lengths``: ``keys`` but the last, and L.
    """
    group = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    ranked = active.select("*", F.rank().over(group.orderBy(value)).alias("low"), ties.alias("ties"), F.count("*").over(group).alias("k"))
    joined = ranked.join(lengths, keys[:-1])
    rank = F.col("L") - F.col("k") + F.col("low") + (F.col("ties") - 1) / 2
    return joined.withColumn("rank", rank).withColumn("zero_rank", (F.col("L") - F.col("k") + 1) / 2).drop("low", "ties")


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] | None = None, out: str = "fdr") -> DataFrame:
    """Adjusted p-values: the least of p * n / rank from each rank on, 1 at most.

    Null p-values don't count and stay null. A p-value outside 0..1 or NaN is an error.
    """
    keys = keys or []
    checked = df.withColumn(p, F.when(F.col(p).isNull() | F.col(p).between(0, 1), F.col(p)).otherwise(F.raise_error(F.lit("a p-value is not in 0..1")).cast("double")))
    distinct = cumulated(checked.where(F.col(p).isNotNull()).withColumn("n", F.lit(1)), p, ["n"], keys)
    total = distinct.groupBy(*keys).agg(F.sum("n").alias("total"))
    raw = (distinct.join(total, keys) if keys else distinct.crossJoin(F.broadcast(total))).withColumn("raw", F.col(p) * F.col("total") / F.col("cum_n"))
    raw = stretched(raw, p)
    inside = Window.partitionBy(*keys, "stretch").orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    least = raw.groupBy(*keys, "stretch").agg(F.min("raw").alias("least"))
    after = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("stretch").rowsBetween(1, Window.unboundedFollowing)
    least = least.select(*keys, "stretch", F.min("least").over(after).alias("later"))
    done = raw.withColumn("own", F.min("raw").over(inside)).join(least, [*keys, "stretch"]).select(*keys, p, F.least(F.lit(1.0), "own", F.coalesce("later", F.lit(1.0))).alias(out))
    return checked.join(done, [*keys, p], "left")
