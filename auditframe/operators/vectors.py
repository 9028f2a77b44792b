"""Vectors in long form: pooling, bands of pairs, similarities and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long(vectors: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """A row for each component: keys, dim, x."""
    return vectors.select(*keys, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def pooled(components: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation and maximum of each component; pre-aggregated in each task."""
    return components.groupBy(*keys, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("max"))


def positioned(vectors: DataFrame, group: str, order: str) -> DataFrame:
    """Position from 0 in each group, and the group's length L."""
    own = Window.partitionBy(group)
    return vectors.select("*", (F.row_number().over(own.orderBy(order)) - 1).alias("pos"), F.count("*").over(own).alias("L"))


def segment(pos: Column, length: Column, segments: int) -> Column:
    """Number of the relative segment: segment k begins at floor(L * k / segments)."""
    return sum((F.when(pos >= F.floor(length * k / segments), 1).otherwise(0) for k in range(1, segments)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def band_pairs(placed: DataFrame, group: str, vec: str, widest: int) -> DataFrame:
    """Dot products of positions at most ``widest`` apart: an equality join on position."""
    left = placed.select(group, "pos", F.col(vec).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(widest))).alias("apart")).withColumn("other", F.col("pos") + F.col("apart"))
    right = placed.select(group, F.col("pos").alias("other"), F.col(vec).alias("b"))
    return left.join(right, [group, "other"]).select(group, "pos", "apart", dot(F.col("a"), F.col("b")).alias("dot"))


def all_pairs_mean(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean dot product over all pairs of different positions, from sums alone."""
    sums = long(vectors, [group], vec).groupBy(group, "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    whole = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("total"), F.max("n").alias("n"))
    return whole.select(group, F.when(F.col("n") > 1, F.col("total") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("mean"))


def pair_means(vectors: DataFrame, key: str, group: str, vec: str) -> DataFrame:
    """Mean dot product of each vector with all others of its group; null for a group of one."""
    parts = long(vectors, [key, group], vec)
    sums = parts.groupBy(group, "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    each = parts.join(sums, [group, "dim"]).groupBy(key, group).agg(F.sum(F.col("x") * (F.col("s") - F.col("x"))).alias("dot"), F.max("n").alias("n"))
    return each.select(key, group, F.when(F.col("n") > 1, F.col("dot") / F.when(F.col("n") > 1, F.col("n") - 1)).alias("mean"))


def band_moments(placed: DataFrame, group: str, vec: str, edges: list[int]) -> DataFrame:
    """Pairs, mean and population deviation of dot products for all pairs of a group, for separations up
    to each edge, and beyond the last; an empty band has zeros.

    Only pairs up to the last edge are made. The sum over all pairs is half of |s|**2 - sum |x|**2 with
    the vector sum s, the sum of squares half of |G|**2 - sum |x|**4 with the Gram matrix G of the
    components, and what lies beyond the last edge is the rest.
    """
    x = F.transform(vec, lambda v: v.cast("double"))
    rows = placed.select(group, x.alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    own = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(square).alias("q"), F.sum(square * square).alias("qq"))
    total = long(placed, [group], vec).groupBy(group, "dim").agg(F.sum("x").alias("s")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    products = rows.select(group, F.posexplode("x").alias("i", "a"), "x").select(group, "i", "a", F.posexplode("x").alias("j", "b"))
    gram = products.groupBy(group, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).groupBy(group).agg(F.sum(F.col("g") * F.col("g")).alias("gg"))
    whole = own.join(total, group).join(gram, group).select(group, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), ((F.col("ss") - F.col("q")) / 2).alias("s"), ((F.col("gg") - F.col("qq")) / 2).alias("t"))
    names = [f"{a + 1}-{b}" for a, b in zip([0, *edges], edges, strict=False)]
    name = F.lit(names[-1])
    for edge, n in reversed(list(zip(edges[:-1], names[:-1], strict=True))):
        name = F.when(F.col("apart") <= edge, n).otherwise(name)
    near = band_pairs(placed, group, vec, edges[-1]).groupBy(group, name.alias("band")).agg(F.count("*").alias("pairs"), F.sum("dot").alias("s"), F.sum(F.col("dot") * F.col("dot")).alias("t"))
    met = near.groupBy(group).agg(*(F.sum(c).alias(f"m_{c}") for c in ("pairs", "s", "t")))
    zero = F.lit(0)
    far = whole.join(met, group, "left").select(group, F.lit(f">{edges[-1]}").alias("band"), *((F.col(c) - F.coalesce(f"m_{c}", zero)).alias(c) for c in ("pairs", "s", "t")))
    every = near.unionByName(far).unionByName(whole.select(group, F.lit("global").alias("band"), "pairs", "s", "t"))
    bands = whole.select(group, F.explode(F.array(*map(F.lit, names))).alias("band")).join(near, [group, "band"], "left_anti")
    every = every.unionByName(bands.select(group, "band", zero.cast("long").alias("pairs"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t")))
    has = F.col("pairs") > 0
    mean = F.when(has, F.col("s") / F.when(has, F.col("pairs"))).otherwise(0.0)
    spread = F.when(has, F.col("t") / F.when(has, F.col("pairs"))).otherwise(0.0) - mean * mean
    return every.select(group, "band", "pairs", mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"))


def scalars(vectors: DataFrame, key: str, group: str, vec: str) -> DataFrame:
    """Norm, distance to the group's mean vector and cosine with it."""
    parts = long(vectors, [key, group], vec)
    means = parts.groupBy(group, "dim").agg(F.avg("x").alias("m"))
    both = parts.join(means, [group, "dim"])
    x, m = F.col("x"), F.col("m")
    sums = both.groupBy(key, group).agg(F.sqrt(F.sum(x * x)).alias("norm"), F.sqrt(F.sum((x - m) * (x - m))).alias("distance"), F.sum(x * m).alias("xm"), F.sqrt(F.sum(m * m)).alias("mm"))
    return sums.select(key, group, "norm", "distance", F.when(F.col("norm") * F.col("mm") > 0, F.col("xm") / F.when(F.col("norm") * F.col("mm") > 0, F.col("norm") * F.col("mm"))).alias("cosine"))


def linear_score(vectors: DataFrame, keys: list[str], vec: str, coefficients: DataFrame, intercept: float) -> DataFrame:
    """Intercept and sum of component times coefficient (``dim``, ``coef``)."""
    return long(vectors, keys, vec).join(coefficients, "dim").groupBy(*keys).agg((F.sum(F.col("x") * F.col("coef")) + intercept).alias("score"))


def reconstruction(components: DataFrame, approximation: Column, keys: list[str]) -> DataFrame:
    """Mean squared error and explained variance of an approximation of each component."""
    error = F.col("x") - approximation
    stats = components.groupBy(*keys).agg(F.avg(error * error).alias("mse"), F.var_pop("x").alias("variance"))
    return stats.withColumn("explained", F.when(F.col("variance") > 0, 1 - F.col("mse") / F.when(F.col("variance") > 0, F.col("variance")))).drop("variance")
