"""Resolution of free names against a catalog: ranked candidates by shared tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions.text import LOWER, UPPER


def name_tokens(name: Column) -> Column:
    """Distinct words of letters A-Z, lower-cased, and digits, in order; none for null."""
    words = F.split(F.translate(F.coalesce(name, F.lit("")), UPPER, LOWER), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def _rare_first(classes: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """``tokens`` and ``token``: of each set of n, the n - ceil(least * n) + 1 that the catalog has least often.

    Tokens that the catalog lacks come first: they take places and meet nothing.
    """
    each = classes.select("tokens", F.explode("tokens").alias("token")).join(often, "token", "left")
    ordered = each.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))).alias("o"))
    n = F.size("o")
    first = F.slice("o", 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
    return ordered.select("tokens", F.explode(first).alias("o")).where("o.often > 0").select("tokens", F.col("o.token").alias("token"))


def candidates(queries: DataFrame, unit: str, query: str, catalog: DataFrame, entry: str, name: str, least: float = 0.5, top: int = 5) -> DataFrame:
    """``unit``, rank (from 1), candidate, similarity and exact: the first ``top`` catalog entries of each query.

    Similarity is the Jaccard similarity of the token sets, ``least`` and more; ties go to the smaller
    ``entry``. ``exact`` marks entries with the same tokens. A name without tokens, or without an entry so
    near, has no row.

    Names with the same tokens are resolved once, and entries with the same tokens are met as one: of them
    the first ``top`` can be wanted. Two sets reach ``least`` only if they share a token among the rarest
    of each, as many as may be missing and one more; frequent tokens join nothing in longer names.
    """
    asked = queries.select(F.col(unit).alias("unit"), name_tokens(F.col(query)).alias("tokens")).where(F.size("tokens") > 0)
    known = catalog.select(F.col(entry).alias("candidate"), name_tokens(F.col(name)).alias("known"))
    known = known.where((F.size("known") > 0) & F.col("candidate").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy("known").orderBy("candidate"))
    firsts = known.withColumn("place", place).where(F.col("place") <= top).drop("place")
    sets = known.select(F.col("known").alias("tokens")).distinct()
    often = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("often"))
    left = _rare_first(asked.select("tokens").distinct(), often, least)
    right = _rare_first(sets, often, least).withColumnRenamed("tokens", "known")
    shared = F.size(F.array_intersect("tokens", "known"))
    pairs = left.join(right, "token").select("tokens", "known").distinct().withColumn("shared", shared)
    both = F.size("tokens") + F.size("known") - F.col("shared")
    near = pairs.where(F.col("shared") >= both * least - 1e-9).select("tokens", "known", (F.col("shared") / both).alias("similarity"))
    ranked = near.join(firsts, "known")
    order = Window.partitionBy("tokens").orderBy(F.desc("similarity"), "candidate")
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    found = asked.join(best, "tokens")
    return found.select(F.col("unit").alias(unit), "rank", "candidate", "similarity", (F.col("similarity") == 1).alias("exact"))
