"""Splits, purges, samples and controls; seeds enter through hashes of keys."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.operators.ranks import cumulated, numbered

SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}


#: A group with more than this share of all rows is placed by itself; there are fewer than 1 / LARGE.
LARGE = 0.001


def _placed(groups: list, want: np.ndarray, seed: int, names: list[str]) -> tuple[dict[str, str], np.ndarray]:
    """The split of each large group, and the rows of each class that every split then has.

    A group goes where its classes are missed most: each class counts by its rows, times the share of
    the split's target that is open at the group's middle row. A keyed hash decides ties.
    """
    have, found = np.zeros_like(want), {}
    tie = {(g["group"], n): hashlib.blake2b(f"{seed}/{n}/{g['group']}".encode()).digest() for g in groups for n in names}
    for g in sorted(groups, key=lambda g: (-(g["zeros"] + g["ones"]), tie[g["group"], names[0]])):
        size = np.array([g["zeros"], g["ones"]], dtype=float)
        missed = ((want - have - size / 2) / np.maximum(want, 1)) @ size
        best = max(range(len(names)), key=lambda i: (round(float(missed[i]), 9), tie[g["group"], names[i]]))
        found[g["group"]] = names[best]
        have[best] += size
    return found, have


def grouped_split(df: DataFrame, group: str, label: str, seed: int = 42, splits: dict[str, float] = SPLITS) -> DataFrame:
    """``df`` with ``split``; groups are never divided, shares hold for rows and for both classes.

    The few large groups are placed first, largest first. All others are put in the order of a keyed
    hash, apart for groups with mostly one and mostly the other class, and cut where the running number
    of rows passes what the splits still miss of that class. Rows whose group is null stay without a split.
    """
    one = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    counts = df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("group")).agg((F.count("*") - one).alias("zeros"), one.alias("ones"))
    size, stratum = F.col("zeros") + F.col("ones"), (F.col("ones") > F.col("zeros")).cast("int")
    total = counts.agg(F.coalesce(F.sum("zeros"), F.lit(0)).alias("zeros"), F.coalesce(F.sum("ones"), F.lit(0)).alias("ones")).first()
    names, share = list(splits), np.array(list(splits.values()))
    want = share[:, None] * np.array([[total["zeros"], total["ones"]]], dtype=float)
    is_large = size > LARGE * (total["zeros"] + total["ones"])
    large, have = _placed(counts.where(is_large).collect(), want, seed, names)
    small = counts.where(~is_large).select("group", size.alias("rows"), stratum.alias("stratum"), F.xxhash64(F.lit(seed), "group").alias("place"))
    of_stratum = {r["stratum"]: r["rows"] for r in small.groupBy("stratum").agg(F.sum("rows").alias("rows")).collect()}
    split = F.lit(None).cast("string")
    for c, rows in of_stratum.items():
        missed = np.maximum(want[:, c] - have[:, c], 0)
        ends = np.cumsum(missed / missed.sum() if missed.sum() else share) * rows
        own = F.lit(names[-1])
        for name, end in reversed(list(zip(names[:-1], ends[:-1], strict=True))):
            own = F.when(F.col("cum_rows") - F.col("rows") / 2 <= float(end), name).otherwise(own)
        split = F.when(F.col("stratum") == c, own).otherwise(split)
    positions = cumulated(small, "place", ["rows"], ["stratum"]).select("place", "stratum", split.alias("split"))
    found = small.join(positions, ["place", "stratum"]).select("group", "split")
    if large:
        found = found.unionByName(df.sparkSession.createDataFrame(list(large.items()), "group string, split string"))
    found = found.withColumnRenamed("group", "__group")
    return df.join(found, F.col(group).cast("string") == F.col("__group"), "left").drop("__group")


def held_out_source(df: DataFrame, source: str, value: str, group: str) -> DataFrame:
    """``df`` with ``split``: rows of one source are the test set, others of its groups are purged."""
    tested = df.where(F.col(source) == value).select(group).distinct().withColumn("hit", F.lit(True))
    return df.join(tested, group, "left").withColumn("split", F.when(F.col(source) == value, "test").when(F.col("hit"), "purged").otherwise("development")).drop("hit")


def hash_sample(df: DataFrame, keys: list[str], unit: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each group, in the order of a seeded hash."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(unit).cast("string")), 256)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, unit))).where(F.col("place") <= n).drop("place")


def decile_controls(df: DataFrame, unit: str, value: str, chosen: str, seed: int) -> DataFrame:
    """For each chosen row a control of its decile of ``value``, by hash order, none used twice.

    Chosen rows without a control left in their decile get one from what remains, by hash order.
    """
    edges = df.select(F.percentile(value, [i / 10 for i in range(11)])).first()[0]
    inner = sorted(set(edges))[1:-1]
    decile = F.size(F.filter(F.lit(inner) if inner else F.array().cast("array<double>"), lambda e: e < F.col(value)))
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(unit).cast("string")), 256)
    placed = df.select(unit, chosen, decile.alias("decile")).withColumn("turn", F.row_number().over(Window.partitionBy("decile", chosen).orderBy(order, unit)))
    want = placed.where(chosen).select(F.col(unit).alias("chosen_id"), "decile", "turn")
    have = placed.where(~F.col(chosen)).select(F.col(unit).alias("control_id"), "decile", "turn")
    first = want.join(have, ["decile", "turn"], "left")
    by_hash = lambda c: F.sha2(F.concat_ws(":", F.lit(seed), F.lit("rest"), F.col(c).cast("string")), 256)
    need = numbered(first.where("control_id IS NULL").select("chosen_id", "decile", by_hash("chosen_id").alias("key")), "key", "chosen_id", "turn")
    spare = numbered(have.join(first.select("control_id"), "control_id", "left_anti").select("control_id", by_hash("control_id").alias("key")), "key", "control_id", "turn")
    rest = need.join(spare.select("control_id", "turn"), "turn", "left").select("chosen_id", "decile", "control_id")
    return first.where("control_id IS NOT NULL").select("chosen_id", "decile", "control_id").unionByName(rest)


def median_impute(df: DataFrame, columns: list[str], train) -> DataFrame:
    """Nulls replaced by the training rows' exact median, and ``has_*`` flags."""
    medians = df.where(train).agg(*(F.percentile(c, 0.5).alias(f"m_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(medians))
    for c in columns:
        out = out.withColumn(f"has_{c}", F.col(c).isNotNull()).withColumn(c, F.coalesce(F.col(c).cast("double"), f"m_{c}")).drop(f"m_{c}")
    return out
