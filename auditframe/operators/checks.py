"""Constraints as queries of the rows that break them: an empty result passes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.operators import near_pairs
from auditframe.sources.scratch import saved


def enforce(violations: DataFrame, what: str) -> None:
    if (row := violations.first()) is not None:
        raise ValueError(f"{what}: {row}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", expect: str = "m:1") -> DataFrame:
    """A join whose sides are unique where ``expect`` ("1:1", "m:1", "1:m") says so."""
    a, b = expect.split(":")
    for side, df, one in (("left", left, a), ("right", right, b)):
        if one == "1":
            enforce(repeated_keys(df, on), f"keys of the {side} side repeat")
    return left.join(right, on, how)


def subset(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` lacks; a set of exclusions must be a subset of what it excludes from."""
    return a.join(b.select(*on), on, "left_anti")


def forbidden_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Columns that a feature view must not have, whatever their case."""
    lower = {n.lower() for n in names}
    return sorted(c for c in df.columns if c.lower() in lower)


def one_signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """Signatures beside the commonest (ties: the least), with their numbers."""
    counts = df.groupBy(*columns).count()
    usual = counts.orderBy(F.desc("count"), *columns).limit(1).select(*columns)
    same = [counts[c].eqNullSafe(usual[c]) for c in columns]
    return counts.join(F.broadcast(usual), same, "left_anti")


def tally(broken: dict[str, DataFrame]) -> DataFrame:
    """Rows that break each rule: check, rows. Rules are few."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("check"), "rows") for name, df in broken.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def plan_digest(plan: dict) -> str:
    """SHA-256 of a plan as canonical JSON, without a digest that it holds itself."""
    own = {k: v for k, v in plan.items() if k != "digest"}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def unchanged(plan: dict, rebuilt: dict) -> None:
    """An error if a plan's digest is wrong or a rebuilt plan is another one."""
    if plan.get("digest") != plan_digest(plan):
        raise ValueError("the plan was changed after its digest was made")
    if plan_digest(rebuilt) != plan["digest"]:
        raise ValueError("the plan can't be rebuilt: " + ", ".join(sorted(k for k in {*plan, *rebuilt} - {"digest"} if plan.get(k) != rebuilt.get(k))))


def registered_model(registry: dict, name: str, payload: bytes, features: list[str]) -> None:
    """An error unless a frozen model is registered with this checksum and these feature names in order."""
    if name not in registry:
        raise ValueError(f"{name} is not registered")
    if hashlib.sha256(payload).hexdigest() != registry[name]["sha256"]:
        raise ValueError(f"{name} has another checksum")
    if list(features) != list(registry[name]["features"]):
        raise ValueError(f"{name} was made for other features")


def crossing_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows in several splits."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def shared_between_classes(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that occur with both labels."""
    both = df.groupBy(key).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("ones"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("zeros"))
    return both.where("ones > 0 AND zeros > 0")


def changed_rows(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are missing, extra or have another value."""
    left, right = a.select(key, F.col(value).alias("was"), F.lit(True).alias("in_a")), b.select(key, F.col(value).alias("now"), F.lit(True).alias("in_b"))
    both = left.join(right, key, "full")
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(key, state.alias("state"), "was", "now").where("state IS NOT NULL")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, copies counted."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


#: Sets whose keys are broadcast; more are joined by a shuffle.
MOST_KEYS = 2_000_000


def near_duplicates(df: DataFrame, key: str, label: str, grams: str, least: float = 0.95) -> DataFrame:
    """Pairs of sets of different classes that have a cosine of at least ``least``.

    A set stands for all rows that have it: ``one`` and ``zero`` are their least keys, ``ones`` and
    ``zeros`` their numbers; copies are never expanded into pairs.

    Candidates come from signatures of parts of the sets (``near_pairs``), which miss no near pair, and are
    verified on the grams themselves.
    """
    sets = df.select(key, label, F.array_sort(F.array_distinct(grams)).alias("g"))
    # Each gram with its length before it: different sets have different texts, and a null set has none.
    digest = F.sha2(F.array_join(F.transform("g", lambda g: F.coalesce(F.concat(F.length(g).cast("string"), F.lit(":"), g), F.lit("-"))), ""), 256)
    sets = saved(sets.select(F.col(key).alias("member"), label, "g", digest.alias("digest"), F.array_distinct(F.transform("g", lambda g: F.xxhash64(g))).alias("h")), "sets")
    # Copies are counted by digests: no gram is shuffled but those of candidates.
    each = saved(sets.where(F.col(label).isin(0, 1) & (F.size("g") > 0)).groupBy("digest", label).agg(F.min("member").alias("member"), F.count("*").alias("copies")).drop("digest"), "sets")

    def some(rows: DataFrame, of: DataFrame, on: list[str]) -> DataFrame:
        return rows.join(F.broadcast(of) if of.count() <= MOST_KEYS else of, on)

    distinct = some(sets, each, ["member", label])
    # Empty sets go here: a filter before the table is saved would make the grams twice.
    side = {c: distinct.where((F.col(label) == c) & (F.size("g") > 0)).select(*(F.col(x).alias(f"{x}{c}") for x in ("member", "g", "h", "copies")), F.size("g").alias(f"n{c}")) for c in (1, 0)}
    pairs = near_pairs.candidates(*(side[c].select(F.col(f"member{c}").alias("member"), F.col(f"h{c}").alias("h")) for c in (1, 0)), least)
    pairs = saved(pairs.withColumnsRenamed({"a": "member1", "b": "member0"}), "candidates")
    side = {c: some(side[c], pairs.select(f"member{c}").distinct(), [f"member{c}"]) for c in (1, 0)}
    reached = F.sqrt(F.col("n1").cast("double") * F.col("n0")) * (least - 1e-12)
    # Hashes are compared first; grams of one set that share a hash count as found.
    found = F.size(F.array_intersect("h1", "h0")) + F.col("n1") - F.size("h1")
    likely = pairs.join(side[1].drop("g1", "copies1"), "member1").join(side[0].drop("g0", "copies0"), "member0").where(found >= reached).select("member1", "member0", "n1", "n0")
    whole = likely.join(side[1].select("member1", "g1", F.col("copies1").alias("ones")), "member1").join(side[0].select("member0", "g0", F.col("copies0").alias("zeros")), "member0")
    verified = whole.withColumn("shared", F.size(F.array_intersect("g1", "g0"))).where(F.col("shared") >= reached)
    verified = verified.withColumn("cosine", F.col("shared") / F.sqrt(F.col("n1").cast("double") * F.col("n0"))).withColumnsRenamed({"member1": "s1", "member0": "s0"})
    return verified.select(F.col("s1").alias("one"), F.col("s0").alias("zero"), "ones", "zeros", "cosine")


#: Representations and residue policies that metadata may name (fixed values).
REPRESENTATIONS = ["folding_trunk_s_s", "alphafold2_evoformer_single", "esm2_final_hidden_state"]
POLICIES = ["none", "U_to_X"]


def embedding_faults(catalog: DataFrame, metadata: DataFrame, width: int) -> DataFrame:
    """``id`` and ``fault`` of each entry of ``catalog`` (id, sequence): the first rule that its metadata breaks, null if none.

    Metadata has id, sequence_sha256, rows, width, dtype, model_id, model_revision, representation, output_dtype, policy and model_sequence_sha256; a null
    policy is "none", a null last digest the sequence's own. The last digest must be that of the sequence after the policy. An entry without metadata is "missing",
    with two it is "repeated"; metadata of no entry aren't looked at.
    """
    counted = metadata.groupBy("id").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in metadata.columns if c != "id"))
    rows = catalog.select("id", "sequence").join(counted.withColumnRenamed("width", "own_width"), "id", "left")
    policy = F.coalesce("policy", F.lit("none"))
    own = F.sha2("sequence", 256)
    read = F.when(policy == "U_to_X", F.translate("sequence", "U", "X")).otherwise(F.col("sequence"))
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rules = {
        "missing": F.col("copies").isNull(), "repeated": F.col("copies") > 1, "sequence digest": ~F.col("sequence_sha256").eqNullSafe(own), "shape": ~(F.col("rows").eqNullSafe(F.length("sequence")) & F.col("own_width").eqNullSafe(F.lit(width))),
        "dtype": ~F.col("dtype").eqNullSafe(F.lit("float32")), "model": empty("model_id") | empty("model_revision"), "representation": ~F.coalesce(F.col("representation").isin(REPRESENTATIONS), F.lit(False)),
        "output dtype": ~F.col("output_dtype").eqNullSafe(F.lit("float32")), "policy": ~policy.isin(POLICIES), "model digest": ~F.coalesce("model_sequence_sha256", own).eqNullSafe(F.sha2(read, 256)),
    }
    return rows.select("id", F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules.items())).alias("fault"))


def dataset_faults(df: DataFrame, label: str, split: str, group: str | None = None, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """``rule`` and number of breaches ``n`` of what a fixed split must keep.

    "columns" are missing ones (then nothing else is counted), "splits" values of ``split`` that aren't in ``splits`` or lack rows, null among them,
    "labels" rows whose label isn't 0 or 1, "classes" splits without both, "groups" groups in several splits (null groups don't count).
    """
    spark = df.sparkSession
    missing = [c for c in (label, split, group) if c is not None and c not in df.columns]
    if missing:
        return spark.createDataFrame([("columns", len(missing))], "rule string, n long")
    y = F.col(label)
    wrong = F.count_if(~F.coalesce(y.isin(0, 1), F.lit(False)))
    each = df.groupBy(F.col(split).cast("string").alias("split")).agg(wrong.alias("labels"), F.count_if(y == 0).alias("zeros"), F.count_if(y == 1).alias("ones"))
    known = F.coalesce(F.col("split").isin(*splits), F.lit(False))
    sums = each.agg(
        (F.count_if(~known) + len(splits) - F.count_if(known)).alias("splits"), F.coalesce(F.sum("labels"), F.lit(0)).alias("labels"),
        (len(splits) - F.count_if(known & (F.col("zeros") > 0) & (F.col("ones") > 0))).alias("classes"),
    )
    rules = ["splits", "labels", "classes"]
    if group is not None:
        crossing = df.where(F.col(group).isNotNull()).groupBy(group).agg((F.min(split) != F.max(split)).alias("crosses")).agg(F.count_if("crosses").alias("groups"))
        sums, rules = sums.crossJoin(F.broadcast(crossing)), [*rules, "groups"]
    return spark.createDataFrame([("columns", 0)], "rule string, n long").unionByName(sums.select(*(F.col(r).cast("long").alias(r) for r in rules)).unpivot([], rules, "rule", "n"))
