"""Statistics of sparse activations against a target, with implicit zeros.

Activations are long: group, position, feature, value > 0. Zeros are never made. With weights that
add up to 1 in every group, sums over all (group, position) pairs of a feature need only its active
entries and constants of the groups: an inactive group has rank (L + 1) / (2 L) everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.operators.ranks import sparse_average_ranks
from auditframe.sources.scratch import saved


def top_k(vectors: DataFrame, keys: list[str], vec: str, k: int) -> DataFrame:
    """The ``k`` largest positive components of each vector: feature and activation."""
    entries = F.transform(vec, lambda x, i: F.struct((-x.cast("double")).alias("m"), i.alias("feature")))
    best = F.slice(F.array_sort(F.filter(entries, lambda e: e["m"] < 0)), 1, k)
    return vectors.select(*keys, F.explode(best).alias("e")).select(*keys, F.col("e.feature").alias("feature"), (-F.col("e.m")).alias("activation"))


def feature_summary(active: DataFrame, positions: DataFrame) -> DataFrame:
    """Mean over all positions, maximum, active count and density of each active feature."""
    total = positions.agg(F.count("*").alias("total"))
    sums = active.groupBy("feature").agg(F.sum("activation").alias("s"), F.max("activation").alias("max"), F.count("*").alias("active"))
    return sums.crossJoin(F.broadcast(total)).select("feature", (F.col("s") / F.col("total")).alias("mean"), "max", "active", (F.col("active") / F.col("total")).alias("density"))


def weighted_pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> dict[str, Column]:
    """Correlation and slope of y on x from weighted sums; null where a variance is 0."""
    vx, vy, cov = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n), sxy / n - (sx / n) * (sy / n)
    fine = (vx > 1e-15) & (vy > 1e-15)
    return {"pearson": F.when(fine, cov / F.sqrt(F.when(fine, vx * vy))), "slope": F.when(vx > 1e-15, cov / F.when(vx > 1e-15, vx))}


def association(active: DataFrame, targets: DataFrame, group: str, position: str, target: str) -> DataFrame:
    """Global and group-balanced Pearson correlation and slope of each feature with a target.

    ``targets`` has every position. Balanced: each position weighs 1 / L of its group.
    """
    sized = targets.withColumn("w", 1 / F.count("*").over(Window.partitionBy(group)))
    y = F.col(target)
    whole = sized.agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum("w").alias("wn"), F.sum(F.col("w") * y).alias("wsy"), F.sum(F.col("w") * y * y).alias("wsyy"))
    x, w = F.col("activation"), F.col("w")
    joined = active.join(sized.select(group, position, target, "w"), [group, position])
    sums = joined.groupBy("feature").agg(F.count("*").alias("active"), *(F.sum(e).alias(k) for k, e in {"sx": x, "sxx": x * x, "sxy": x * y, "wsx": w * x, "wsxx": w * x * x, "wsxy": w * x * y}.items()))
    sums = sums.crossJoin(F.broadcast(whole))
    c = F.col
    plain = weighted_pearson(c("n"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy"))
    balanced = weighted_pearson(c("wn"), c("wsx"), c("wsy"), c("wsxx"), c("wsyy"), c("wsxy"))
    return sums.select("feature", "active", *(v.alias(f"global_{k}") for k, v in plain.items()), *(v.alias(f"balanced_{k}") for k, v in balanced.items()))


def balanced_spearman(active: DataFrame, targets: DataFrame, group: str, position: str, target: str) -> DataFrame:
    """Group-balanced correlation of within-group percentile ranks of a feature and the target.

    Ranks are divided by L; a feature's rank where it is inactive in a group of k active positions is
    (L - k + 1) / 2. Sums over inactive groups are constants.
    """
    by_group = Window.partitionBy(group)
    ties = F.count("*").over(Window.partitionBy(group, target))
    ranked = targets.select(group, position, F.count("*").over(by_group).alias("L"), (F.rank().over(by_group.orderBy(target)) + (ties - 1) / 2).alias("r"))
    ranked = ranked.withColumn("y", F.col("r") / F.col("L")).withColumn("w", 1 / F.col("L"))
    centre = F.col("y") - (F.col("L") + 1) / (2 * F.col("L"))
    lengths = ranked.groupBy(group).agg(F.first("L").alias("L"), F.sum(F.col("w") * centre * centre).alias("wyy"))
    base = (F.col("L") + 1) / (2 * F.col("L"))
    whole = lengths.agg(F.count("*").cast("double").alias("groups"), F.sum(base).alias("sx"), F.sum(base * base).alias("sxx0"), F.sum("wyy").alias("syy"))
    own = sparse_average_ranks(active.select(group, "feature", position, "activation"), lengths.select(group, "L"), [group, "feature"], "activation")
    b, b0, delta = F.col("zero_rank") / F.col("L"), base, (F.col("rank") - F.col("zero_rank")) / F.col("L")
    joined = own.join(ranked.select(group, position, "y", "w"), [group, position])
    # k active entries of a group together hold the change of its constant part, once a group.
    change = (b * b - b0 * b0) / F.col("k") + F.col("w") * (2 * b * delta + delta * delta)
    sums = joined.groupBy("feature").agg(F.sum(change).alias("dxx"), F.sum(F.col("w") * delta * centre).alias("sxy"))
    sums = sums.crossJoin(F.broadcast(whole))
    n, mx = F.col("groups"), F.col("sx") / F.col("groups")
    vx, vy = (F.col("sxx0") + F.col("dxx")) / n - mx * mx, F.col("syy") / n
    return sums.select("feature", F.when((vx > 1e-15) & (vy > 1e-15), F.col("sxy") / n / F.sqrt(F.when((vx > 1e-15) & (vy > 1e-15), vx * vy))).alias("spearman"))


def feature_cosine(active: DataFrame, keys: list[str]) -> DataFrame:
    """Cosine of each pair of features over shared rows; pairs that share none are left out.

    A row has at most its K active features, so it yields at most K * K products.
    """
    row = active.groupBy(*keys).agg(F.collect_list(F.struct("feature", "activation")).alias("f"))
    pairs = row.select(F.explode("f").alias("a"), "f").select("a", F.explode("f").alias("b")).where("a.feature <= b.feature")
    dots = pairs.groupBy(F.col("a.feature").alias("left"), F.col("b.feature").alias("right")).agg(F.sum(F.col("a.activation") * F.col("b.activation")).alias("dot"))
    norm = dots.where("left = right").select(F.col("left").alias("f"), F.sqrt("dot").alias("norm"))
    out = dots.join(norm.select(F.col("f").alias("left"), F.col("norm").alias("nl")), "left").join(norm.select(F.col("f").alias("right"), F.col("norm").alias("nr")), "right")
    return out.where("left < right").select("left", "right", (F.col("dot") / (F.col("nl") * F.col("nr"))).alias("cosine"))


def permutation_null(active: DataFrame, targets: DataFrame, group: str, position: str, target: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """p = (1 + number of |null| >= |observed|) / (draws + 1) of the balanced covariance of each
    feature, the target being shuffled within groups in an order of seeded hashes."""
    by_group = Window.partitionBy(group)
    sized = targets.select(group, position, target, F.count("*").over(by_group).alias("L"), F.avg(target).over(by_group).alias("m"), F.row_number().over(by_group.orderBy(position)).alias("place"))
    # The planner doesn't reckon with the draws: left to it, all of them are broadcast through the driver.
    sized = saved(sized, "positions")
    drawn = sized.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    order = F.when(F.col("draw") == 0, F.lpad(F.col("place").cast("string"), 12, "0")).otherwise(F.sha2(F.concat_ws(":", F.lit(seed), "draw", group, position), 256))
    shuffled = drawn.withColumn("place", F.row_number().over(Window.partitionBy(group, "draw").orderBy(order))).select(group, "draw", "place", ((F.col(target) - F.col("m")) / F.col("L")).alias("y"))
    placed = active.join(sized.select(group, position, "place").hint("merge"), [group, position])
    stats = saved(placed.hint("merge").join(shuffled.hint("merge"), [group, "place"]).groupBy("feature", "draw").agg(F.abs(F.sum(F.col("activation") * F.col("y"))).alias("s")), "draw-sums")
    observed = stats.where("draw = 0").select("feature", F.col("s").alias("observed"))
    hits = stats.where("draw > 0").join(observed, "feature").groupBy("feature").agg(F.sum(F.when(F.col("s") >= F.col("observed") - 1e-12, 1).otherwise(0)).alias("hits"))
    return observed.join(hits, "feature").select("feature", "observed", ((F.col("hits") + 1) / (draws + 1)).alias("p"))
