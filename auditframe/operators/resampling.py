"""Bootstrap, permutation and cross-validation from hashes: the same on any cluster, and in SQL.

A resample is a Poisson weight for each row and draw. Weights come from SHA-256 of seed, block and unit:
one digest gives eight numbers of 32 bits, so eight draws. No group is ever gathered; what is exploded is
one row a draw, summed by score before it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.operators.metrics import auroc, equal_bin, ratio
from auditframe.operators.ranks import cumulated, numbered

#: Cumulative probabilities of a Poisson variable of mean one, up to where 32 bits see no more.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(10)]


def uniform(digest: Column, place: int | Column) -> Column:
    """The number in [0, 1) of the ``place``-th eight hexadecimal digits."""
    start = F.lit(place) * 8 + 1 if isinstance(place, int) else place * 8 + 1
    return F.conv(F.substring(digest, start, F.lit(8)), 16, 10).cast("double") / 2**32


def weighted(df: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """``df`` once a draw with Poisson weight ``w``; rows of weight zero are left out."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(draws / 8) - 1)))
    dealt = df.withColumn("__block", blocks)
    dealt = dealt.withColumn("__digest", F.sha2(F.concat_ws(":", F.lit(seed), F.col("__block").cast("string"), F.col(unit).cast("string")), 256))
    u = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: uniform(F.col("__digest"), j))
    each = dealt.select(*df.columns, "__block", F.posexplode(u).alias("__j", "__u")).withColumn("draw", F.col("__block") * 8 + F.col("__j"))
    w = sum((F.when(F.col("__u") >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    return each.where(F.col("draw") < draws).withColumn("w", w).where("w > 0").drop("__block", "__j", "__u")


def weighted_auroc(df: DataFrame, label: str, p: str, keys: list[str]) -> DataFrame:
    """Area under the curve of weighted rows, ties counted half; null where a class has no weight."""
    pos, neg = F.when(F.col(label) == 1, F.col("w")).otherwise(0), F.when(F.col(label) == 1, 0).otherwise(F.col("w"))
    points = cumulated(df.select(*keys, F.col(p).alias("p"), pos.alias("pos"), neg.alias("neg")), "p", ["pos", "neg"], keys)
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    sums = points.groupBy(*keys).agg(F.sum(won).alias("won"), F.sum("pos").cast("double").alias("pos"), F.sum("neg").cast("double").alias("neg"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select(*keys, F.when(both, F.col("won") / F.when(both, F.col("pos") * F.col("neg"))).alias("value"))


def interval(values: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Percentile interval over draws that have a value, and their number."""
    found = values.where("value IS NOT NULL").groupBy(*(keys or []))
    return found.agg(F.count("*").alias("draws"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))


def bootstrap_auroc(df: DataFrame, unit: str, label: str, p: str, draws: int, seed: int = 0) -> DataFrame:
    """Interval of the area under the curve; draws with a single class are skipped."""
    return interval(weighted_auroc(weighted(df.select(unit, label, p), unit, draws, seed), label, p, ["draw"]))


def bootstrap_difference(df: DataFrame, unit: str, label: str, first: str, second: str, draws: int, seed: int = 0) -> DataFrame:
    """Interval of the difference of two scores' areas, both on the same resample."""
    rows = weighted(df.select(unit, label, first, second), unit, draws, seed)
    a, b = (weighted_auroc(rows, label, c, ["draw"]).withColumnRenamed("value", n) for c, n in ((first, "a"), (second, "b")))
    return interval(a.join(b, "draw").select("draw", (F.col("a") - F.col("b")).alias("value")))


def stratified_drop(df: DataFrame, unit: str, label: str, before: str, after: str, draws: int, seed: int = 0) -> DataFrame:
    """Interval of the drop in accuracy from one correctness flag to another, resampled within classes.

    Each class keeps its share of the rows, whatever weight it draws.
    """
    shares = df.groupBy(label).agg(F.count("*").alias("rows"))
    total = shares.agg(F.sum("rows").alias("all"))
    shares = shares.crossJoin(F.broadcast(total)).select(F.col(label), (F.col("rows") / F.col("all")).alias("share"))
    drop = F.col(before).cast("double") - F.col(after).cast("double")
    of_class = weighted(df.select(unit, label, drop.alias("drop")), unit, draws, seed).groupBy("draw", label).agg((F.sum(F.col("w") * F.col("drop")) / F.sum("w")).alias("mean"))
    classes = F.count("*").alias("classes")
    each = of_class.join(F.broadcast(shares), label).groupBy("draw").agg(F.sum(F.col("share") * F.col("mean")).alias("value"), classes)
    return interval(each.where("classes = 2"))


#: What ``bootstrap_metrics`` reports.
METRICS = ["prevalence", "mean_p", "predicted_positive", "accuracy", "balanced_accuracy", "sensitivity", "specificity", "fnr", "fpr", "f1", "mcc", "brier", "ece", "auroc", "average_precision"]


def stratified_metrics(df: DataFrame, unit: str, label: str, p: str, draws: int, seed: int = 0, threshold: float = 0.5) -> DataFrame:
    """``draw`` and all of ``METRICS`` on resamples within classes: a class has as many rows in a draw as in ``df``, whatever weight it drew.

    Draws that miss a class of ``df`` are left out. Where ``df`` has one class, what needs both is null. Rows without a label or score don't
    count. A draw's rows are summed by score before they are shuffled, and one cumulated pass over the scores gives every metric.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(p).isNotNull()).select(unit, F.col(label).alias("y"), F.col(p).cast("double").alias("p"))
    real = rows.agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") != 1).alias("zeros"))
    one = F.when(F.col("y") == 1, F.col("w")).otherwise(0)
    points = cumulated(weighted(rows, unit, draws, seed).select("draw", "p", one.alias("pos"), (F.col("w") - one).alias("neg")), "p", ["pos", "neg"], ["draw"], descending=True)
    drawn = points.groupBy("draw").agg(F.sum("pos").cast("double").alias("pw"), F.sum("neg").cast("double").alias("nw")).crossJoin(F.broadcast(real))
    whole = ((F.col("pw") > 0) | (F.col("ones") == 0)) & ((F.col("nw") > 0) | (F.col("zeros") == 0))
    drawn = drawn.where(whole).select("draw", "ones", "zeros", F.coalesce(ratio(F.col("ones"), F.col("pw")), F.lit(0.0)).alias("a"), F.coalesce(ratio(F.col("zeros"), F.col("nw")), F.lit(0.0)).alias("b"))
    a, b = F.col("a"), F.col("b")
    points = points.join(F.broadcast(drawn), "draw").select(
        "draw", "ones", "zeros", "p", (a * F.col("pos")).alias("pos"), (b * F.col("neg")).alias("neg"), (a * F.col("cum_pos")).alias("cum_pos"), (b * F.col("cum_neg")).alias("cum_neg")
    )
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("p")
    hit = score >= threshold
    sums = {
        "tp": F.when(hit, pos).otherwise(0.0), "fp": F.when(hit, neg).otherwise(0.0), "total_p": (pos + neg) * score, "square": pos * (1 - score) * (1 - score) + neg * score * score,
        "won": pos * (F.col("zeros") - F.col("cum_neg") + neg / 2), "gain": pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), "excess": pos - (pos + neg) * score,
    }
    bins = points.groupBy("draw", "ones", "zeros", equal_bin(score).alias("bin")).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    each = bins.groupBy("draw", "ones", "zeros").agg(*(F.sum(n).alias(n) for n in sums), F.sum(F.abs("excess")).alias("off"))
    ones, zeros, tp, fp = (F.col(c).cast("double") for c in ("ones", "zeros", "tp", "fp"))
    fn, tn, n = ones - tp, zeros - fp, ones + zeros
    sens, spec = ratio(tp, ones), ratio(tn, zeros)
    spread = F.sqrt(tp + fp) * F.sqrt(ones) * F.sqrt(zeros) * F.sqrt(tn + fn)
    values = {
        "prevalence": ones / n, "mean_p": F.col("total_p") / n, "predicted_positive": (tp + fp) / n, "accuracy": (tp + tn) / n, "balanced_accuracy": (sens + spec) / 2, "sensitivity": sens, "specificity": spec,
        "fnr": ratio(fn, ones), "fpr": ratio(fp, zeros), "f1": F.coalesce(ratio(2 * tp, tp + fp + ones), F.lit(0.0)), "mcc": F.coalesce(ratio(tp * tn - fp * fn, spread), F.lit(0.0)), "brier": F.col("square") / n, "ece": F.col("off") / n,
        "auroc": ratio(F.col("won"), ones * zeros), "average_precision": F.when(zeros > 0, ratio(F.col("gain"), ones)),
    }
    return each.select("draw", *(values[m].alias(m) for m in METRICS))


def bootstrap_metrics(df: DataFrame, unit: str, label: str, p: str, draws: int, seed: int = 0, threshold: float = 0.5) -> DataFrame:
    """``metric``, number of ``draws`` with a value, ``low`` and ``high`` of its percentile interval; metrics without any value are left out."""
    each = stratified_metrics(df, unit, label, p, draws, seed, threshold)
    return interval(each.unpivot(["draw"], METRICS, "metric", "value"), ["metric"])


def permuted_labels(df: DataFrame, unit: str, label: str, draws: int, seed: int = 0) -> DataFrame:
    """``df`` once a draw with ``label`` dealt anew: the rows of least hash get the ones."""
    ones = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("ones"))
    each = df.drop(label).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    each = each.withColumn("__key", F.sha2(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"), F.col(unit).cast("string")), 256))
    placed = numbered(each, "__key", unit, "__turn", ["draw"])
    return placed.crossJoin(F.broadcast(ones)).withColumn(label, (F.col("__turn") <= F.col("ones")).cast("int")).drop("__key", "__turn", "ones")


def label_permutation(df: DataFrame, unit: str, label: str, p: str, draws: int, seed: int = 0) -> DataFrame:
    """The area under the curve against its distribution under permuted labels: observed, mean, q025,
    q975 and p = (1 + number not smaller) / (draws + 1)."""
    null = auroc(permuted_labels(df.select(unit, label, p), unit, label, draws, seed), label, p, ["draw"])
    seen = auroc(df, label, p).withColumnRenamed("auroc", "observed")
    summary = null.crossJoin(F.broadcast(seen)).groupBy("observed").agg(
        F.avg("auroc").alias("mean"), F.percentile("auroc", 0.025).alias("q025"), F.percentile("auroc", 0.975).alias("q975"),
        ((F.sum((F.col("auroc") >= F.col("observed") - 1e-12).cast("int")) + 1) / (F.count("*") + 1)).alias("p"),
    )
    return summary


def hash_folds(df: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: groups are dealt by a keyed hash and never divided."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")), 256)
    return df.withColumn("fold", F.floor(uniform(digest, 0) * folds).cast("int"))


def _line(n: Column, x: Column, y: Column, xx: Column, xy: Column) -> tuple[Column, Column]:
    """Slope and intercept of least squares from sums; a constant x has slope 0."""
    spread = n * xx - x * x
    slope = F.when(F.abs(spread) > 1e-12, (n * xy - x * y) / F.when(F.abs(spread) > 1e-12, spread)).otherwise(0.0)
    return slope, (y - slope * x) / n


SUMS = ("n", "x", "y", "xx", "xy")


def _sums(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(a * b).alias("xy"))


def _moments(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Number, means, variance and covariance of rows that have both values: stable at any distance from zero."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.where(a.isNotNull() & b.isNotNull()).groupBy(*keys)
    return both.agg(F.count("*").cast("double").alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("vx"), F.covar_pop(a, b).alias("vxy"))


def out_of_fold(df: DataFrame, x: str, y: str, fold: str) -> DataFrame:
    """``df`` with ``predicted``: each row by the line fitted on the other folds.

    One pass takes every fold's moments; the others' sums, about the mean of all, are the total less the
    fold's own, so no model is fitted by reading rows again.
    """
    own = _moments(df, x, y, [fold])
    centre = own.agg((F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("cx"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("cy"))
    dx, dy, n = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy"), F.col("n")
    own = own.crossJoin(F.broadcast(centre)).select(fold, "cx", "cy", "n", (n * dx).alias("x"), (n * dy).alias("y"), (n * (F.col("vx") + dx * dx)).alias("xx"), (n * (F.col("vxy") + dx * dy)).alias("xy"))
    total = own.agg(*(F.sum(c).alias(f"t_{c}") for c in SUMS))
    rest = own.crossJoin(F.broadcast(total)).select(fold, "cx", "cy", *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in SUMS)).where("n > 0")
    slope, intercept = _line(*(F.col(c) for c in SUMS))
    lines = rest.select(fold, slope.alias("__slope"), (intercept + F.col("cy")).alias("__intercept"), F.col("cx").alias("__centre"))
    predicted = F.col("__slope") * (F.col(x) - F.col("__centre")) + F.col("__intercept")
    return df.join(F.broadcast(lines), fold, "left").withColumn("predicted", predicted).drop("__slope", "__intercept", "__centre")


def leave_one_out(df: DataFrame, x: str, y: str) -> DataFrame:
    """``df`` with ``predicted``: each row by the line fitted on all others, from total sums about the means."""
    total = _moments(df, x, y, []).select(*(F.col(c).alias(f"__{c}") for c in ("n", "mx", "my", "vx", "vxy")))
    a, b, n = F.col(x).cast("double") - F.col("__mx"), F.col(y).cast("double") - F.col("__my"), F.col("__n")
    slope, intercept = _line(n - 1, -a, -b, n * F.col("__vx") - a * a, n * F.col("__vxy") - a * b)
    return df.crossJoin(F.broadcast(total)).withColumn("predicted", slope * a + intercept + F.col("__my")).drop(*(f"__{c}" for c in ("n", "mx", "my", "vx", "vxy")))


def chosen_model(df: DataFrame, features: list[str], y: str, split: str) -> DataFrame:
    """The line that predicts ``y`` best on validation rows, fitted again on training and validation
    rows and tested once: feature, val_mse, test_mse. Ties go to the later name."""
    rows = df.select(split, F.col(y).cast("double").alias("y"), F.explode(F.create_map(*(c for f in features for c in (F.lit(f), F.col(f).cast("double"))))).alias("feature", "x"))

    def fitted(part: DataFrame) -> DataFrame:
        slope, intercept = _line(*(F.col(c) for c in SUMS))
        return _sums(part, "x", "y", ["feature"]).select("feature", slope.alias("slope"), intercept.alias("intercept"))

    def error(lines: DataFrame, on: DataFrame, name: str) -> DataFrame:
        off = F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")
        return on.join(F.broadcast(lines), "feature").groupBy("feature").agg(F.avg(off * off).alias(name))

    val = error(fitted(rows.where(F.col(split) == "train")), rows.where(F.col(split) == "val"), "val_mse")
    best = val.orderBy(F.round("val_mse", 9), F.desc("feature")).limit(1)
    again = rows.where(F.col(split) != "test").join(F.broadcast(best), "feature", "left_semi")
    return best.join(error(fitted(again), rows.where(F.col(split) == "test"), "test_mse"), "feature")


def shuffled_split(df: DataFrame, by: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """``by`` and ``split`` of each distinct value: values in hash order, cut at the shares."""
    values = df.select(F.col(by)).where(F.col(by).isNotNull()).distinct()
    keyed = values.withColumn("__key", F.sha2(F.concat_ws(":", F.lit(seed), F.col(by).cast("string")), 256))
    placed = numbered(keyed, "__key", by, "__turn").crossJoin(F.broadcast(values.agg(F.count("*").alias("__all"))))
    names = list(shares)
    ends = [round(sum(list(shares.values())[: i + 1]), 9) for i in range(len(names))]
    split = F.lit(names[-1])
    for name, end in reversed(list(zip(names[:-1], ends[:-1], strict=True))):
        split = F.when(F.col("__turn") <= F.col("__all") * end, name).otherwise(split)
    return placed.select(by, split.alias("split"))
