"""Classification and calibration metrics with exact ties, for any number of groups at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.operators.ranks import cumulated

#: The ten-bin edges as they come out in binary arithmetic; p = 0.3 lies below the fourth edge.
EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)]


def equal_bin(p: Column) -> Column:
    """Left-closed tenth that holds ``p``; 1 is in the last."""
    return F.least(F.size(F.filter(F.lit(EDGES[1:]), lambda e: e <= p)), F.lit(9))


def rates(label: str, p: str, threshold: float = 0.5) -> dict[str, Column]:
    y, hit = F.col(label) == 1, F.col(p) >= threshold
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return {"n": F.count("*"), "tp": count(y & hit), "fp": count(~y & hit), "tn": count(~y & ~hit), "fn": count(y & ~hit), "positives": count(y)}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def auroc(df: DataFrame, label: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks; null if a class is missing."""
    keys = keys or []
    marked = df.select(*keys, p, F.when(F.col(label) == 1, 1).otherwise(0).alias("pos"), F.lit(1).alias("n"))
    for c in (*keys, p):
        marked = marked.where(F.col(c).isNotNull())
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    sums = cumulated(marked, p, ["pos", "n"], keys).groupBy(*keys).agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("pos"), F.sum("n").alias("size"))
    pos = F.col("pos").cast("double")
    neg = F.col("size") - pos
    return sums.select(*keys, ratio(F.col("r") - pos * (pos + 1) / 2, pos * neg).alias("auroc"))


def precision_recall(df: DataFrame, label: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """Precision and recall at each distinct score, from the highest down."""
    keys = keys or []
    marked = df.select(*keys, p, F.when(F.col(label) == 1, 1).otherwise(0).alias("pos"), F.lit(1).alias("all"))
    points = cumulated(marked, p, ["pos", "all"], keys, descending=True)
    totals = marked.groupBy(*keys).agg(F.sum("pos").alias("total"))
    points = points.join(totals, keys) if keys else points.crossJoin(F.broadcast(totals))
    return points.select(*keys, p, "pos", "all", "total", (F.col("cum_pos") / F.col("cum_all")).alias("precision"), ratio(F.col("cum_pos"), F.col("total")).alias("recall"))


def average_precision(df: DataFrame, label: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """Sum over distinct scores of the gain in recall times precision; null without positives."""
    points = precision_recall(df, label, p, keys)
    return points.groupBy(*(keys or [])).agg(F.sum(ratio(F.col("pos"), F.col("total")) * F.col("precision")).alias("average_precision"))


def recall_at_precision(df: DataFrame, label: str, p: str, least: float = 0.8, keys: list[str] | None = None) -> DataFrame:
    points = precision_recall(df, label, p, keys)
    return points.groupBy(*(keys or [])).agg(F.coalesce(F.max(F.when(F.col("precision") >= least, F.col("recall"))), F.lit(0.0)).alias("recall_at_precision"))


def calibration_error(df: DataFrame, label: str, p: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    bins = df.groupBy(*keys, equal_bin(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"), F.avg(p).alias("mean"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, label: str, p: str) -> DataFrame:
    """Bins closed at both ends: a value on an inner edge counts in two bins."""
    bins = F.explode(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda b: (F.lit(EDGES)[b] <= F.col(p)) & (F.col(p) <= F.lit(EDGES)[b + 1])))
    return df.select(bins.alias("bin"), label, p).groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"), F.avg(p).alias("mean"))


def binary_metrics(df: DataFrame, label: str, p: str, keys: list[str] | None = None, threshold: float = 0.5, measures: list[str] | None = None) -> DataFrame:
    """One pass for what a confusion matrix gives; ranks and curves are joined to it.

    ``measures``: those that are wanted, all if None. Ranks and curves that nobody wants aren't worked out.
    """
    keys = keys or []
    y = F.col(label).cast("double")
    base = df.groupBy(*keys).agg(*(c.alias(k) for k, c in rates(label, p, threshold).items()), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), F.avg(p).alias("mean_p"))
    # In doubles: products of four counts leave the longs from some hundred thousand rows on.
    tp, fp, tn, fn, n = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn", "n"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    margins = [tp + fp, tp + fn, tn + fp, tn + fn]
    mcc = (tp * tn - fp * fn) / F.when(F.least(*margins) > 0, F.sqrt(margins[0]) * F.sqrt(margins[1]) * F.sqrt(margins[2]) * F.sqrt(margins[3])).otherwise(1.0)
    out = base.select(
        *keys, "n", ratio(F.col("positives"), n).alias("prevalence"), "brier", ((tp + tn) / n).alias("accuracy"), ((F.coalesce(sens, spec) + F.coalesce(spec, sens)) / 2).alias("balanced_accuracy"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), mcc.alias("mcc"), sens.alias("sensitivity"), spec.alias("specificity"), ratio(fn, tp + fn).alias("fnr"), ratio(fp, tn + fp).alias("fpr"), ratio(tp + fp, n).alias("predicted_positive"), "mean_p",
    )
    curves = {"auroc": auroc, "average_precision": average_precision, "ece": calibration_error, "recall_at_precision": recall_at_precision}
    for name, curve in curves.items():
        if measures is None or name in measures:
            extra = curve(df, label, p, keys=keys)
            out = out.join(extra, keys) if keys else out.crossJoin(F.broadcast(extra))
    return out if measures is None else out.select(*keys, *measures)


def capture_curve(df: DataFrame, label: str, p: str) -> DataFrame:
    """Share of rows seen and of positives captured at each distinct score, from the highest down."""
    points = precision_recall(df, label, p)
    size = df.select(F.count("*").alias("size"))
    return points.crossJoin(F.broadcast(size)).select(p, (F.col("recall") * F.col("total") / F.col("precision") / F.col("size")).alias("seen"), F.col("recall").alias("captured"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of each pair of classes, and their share of the actual class."""
    counts = df.groupBy(actual, predicted).count()
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(actual)))


def one_vs_rest(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Mean over classes of the area of each class's probability against all others, and the mean log loss.

    ``df`` has a column of probabilities for each class. Classes without rows on both sides are left out
    of the mean.
    """
    long = df.select(label, F.explode(F.create_map(*(c for k in classes for c in (F.lit(k), F.round(F.col(k), 9))))).alias("class", "p"))
    areas = auroc(long.select("class", "p", (F.col(label) == F.col("class")).cast("int").alias("y")), "y", "p", ["class"])
    own = F.coalesce(*(F.when(F.col(label) == k, F.col(k)) for k in classes))
    loss = df.agg(F.avg(-F.ln(F.greatest(own, F.lit(1e-15)))).alias("log_loss"))
    return areas.agg(F.avg("auroc").alias("macro_auroc")).crossJoin(F.broadcast(loss))
