"""Scores: discounts of ``lineitem`` as probabilities with many ties, return flag R as label 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators import metrics
from auditframe.operators.ranks import benjamini_hochberg
from auditframe.plans.registry import query, six, sql_six, table

SCORED = "(SELECT (l_returnflag = 'R')::INT AS y, l_discount * 10 AS p, l_linestatus AS s, l_linenumber AS seed, l_returnflag AS flag, l_orderkey, l_quantity AS q FROM lineitem)"
#: Distinct scores from the highest down with cumulative counts.
POINTS = f"""(SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS total, sum(n) OVER () AS size
    FROM (SELECT p, sum(y) AS pos, count(*) AS n FROM {SCORED} GROUP BY p))"""
RANKED = f"(SELECT s, y, p, rank() OVER (PARTITION BY s ORDER BY p) + (count(*) OVER (PARTITION BY s, p) - 1) / 2.0 AS r FROM {SCORED})"
EDGES = "[0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]"
BIN = f"least(len(list_filter({EDGES}, lambda e: e <= p)), 9)"


def scored(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"), F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("flag"), "l_orderkey", F.col("l_quantity").alias("q"))


@query(f"SELECT s, {sql_six('(sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::DOUBLE)')} AS auroc FROM {RANKED} GROUP BY s HAVING sum(y) > 0 AND sum(y) < count(*) UNION ALL SELECT s, NULL FROM {SCORED} GROUP BY s HAVING sum(y) = 0 OR sum(y) = count(*)")
def auroc_ties(spark, sf):
    return metrics.auroc(scored(spark, sf), "y", "p", ["s"]).select("s", six(F.col("auroc")).alias("auroc"))


@query(f"SELECT {sql_six('sum(pos / total * tp / seen)')} AS average_precision FROM {POINTS}")
def average_precision(spark, sf):
    return metrics.average_precision(scored(spark, sf), "y", "p").select(six(F.col("average_precision")).alias("average_precision"))


@query(f"SELECT {sql_six('coalesce(max(tp / total) FILTER (WHERE tp / seen >= 0.24), 0.0)')} AS recall_at_precision FROM {POINTS}")
def recall_at_precision(spark, sf):
    return metrics.recall_at_precision(scored(spark, sf), "y", "p", 0.24).select(six(F.col("recall_at_precision")).alias("recall_at_precision"))


@query(f"SELECT {sql_six('sum(n * abs(rate - mean)) / sum(n)')} AS ece FROM (SELECT {BIN} AS bin, count(*) AS n, avg(y) AS rate, avg(p) AS mean FROM {SCORED} GROUP BY ALL)")
def ece10(spark, sf):
    return metrics.calibration_error(scored(spark, sf), "y", "p").select(six(F.col("ece")).alias("ece"))


@query(f"""SELECT bin, count(*) AS n, {sql_six('avg(y)')} AS rate, {sql_six('avg(p)')} AS mean FROM {SCORED} JOIN (SELECT generate_series AS bin, ([0.0] || {EDGES})[generate_series + 1] AS lo, {EDGES}[generate_series + 1] AS hi FROM generate_series(0, 9)) ON p >= lo AND p <= hi GROUP BY bin""")
def reliability_closed_bins(spark, sf):
    return metrics.reliability(scored(spark, sf), "y", "p").select(F.col("bin").cast("long").alias("bin"), "n", six(F.col("rate")).alias("rate"), six(F.col("mean")).alias("mean"))


COUNTS = "count(*) AS n, sum(y) AS pos, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, avg((p - y) * (p - y)) AS brier"


@query(f"""WITH c AS (SELECT {COUNTS} FROM {SCORED}), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM {SCORED})
    SELECT n, {sql_six('pos / n')} AS prevalence, {sql_six('brier')} AS brier, {sql_six('(tp + tn) / n')} AS accuracy, {sql_six('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS balanced_accuracy, {sql_six('2 * tp / (2 * tp + fp + fn)')} AS f1,
    {sql_six('(tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc,
    (SELECT {sql_six('(sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::DOUBLE)')} FROM r) AS auroc, (SELECT {sql_six('sum(pos / total * tp / seen)')} FROM {POINTS}) AS average_precision FROM c""")
def binary_metrics(spark, sf):
    out = metrics.binary_metrics(scored(spark, sf), "y", "p")
    return out.select("n", *(six(F.col(c)).alias(c) for c in ("prevalence", "brier", "accuracy", "balanced_accuracy", "f1", "mcc", "auroc", "average_precision")))


@query(f"""SELECT seed, n, {sql_six('(tp + tn) / n')} AS accuracy, {sql_six('tp / nullif(tp + fn, 0)')} AS sensitivity, {sql_six('tn / nullif(tn + fp, 0)')} AS specificity, {sql_six('fn / nullif(tp + fn, 0)')} AS fnr, {sql_six('fp / nullif(tn + fp, 0)')} AS fpr, {sql_six('(tp + fp) / n')} AS predicted_positive
    FROM (SELECT seed, {COUNTS} FROM {SCORED} GROUP BY seed)""")
def metrics_by_stratum(spark, sf):
    out = metrics.binary_metrics(scored(spark, sf), "y", "p", ["seed"])
    return out.select("seed", "n", *(six(F.col(c)).alias(c) for c in ("accuracy", "sensitivity", "specificity", "fnr", "fpr", "predicted_positive")))


@query(f"""SELECT flag, n, {sql_six('tp / nullif(tp + fn, 0)')} AS sensitivity, {sql_six('tn / nullif(tn + fp, 0)')} AS specificity, {sql_six('m')} AS mean_p FROM (SELECT flag, {COUNTS}, avg(p) AS m FROM {SCORED} GROUP BY flag)""")
def one_class_metrics(spark, sf):
    out = metrics.binary_metrics(scored(spark, sf), "y", "p", ["flag"])
    return out.select("flag", "n", *(six(F.col(c)).alias(c) for c in ("sensitivity", "specificity", "mean_p")))


@query(f"SELECT p, {sql_six('seen / size')} AS seen, {sql_six('tp / total')} AS captured FROM {POINTS} WHERE tp > 0")
def capture_curve(spark, sf):
    return metrics.capture_curve(scored(spark, sf), "y", "p").where("captured > 0").select("p", six(F.col("seen")).alias("seen"), six(F.col("captured")).alias("captured"))


PREDICTED = "CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END"


@query(f"SELECT flag, guess, count(*) AS count, {sql_six('count(*) / sum(count(*)) OVER (PARTITION BY flag)')} AS share FROM (SELECT l_returnflag AS flag, {PREDICTED} AS guess FROM lineitem) GROUP BY flag, guess")
def confusion_normalized(spark, sf):
    guess = F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R")
    out = metrics.confusion(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), guess.alias("guess")), "flag", "guess")
    return out.select("flag", "guess", "count", six(F.col("share")).alias("share"))


@query(f"""WITH c AS (SELECT l_returnflag AS flag, {PREDICTED} AS guess FROM lineitem), k AS (SELECT flag AS class, avg((flag = guess)::INT) AS recall FROM c GROUP BY flag),
    f AS (SELECT class, 2 * count(*) FILTER (WHERE flag = class AND guess = class) / (count(*) FILTER (WHERE flag = class) + count(*) FILTER (WHERE guess = class)) AS f1 FROM c, (SELECT DISTINCT flag AS class FROM c) GROUP BY class)
    SELECT {sql_six('(SELECT avg((flag = guess)::INT) FROM c)')} AS accuracy, {sql_six('(SELECT avg(recall) FROM k)')} AS balanced_accuracy, {sql_six('(SELECT avg(f1) FROM f)')} AS macro_f1, {sql_six('(SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM c GROUP BY flag))')} AS majority""")
def multiclass_metrics(spark, sf):
    counts = confusion_normalized(spark, sf).select("flag", "guess", F.col("count").alias("n"))
    actual = counts.groupBy(F.col("flag").alias("class")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("flag") == F.col("guess"), F.col("n")).otherwise(0)).alias("hits"))
    guessed = counts.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("guessed"))
    each = actual.join(guessed, "class", "left")
    return each.agg(
        six(F.sum("hits") / F.sum("actual")).alias("accuracy"), six(F.avg(F.col("hits") / F.col("actual"))).alias("balanced_accuracy"),
        six(F.avg(2 * F.col("hits") / (F.col("actual") + F.coalesce("guessed", F.lit(0))))).alias("macro_f1"), six(F.max("actual") / F.sum("actual")).alias("majority"),
    )


P_VALUES = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_custkey * 7919 % 10007) / 10007.0::DOUBLE END AS p FROM orders)"


@query(f"""WITH r AS (SELECT id, p, p * (count(*) OVER ()) / rank AS raw FROM (SELECT id, p, count(*) OVER (ORDER BY p) AS rank FROM {P_VALUES} WHERE p IS NOT NULL))
    SELECT id, p, {sql_six('least(1.0, min(raw) OVER (ORDER BY p DESC))')} AS fdr FROM r UNION ALL SELECT id, p, NULL FROM {P_VALUES} WHERE p IS NULL""")
def bh_joint_missing(spark, sf):
    p = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") * 7919 % 10007) / F.lit(10007.0))
    out = benjamini_hochberg(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), p.alias("p")), "p")
    return out.select("id", "p", six(F.col("fdr")).alias("fdr"))
