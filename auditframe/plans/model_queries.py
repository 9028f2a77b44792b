"""Folds, fitted models, calibration and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators import metrics, models
from auditframe.plans.registry import query, six, sql_six, table
from auditframe.sources.scratch import saved

FOLDS_SQL = """c AS (SELECT o_custkey AS g, o_orderstatus AS y, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT g, sum(n)::BIGINT AS size, arg_max(y, (n, y)) AS cls FROM c GROUP BY g), k AS (SELECT o_orderstatus AS cls, count(*) AS total FROM orders GROUP BY ALL),
    p AS (SELECT g, cls, (2 * sum(size) OVER (PARTITION BY cls ORDER BY sha256('11:' || g), g) - size)::BIGINT AS middle, sum(size) OVER (PARTITION BY cls)::BIGINT AS whole FROM g),
    folds AS (SELECT g, least(4, len(list_filter([1, 2, 3, 4, 5], lambda f: f * total <= middle * (5 * total) / (2.0::DOUBLE * whole))))::INT AS fold FROM p JOIN k USING (cls))"""


def order_folds(spark, sf):
    orders = table(spark, sf, "orders")
    return orders, models.stratified_group_folds(orders, "o_custkey", "o_orderstatus", 5, 11, large=0.1)


@query(f"WITH {FOLDS_SQL} SELECT fold, o_orderstatus AS status, count(*) AS n, count(DISTINCT g) AS customers FROM orders JOIN folds ON g = o_custkey GROUP BY ALL")
def stratified_folds(spark, sf):
    """Customers dealt whole to five folds with even shares of every order status."""
    orders, folds = order_folds(spark, sf)
    joined = orders.join(folds, "o_custkey")
    return joined.groupBy("fold", F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


PENALTIES = [models.Penalty("l2", 0.01), models.Penalty("l2", 1.0)]


def newton_sql(steps: int = 9) -> str:
    """CTEs that fit two-feature models on the other folds by Newton steps from zero; ``w{steps}`` has the coefficients."""
    z = "z0, z1, z2"
    out = f"""{FOLDS_SQL}, d AS (SELECT o_orderkey, fold, (o_orderstatus = 'O')::INT AS y, ln(o_totalprice) AS x1, (o_orderkey % 13 + 3 * (o_orderstatus = 'O')::INT)::DOUBLE AS x2 FROM orders JOIN folds ON g = o_custkey),
    tr AS (SELECT m.fold AS own, d.* FROM d JOIN (SELECT DISTINCT fold FROM folds) m ON m.fold <> d.fold),
    st AS (SELECT own, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, count(*) / (2.0::DOUBLE * sum(y)) AS pos, count(*) / (2.0::DOUBLE * sum(1 - y)) AS neg FROM tr GROUP BY own),
    zs AS (SELECT own, 1.0::DOUBLE AS z0, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, y, CASE WHEN y = 1 THEN pos ELSE neg END AS s FROM tr JOIN st USING (own)),
    w0 AS (SELECT own, c, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM st, (SELECT unnest([0.01, 1.0])::DOUBLE AS c))"""
    for k in range(steps):
        terms = [f"sum(s * (p - y) * z{i}) + {'0' if i == 0 else f'any_value(b{i}) / c'} AS g{i}" for i in range(3)]
        terms += [f"sum(s * p * (1 - p) * z{i} * z{j}) + {f'1 / c' if i == j and i else '0'} AS h{i}{j}" for i in range(3) for j in range(i, 3)]
        det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
        move = [
            "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2))",
            "(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02))",
            "(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02))",
        ]
        out += f""", s{k} AS (SELECT own, c, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {", ".join(terms)} FROM (SELECT zs.own, {z}, y, s, c, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS p FROM zs JOIN w{k} ON zs.own = w{k}.own) GROUP BY own, c),
    w{k + 1} AS (SELECT own, c, {", ".join(f"b{i} - {move[i]} / {det} AS b{i}" for i in range(3))} FROM s{k})"""
    return out + f""", fits AS (SELECT own AS fold, 'logistic_l2_C' || CASE WHEN c < 0.5 THEN '0.01' ELSE '1.0' END AS candidate, b1 / s1 AS c1, b2 / s2 AS c2, b0 - b1 / s1 * m1 - b2 / s2 * m2 AS intercept FROM w{steps} JOIN st USING (own))"""


def labelled_orders(spark, sf):
    orders, folds = order_folds(spark, sf)
    y = (F.col("o_orderstatus") == "O").cast("int")
    return orders.join(folds, "o_custkey").select("o_orderkey", "fold", y.alias("y"), F.ln("o_totalprice").alias("x1"), (F.col("o_orderkey") % 13 + 3 * y).cast("double").alias("x2"))


@query(f"WITH {newton_sql()} SELECT fold, candidate, {sql_six('intercept')} AS intercept, {sql_six('c1')} AS c1, {sql_six('c2')} AS c2 FROM fits")
def penalised_folds(spark, sf):
    """Coefficients of balanced logistic models for each fold and penalty, all fitted together."""
    fits = models.logistic_folds(labelled_orders(spark, sf), ["x1", "x2"], "y", "fold", PENALTIES)
    return fits.select("fold", "candidate", six(F.col("intercept")).alias("intercept"), *(six(F.col("coefficients")[i]).alias(f"c{i + 1}") for i in range(2)))


@query(f"""WITH {newton_sql()}, o AS (SELECT candidate, fold, y, 1 / (1 + exp(-(intercept + c1 * x1 + c2 * x2))) AS p FROM d JOIN fits USING (fold)), r AS (SELECT *, rank() OVER (PARTITION BY candidate, fold ORDER BY p) + (count(*) OVER (PARTITION BY candidate, fold, p) - 1) / 2.0::DOUBLE AS r FROM o),
    a AS (SELECT candidate, fold, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) AS auroc FROM r GROUP BY ALL), f AS (SELECT candidate, avg(auroc) AS m, stddev_pop(auroc) AS s FROM a GROUP BY candidate)
    SELECT candidate, count(*) AS n, round(avg((p - y) ** 2), 5) AS brier, round(avg(((p >= 0.5)::INT = y)::INT), 4) AS accuracy, round(any_value(m), 4) AS cv_mean, round(any_value(s), 4) AS cv_std FROM o JOIN f USING (candidate) GROUP BY candidate""")
def cv_candidates(spark, sf):
    """Out-of-fold metrics of each fixed candidate, and its area's mean and deviation over the folds."""
    _, report = models.cross_validated(labelled_orders(spark, sf), ["x1", "x2"], "y", "fold", PENALTIES, measures=["n", "brier", "accuracy"])
    return report.select("candidate", "n", F.round("brier", 5).alias("brier"), *(F.round(c, 4).alias(c) for c in ("accuracy", "cv_mean", "cv_std")))


def platt_sql(steps: int = 9) -> str:
    out = """s AS (SELECT l_orderkey % 2 AS half, ln(greatest(l_quantity, 1) / greatest(51 - l_quantity, 1)) AS x, (l_returnflag = 'R')::INT AS y FROM lineitem), t AS (SELECT x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS ones FROM s WHERE half = 0 GROUP BY x), w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"""
    for k in range(steps):
        out += f""", q{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((n * p - ones) * x) + any_value(a) AS g1, sum(n * p - ones) AS g0, sum(n * p * (1 - p) * x * x) + 1 AS h11, sum(n * p * (1 - p) * x) AS h10, sum(n * p * (1 - p)) AS h00 FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS p FROM t, w{k})),
    w{k + 1} AS (SELECT a - (g1 * h00 - g0 * h10) / (h11 * h00 - h10 * h10) AS a, b - (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) AS b FROM q{k})"""
    return out


def ece_sql(p: str) -> str:
    return f"(SELECT sum(n * abs(rate - mean)) / sum(n) FROM (SELECT least(floor({p} * 10 + 1e-12), 9) AS bin, count(*) AS n, avg(y) AS rate, avg({p}) AS mean FROM c GROUP BY bin))"


@query(f"""WITH {platt_sql()}, c AS (SELECT y, 1 / (1 + exp(-x)) AS raw, 1 / (1 + exp(-(a * x + b))) AS fitted FROM s, w9 WHERE half = 1)
    SELECT {sql_six('a')} AS slope, {sql_six('b')} AS intercept, {sql_six(ece_sql('raw'))} AS ece_before, {sql_six(ece_sql('fitted'))} AS ece_after FROM w9""")
def calibrated_scores(spark, sf):
    """A score calibrated on one half of the rows, and its calibration error on the other before and after."""
    q = F.col("l_quantity")
    logit = F.ln(F.greatest(q, F.lit(1.0)) / F.greatest(51 - q, F.lit(1.0)))
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 2).alias("half"), logit.alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    slope, intercept = models.platt(rows.where("half = 0"), "x", "y")
    other = rows.where("half = 1").select("y", (1 / (1 + F.exp(-F.col("x")))).alias("raw"), models.calibrated(F.col("x"), (slope, intercept)).alias("fitted"))
    before, after = (metrics.calibration_error(other, "y", p).withColumnRenamed("ece", n) for p, n in (("raw", "ece_before"), ("fitted", "ece_after")))
    both = before.crossJoin(F.broadcast(after))
    return both.select(F.lit(round(slope, 6)).alias("slope"), F.lit(round(intercept, 6)).alias("intercept"), six(F.col("ece_before")).alias("ece_before"), six(F.col("ece_after")).alias("ece_after"))


NEAR_SQL = """e AS (SELECT vec_id, label, vec_id % 5 = 0 AS test, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT vec_id, label, test, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS d FROM e),
    st AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM l WHERE NOT test GROUP BY d), z AS (SELECT vec_id, label, test, list((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY d) AS v FROM l JOIN st USING (d) GROUP BY ALL),
    n AS (SELECT a.vec_id AS q, b.vec_id AS o, b.label, list_distance(a.v, b.v) AS dist FROM z a JOIN z b ON a.test AND NOT b.test QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dist, b.vec_id) <= 31),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, o) AS rk FROM n),
    k AS (SELECT q, label, unnest([5, 15, 31]) AS k, rk, dist FROM r), f AS (SELECT *, min(dist) OVER (PARTITION BY q, k) = 0 AS exact FROM k WHERE rk <= k),
    v AS (SELECT q, k, label, sum(CASE WHEN k = 31 THEN 1 WHEN exact THEN (dist = 0)::INT ELSE 1 / dist END) AS w FROM f GROUP BY ALL)"""


@query(f"WITH {NEAR_SQL} SELECT q AS vec_id, k, arg_min(label, (-round(w, 7), label)) AS predicted, round(max(w) / sum(w), 5) AS share FROM v GROUP BY q, k")
def neighbour_classes(spark, sf):
    """Class of every fifth vector by its nearest standardised neighbours among the others: 5 and 15 by distance, 31 uniform, from one search."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 5 == 0).alias("test"), F.col("embedding").cast("array<double>").alias("v"))
    stats = e.where("NOT test").select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m", "s"))), lambda r: F.struct(r["m"].alias("m"), F.when(r["s"] > 0, r["s"]).otherwise(1.0).alias("s"))).alias("stats"))
    z = e.crossJoin(F.broadcast(stats)).withColumn("v", F.zip_with("v", "stats", lambda x, r: (x - r["m"]) / r["s"]))
    near = saved(models.nearest_neighbours(z.where("test"), z.where("NOT test"), "vec_id", "v", "label", 31), "neighbours")
    out = None
    for k, weights in ((5, "distance"), (15, "distance"), (31, "uniform")):
        votes = models.neighbour_votes(near, "vec_id", k, weights)
        best = votes.groupBy("vec_id").agg(F.min_by("label", F.struct(-F.round("share", 7), F.col("label"))).alias("predicted"), F.round(F.max("share"), 5).alias("share"))
        best = best.select("vec_id", F.lit(k).alias("k"), "predicted", "share")
        out = best if out is None else out.unionByName(best)
    return out
