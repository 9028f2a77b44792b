"""Resampling, cross-validation, model choice, controls and encodings, each from hashes or sums that SQL
can express, too."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.functions import text
from auditframe.operators import controls, inference, metrics, resampling, vectors
from auditframe.operators.structure import near_points
from auditframe.plans.registry import query, six, sql_six, table
from auditframe.plans.relational_queries import CATALOG, catalog
from auditframe.plans.vector_queries import ACTIVE, DOT, LONG, PLACED, active, embeddings

DRAWS = 40
#: Labelled documents with two scores that have ties.
SCORES = f"(SELECT doc_id AS id, quality AS y, lang, (least(n_chars, 3000) // 30) / 100.0::DOUBLE AS p, (doc_id * 37 % 101) / 101.0::DOUBLE AS q FROM {CATALOG} WHERE quality IS NOT NULL)"
CUTS = ", ".join(repr(p) for p in resampling.POISSON)


def scores(spark, sf):
    rows = catalog(spark, sf).where("quality IS NOT NULL")
    return rows.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), "lang", (F.floor(F.least("n_chars", F.lit(3000)) / 30) / F.lit(100.0)).alias("p"), (F.col("doc_id") * 37 % 101 / F.lit(101.0)).alias("q"))


def draws_sql(rows: str, seed: int) -> str:
    """SQL of ``rows`` once a draw with weight w."""
    return f"""(SELECT * EXCLUDE (u) FROM (SELECT *, block * 8 + j AS draw, len(list_filter([{CUTS}], lambda c: c <= u)) AS w FROM (
        SELECT *, ('0x' || substr(digest, 1 + 8 * j, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT r.*, block, j, sha256('{seed}:' || block || ':' || id) AS digest FROM {rows} r, range(0, {-(-DRAWS // 8)}) b(block), range(0, 8) t(j)))) WHERE w > 0 AND draw < {DRAWS})"""


def areas_sql(rows: str, p: str) -> str:
    return f"""(SELECT draw, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cum - neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) END AS value FROM (
        SELECT draw, pos, neg, sum(neg) OVER (PARTITION BY draw ORDER BY p) AS cum FROM (SELECT draw, {p} AS p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM {rows} GROUP BY draw, {p})) GROUP BY draw)"""


def interval_sql(values: str) -> str:
    return f"SELECT count(*) AS draws, {sql_six('quantile_cont(value, 0.025)')} AS low, {sql_six('quantile_cont(value, 0.975)')} AS high FROM {values} WHERE value IS NOT NULL"


def rounded(out):
    return out.select("draws", six(F.col("low")).alias("low"), six(F.col("high")).alias("high"))


@query(interval_sql(areas_sql(draws_sql(SCORES, 5), "p")))
def bootstrap_metric_ci(spark, sf):
    """Interval of the area under the curve; draws with one class are skipped."""
    return rounded(resampling.bootstrap_auroc(scores(spark, sf), "id", "y", "p", DRAWS, 5))


@query(interval_sql(f"(SELECT a.value - b.value AS value FROM {areas_sql(draws_sql(SCORES, 6), 'p')} a JOIN {areas_sql(draws_sql(SCORES, 6), 'q')} b USING (draw))"))
def bootstrap_paired_difference(spark, sf):
    return rounded(resampling.bootstrap_difference(scores(spark, sf), "id", "y", "p", "q", DRAWS, 6))


FLAGS = f"(SELECT id, y, ((p >= 0.3)::INT = y)::INT AS before, ((q >= 0.5)::INT = y)::INT AS after FROM {SCORES})"


@query(interval_sql(f"""(SELECT sum(share * mean) AS value FROM (SELECT draw, y, sum(w * (before - after)) / sum(w)::DOUBLE AS mean FROM {draws_sql(FLAGS, 7)} GROUP BY draw, y)
    JOIN (SELECT y, count(*) / sum(count(*)) OVER () AS share FROM {SCORES} GROUP BY y) USING (y) GROUP BY draw HAVING count(*) = 2)"""))
def bootstrap_stratified_drop(spark, sf):
    """Drop in accuracy from one classifier to another, resampled within classes."""
    rows = scores(spark, sf)
    flags = rows.select("id", "y", ((F.col("p") >= 0.3).cast("int") == F.col("y")).cast("int").alias("before"), ((F.col("q") >= 0.5).cast("int") == F.col("y")).cast("int").alias("after"))
    return rounded(resampling.stratified_drop(flags, "id", "y", "before", "after", DRAWS, 7))


@query(f"""WITH o AS (SELECT sum(y) AS ones, count(*) AS n FROM {SCORES}), d AS (SELECT draw, p, (row_number() OVER (PARTITION BY draw ORDER BY sha256('9:' || draw || ':' || id), id) <= (SELECT ones FROM o))::INT AS y FROM {SCORES}, range(0, {DRAWS}) t(draw)),
    n AS (SELECT draw, (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS a FROM (SELECT *, rank() OVER (PARTITION BY draw ORDER BY p) + (count(*) OVER (PARTITION BY draw, p) - 1) / 2.0 AS r FROM d) GROUP BY draw),
    s AS (SELECT (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS a FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM {SCORES}))
    SELECT {sql_six('(SELECT a FROM s)')} AS observed, {sql_six('avg(a)')} AS mean, {sql_six('quantile_cont(a, 0.025)')} AS q025, {sql_six('quantile_cont(a, 0.975)')} AS q975, {sql_six('(1 + count(*) FILTER (WHERE a >= (SELECT a FROM s) - 1e-12)) / (count(*) + 1)')} AS p FROM n""")
def label_permutation_null(spark, sf):
    out = resampling.label_permutation(scores(spark, sf), "id", "y", "p", DRAWS, 9)
    return out.select(*(six(F.col(c)).alias(c) for c in ("observed", "mean", "q025", "q975", "p")))


FOLDED = "(SELECT o_orderkey, o_custkey, (o_orderkey % 13)::DOUBLE AS x, o_totalprice / 1000 AS y, floor(('0x' || substr(sha256('3:' || o_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 5)::INT AS fold FROM orders)"


@query(f"""WITH s AS (SELECT fold, count(*)::DOUBLE AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM {FOLDED} GROUP BY fold), t AS (SELECT a.fold, sum(b.n) AS n, sum(b.x) AS x, sum(b.y) AS y, sum(b.xx) AS xx, sum(b.xy) AS xy FROM s a JOIN s b ON a.fold <> b.fold GROUP BY a.fold),
    l AS (SELECT fold, (n * xy - x * y) / (n * xx - x * x) AS slope, (y - (n * xy - x * y) / (n * xx - x * x) * x) / n AS intercept FROM t) SELECT o_orderkey, fold, round(slope * x + intercept, 4) + 0.0 AS predicted FROM {FOLDED} JOIN l USING (fold)""")
def out_of_fold(spark, sf):
    """Predictions of each fold from a line on the others; customers are never divided."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 13).cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    out = resampling.out_of_fold(resampling.hash_folds(rows, "o_custkey", 5, 3), "x", "y", "fold")
    return out.select("o_orderkey", "fold", (F.round("predicted", 4) + F.lit(0.0)).alias("predicted"))


@query("""WITH b AS (SELECT item_id AS id, length(text)::DOUBLE AS x, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS y FROM benchmark), l AS (SELECT a.id, a.x, regr_slope(b.y, b.x) AS slope, regr_intercept(b.y, b.x) AS intercept FROM b a JOIN b ON a.id <> b.id GROUP BY a.id, a.x) SELECT id, round(slope * x + intercept, 4) + 0.0 AS predicted FROM l""")
def leave_one_out(spark, sf):
    """Each item's number of blanks by a line on the lengths of all others."""
    n = F.length("text")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), n.cast("double").alias("x"), (n - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))).cast("double").alias("y"))
    return resampling.leave_one_out(rows, "x", "y").select("id", (F.round("predicted", 4) + F.lit(0.0)).alias("predicted"))


MODEL = "(SELECT o_totalprice / 1e5 AS y, CASE o_orderkey % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split, unnest(['a', 'b', 'c']) AS feature, unnest([(o_orderkey % 13)::DOUBLE, (o_custkey % 17)::DOUBLE, ((o_orderkey + o_custkey) % 7)::DOUBLE]) AS x FROM orders)"


@query(f"""WITH m AS (SELECT * FROM {MODEL}), f AS (SELECT feature, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM m WHERE split = 'train' GROUP BY feature), v AS (SELECT feature, avg((y - s * x - i) ** 2) AS val_mse FROM m JOIN f USING (feature) WHERE split = 'val' GROUP BY feature),
    best AS (SELECT * FROM v ORDER BY round(val_mse, 9), feature DESC LIMIT 1), g AS (SELECT feature, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM m SEMI JOIN best USING (feature) WHERE split <> 'test' GROUP BY feature)
    SELECT feature, {sql_six('any_value(val_mse)')} AS val_mse, {sql_six('avg((y - s * x - i) ** 2)')} AS test_mse FROM m JOIN g USING (feature) JOIN best USING (feature) WHERE split = 'test' GROUP BY feature""")
def model_selection(spark, sf):
    """The best of three models on validation rows, fitted anew and tested once."""
    split = F.when(F.col("o_orderkey") % 5 == 3, "val").when(F.col("o_orderkey") % 5 == 4, "test").otherwise("train")
    rows = table(spark, sf, "orders").select((F.col("o_totalprice") / 1e5).alias("y"), split.alias("split"), (F.col("o_orderkey") % 13).alias("a"), (F.col("o_custkey") % 17).alias("b"), ((F.col("o_orderkey") + F.col("o_custkey")) % 7).alias("c"))
    return resampling.chosen_model(rows, ["a", "b", "c"], "y", "split").select("feature", six(F.col("val_mse")).alias("val_mse"), six(F.col("test_mse")).alias("test_mse"))


def split_sql(mode: str, by: str, seed: int) -> str:
    return f"""SELECT '{mode}' AS mode, doc_id, CASE WHEN turn <= n * 0.7 THEN 'train' WHEN turn <= n * 0.85 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {by}::VARCHAR AS k FROM documents) JOIN (
        SELECT k, row_number() OVER (ORDER BY sha256('{seed}:' || k), k) AS turn, count(*) OVER () AS n FROM (SELECT DISTINCT {by}::VARCHAR AS k FROM documents)) USING (k)"""


@query(" UNION ALL ".join(split_sql(m, b, s) for m, b, s in (("random", "doc_id", 1), ("family", "sha256(text)", 2), ("source", "source", 3))))
def split_modes(spark, sf):
    """Shuffled splits by row, by family of equal texts and by source."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("random"), F.sha2("text", 256).alias("family"), "source")
    shares, out = {"train": 0.7, "val": 0.15, "test": 0.15}, None
    for seed, mode in enumerate(("random", "family", "source"), start=1):
        own = docs.join(resampling.shuffled_split(docs, mode, seed, shares), mode).select(F.lit(mode).alias("mode"), "doc_id", "split")
        out = own if out is None else out.unionByName(own)
    return out


@query("""WITH d AS (SELECT doc_id, source, sha256(text) AS family FROM documents), last AS (SELECT max(source) AS s FROM documents), t AS (SELECT DISTINCT family FROM d, last WHERE source = s),
    dev AS (SELECT DISTINCT family FROM d ANTI JOIN t USING (family)), r AS (SELECT family, row_number() OVER (ORDER BY sha256('4:' || family), family) <= count(*) OVER () * 0.8 AS train FROM dev)
    SELECT doc_id, CASE WHEN source = s THEN 'test' WHEN r.family IS NULL THEN 'purged' WHEN train THEN 'train' ELSE 'val' END AS split FROM d LEFT JOIN r USING (family), last""")
def held_out_source_split(spark, sf):
    """One source is the test set, its families elsewhere are purged, the rest is divided 80 to 20."""
    from auditframe.operators.cohort import held_out_source

    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("family"))
    last = docs.agg(F.max("source")).first()[0] or ""
    marked = held_out_source(docs, "source", last, "family")
    parts = resampling.shuffled_split(marked.where("split = 'development'"), "family", 4, {"train": 0.8, "val": 0.2}).withColumnRenamed("split", "part")
    return marked.join(parts, "family", "left").select("doc_id", F.when(F.col("split") == "development", F.col("part")).otherwise(F.col("split")).alias("split"))


# Balance, imputation and paired tests

BALANCE = f"(SELECT doc_id, quality AS y, unnest(['chars', 'blanks']) AS covariate, unnest([n_chars::DOUBLE, (length(text) - length(replace(text, ' ', '')))::DOUBLE]) AS x, n_chars FROM {CATALOG} WHERE quality IS NOT NULL)"
COMMON = f"(SELECT greatest(min(n_chars) FILTER (WHERE quality = 1), min(n_chars) FILTER (WHERE quality = 0)) AS lo, least(max(n_chars) FILTER (WHERE quality = 1), max(n_chars) FILTER (WHERE quality = 0)) AS hi FROM {CATALOG} WHERE quality IS NOT NULL)"
SMD = "CASE WHEN var_pop(x) FILTER (WHERE y = 1{0}) + var_pop(x) FILTER (WHERE y = 0{0}) = 0 THEN 0.0 ELSE (avg(x) FILTER (WHERE y = 1{0}) - avg(x) FILTER (WHERE y = 0{0})) / sqrt((var_pop(x) FILTER (WHERE y = 1{0}) + var_pop(x) FILTER (WHERE y = 0{0})) / 2) END"


@query(f"SELECT covariate, {sql_six('before')} AS before, {sql_six('after')} AS after, abs(after) <= 0.15 AS passes FROM (SELECT covariate, {SMD.format('')} AS before, {SMD.format(' AND n_chars BETWEEN lo AND hi')} AS after FROM {BALANCE}, {COMMON} GROUP BY covariate)")
def balance_gate(spark, sf):
    """Standardised differences before and after a restriction to common support, and the gate."""
    rows = catalog(spark, sf).where("quality IS NOT NULL")
    blanks = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    long = rows.select("quality", "n_chars", F.explode(F.create_map(F.lit("chars"), F.col("n_chars").cast("double"), F.lit("blanks"), blanks.cast("double"))).alias("covariate", "x"))
    end = lambda f, c: f(F.when(F.col("quality") == c, F.col("n_chars")))
    common = rows.agg(F.greatest(end(F.min, 1), end(F.min, 0)).alias("lo"), F.least(end(F.max, 1), end(F.max, 0)).alias("hi"))
    after = long.crossJoin(F.broadcast(common)).where("n_chars BETWEEN lo AND hi")
    return controls.balance(long, after, ["covariate"], "quality", "x", 0.15).select("covariate", six(F.col("before")).alias("before"), six(F.col("after")).alias("after"), "passes")


@query(f"SELECT o_orderkey, {sql_six('coalesce(price, (SELECT avg(price) FROM r WHERE o_orderkey % 4 <> 0))')} AS price FROM r".join(["WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders) ", ""]))
def mean_imputation(spark, sf):
    """Missing values by the training rows' mean."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("price"))
    mean = rows.where("o_orderkey % 4 <> 0").agg(F.avg("price").alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).select("o_orderkey", six(F.coalesce("price", "mean")).alias("price"))


CELLS = f"(SELECT feature, label AS unit, avg(activation) FILTER (WHERE vec_id % 2 = 0) - avg(activation) FILTER (WHERE vec_id % 2 = 1) AS mean, max(activation) FILTER (WHERE vec_id % 2 = 0) - max(activation) FILTER (WHERE vec_id % 2 = 1) AS max FROM {ACTIVE} WHERE feature < 8 GROUP BY ALL)"
CONTRASTS = f"(SELECT feature, metric, unit, round(d, 9) AS d FROM (UNPIVOT {CELLS} ON mean, max INTO NAME metric VALUE d) WHERE d IS NOT NULL)"


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY feature, metric ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY feature, metric) AS n, abs(sum(d) OVER (PARTITION BY feature, metric)) AS seen FROM {CONTRASTS}),
    m AS (SELECT feature, metric, n, unnest(range(0, (1 << n)::BIGINT)) AS mask FROM (SELECT DISTINCT feature, metric, n FROM d)), s AS (SELECT feature, metric, mask, abs(sum(CASE WHEN (mask >> i) & 1 = 1 THEN -d ELSE d END)) AS null_sum, any_value(seen) AS seen FROM m JOIN d USING (feature, metric) GROUP BY ALL),
    p AS (SELECT feature, metric, count(*) FILTER (WHERE null_sum >= seen - 1e-9) / count(*) AS p FROM s GROUP BY ALL), r AS (SELECT *, p * (count(*) OVER (PARTITION BY metric)) / (count(*) OVER (PARTITION BY metric ORDER BY p)) AS raw FROM p)
    SELECT feature, metric, {sql_six('p')} AS p, {sql_six('least(1.0, min(raw) OVER (PARTITION BY metric ORDER BY p DESC))')} AS fdr FROM r""")
def paired_cell_tests(spark, sf):
    """Each feature and metric: contrasts inside units, an exact test over units, adjusted by metric."""
    even = F.col("vec_id") % 2 == 0
    side = lambda f, e: f(F.when(e, F.col("activation")))
    cells = active(spark, sf).where("feature < 8").groupBy(F.col("feature").cast("long").alias("feature"), F.col("label").alias("unit"))
    cells = cells.agg(*((side(f, even) - side(f, ~even)).alias(n) for n, f in (("mean", F.avg), ("max", F.max))))
    long = cells.select("feature", "unit", F.explode(F.create_map(F.lit("mean"), F.col("mean").cast("double"), F.lit("max"), F.col("max").cast("double"))).alias("metric", "d")).where("d IS NOT NULL").withColumn("d", F.round("d", 9))
    return inference.paired_table(long, ["feature"], "metric", "unit", "d").select("feature", "metric", six(F.col("p")).alias("p"), six(F.col("fdr")).alias("fdr"))


@query()
def pearson_p(spark, sf):
    """Correlation of price and discount in each class, and its two-sided tail."""
    lines = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.corr("l_extendedprice", "l_quantity").alias("r"), F.count("*").alias("n"))
    return lines.select("l_returnflag", six(F.col("r")).alias("r"), "n", inference.pearson_tail(F.col("r"), F.col("n")).alias("p"))


CLASSES = "(SELECT l_orderkey, l_linenumber, l_returnflag AS flag, l_discount * 10 + 0.2 AS a, l_tax * 12 + 0.3 AS n, l_quantity / 50 + 0.1 AS r FROM lineitem)"
ONE_VS_REST = f"(SELECT class, flag = class AS y, CASE class WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END / (a + n + r) AS p FROM {CLASSES}, (SELECT unnest(['A', 'N', 'R']) AS class))"


@query(f"""SELECT (SELECT {sql_six('avg(area)')} FROM (SELECT class, (sum(k) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y))::DOUBLE AS area FROM (
    SELECT *, rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2.0 AS k FROM (SELECT class, y, round(p, 9) AS p FROM {ONE_VS_REST})) GROUP BY class)) AS macro_auroc, {sql_six('avg(-ln(greatest(p, 1e-15))) FILTER (WHERE y)')} AS log_loss FROM {ONE_VS_REST}""")
def one_vs_rest(spark, sf):
    """Macro average of one-against-rest areas, and the mean log loss, of class probabilities."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), *(c.alias(n) for n, c in (("A", F.col("l_discount") * 10 + 0.2), ("N", F.col("l_tax") * 12 + 0.3), ("R", F.col("l_quantity") / 50 + 0.1))))
    total = F.col("A") + F.col("N") + F.col("R")
    out = metrics.one_vs_rest(rows.select("flag", *((F.col(c) / total).alias(c) for c in "ANR")), "flag", ["A", "N", "R"])
    return out.select(six(F.col("macro_auroc")).alias("macro_auroc"), six(F.col("log_loss")).alias("log_loss"))


# Controls

LETTERED = f"(SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, substr('{text.LETTERS}', (vec_id % 5 + 1)::INT, 1) AS letter, vec_id % 17 = 0 AS chosen FROM embeddings)"


@query(f"""WITH p AS (SELECT * FROM {LETTERED}), f AS (SELECT a.* FROM p a WHERE NOT chosen AND NOT EXISTS (SELECT 1 FROM p b WHERE b.chosen AND b.label = a.label AND abs(b.pos - a.pos) <= 2)),
    c AS (SELECT label, letter, vec_id, row_number() OVER (PARTITION BY label, letter ORDER BY sha256('8:' || vec_id), vec_id) AS turn FROM f), t AS (SELECT label, letter, vec_id, row_number() OVER (PARTITION BY label, letter ORDER BY sha256('8:' || vec_id), vec_id) AS turn FROM p WHERE chosen)
    SELECT t.vec_id AS chosen_id, c.vec_id AS control_id FROM t LEFT JOIN c USING (label, letter, turn)""")
def letter_matched_controls(spark, sf):
    """For each chosen position one of its letter, at least three positions from any chosen one."""
    placed = vectors.positioned(embeddings(spark, sf).select("label", "vec_id"), "label", "vec_id")
    rows = placed.select("label", "vec_id", "pos", F.substring(F.lit(text.LETTERS), (F.col("vec_id") % 5 + 1).cast("int"), F.lit(1)).alias("letter"), (F.col("vec_id") % 17 == 0).alias("chosen"))
    return controls.matched_draws(rows, "label", "pos", "letter", "chosen", "vec_id", radius=2, seed=8)


@query()
def matched_features(spark, sf):
    """Features of two models over the same rows, matched one to one by cosine."""
    rows = active(spark, sf)
    other = rows.where("vec_id % 10 <> 0").withColumn("feature", (F.col("feature") + 5) % 64)
    return controls.matched_features(rows, other, ["vec_id"], least=0.5).select("left", "right", six(F.col("cosine")).alias("cosine"))


# Encodings and linear models

LATENTS, SHIFT, BIAS = 16, 0.01, 0.05
WEIGHT = "(((k * 31 + dim * 17) % 11) - 5) / 10.0::DOUBLE"
ENCODED = f"(SELECT label, vec_id, k, a FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(a, 9) DESC, k) AS place FROM (SELECT label, vec_id, k, sum({WEIGHT} * (x - {SHIFT})) + {BIAS} AS a FROM {LONG}, range(0, {LATENTS}) t(k) GROUP BY ALL) WHERE a > 0) WHERE place <= 4)"


def encoder():
    import numpy as np

    k, dim = np.arange(LATENTS)[:, None], np.arange(64)[None, :]
    return ((k * 31 + dim * 17) % 11 - 5) / 10.0


@query(f"""WITH e AS (SELECT * FROM {ENCODED}), d AS (SELECT vec_id, dim, {SHIFT} + sum({WEIGHT} * a) AS back FROM e, range(0, 64) t(dim) GROUP BY ALL) SELECT l.vec_id, (SELECT count(*) FROM e WHERE e.vec_id = l.vec_id) AS active, {sql_six(f'avg((x - coalesce(back, {SHIFT})) ** 2)')} AS mse FROM {LONG} l LEFT JOIN d USING (vec_id, dim) GROUP BY l.vec_id""")
def encode_decode(spark, sf):
    """Rectified codes of each vector, the four greatest kept, and the error of what they decode to."""
    out = controls.encoded(embeddings(spark, sf), ["vec_id"], "embedding", encoder(), shift=SHIFT, bias=BIAS, top=4)
    return out.select("vec_id", "active", six(F.col("mse")).alias("mse"))


@query(f"""WITH e AS (SELECT * FROM {ENCODED}), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, k AS latent, {sql_six(f"(SELECT sum({WEIGHT} * ((dim % 7) - 3) / 10.0) FROM range(0, 64) t(dim)) * sum(a) / any_value(n)")} AS score_drop FROM e JOIN n USING (label) GROUP BY label, k""")
def latent_ablation(spark, sf):
    """How much the score of a group's pooled vector falls when a latent is taken out of its decoding."""
    coef = [((d % 7) - 3) / 10.0 for d in range(64)]
    out = controls.ablated(embeddings(spark, sf), "label", "embedding", encoder(), coef, shift=SHIFT, bias=BIAS, top=4)
    return out.select("label", "latent", six(F.col("score_drop")).alias("score_drop"))


@query(f"""WITH s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM {LONG} GROUP BY dim), c AS (SELECT dim, ((dim % 7) - 3) / 10.0::DOUBLE / CASE WHEN s > 0 THEN s ELSE 1 END AS raw, m FROM s) SELECT vec_id, {sql_six('sum(x * raw) + 0.25 - (SELECT sum(raw * m) FROM c)')} AS score FROM {LONG} JOIN c USING (dim) GROUP BY vec_id""")
def unscaled_score(spark, sf):
    """A linear model of standardised components, with coefficients and intercept for raw ones."""
    stats = vectors.long(embeddings(spark, sf), [], "embedding").groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    model = stats.withColumn("coef", (F.col("dim") % 7 - 3) / 10.0)
    raw, shift = controls.unscaled(model)
    out = vectors.linear_score(embeddings(spark, sf), ["vec_id"], "embedding", raw, 0.25)
    return out.crossJoin(F.broadcast(shift)).select("vec_id", six(F.col("score") - F.col("shift")).alias("score"))


# Pairs of positions and structure


@query(f"""WITH p AS (SELECT a.label, b.pos - a.pos AS apart, {DOT} AS d FROM {PLACED} a JOIN {PLACED} b ON a.label = b.label AND b.pos > a.pos), b AS (SELECT label, unnest(['global', '1-8', '9-32', '>32']) AS band FROM (SELECT DISTINCT label FROM embeddings))
    SELECT b.label, b.band, count(d) AS pairs, round(coalesce(avg(d), 0), 5) + 0.0 AS mean, round(coalesce(stddev_pop(d), 0), 5) + 0.0 AS std FROM b LEFT JOIN p ON p.label = b.label AND CASE b.band WHEN 'global' THEN true WHEN '1-8' THEN apart <= 8 WHEN '9-32' THEN apart BETWEEN 9 AND 32 ELSE apart > 32 END GROUP BY ALL""")
def pair_bands(spark, sf):
    """Mean and deviation of pair products by separation, all pairs included, without making far pairs:
    the sums over all pairs follow from the group's vector sum and its Gram matrix."""
    out = vectors.band_moments(vectors.positioned(embeddings(spark, sf), "label", "vec_id"), "label", "embedding", [8, 32])
    five = lambda c: (F.round(c, 5) + F.lit(0.0)).alias(c)
    return out.select("label", "band", "pairs", five("mean"), five("std"))


@query(f"SELECT a.vec_id, {sql_six(f'avg({DOT})')} AS mean FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def position_pair_mean(spark, sf):
    """Mean product of each position with all others of its group, from the group's vector sum."""
    return vectors.pair_means(embeddings(spark, sf), "vec_id", "label", "embedding").where("mean IS NOT NULL").select("vec_id", six(F.col("mean")).alias("mean"))


@query("""SELECT l_returnflag AS flag, greatest(abs(a), abs(b), abs(c)) <= 0.05 AS passes, round(greatest(abs(a), abs(b), abs(c)), 6) + 0.0 AS worst FROM (SELECT l_returnflag, avg(l_discount) - 0.05 AS a, avg(l_tax) - 0.04 AS b, avg(l_quantity) / 50 - 0.5 AS c FROM lineitem GROUP BY 1)""")
def worst_column_gate(spark, sf):
    """The greatest deviation over several columns against a limit."""
    off = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg((F.avg("l_discount") - 0.05).alias("a"), (F.avg("l_tax") - 0.04).alias("b"), (F.avg("l_quantity") / 50 - 0.5).alias("c"))
    worst = F.greatest(*(F.abs(c) for c in ("a", "b", "c")))
    return off.select("flag", (worst <= 0.05).alias("passes"), six(worst).alias("worst"))


POINTS3 = "(SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


@query(f"""WITH t AS (SELECT label, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, arg_min(x, vec_id) AS x0, arg_min(y, vec_id) AS y0, arg_min(z, vec_id) AS z0, arg_max(x, vec_id) AS x1, arg_max(y, vec_id) AS y1, arg_max(z, vec_id) AS z1 FROM {POINTS3} GROUP BY label)
    SELECT label, n, {sql_six('sqrt(xx + yy + zz)')} AS radius, {sql_six('1 - 3 * (xx * yy + yy * zz + xx * zz - xy * xy - xz * xz - yz * yz) / (xx + yy + zz) ** 2')} AS anisotropy, {sql_six('sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2)')} AS end_to_end FROM t""")
def geometry_descriptors(spark, sf):
    """Gyration radius, relative anisotropy from the tensor's invariants, and distance of the ends."""
    e = F.col("embedding")
    points = embeddings(spark, sf).select("label", "vec_id", *(e[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    out = controls.geometry(points, "label", "vec_id", ["x", "y", "z"])
    return out.select("label", "n", *(six(F.col(c)).alias(c) for c in ("radius", "anisotropy", "end_to_end")))


NEAR2 = "(SELECT label, vec_id, vec_id // 2 AS residue, vec_id % 3 AS kind, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


@query(f"""SELECT a.label, a.residue AS "left", b.residue AS "right", {sql_six('min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))')} AS distance FROM {NEAR2} a JOIN {NEAR2} b ON a.label = b.label AND a.residue < b.residue AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.03 * 0.03 GROUP BY ALL""")
def closest_atoms(spark, sf):
    """Contacts of residues: the least distance of any two of their atoms, inside a sphere."""
    e = F.col("embedding")
    atoms = embeddings(spark, sf).select("label", "vec_id", *(e[i].cast("double").alias(c) for i, c in enumerate("xy")))
    near = near_points(atoms, "vec_id", "label", ["x", "y"], 0.03)
    residues = near.select("label", F.floor(F.col("left") / 2).alias("a"), F.floor(F.col("right") / 2).alias("b"), "distance").where("a <> b")
    return residues.groupBy("label", F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).agg(six(F.min("distance")).alias("distance"))


@query(f"""SELECT a.label, least(a.kind, b.kind) AS kind_a, greatest(a.kind, b.kind) AS kind_b, count(*) AS contacts, count(*) FILTER (WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.015 * 0.015) AS close FROM {NEAR2} a JOIN {NEAR2} b ON a.label = b.label AND a.vec_id < b.vec_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.03 * 0.03 GROUP BY ALL""")
def contact_classes(spark, sf):
    """Contacts by the classes of both sides, and those that are close."""
    e = F.col("embedding")
    atoms = embeddings(spark, sf).select("label", "vec_id", *(e[i].cast("double").alias(c) for i, c in enumerate("xy")))
    near = near_points(atoms, "vec_id", "label", ["x", "y"], 0.03)
    kind = {c: F.col(c) % 3 for c in ("left", "right")}
    return near.groupBy("label", F.least(kind["left"], kind["right"]).alias("kind_a"), F.greatest(kind["left"], kind["right"]).alias("kind_b")).agg(F.count("*").alias("contacts"), F.sum((F.col("distance") <= 0.015).cast("long")).alias("close"))


RAGGED = "(SELECT conv_id, list(length(text) ORDER BY turn) FILTER (WHERE role = 'user') AS asked, list(length(text) ORDER BY turn) FILTER (WHERE role = 'assistant' AND turn > 1) AS told FROM conversations GROUP BY conv_id)"


@query(f"""WITH r AS (SELECT *, greatest(coalesce(len(asked), 0), coalesce(len(told), 0)) AS n FROM {RAGGED}), b AS (SELECT *, ((n + 1) // 2 * 2)::INT AS bucket FROM r), p AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY sha256('0:' || conv_id), conv_id) - 1) AS turn FROM b),
    g AS (SELECT *, turn // 8 AS batch, max(n) OVER (PARTITION BY bucket, turn // 8) AS width FROM p)
    SELECT bucket, batch, list(conv_id ORDER BY turn) AS units, any_value(width)::INT AS width, list(list_concat(coalesce(asked, []), list_resize([]::BIGINT[], width - coalesce(len(asked), 0), -1)) ORDER BY turn) AS asked, list(list_transform(range(0, width), lambda i: i < coalesce(len(asked), 0)) ORDER BY turn) AS asked_mask, list(asked IS NOT NULL ORDER BY turn) AS asked_available,
    list(list_concat(coalesce(told, []), list_resize([]::BIGINT[], width - coalesce(len(told), 0), -1)) ORDER BY turn) AS told, list(list_transform(range(0, width), lambda i: i < coalesce(len(told), 0)) ORDER BY turn) AS told_mask, list(told IS NOT NULL ORDER BY turn) AS told_available,
    {sql_six('CASE WHEN any_value(width) > 0 THEN 1 - sum(coalesce(len(asked), 0) + coalesce(len(told), 0)) / (2 * count(*) * any_value(width)) ELSE 0 END')} AS waste FROM g GROUP BY bucket, batch""")
def padded_conversations(spark, sf):
    """Lengths of turns by two roles as padded batches with masks and availability, and the share of padding."""
    from auditframe.operators.batches import padded_batches

    item = F.struct("turn", F.length("text").cast("long").alias("n"))
    told = F.col("role").eqNullSafe("assistant") & (F.col("turn") > 1)

    def lengths(chosen):
        own = F.transform(F.array_sort(F.collect_list(F.when(chosen, item))), lambda r: r["n"])
        return F.when(F.size(own) > 0, own)

    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(lengths(F.col("role") == "user").alias("asked"), lengths(told).alias("told"))
    fill = F.lit(-1).cast("long")
    out = padded_batches(rows, "conv_id", {"asked": fill, "told": fill}, size=8, step=2)
    return out.withColumn("waste", six(F.col("waste")))
