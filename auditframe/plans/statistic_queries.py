"""Paired tests, balance, selection, controls, splits, matching and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.operators import causal, checks, cohort, inference, metrics
from auditframe.operators.ranks import benjamini_hochberg, top_n
from auditframe.plans.metric_queries import P_VALUES, SCORED, scored
from auditframe.plans.registry import query, six, sql_six, table
from auditframe.plans.relational_queries import CATALOG, catalog, split_of
from auditframe.plans.vector_queries import ACTIVE, TARGETS, active, embeddings, targets
from auditframe.sources.scratch import saved

# Paired inference: order lines by number are repetitions, return flags are views.

VIEW_MEANS = "(SELECT l_linenumber::BIGINT AS seed, l_returnflag AS view, round(avg(l_discount), 9) AS value FROM lineitem GROUP BY ALL)"
DIFFERENCES = f"(SELECT a.seed, a.view, a.value - b.value AS d FROM {VIEW_MEANS} a JOIN {VIEW_MEANS} b ON a.seed = b.seed AND b.view = 'A' AND a.view <> 'A')"


def flips(plus_one: int, tolerance: str) -> str:
    """SQL of the exact test: every subset of repetitions changes its sign."""
    return f"""(WITH d AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY seed) - 1 AS i, count(*) OVER (PARTITION BY view) AS n, abs(sum(d) OVER (PARTITION BY view)) AS seen FROM {DIFFERENCES}),
    m AS (SELECT view, n, unnest(range(0, (1 << n)::BIGINT)) AS mask FROM (SELECT DISTINCT view, n FROM d)),
    s AS (SELECT view, mask, abs(sum(CASE WHEN (mask >> i) & 1 = 1 THEN -d ELSE d END)) AS null_sum, max(seen) AS seen FROM m JOIN d USING (view) GROUP BY ALL)
    SELECT view, (count(*) FILTER (WHERE null_sum >= seen - {tolerance}) + {plus_one}) / (count(*) + {plus_one}) AS p FROM s GROUP BY view)"""


def view_means(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("seed"), F.col("l_returnflag").alias("view")).agg(F.round(F.avg("l_discount"), 9).alias("value"))


def differences(spark, sf):
    means = view_means(spark, sf)
    base = means.where("view = 'A'").select("seed", F.col("value").alias("base"))
    return means.where("view <> 'A'").join(base, "seed").select("seed", "view", (F.col("value") - F.col("base")).alias("d"))


@query(f"SELECT view, n, {sql_six('mean')} AS mean_difference, {sql_six('p')} AS p FROM (SELECT view, count(*) AS n, avg(d) AS mean FROM {DIFFERENCES} GROUP BY view) JOIN {flips(0, '1e-12')} USING (view)")
def sign_flip_exact(spark, sf):
    out = inference.sign_flip_exact(differences(spark, sf), ["view"], "d", "seed", tolerance=1e-12)
    return out.select("view", "n", six(F.col("mean_difference")).alias("mean_difference"), six(F.col("p")).alias("p"))


@query(f"SELECT view, {sql_six('p')} AS p FROM {flips(1, '1e-12')}")
def sign_flip_plus_one(spark, sf):
    """The variant that counts the observed pattern once more."""
    return inference.sign_flip_exact(differences(spark, sf), ["view"], "d", "seed", plus_one=True, tolerance=1e-12).select("view", six(F.col("p")).alias("p"))


@query(f"""WITH t AS (SELECT view, p, p * (count(*) OVER ()) / (count(*) OVER (ORDER BY p)) AS raw FROM {flips(0, '0')})
    SELECT view, {sql_six('p')} AS p, {sql_six('least(1.0, min(raw) OVER (ORDER BY p DESC))')} AS fdr FROM t""")
def view_pivot_tests(spark, sf):
    out = inference.paired_views(view_means(spark, sf), "seed", "view", "value", "A", ["N", "R"])
    return out.select("view", six(F.col("p")).alias("p"), six(F.col("fdr")).alias("fdr"))


@query(f"""WITH r AS (SELECT id % 4 AS family, p, p * (count(*) OVER (PARTITION BY id % 4)) / (count(*) OVER (PARTITION BY id % 4 ORDER BY p)) AS raw FROM {P_VALUES} WHERE p IS NOT NULL)
    SELECT DISTINCT family, p, {sql_six('least(1.0, min(raw) OVER (PARTITION BY family ORDER BY p DESC))')} AS fdr FROM r""")
def bh_adjust(spark, sf):
    """Adjusted within families."""
    p = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") * 7919 % 10007) / F.lit(10007.0))
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("family"), p.alias("p")).where("p IS NOT NULL")
    return benjamini_hochberg(rows, "p", ["family"]).select("family", "p", six(F.col("fdr")).alias("fdr")).distinct()


@query(f"""SELECT view, n, {sql_six('mean')} AS mean, {sql_six('2.4469118511449692 * sd / sqrt(n)')} AS half_width FROM (SELECT view, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM {VIEW_MEANS} GROUP BY view)""")
def t_ci(spark, sf):
    out = inference.t_interval(view_means(spark, sf), ["view"], "value")
    return out.select("view", "n", six(F.col("mean")).alias("mean"), six(F.col("half_width")).alias("half_width"))


@query(f"SELECT view, count(*) AS n, {sql_six('avg(d) / stddev_samp(d)')} AS dz FROM {DIFFERENCES} GROUP BY view")
def cohen_dz(spark, sf):
    return differences(spark, sf).groupBy("view").agg(F.count("*").alias("n"), six(F.avg("d") / F.stddev_samp("d")).alias("dz"))


# Balance and association

GROUPED = "(SELECT l_returnflag AS flag, l_orderkey, l_linenumber, (l_linestatus = 'O')::INT AS y, l_quantity AS x FROM lineitem)"


def grouped(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").cast("int").alias("y"), F.col("l_quantity").alias("x"))


@query(f"""SELECT flag, {sql_six('a')} AS mean_1, {sql_six('b')} AS mean_0, {sql_six('CASE WHEN v = 0 THEN 0.0 ELSE (a - b) / sqrt(v) END')} AS smd FROM (
    SELECT flag, avg(x) FILTER (WHERE y = 1) AS a, avg(x) FILTER (WHERE y = 0) AS b, (var_pop(x) FILTER (WHERE y = 1) + var_pop(x) FILTER (WHERE y = 0)) / 2 AS v FROM {GROUPED} GROUP BY flag)""")
def smd_table(spark, sf):
    return inference.smd(grouped(spark, sf), ["flag"], "y", "x").select("flag", *(six(F.col(c)).alias(c) for c in ("mean_1", "mean_0", "smd")))


LABELLED = f"(SELECT lang, doc_id, quality, n_chars FROM {CATALOG} WHERE quality IS NOT NULL)"


@query(f"""WITH e AS (SELECT a.lang, a.doc_id, avg(b.n_chars) FILTER (WHERE b.quality = 1) AS m1, avg(b.n_chars) FILTER (WHERE b.quality = 0) AS m0, (var_pop(b.n_chars) FILTER (WHERE b.quality = 1) + var_pop(b.n_chars) FILTER (WHERE b.quality = 0)) / 2 AS v
    FROM {LABELLED} a JOIN {LABELLED} b ON a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY ALL) SELECT lang, doc_id, round(CASE WHEN v <= 1e-12 THEN 0.0 ELSE (m1 - m0) / sqrt(v) END, 6) + 0.0 AS smd FROM e""")
def leave_one_out_smd(spark, sf):
    rows = catalog(spark, sf).where("quality IS NOT NULL").select("lang", "doc_id", "quality", "n_chars")
    return inference.leave_one_out_smd(rows, ["lang"], "doc_id", "quality", "n_chars").select("lang", "doc_id", six(F.col("smd")).alias("smd"))


SOURCES = f"(SELECT source, n_chars FROM {CATALOG} WHERE source <> 'unknown' AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 5))"


@query(f"""WITH m AS (SELECT source, count(*) AS n, avg(n_chars) AS m FROM {SOURCES} GROUP BY source) SELECT (SELECT count(*) FROM m) AS groups, count(*) AS n, {sql_six('(SELECT sum(n * (m - (SELECT avg(n_chars) FROM ' + SOURCES + ')) ** 2) FROM m) / (var_pop(n_chars) * count(*))')} AS eta_squared FROM {SOURCES}""")
def eta_squared(spark, sf):
    return inference.kruskal(table(spark, sf, "documents").select("source", "n_chars"), "n_chars", "source").select("groups", "n", six(F.col("eta_squared")).alias("eta_squared"))


@query(f"""WITH r AS (SELECT source, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM {SOURCES}), t AS (SELECT sum(c::DOUBLE ** 3 - c) AS t FROM (SELECT count(*) AS c FROM {SOURCES} GROUP BY n_chars)),
    s AS (SELECT sum(sr * sr / k) AS q, sum(k) AS n FROM (SELECT source, sum(r) AS sr, count(*) AS k FROM r GROUP BY source)) SELECT {sql_six('(12.0 / (n::DOUBLE * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n::DOUBLE ** 3 - n))')} AS h FROM s, t""")
def kruskal_h(spark, sf):
    return inference.kruskal(table(spark, sf, "documents").select("source", "n_chars"), "n_chars", "source").select(six(F.col("h")).alias("h"))


@query(f"""WITH r AS (SELECT flag, y, rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2.0 AS r FROM {GROUPED}), s AS (SELECT flag, sum(y)::BIGINT AS n1, (count(*) - sum(y))::BIGINT AS n0, sum(r) FILTER (WHERE y = 1) AS r FROM r GROUP BY flag)
    SELECT flag, n1, n0, {sql_six('r - n1 * (n1 + 1) / 2.0')} AS u, {sql_six('2 * (r - n1 * (n1 + 1) / 2.0) / (n1::DOUBLE * n0) - 1')} AS rank_biserial FROM s WHERE n1 > 0 AND n0 > 0""")
def rank_biserial(spark, sf):
    out = inference.rank_biserial(grouped(spark, sf), ["flag"], "x", "y")
    return out.select("flag", F.col("n1").cast("long").alias("n1"), "n0", six(F.col("u")).alias("u"), six(F.col("rank_biserial")).alias("rank_biserial"))


@query(f"""WITH r AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2.0 AS b FROM (SELECT l_linestatus AS flag, l_quantity AS x, l_extendedprice AS y FROM lineitem))
    SELECT flag, count(*) AS n, {sql_six('corr(a, b)')} AS rho FROM r GROUP BY flag""")
def spearman(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("flag"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return inference.spearman(rows, "x", "y", ["flag"]).select("flag", "n", six(F.col("rho")).alias("rho"))


@query(f"""WITH m AS (SELECT l_orderkey % 200 AS unit, avg(l_discount) FILTER (WHERE l_linenumber <= 3) AS a, avg(l_discount) FILTER (WHERE l_linenumber > 3) AS b FROM lineitem GROUP BY ALL)
    SELECT count(*) AS n, {sql_six('corr(a, b)')} AS r, {sql_six('avg((sign(round(a - 0.05, 9)) = sign(round(b - 0.05, 9)))::INT)')} AS same_sign, count(*) FILTER (WHERE abs(a - 0.05) > 0.002) AS significant, {sql_six('avg((abs(b - 0.05) > 0.002)::INT) FILTER (WHERE abs(a - 0.05) > 0.002)')} AS replicated FROM m""")
def replication_summary(spark, sf):
    """How effects of one half of the repetitions come back in the other."""
    d = F.col("l_discount")
    m = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 200).alias("unit")).agg(F.avg(F.when(F.col("l_linenumber") <= 3, d)).alias("a"), F.avg(F.when(F.col("l_linenumber") > 3, d)).alias("b"))
    sign = lambda c: F.signum(F.round(F.col(c) - 0.05, 9))
    strong = lambda c: F.abs(F.col(c) - 0.05) > 0.002
    return m.agg(F.count("*").alias("n"), six(F.corr("a", "b")).alias("r"), six(F.avg((sign("a") == sign("b")).cast("int"))).alias("same_sign"), F.sum(strong("a").cast("long")).alias("significant"), six(F.avg(F.when(strong("a"), strong("b").cast("int")))).alias("replicated"))


@query(f"""SELECT s, {sql_six('(sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::DOUBLE)')} AS auroc FROM (SELECT s, y, rank() OVER (PARTITION BY s ORDER BY p) + (count(*) OVER (PARTITION BY s, p) - 1) / 2.0 AS r FROM {SCORED} WHERE flag <> 'N' OR q < 25) GROUP BY s HAVING sum(y) > 0 AND sum(y) < count(*)""")
def clean_sensitivity(spark, sf):
    """The curve without contextual negatives, only where both classes remain."""
    out = metrics.auroc(scored(spark, sf).where("flag <> 'N' OR q < 25"), "y", "p", ["s"])
    return out.where("auroc IS NOT NULL").select("s", six(F.col("auroc")).alias("auroc"))


@query(f"""WITH z AS (SELECT o_orderkey, 1.0 AS z0, o_totalprice / 1e5 AS z1, (o_orderkey % 13)::DOUBLE AS z2 FROM orders) SELECT {', '.join(sql_six(f'avg(z{i} * z{j})') + f' AS g_{i}{j}' for i in range(3) for j in range(i, 3))} FROM z""")
def weighted_gram(spark, sf):
    """The normal matrix of a design in one pass."""
    z = [F.lit(1.0), F.col("o_totalprice") / 1e5, (F.col("o_orderkey") % 13).cast("double")]
    return table(spark, sf, "orders").agg(*(six(F.avg(z[i] * z[j])).alias(f"g_{i}{j}") for i in range(3) for j in range(i, 3)))


# Sparse features

EFFECTS = f"""(SELECT a.label, a.feature, count(*) AS active, corr(a.activation, t.y) AS r FROM {ACTIVE} a JOIN {TARGETS} t USING (vec_id) GROUP BY ALL HAVING count(*) >= 5)"""


@query(f"""SELECT feature, count(*) AS groups, {sql_six('avg(r)')} AS mean_r, {sql_six('median(r)')} AS median_r, {sql_six('greatest(avg((r > 0)::INT), avg((r < 0)::INT))')} AS same_sign FROM {EFFECTS} WHERE r IS NOT NULL GROUP BY feature""")
def per_group_effects(spark, sf):
    """Correlations inside groups with at least five active positions, summarised over groups."""
    rows = active(spark, sf).join(targets(spark, sf).select("vec_id", "y"), "vec_id")
    own = rows.groupBy("label", "feature").agg(F.count("*").alias("n"), F.corr("activation", "y").alias("r")).where("n >= 5 AND r IS NOT NULL AND NOT isnan(r)")
    sign = lambda c: F.avg(c.cast("int"))
    out = own.groupBy(F.col("feature").cast("long").alias("feature"))
    return out.agg(F.count("*").alias("groups"), six(F.avg("r")).alias("mean_r"), six(F.percentile("r", 0.5)).alias("median_r"), six(F.greatest(sign(F.col("r") > 0), sign(F.col("r") < 0))).alias("same_sign"))


@query(f"""SELECT a.label, a.feature, {sql_six('sum(activation) / max(L)')} AS mean, max(activation) AS max, {sql_six('count(*) / max(L)::DOUBLE')} AS active_share FROM {ACTIVE} a JOIN (SELECT label, count(*) AS L FROM embeddings GROUP BY label) USING (label) GROUP BY ALL""")
def group_feature_stats(spark, sf):
    """Mean, maximum and active share over all positions of a group, zeros counted."""
    lengths = embeddings(spark, sf).groupBy("label").agg(F.count("*").alias("L"))
    rows = active(spark, sf).join(lengths, "label").groupBy("label", F.col("feature").cast("long").alias("feature"))
    return rows.agg(six(F.sum("activation") / F.max("L")).alias("mean"), F.max("activation").alias("max"), six(F.count("*") / F.max("L")).alias("active_share"))


@query("""WITH h AS (SELECT item_id, length(text) // 2 AS mid, text FROM benchmark), o AS (SELECT item_id, off, CASE WHEN mid + off BETWEEN 1 AND length(text) THEN substr(text, mid + off, 1) ELSE '-' END AS letter FROM (SELECT *, unnest(range(-7, 8)) AS off FROM h))
    SELECT off, letter, count(*) AS n, round(count(*) / (SELECT count(*) FROM benchmark)::DOUBLE, 6) + 0.0 AS frequency FROM o GROUP BY ALL""")
def motif_profile(spark, sf):
    """Frequency of each letter at each offset from a position; "-" beyond the ends."""
    rows = table(spark, sf, "benchmark").select("text", F.floor(F.length("text") / 2).alias("mid"), F.explode(F.sequence(F.lit(-7).cast("long"), F.lit(7).cast("long"))).alias("off"))
    place = F.col("mid") + F.col("off")
    letter = F.when(place.between(1, F.length("text")), F.substring(F.col("text"), place.cast("int"), F.lit(1))).otherwise("-")
    total = table(spark, sf, "benchmark").agg(F.count("*").alias("total"))
    counts = rows.groupBy("off", letter.alias("letter")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("off", "letter", "n", six(F.col("n") / F.col("total")).alias("frequency"))


FEATURE_MEANS = f"(SELECT label, feature, round(sum(activation), 9) AS score FROM {ACTIVE} GROUP BY ALL)"


def feature_means(spark, sf):
    return active(spark, sf).groupBy("label", F.col("feature").cast("long").alias("feature")).agg(F.round(F.sum("activation"), 9).alias("score"))


BEST = f"(SELECT feature, label, score FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, label) AS r FROM {FEATURE_MEANS}) WHERE r = 1)"


@query(f"""(SELECT 'high' AS side, feature, label, {sql_six('score')} AS score FROM {BEST} b ORDER BY b.score DESC, feature LIMIT 10)
    UNION ALL (SELECT 'low', feature, label, {sql_six('score')} FROM {BEST} b ORDER BY b.score, feature LIMIT 10)""")
def candidate_selection(spark, sf):
    """The best row of each feature; of these the ten highest and the ten lowest."""
    best = top_n(feature_means(spark, sf), 1, ["feature"], F.desc("score"), F.col("label")).select("feature", "label", "score")
    sides = [best.orderBy(*order).limit(10).select(F.lit(side).alias("side"), "feature", "label", six(F.col("score")).alias("score")) for side, order in (("high", (F.desc("score"), "feature")), ("low", ("score", "feature")))]
    return sides[0].unionByName(sides[1])


@query(f"""WITH t AS (SELECT feature, sum(score) AS s, max(score) AS m FROM {FEATURE_MEANS} GROUP BY feature), a AS (SELECT feature, 'sum' AS why FROM t ORDER BY s DESC, feature LIMIT 10), b AS (SELECT feature, 'max' AS why FROM t ORDER BY m DESC, feature LIMIT 10)
    SELECT feature, string_agg(why, '+' ORDER BY why) AS why FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY feature""")
def track_selection(spark, sf):
    """Two top-ten lists merged, with where each feature comes from."""
    t = feature_means(spark, sf).groupBy("feature").agg(F.sum("score").alias("sum"), F.max("score").alias("max"))
    lists = [t.orderBy(F.desc(c), "feature").limit(10).select("feature", F.lit(c).alias("why")) for c in ("sum", "max")]
    return lists[0].unionByName(lists[1]).groupBy("feature").agg(F.array_join(F.array_sort(F.collect_list("why")), "+").alias("why"))


@query(f"""WITH t AS (SELECT feature, round(sum(score), 6) AS s, round(max(score), 6) AS m FROM {FEATURE_MEANS} GROUP BY feature), r AS (SELECT feature, (rank() OVER (ORDER BY s DESC) + rank() OVER (ORDER BY m DESC)) / 2.0 AS mean_rank FROM t)
    SELECT feature, mean_rank::DOUBLE AS mean_rank FROM r ORDER BY mean_rank, feature LIMIT 20""")
def rank_aggregation(spark, sf):
    """The mean of two ranks of each feature; ties by its number; the first twenty. Features are few."""
    t = feature_means(spark, sf).groupBy("feature").agg(F.round(F.sum("score"), 6).alias("s"), F.round(F.max("score"), 6).alias("m"))
    rank = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c)))
    return t.select("feature", ((rank("s") + rank("m")) / 2).alias("mean_rank")).orderBy("mean_rank", "feature").limit(20)


@query(f"""WITH v AS (SELECT feature, label, score FROM {FEATURE_MEANS}), c AS (SELECT feature, score AS control FROM v WHERE label >= 5)
    SELECT v.feature, v.label, count(*) AS controls, {sql_six('avg((control <= v.score)::INT)')} AS percentile, {sql_six('(1 + count(*) FILTER (WHERE control >= v.score)) / (count(*) + 1)')} AS p FROM v JOIN c USING (feature) WHERE v.label < 5 GROUP BY v.feature, v.label, v.score""")
def control_percentile(spark, sf):
    """Place of each value among its controls, and (1 + number not smaller) / (n + 1)."""
    v = feature_means(spark, sf)
    controls = v.where("label >= 5").select("feature", F.col("score").alias("control"))
    pairs = v.where("label < 5").join(controls, "feature")
    below = F.avg((F.col("control") <= F.col("score")).cast("int"))
    above = F.sum((F.col("control") >= F.col("score")).cast("int"))
    return pairs.groupBy("feature", F.col("label").alias("label")).agg(F.count("*").alias("controls"), six(below).alias("percentile"), six((above + 1) / (F.count("*") + 1)).alias("p"))


# Splits, samples and controls


@query("""WITH d AS (SELECT doc_id, source, sha256(text) AS family FROM documents), t AS (SELECT DISTINCT family FROM d WHERE source = (SELECT max(source) FROM documents))
    SELECT doc_id, CASE WHEN source = (SELECT max(source) FROM documents) THEN 'test' WHEN t.family IS NOT NULL THEN 'purged' ELSE 'development' END AS split FROM d LEFT JOIN t USING (family)""")
def homolog_purge(spark, sf):
    """One source is the test set; rows elsewhere of its families are purged."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("family"))
    last = docs.agg(F.max("source")).first()[0]
    return cohort.held_out_source(docs, "source", last or "", "family").select("doc_id", "split")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 8")
def hash_balanced_sample(spark, sf):
    """A sampling operator: at most eight rows of each source in hash order."""
    return cohort.hash_sample(table(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id", 8, 42).select("source", "doc_id")


EDGES_SQL = "(SELECT list_distinct(quantile_cont(s_acctbal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM supplier)"
PLACED_SQL = f"(SELECT *, row_number() OVER (PARTITION BY decile, chosen ORDER BY sha256('7:' || s_suppkey), s_suppkey) AS turn FROM (SELECT s_suppkey, (s_suppkey % 5 = 0 OR (s_acctbal > 4000 AND s_suppkey % 5 < 3)) AS chosen, len(list_filter(e, lambda x: x < s_acctbal)) AS decile FROM supplier, {EDGES_SQL}))"


@query(f"""WITH p AS (SELECT * FROM {PLACED_SQL}), f AS (SELECT a.s_suppkey AS chosen_id, a.decile, b.s_suppkey AS control_id FROM p a LEFT JOIN p b ON a.decile = b.decile AND a.turn = b.turn AND NOT b.chosen WHERE a.chosen),
    need AS (SELECT chosen_id, decile, row_number() OVER (ORDER BY sha256('7:rest:' || chosen_id), chosen_id) AS turn FROM f WHERE control_id IS NULL),
    spare AS (SELECT s_suppkey AS control_id, row_number() OVER (ORDER BY sha256('7:rest:' || s_suppkey), s_suppkey) AS turn FROM p WHERE NOT chosen AND s_suppkey NOT IN (SELECT control_id FROM f WHERE control_id IS NOT NULL))
    SELECT chosen_id, decile, control_id FROM f WHERE control_id IS NOT NULL UNION ALL SELECT chosen_id, decile, control_id FROM need LEFT JOIN spare USING (turn)""")
def decile_matched_controls(spark, sf):
    """Controls from each chosen row's decile; where a decile runs out, from what is left anywhere."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", ((F.col("s_suppkey") % 5 == 0) | ((F.col("s_acctbal") > 4000) & (F.col("s_suppkey") % 5 < 3))).alias("chosen"))
    out = cohort.decile_controls(rows, "s_suppkey", "s_acctbal", "chosen", 7)
    return out.select("chosen_id", F.col("decile").cast("long").alias("decile"), "control_id")


@query(f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders) SELECT o_orderkey, {sql_six("coalesce(price, (SELECT quantile_cont(price, 0.5) FROM r WHERE o_orderkey % 4 <> 0))")} AS price, price IS NOT NULL AS has_price FROM r""")
def median_impute_flag(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("price"))
    return cohort.median_impute(rows, ["price"], "o_orderkey % 4 <> 0").select("o_orderkey", six(F.col("price")).alias("price"), "has_price")


@query()
def grouped_split(spark, sf):
    """Groups are equal texts; tests check shares, classes and that no group is divided."""
    rows = catalog(spark, sf).select("doc_id", F.sha2("text", 256).alias("family"), "quality")
    return cohort.grouped_split(rows, "family", "quality").select("doc_id", "split")


@query("SELECT 0 AS divided, 0 AS without_split, true AS shares, true AS classes")
def split_invariants(spark, sf):
    """What a grouped split guarantees: no divided group, the shares within three points, and both classes'
    shares within five of the whole."""
    rows = catalog(spark, sf).select("doc_id", F.sha2("text", 256).alias("family"), "quality")
    out = cohort.grouped_split(rows, "family", "quality")
    divided = out.groupBy("family").agg(F.count_distinct("split").alias("n")).agg(F.sum((F.col("n") > 1).cast("int")).alias("divided"))
    whole = out.agg(F.count("*").alias("all"), F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("rate"), F.sum(F.col("split").isNull().cast("int")).alias("without_split"))
    wanted = F.create_map(*(x for n, v in cohort.SPLITS.items() for x in (F.lit(n), F.lit(v))))
    each = out.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("own")).crossJoin(F.broadcast(whole))
    checked = each.agg(F.max("without_split").alias("without_split"), F.every(F.abs(F.col("n") / F.col("all") - wanted[F.col("split")]) <= 0.03).alias("shares"), F.every(F.abs(F.col("own") - F.col("rate")) <= 0.05).alias("classes"))
    return checked.crossJoin(F.broadcast(divided)).select(F.col("divided").cast("int").alias("divided"), F.col("without_split").cast("int").alias("without_split"), "shares", "classes")


def covariates(spark, sf):
    """Measures of labelled documents, read from the texts once and kept: what follows takes many passes over them."""
    d = F.col("text")
    space = F.length(d) - F.length(F.replace(d, F.lit(" "), F.lit("")))
    digits = F.length(F.regexp_replace(d, "[^0-9]+", ""))
    # Measured before the join, which then moves no text.
    measured = table(spark, sf, "documents").select("doc_id", F.log1p("n_chars").alias("a"), (space / (F.length(d) + 1)).alias("b"), (digits / (F.length(d) + 1)).alias("c"))
    rows = measured.join(table(spark, sf, "labels").where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    return saved(rows.select("doc_id", "quality", split_of(F.col("doc_id")).alias("split"), "a", "b", "c"), "covariates")


def propensities(values):
    return saved(causal.propensity(values, "quality", ["a", "b", "c"], "split = 'train'"), "propensities")


def spread_of(rows):
    return rows.where("split = 'train'").agg(F.stddev_samp("logit")).first()[0] or 0.0


@query()
def propensity_logit(spark, sf):
    return propensities(covariates(spark, sf)).select("doc_id", "split", "bin", six(F.col("logit")).alias("logit"))


def pairs(values):
    rows = propensities(values)
    return causal.matched_pairs(rows, ["split", "bin"], "doc_id", "quality", 0.2 * spread_of(rows))


@query()
def covariate_match(spark, sf):
    return pairs(covariates(spark, sf))


@query("SELECT true AS found, 0 AS repeated, 0 AS beyond_caliper, 0 AS wrong_class, true AS as_balanced")
def match_invariants(spark, sf):
    """What matching and pruning guarantee: units once at most, the caliper, one of each class, and no
    worse imbalance afterwards."""
    values = covariates(spark, sf)
    rows = propensities(values)
    spread = spread_of(rows)
    found = saved(causal.matched_pairs(rows, ["split", "bin"], "doc_id", "quality", 0.2 * spread), "pairs")
    pruned = saved(causal.pruned_pairs(found, values, "doc_id", ["a", "b", "c"]), "pairs")
    units = found.select(F.explode(F.array("zero", "one")).alias("doc_id"))
    label = rows.select("doc_id", F.col("quality").alias("y"))
    wrong = found.join(label.select(F.col("doc_id").alias("one"), F.col("y").alias("y1")), "one").join(label.select(F.col("doc_id").alias("zero"), F.col("y").alias("y0")), "zero").where("y1 <> 1 OR y0 <> 0")

    def worst(pairs):
        long = pairs.select(F.explode(F.array(F.struct(F.col("zero").alias("doc_id"), F.lit(0).alias("y")), F.struct(F.col("one").alias("doc_id"), F.lit(1).alias("y")))).alias("u")).select("u.*")
        each = long.join(values.select("doc_id", F.posexplode(F.array(*(F.col(c).cast("double") for c in "abc"))).alias("dim", "x")), "doc_id")
        return inference.smd(each, ["dim"], "y", "x").agg(F.max(F.abs("smd"))).first()[0] or 0.0

    row = (found.count() > 0, checks.repeated_keys(units, ["doc_id"]).count(), found.where(F.col("distance") > 0.2 * spread).count(), wrong.count(), worst(pruned) <= worst(found) + 1e-9)
    return spark.createDataFrame([row], "found boolean, repeated int, beyond_caliper int, wrong_class int, as_balanced boolean")


@query()
def balance_prune(spark, sf):
    values = covariates(spark, sf)
    return causal.pruned_pairs(pairs(values), values, "doc_id", ["a", "b", "c"])


@query(f"""WITH t AS (SELECT doc_id, split, ln(1 + n_chars) AS a, (length(text) - length(replace(text, ' ', ''))) / (length(text) + 1) AS b, length(regexp_replace(text, '[^0-9]', '', 'g')) / (length(text) + 1) AS c FROM {CATALOG} WHERE quality IS NOT NULL), y AS (SELECT doc_id, split, b, c, unnest([0, 1]) AS dim, unnest([a, b * a]) AS x FROM t),
    f AS (SELECT dim, avg(x) AS mx, avg(b) AS mb, avg(c) AS mc, covar_pop(b, x) AS bx, covar_pop(c, x) AS cx, covar_pop(b, c) AS bc, var_pop(b) AS bb, var_pop(c) AS cc FROM y WHERE split = 'train' GROUP BY dim)
    SELECT doc_id, dim, {sql_six('x - mx - (bx * cc - cx * bc) / (bb * cc - bc * bc) * (b - mb) - (cx * bb - bx * bc) / (bb * cc - bc * bc) * (c - mc)')} AS residual FROM y JOIN f USING (dim)""")
def residualize(spark, sf):
    """Two text measures less their fit on covariates from the training rows."""
    rows = covariates(spark, sf)
    outputs = rows.select("doc_id", F.posexplode(F.array("a", F.col("b") * F.col("a"))).alias("dim", "x"))
    return causal.residuals(rows, "doc_id", ["b", "c"], outputs, "split = 'train'").select("doc_id", "dim", six(F.col("residual")).alias("residual"))


@query("SELECT dim, true AS centred, true AS uncorrelated FROM (SELECT unnest([0, 1]) AS dim)")
def residual_invariants(spark, sf):
    """Residuals of the training rows sum to zero and have no correlation with the covariates."""
    rows = covariates(spark, sf)
    outputs = rows.select("doc_id", F.posexplode(F.array("a", F.col("b") * F.col("a"))).alias("dim", "x"))
    out = causal.residuals(rows, "doc_id", ["b", "c"], outputs, "split = 'train'").where("fit").join(rows.select("doc_id", "b", "c"), "doc_id")
    flat = F.abs(F.avg("residual")) < 1e-6
    zero = lambda c: F.abs(F.covar_pop("residual", c)) < 1e-6
    return out.groupBy("dim").agg(flat.alias("centred"), (zero("b") & zero("c")).alias("uncorrelated"))


@query()
def bootstrap_ci(spark, sf):
    return inference.bootstrap_mean(table(spark, sf, "documents").select("lang", "n_chars", "doc_id"), ["lang"], "n_chars", draws=500)


@query()
def mann_whitney_p(spark, sf):
    return inference.rank_biserial(grouped(spark, sf), ["flag"], "x", "y").select("flag", "u", "p")


@query()
def kruskal_p(spark, sf):
    return inference.kruskal(table(spark, sf, "documents").select("source", "n_chars"), "n_chars", "source").select("groups", "n", "h", "p")


@query()
def sign_flip_sampled(spark, sf):
    """For more units than an exact test takes: days of orders."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("view"), (F.col("l_orderkey") % 97).alias("unit")).agg((F.avg("l_discount") - 0.05).alias("d"))
    return inference.sign_flip_sampled(rows, ["view"], "d", "unit", draws=20_000)


@query(f"""WITH g AS (SELECT vec_id // 12 AS k, embedding[1]::DOUBLE AS x, (label < 5)::INT AS y FROM embeddings), r AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY x) AS r FROM g), s AS (SELECT k, sum(y)::INT AS n1, (count(*) - sum(y))::INT AS n0, coalesce(sum(r) FILTER (WHERE y = 1), 0) - sum(y) * (sum(y) + 1) / 2 AS u FROM r GROUP BY k),
    sizes AS (SELECT DISTINCT n1, n0 FROM s WHERE n1 > 0 AND n0 > 0), m AS (SELECT n1, n0, unnest(range(0, (2 ** (n1 + n0))::BIGINT)) AS mask FROM sizes),
    d AS (SELECT n1, n0, list_sum(list_transform(range(0, n1 + n0), lambda i: ((mask >> i) & 1) * (i + 1))) - n1 * (n1 + 1) // 2 AS v FROM m WHERE bit_count(mask) = n1)
    SELECT k, s.n1, s.n0, round(u, 1) AS u, {sql_six('least(1, 2 * avg((v >= greatest(u, s.n1 * s.n0 - u))::INT))')} AS p FROM s JOIN d ON s.n1 = d.n1 AND s.n0 = d.n0 GROUP BY ALL""")
def exact_rank_tests(spark, sf):
    """Exact Mann-Whitney tests of groups of twelve, against all ways to choose the members."""
    e = table(spark, sf, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 12).alias("k"), F.col("embedding")[0].cast("double").alias("x"), (F.col("label") < 5).cast("int").alias("y"))
    out = inference.rank_biserial(rows, ["k"], "x", "y")
    return out.select("k", F.col("n1").cast("int").alias("n1"), F.col("n0").cast("int").alias("n0"), F.round("u", 1).alias("u"), six(F.col("p")).alias("p"))
