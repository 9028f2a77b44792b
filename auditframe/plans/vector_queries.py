"""Vectors: the rows of ``embeddings`` stand for positions of ten groups (``label``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators import sparse, vectors
from auditframe.operators.ranks import top_fraction, top_n
from auditframe.operators.structure import align, near_points, response_scan, rmsd, superposed
from auditframe.plans.registry import query, six, sql_six, table

LONG = "(SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
PLACED = "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS L FROM embeddings)"
ACTIVE = f"""(SELECT label, vec_id, dim AS feature, x AS activation FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, dim) AS place FROM {LONG} WHERE x > 0) WHERE place <= 8)"""
DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def embeddings(spark, sf):
    return table(spark, sf, "embeddings")


def active(spark, sf):
    return sparse.top_k(embeddings(spark, sf), ["label", "vec_id"], "embedding", 8)


def targets(spark, sf):
    """A target for each position: the first component, which no feature statistic is made from."""
    return embeddings(spark, sf).select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 3).alias("y"))


TARGETS = "(SELECT label, vec_id, round(embedding[1]::DOUBLE, 3) AS y FROM embeddings)"


@query(f"SELECT label, dim, {sql_six('avg(x)')} AS mean, {sql_six('stddev_pop(x)')} AS std, max(x) AS max FROM {LONG} GROUP BY label, dim")
def pooled_vectors(spark, sf):
    out = vectors.pooled(vectors.long(embeddings(spark, sf), ["label"], "embedding"), ["label"])
    return out.select("label", F.col("dim").cast("long").alias("dim"), six(F.col("mean")).alias("mean"), six(F.col("std")).alias("std"), "max")


@query(f"""SELECT label, segment, dim, {sql_six('avg(x)')} AS mean, {sql_six('stddev_pop(x)')} AS std FROM (
    SELECT label, dim, x, (CASE WHEN pos >= floor(L * 1 / 4) THEN 1 ELSE 0 END + CASE WHEN pos >= floor(L * 2 / 4) THEN 1 ELSE 0 END + CASE WHEN pos >= floor(L * 3 / 4) THEN 1 ELSE 0 END)::BIGINT AS segment
    FROM (SELECT label, pos, L, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM {PLACED})) GROUP BY ALL""")
def pool_segments(spark, sf):
    placed = vectors.positioned(embeddings(spark, sf), "label", "vec_id").withColumn("segment", vectors.segment(F.col("pos"), F.col("L"), 4).cast("long"))
    out = vectors.pooled(vectors.long(placed, ["label", "segment"], "embedding"), ["label", "segment"])
    return out.select("label", "segment", F.col("dim").cast("long").alias("dim"), six(F.col("mean")).alias("mean"), six(F.col("std")).alias("std"))


@query(f"""SELECT a.label, CASE WHEN b.pos - a.pos <= 8 THEN '1-8' ELSE '9-32' END AS band, count(*) AS pairs, {sql_six(f'avg({DOT})')} AS mean, {sql_six(f'stddev_pop({DOT})')} AS std, {sql_six(f'max({DOT})')} AS max
    FROM {PLACED} a JOIN {PLACED} b ON a.label = b.label AND b.pos - a.pos BETWEEN 1 AND 32 GROUP BY ALL""")
def pair_band_pool(spark, sf):
    pairs = vectors.band_pairs(vectors.positioned(embeddings(spark, sf), "label", "vec_id"), "label", "embedding", 32)
    band = F.when(F.col("apart") <= 8, "1-8").otherwise("9-32").alias("band")
    return pairs.groupBy("label", band).agg(F.count("*").alias("pairs"), six(F.avg("dot")).alias("mean"), six(F.stddev_pop("dot")).alias("std"), six(F.max("dot")).alias("max"))


@query(f"SELECT a.label, {sql_six(f'avg({DOT})')} AS mean FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label")
def pair_global_mean(spark, sf):
    return vectors.all_pairs_mean(embeddings(spark, sf), "label", "embedding").select("label", six(F.col("mean")).alias("mean"))


@query(f"""WITH m AS (SELECT label, dim, avg(x) AS m FROM {LONG} GROUP BY ALL)
    SELECT vec_id, label, {sql_six('sqrt(sum(x * x))')} AS norm, {sql_six('sqrt(sum((x - m) * (x - m)))')} AS distance, {sql_six('sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)))')} AS cosine FROM {LONG} JOIN m USING (label, dim) GROUP BY ALL""")
def vector_scalars(spark, sf):
    out = vectors.scalars(embeddings(spark, sf), "vec_id", "label", "embedding")
    return out.select("vec_id", "label", *(six(F.col(c)).alias(c) for c in ("norm", "distance", "cosine")))


@query(f"SELECT vec_id, {sql_six('sum(x * ((dim % 7) - 3) / 10.0) + 0.25')} AS score FROM {LONG} GROUP BY vec_id")
def linear_score(spark, sf):
    coefficients = spark.range(64).select(F.col("id").cast("int").alias("dim"), ((F.col("id") % 7 - 3) / 10.0).alias("coef"))
    return vectors.linear_score(embeddings(spark, sf), ["vec_id"], "embedding", coefficients, 0.25).select("vec_id", six(F.col("score")).alias("score"))


@query(f"SELECT label, {sql_six('avg((x - round(x, 1)) * (x - round(x, 1)))')} AS mse, {sql_six('1 - avg((x - round(x, 1)) * (x - round(x, 1))) / var_pop(x)')} AS explained FROM {LONG} GROUP BY label")
def reconstruction_error(spark, sf):
    out = vectors.reconstruction(vectors.long(embeddings(spark, sf), ["label"], "embedding"), F.round("x", 1), ["label"])
    return out.select("label", six(F.col("mse")).alias("mse"), six(F.col("explained")).alias("explained"))


@query(f"SELECT label, vec_id, feature, activation FROM {ACTIVE}")
def sparse_topk(spark, sf):
    return active(spark, sf).withColumn("feature", F.col("feature").cast("long"))


@query(f"SELECT feature, {sql_six('sum(activation) / (SELECT count(*) FROM embeddings)')} AS mean, max(activation) AS max, count(*) AS active, {sql_six('count(*) / (SELECT count(*) FROM embeddings)::DOUBLE')} AS density FROM {ACTIVE} GROUP BY feature")
def sparse_feature_summary(spark, sf):
    out = sparse.feature_summary(active(spark, sf), embeddings(spark, sf))
    return out.select(F.col("feature").cast("long").alias("feature"), six(F.col("mean")).alias("mean"), "max", "active", six(F.col("density")).alias("density"))


@query(f"SELECT feature, vec_id, activation, place FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY activation DESC, vec_id) AS place FROM {ACTIVE}) WHERE place <= 20")
def topk_per_feature(spark, sf):
    out = top_n(active(spark, sf), 20, ["feature"], F.desc("activation"), F.col("vec_id"))
    return out.select(F.col("feature").cast("long").alias("feature"), "vec_id", "activation", F.col("place").cast("long").alias("place"))


@query(f"""WITH l AS (SELECT label, count(*) AS L FROM embeddings GROUP BY label), d AS (
    SELECT e.label, e.vec_id, f.feature, coalesce(a.activation, 0) AS v, l.L FROM embeddings e JOIN (SELECT DISTINCT label, feature FROM {ACTIVE}) f USING (label) JOIN l USING (label) LEFT JOIN {ACTIVE} a ON a.vec_id = e.vec_id AND a.feature = f.feature)
    SELECT label, feature, vec_id, rank FROM (SELECT *, rank() OVER (PARTITION BY label, feature ORDER BY v) + (count(*) OVER (PARTITION BY label, feature, v) - 1) / 2.0 AS rank FROM d) WHERE v > 0""")
def sparse_ranks(spark, sf):
    from auditframe.operators.ranks import sparse_average_ranks

    lengths = embeddings(spark, sf).groupBy("label").agg(F.count("*").alias("L"))
    out = sparse_average_ranks(active(spark, sf), lengths, ["label", "feature"], "activation")
    return out.select("label", F.col("feature").cast("long").alias("feature"), "vec_id", F.col("rank").cast("double").alias("rank"))


DENSE = f"""(SELECT e.label, e.vec_id, f.feature, coalesce(a.activation, 0.0) AS v, t.y, 1.0 / count(*) OVER (PARTITION BY e.label, f.feature) AS w, count(*) OVER (PARTITION BY e.label, f.feature) AS L
    FROM embeddings e CROSS JOIN (SELECT DISTINCT feature FROM {ACTIVE}) f JOIN {TARGETS} t USING (vec_id) LEFT JOIN {ACTIVE} a ON a.vec_id = e.vec_id AND a.feature = f.feature)"""


@query(f"""SELECT feature, count(*) FILTER (WHERE v > 0) AS active, {sql_six('corr(v, y)')} AS global_pearson, {sql_six('regr_slope(y, v)')} AS global_slope,
    {sql_six('(sum(w*v*y)/sum(w) - sum(w*v)/sum(w)*sum(w*y)/sum(w)) / sqrt((sum(w*v*v)/sum(w) - (sum(w*v)/sum(w))**2) * (sum(w*y*y)/sum(w) - (sum(w*y)/sum(w))**2))')} AS balanced_pearson,
    {sql_six('(sum(w*v*y)/sum(w) - sum(w*v)/sum(w)*sum(w*y)/sum(w)) / (sum(w*v*v)/sum(w) - (sum(w*v)/sum(w))**2)')} AS balanced_slope FROM {DENSE} GROUP BY feature""")
def sparse_pearson_slope(spark, sf):
    out = sparse.association(active(spark, sf), targets(spark, sf), "label", "vec_id", "y")
    return out.select(F.col("feature").cast("long").alias("feature"), "active", *(six(F.col(c)).alias(c) for c in ("global_pearson", "global_slope", "balanced_pearson", "balanced_slope")))


@query(f"""WITH r AS (SELECT feature, w, (rank() OVER (PARTITION BY label, feature ORDER BY v) + (count(*) OVER (PARTITION BY label, feature, v) - 1) / 2.0) / L AS a,
    (rank() OVER (PARTITION BY label, feature ORDER BY y) + (count(*) OVER (PARTITION BY label, feature, y) - 1) / 2.0) / L - (L + 1) / (2.0 * L) AS b FROM {DENSE})
    SELECT feature, {sql_six('(sum(w*a*b)/sum(w) - sum(w*a)/sum(w)*sum(w*b)/sum(w)) / sqrt((sum(w*a*a)/sum(w) - (sum(w*a)/sum(w))**2) * (sum(w*b*b)/sum(w) - (sum(w*b)/sum(w))**2))')} AS spearman FROM r GROUP BY feature""")
def sparse_balanced_spearman(spark, sf):
    out = sparse.balanced_spearman(active(spark, sf), targets(spark, sf), "label", "vec_id", "y")
    return out.select(F.col("feature").cast("long").alias("feature"), six(F.col("spearman")).alias("spearman"))


@query(f"""WITH p AS (SELECT a.feature AS "left", b.feature AS "right", sum(a.activation * b.activation) AS dot FROM {ACTIVE} a JOIN {ACTIVE} b ON a.vec_id = b.vec_id GROUP BY ALL)
    SELECT p."left", p."right", {sql_six('p.dot / sqrt(l.dot * r.dot)')} AS cosine FROM p JOIN p l ON l."left" = p."left" AND l."right" = p."left" JOIN p r ON r."left" = p."right" AND r."right" = p."right" WHERE p."left" < p."right" """)
def feature_cosine_matrix(spark, sf):
    out = sparse.feature_cosine(active(spark, sf), ["vec_id"])
    return out.select(F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), six(F.col("cosine")).alias("cosine"))


@query(f"""WITH s AS (SELECT label, feature, vec_id, activation, row_number() OVER (PARTITION BY label, feature ORDER BY activation DESC, vec_id) AS place, count(*) OVER (PARTITION BY label, feature) AS size FROM {ACTIVE})
    SELECT label, feature, count(*) AS n, {sql_six('avg(activation) FILTER (WHERE place <= greatest(1, ceil(size * 0.1)))')} AS top_mean, {sql_six('avg(activation)')} AS mean FROM s GROUP BY ALL""")
def top_fraction_enrichment(spark, sf):
    marked = top_fraction(active(spark, sf), 0.1, ["label", "feature"], F.desc("activation"), F.col("vec_id"))
    out = marked.groupBy("label", F.col("feature").cast("long").alias("feature"))
    return out.agg(F.count("*").alias("n"), six(F.avg(F.when(F.col("is_top"), F.col("activation")))).alias("top_mean"), six(F.avg("activation")).alias("mean"))


@query(f"""WITH s AS (SELECT e.label, e.vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings e)
    SELECT x.label, x.vec_id AS "left", y.vec_id AS "right", {sql_six('sqrt((x.a-y.a)**2 + (x.b-y.b)**2)')} AS distance FROM s x JOIN s y ON x.label = y.label AND x.vec_id < y.vec_id WHERE (x.a-y.a)**2 + (x.b-y.b)**2 <= 0.02 * 0.02 AND y.vec_id - x.vec_id > 2""")
def proximity_pairs(spark, sf):
    points = embeddings(spark, sf).select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("ab")))
    out = near_points(points, "vec_id", "label", ["a", "b"], 0.02, apart="vec_id", least_apart=2)
    return out.select("label", "left", "right", six(F.col("distance")).alias("distance"))


@query(f"""WITH s AS (SELECT label, vec_id, activation, row_number() OVER (PARTITION BY label ORDER BY activation DESC, vec_id, feature) AS place, count(*) OVER (PARTITION BY label) AS size FROM {ACTIVE})
    SELECT label, {sql_six('avg(activation) FILTER (WHERE place <= 10)')} AS top, {sql_six('avg(activation) FILTER (WHERE place > 10)')} AS rest FROM s WHERE size > 10 GROUP BY label""")
def top_n_vs_rest(spark, sf):
    from pyspark.sql import Window

    own = Window.partitionBy("label")
    marked = active(spark, sf).select("label", "activation", F.row_number().over(own.orderBy(F.desc("activation"), "vec_id", "feature")).alias("place"), F.count("*").over(own).alias("size")).where("size > 10")
    return marked.groupBy("label").agg(six(F.avg(F.when(F.col("place") <= 10, F.col("activation")))).alias("top"), six(F.avg(F.when(F.col("place") > 10, F.col("activation")))).alias("rest"))


@query()
def permutation_null(spark, sf):
    return sparse.permutation_null(active(spark, sf), targets(spark, sf), "label", "vec_id", "y", draws=50, seed=1)


def superposition_sql() -> str:
    """The distance after superposition from the greatest root of a quartic whose coefficients are invariants of the covariance, by Newton steps from above."""
    axes = range(1, 4)
    s = {(i, j): f"covar_pop(a[{i}], a[{j + 3}])" for i in axes for j in axes}
    names = ", ".join(f"{e} AS s{i}{j}" for (i, j), e in s.items())
    spread = " + ".join(f"var_pop(a[{i}])" for i in range(1, 7))
    square = " + ".join(f"s{i}{j} * s{i}{j}" for i, j in s)
    two = [(1, 2), (1, 3), (2, 3)]
    minors = " + ".join(f"(s{i}{k} * s{j}{m} - s{i}{m} * s{j}{k}) ** 2" for i, j in two for k, m in two)
    det = " + ".join(f"s1{i} * (s2{j} * s3{k} - s2{k} * s3{j})" for i, j, k in ((1, 2, 3), (2, 3, 1), (3, 1, 2)))
    return f"""WITH RECURSIVE c AS (SELECT label, count(*) AS n, {spread} AS g, {names} FROM (SELECT label, embedding::DOUBLE[] AS a FROM embeddings) GROUP BY label HAVING count(*) >= 3), q AS (SELECT label, n, g, {square} AS f, {minors} AS m, {det} AS d FROM c),
    r AS (SELECT label, n, g, f, m, d, g / 2 AS x, 0 AS step FROM q UNION ALL SELECT label, n, g, f, m, d, x - (x ** 4 - 2 * f * x * x - 8 * d * x + f * f - 4 * m) / (4 * x ** 3 - 4 * f * x - 8 * d), step + 1 FROM r WHERE step < 60)
    SELECT label, n, {sql_six('sqrt(g - 2 * x)')} AS rmsd FROM r WHERE step = 60"""


@query(superposition_sql())
def kabsch_rmsd(spark, sf):
    """Distance of two point sets of each label after the best turn and shift."""
    e = F.col("embedding")
    points = embeddings(spark, sf).select("label", "vec_id", *(e[i].cast("double").alias(f"a{i}") for i in range(3)), *(e[i + 3].cast("double").alias(f"b{i}") for i in range(3)))
    out = rmsd(superposed(points, ["label"], "vec_id", ["a0", "a1", "a2"], ["b0", "b1", "b2"]), ["label"])
    return out.select("label", "n", six(F.col("rmsd")).alias("rmsd"))


@query("SELECT label, true AS superposed FROM embeddings GROUP BY label HAVING count(*) >= 3")
def kabsch_of_turned_points(spark, sf):
    """Points against themselves turned by 40 degrees and shifted: nothing is left after superposition."""
    e, c, s = F.col("embedding"), 0.766044443118978, 0.6427876096865393
    x, y, z = (e[i].cast("double") for i in range(3))
    points = embeddings(spark, sf).select("label", "vec_id", x.alias("a0"), y.alias("a1"), z.alias("a2"), (x * c - y * s + 3).alias("b0"), (x * s + y * c - 1).alias("b1"), (z + 0.5).alias("b2"))
    out = rmsd(superposed(points, ["label"], "vec_id", ["a0", "a1", "a2"], ["b0", "b1", "b2"]), ["label"])
    return out.select("label", (F.col("rmsd") < 1e-6).alias("superposed"))


@query()
def response_scan_of_groups(spark, sf):
    """Groups of 25 positions, and what is left of each label, stand for structures."""
    placed = vectors.positioned(embeddings(spark, sf), "label", "vec_id")
    e = F.col("embedding")
    points = placed.select(F.concat_ws(":", "label", F.floor(F.col("pos") / 25)).alias("structure"), "vec_id", *((e[i].cast("double") * 12).alias(c) for i, c in enumerate("xyz")), *(e[i + 3].cast("double").alias(f"m{c}") for i, c in enumerate("xyz")))
    return response_scan(points, "structure", "vec_id", ["x", "y", "z"], ["mx", "my", "mz"], directions=50)


@query()
def align_identity(spark, sf):
    """Each benchmark item against the next one."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(after, "item_id").select("item_id", align("text", "other").alias("a")).select("item_id", "a.identity", "a.coverage")
