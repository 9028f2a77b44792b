"""Chosen positions with their controls, resampled metrics, naive Bayes, and runs that can be resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditframe.functions import text
from auditframe.operators import checks, controls, hotspots, metrics, models, resampling, vectors
from auditframe.plans.registry import query, six, sql_six, table
from auditframe.plans.relational_queries import CATALOG, catalog
from auditframe.plans.study_queries import BIAS, DRAWS, ENCODED, SCORES, SHIFT, WEIGHT, draws_sql, encoder, scores
from auditframe.sources import resume, scratch

#: Groups of different sizes.
MIXED = f"(SELECT CASE WHEN vec_id % 4 = 0 THEN label ELSE 100 + vec_id // 12 END AS g, vec_id AS pos, floor(embedding[1]::DOUBLE * 50) AS x, CASE WHEN vec_id % 11 <> 0 THEN substr('{text.LETTERS}', (vec_id % 5 + 1)::INT, 1) END AS l FROM embeddings)"


def choice_sql(rows: str, most: int = 5) -> str:
    """CTEs up to ``chosen``: the hotspots of each group of ``rows`` (g, pos, x, l) and what each of them takes in turn."""
    out = f"""r AS {rows},
    n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x DESC, pos) AS rank, row_number() OVER (PARTITION BY g ORDER BY x) AS up, count(*) OVER (PARTITION BY g) AS size FROM r),
    c AS (SELECT *, rank <= least({most}, size // 2) AS hot, min(x) FILTER (WHERE up >= ceil((size - 1) * 0.5) + 1) OVER (PARTITION BY g) AS cut FROM n WHERE size > 1),
    e AS (SELECT *, count(*) FILTER (WHERE NOT hot AND x <= cut) OVER (PARTITION BY g) >= {most} AS enough FROM c), pool AS (SELECT * FROM e WHERE NOT hot AND (NOT enough OR x <= cut)), u0 AS (SELECT g, pos, 0 AS no FROM pool WHERE false)"""
    for k in range(1, most + 1):
        out += f""", u{k} AS (SELECT * FROM u{k - 1} UNION ALL (SELECT p.g, p.pos, {k} AS no FROM pool p JOIN e h ON h.g = p.g AND h.hot AND h.rank = {k} ANTI JOIN u{k - 1} u ON u.g = p.g AND u.pos = p.pos
        QUALIFY row_number() OVER (PARTITION BY p.g ORDER BY coalesce(p.l = h.l, false) DESC, abs(p.pos - h.pos), p.pos) = 1))"""
    return out + f""", chosen AS (SELECT e.*, 'hotspot' AS kind, pos AS matched, true AS letter_matched, 0 AS apart FROM e WHERE hot UNION ALL SELECT e.*, 'control', h.pos, coalesce(e.l = h.l, false), abs(e.pos - h.pos) FROM u{most} u JOIN e ON e.g = u.g AND e.pos = u.pos JOIN e h ON h.g = u.g AND h.hot AND h.rank = u.no)"""


@query(f"WITH {choice_sql(MIXED)} SELECT g, pos, kind, x AS value, rank, {sql_six('(size - rank + 1) / size')} AS quantile, matched, letter_matched, apart FROM chosen")
def hotspot_controls(spark, sf):
    """The greatest positions of groups of different sizes and the low ones matched to them, with ranks, letters and distances."""
    i = F.col("vec_id")
    group = F.when(i % 4 == 0, F.col("label").cast("long")).otherwise(100 + F.floor(i / 12))
    letter = F.when(i % 11 != 0, F.substring(F.lit(text.LETTERS), (i % 5 + 1).cast("int"), F.lit(1)))
    rows = table(spark, sf, "embeddings").select(group.alias("g"), i.alias("pos"), F.floor(F.col("embedding")[0].cast("double") * 50).cast("double").alias("x"), letter.alias("l"))
    return hotspots.hotspot_controls(rows, "g", "pos", "x", "l", strict=False).withColumn("quantile", six(F.col("quantile")))


BY_LABEL = f"(SELECT label AS g, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding[1]::DOUBLE AS x, substr('{text.LETTERS}', (vec_id % 5 + 1)::INT, 1) AS l FROM embeddings)"


@query(f"WITH {choice_sql(BY_LABEL)}, v AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings) SELECT g AS label, h.vec_id AS hotspot, c.vec_id AS control FROM chosen JOIN v h ON h.label = g AND h.pos = matched JOIN v c ON c.label = g AND c.pos = chosen.pos WHERE kind = 'control'")
def nearest_controls(spark, sf):
    """Nearest controls of each label's greatest values, one by one without replacement, the same letter first."""
    placed = vectors.positioned(table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x")), "label", "vec_id")
    rows = placed.select("label", "vec_id", "pos", "x", F.substring(F.lit(text.LETTERS), (F.col("vec_id") % 5 + 1).cast("int"), F.lit(1)).alias("letter"))
    out = hotspots.hotspot_controls(rows, "label", "pos", "x", "letter").where("kind = 'control'").select("label", "matched", "pos")
    ids = rows.select("label", "pos", "vec_id")
    return out.join(ids, ["label", "pos"]).select("label", "matched", F.col("vec_id").alias("control")).join(ids.select("label", F.col("pos").alias("matched"), F.col("vec_id").alias("hotspot")), ["label", "matched"]).select("label", "hotspot", "control")


BINS = [f"abs(sum((pos - (pos + neg) * p) * (bin = {i})::INT))" for i in range(10)]


@query(f"""WITH t AS (SELECT sum(y)::DOUBLE AS ones, sum(1 - y)::DOUBLE AS zeros FROM {SCORES}), d AS (SELECT draw, p, sum(w * y)::DOUBLE AS pw, sum(w * (1 - y))::DOUBLE AS nw FROM {draws_sql(SCORES, 12)} GROUP BY draw, p),
    s AS (SELECT draw, p, ones, zeros, pw * ones / sum(pw) OVER whole AS pos, nw * zeros / sum(nw) OVER whole AS neg FROM d, t WINDOW whole AS (PARTITION BY draw)),
    c AS (SELECT *, least(9, len(list_filter({metrics.EDGES[1:]}, lambda e: e <= p))) AS bin, sum(pos) OVER down AS seen_pos, sum(neg) OVER down AS seen_neg FROM s WINDOW down AS (PARTITION BY draw ORDER BY p DESC)),
    k AS (SELECT draw, any_value(ones) AS ones, any_value(zeros) AS zeros, sum(pos) FILTER (WHERE p >= 0.5) AS tp, sum(neg) FILTER (WHERE p >= 0.5) AS fp, sum((pos + neg) * p) AS total, sum(pos * (1 - p) ** 2 + neg * p ** 2) AS square,
        sum(pos * (zeros - seen_neg + neg / 2)) AS won, sum(pos * seen_pos / (seen_pos + seen_neg)) AS gain, {" + ".join(BINS)} AS off FROM c GROUP BY draw),
    v AS (SELECT draw, unnest({resampling.METRICS}) AS metric, unnest([ones / (ones + zeros), total / (ones + zeros), (tp + fp) / (ones + zeros), (tp + zeros - fp) / (ones + zeros), (tp / ones + (zeros - fp) / zeros) / 2, tp / ones, (zeros - fp) / zeros, (ones - tp) / ones, fp / zeros,
        2 * tp / (tp + fp + ones), (tp * (zeros - fp) - fp * (ones - tp)) / sqrt((tp + fp) * ones * zeros * (zeros - fp + ones - tp)), square / (ones + zeros), off / (ones + zeros), won / (ones * zeros), gain / ones]) AS value FROM k)
    SELECT metric, count(*) AS draws, {sql_six('quantile_cont(value, 0.025)')} AS low, {sql_six('quantile_cont(value, 0.975)')} AS high FROM v GROUP BY metric""")
def bootstrap_metrics(spark, sf):
    """Intervals of fifteen metrics from resamples within classes, all from one pass."""
    out = resampling.bootstrap_metrics(scores(spark, sf), "id", "y", "p", DRAWS, 12)
    return out.select("metric", "draws", six(F.col("low")).alias("low"), six(F.col("high")).alias("high"))


SMOOTHINGS = [1e-10, 1e-8, 1e-6, 1e-4]


@query(f"""WITH l AS (SELECT vec_id, label, vec_id % 5 = 0 AS test, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings), w AS (SELECT max(s) AS widest FROM (SELECT var_pop(x) AS s FROM l WHERE NOT test GROUP BY d)),
    m AS (SELECT label, d, avg(x) AS m, var_pop(x) AS s, count(*) AS n FROM l WHERE NOT test GROUP BY label, d), k AS (SELECT label, ln(n / (SELECT count(*) FROM embeddings WHERE vec_id % 5 <> 0)) AS prior FROM m WHERE d = 1),
    j AS (SELECT l.vec_id, smoothing, m.label, sum(-0.5 * (ln(2 * pi() * (m.s + smoothing * widest)) + (x - m.m) ** 2 / (m.s + smoothing * widest))) AS fit FROM l JOIN m USING (d), w, (SELECT unnest([1e-10, 1e-8, 1e-6, 1e-4]) AS smoothing) WHERE test GROUP BY ALL),
    f AS (SELECT vec_id, smoothing, label, fit + prior AS f FROM j JOIN k USING (label)), b AS (SELECT *, max(f) OVER (PARTITION BY vec_id, smoothing) AS best FROM f)
    SELECT vec_id, smoothing, arg_min(label, (-f, label)) AS predicted, {sql_six('1 / sum(exp(f - best))')} AS p FROM b GROUP BY vec_id, smoothing""")
def naive_bayes(spark, sf):
    """Class of every fifth vector by Gaussian naive Bayes fitted on the others, with four smoothings from one fit."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    model = models.gaussian_bayes(e.where("vec_id % 5 <> 0"), "embedding", "label")
    out = models.bayes_classes(e.where("vec_id % 5 = 0"), "vec_id", "embedding", model, SMOOTHINGS)
    return out.select("vec_id", "smoothing", "predicted", six(F.col("p")).alias("p"))


UPPER = f"regexp_replace(translate(coalesce(text, ''), '{text.LOWER}', '{text.UPPER}'), '[^A-Z]', '', 'g')"


@query(f"""WITH s AS (SELECT doc_id, {UPPER} AS s FROM documents), m AS (SELECT doc_id, s, sha256(s) AS own, sha256(replace(s, 'U', 'X')) AS model FROM s)
    SELECT coalesce(CASE WHEN doc_id % 37 = 0 THEN 'missing' WHEN doc_id % 31 = 0 THEN 'repeated' WHEN doc_id % 29 = 0 THEN 'sequence digest' WHEN doc_id % 23 = 0 THEN 'shape' WHEN doc_id % 19 = 0 THEN 'dtype' WHEN doc_id % 17 = 0 THEN 'representation' WHEN doc_id % 13 = 0 AND doc_id % 2 = 1 THEN 'policy' WHEN doc_id % 2 = 0 AND doc_id % 11 = 0 AND own <> model THEN 'model digest' END, 'none') AS fault, count(*) AS n FROM m GROUP BY 1""")
def embedding_identity(spark, sf):
    """Metadata of vectors against the sequences they were made from: which rule is broken first, and how often."""
    i = F.col("id")
    entries = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.as_sequence(F.coalesce("text", F.lit(""))).alias("sequence"))
    read = F.when((i % 2 == 0) & (i % 11 != 0), text.residues(F.col("sequence"))).otherwise(F.col("sequence"))
    known = entries.where(i % 37 != 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(i % 31 == 0, 1).otherwise(0))))
    metadata = known.select(
        "id", F.sha2(F.when(i % 29 == 0, F.concat("sequence", F.lit("A"))).otherwise(F.col("sequence")), 256).alias("sequence_sha256"), F.length("sequence").alias("rows"), F.when(i % 23 == 0, 32).otherwise(64).alias("width"),
        F.when(i % 19 == 0, "float16").otherwise("float32").alias("dtype"), F.lit("m").alias("model_id"), F.lit("1").alias("model_revision"), F.when(i % 17 != 0, "esm2_final_hidden_state").alias("representation"), F.lit("float32").alias("output_dtype"),
        F.when(i % 2 == 0, "U_to_X").when(i % 13 == 0, "other").alias("policy"), F.when(i % 2 == 0, F.sha2(read, 256)).alias("model_sequence_sha256"),
    )
    return checks.embedding_faults(entries, metadata, 64).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT text, quality, split FROM {CATALOG}), s AS (SELECT split, count(*) FILTER (WHERE quality = 0) AS zeros, count(*) FILTER (WHERE quality = 1) AS ones FROM c GROUP BY split)
    SELECT 'columns' AS rule, 0 AS n UNION ALL SELECT 'splits', count(*) FILTER (WHERE split NOT IN ('train', 'val', 'test')) + 3 - count(*) FILTER (WHERE split IN ('train', 'val', 'test')) FROM s UNION ALL SELECT 'labels', count(*) FROM c WHERE quality IS NULL OR quality NOT IN (0, 1)
    UNION ALL SELECT 'classes', 3 - count(*) FILTER (WHERE zeros > 0 AND ones > 0 AND split IN ('train', 'val', 'test')) FROM s UNION ALL SELECT 'groups', count(*) FROM (SELECT text FROM c WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT split) > 1)""")
def dataset_rules(spark, sf):
    """Rules of a fixed split: known splits, binary labels, both classes in each, no text in several."""
    return checks.dataset_faults(catalog(spark, sf), "quality", "split", "text")


@query(f"""WITH e AS (SELECT label, k, (SELECT sum({WEIGHT} * ((dim % 7) - 3) / 10.0) FROM range(0, 64) t(dim)) * sum(a) AS share FROM {ENCODED} GROUP BY label, k), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), sets AS (SELECT * FROM (VALUES ('even', 2, 0), ('threes', 3, 0), ('none', 99, 98)) t(name, step, rest)),
    s AS (SELECT label, name, sum(share) / any_value(n) + {SHIFT} * (SELECT sum(((dim % 7) - 3) / 10.0) FROM range(0, 64) t(dim)) + 0.2 AS score, coalesce(sum(share) FILTER (WHERE k % step = rest), 0) / any_value(n) AS part FROM e JOIN n USING (label), sets GROUP BY label, name)
    SELECT label, name, {sql_six('1 / (1 + exp(-score))')} AS before, {sql_six('1 / (1 + exp(part - score))')} AS after, {sql_six('1 / (1 + exp(-score)) - 1 / (1 + exp(part - score))')} AS "drop" FROM s""")
def latent_set_ablation(spark, sf):
    """How much the probability of a group's pooled vector falls when whole sets of latents are taken out of its decoding."""
    coef = [((d % 7) - 3) / 10.0 for d in range(64)]
    sets = {"even": list(range(0, 16, 2)), "threes": list(range(0, 16, 3)), "none": []}
    out = controls.ablated_sets(table(spark, sf, "embeddings"), "label", "embedding", encoder(), coef, sets, shift=SHIFT, bias=BIAS, top=4, intercept=0.2)
    return out.select("label", "name", *(six(F.col(c)).alias(c) for c in ("before", "after", "drop")))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM documents")
def resumed_digests(spark, sf):
    """Digests of whole texts, made in a run of four batches that stops after one and goes on from there."""
    path = f"{scratch.shared_dir(spark)}/resumed-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    work = lambda part: part.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"))
    for most in (1, None):
        resume.advance(docs, "doc_id", path, {"digest": "sha256"}, work, batches=4, most=most)
    return resume.result(spark, path)
