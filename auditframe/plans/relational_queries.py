"""Scans, checks, joins, reshapes and summaries: ``documents`` stand for the catalog, ``labels`` for
its classes, orders and their lines for large relational load."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.functions import text
from auditframe.operators import checks
from auditframe.plans.registry import query, six, sql_six, table

#: Catalog rows with a class where there is one, and a split by id.
CATALOG = "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, CASE d.doc_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM documents d LEFT JOIN labels l USING (doc_id))"


def split_of(doc_id):
    return F.when(doc_id % 5 == 3, "val").when(doc_id % 5 == 4, "test").otherwise("train")


def catalog(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("split", split_of(F.col("doc_id")))


def long(c):
    return F.col(c).cast("long").alias(c) if isinstance(c, str) else c.cast("long")


# Text, hashes and JSON

SEQUENCE = f"regexp_replace(translate(coalesce(text, ''), '{text.LOWER}', '{text.UPPER}'), '[^A-Z]', '', 'g')"
SHARES = ", ".join(f"CASE WHEN length(s) > 0 THEN (length(s) - length(replace(s, '{a}', ''))) / length(s) ELSE 0.0 END AS f_{a}" for a in text.LETTERS)
ENTROPY = " + ".join(f"(CASE WHEN f_{a} > 0 THEN -f_{a} * ln(f_{a}) ELSE 0.0 END)" for a in text.LETTERS)


@query(f"WITH s AS (SELECT doc_id, {SEQUENCE} AS s FROM documents), f AS (SELECT doc_id, s, {SHARES} FROM s) SELECT doc_id, {', '.join(sql_six(f'f_{a}') + f' AS f_{a}' for a in text.LETTERS)}, {sql_six(ENTROPY)} AS entropy, {sql_six('ln(1 + length(s))')} AS log_length FROM f")
def seq_covariates(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", text.as_sequence(F.coalesce("text", F.lit(""))).alias("s"))
    shares = s.select("doc_id", "s", *(text.letter_fraction(F.col("s"), a).alias(f"f_{a}") for a in text.LETTERS))
    return shares.select("doc_id", *(six(F.col(f"f_{a}")).alias(f"f_{a}") for a in text.LETTERS), six(text.entropy([F.col(f"f_{a}") for a in text.LETTERS])).alias("entropy"), six(F.log1p(F.length("s"))).alias("log_length"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def sha_identity(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query(f"SELECT sha256(text) AS digest, count(*) FILTER (WHERE quality = 1) AS ones, count(*) FILTER (WHERE quality = 0) AS zeros FROM {CATALOG} GROUP BY sha256(text) HAVING ones > 0 AND zeros > 0")
def cross_class_exact_overlap(spark, sf):
    return checks.shared_between_classes(catalog(spark, sf).select(F.sha2("text", 256).alias("digest"), "quality"), "digest", "quality").select("digest", "ones", "zeros")


@query(f"""WITH e AS (SELECT quality, list_sort(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS g, doc_id FROM {CATALOG} WHERE quality IS NOT NULL AND length(text) >= 3),
    d AS (SELECT quality, min(doc_id) AS id, count(*) AS copies, g FROM e GROUP BY quality, g), g AS (SELECT quality, id, copies, len(g) AS n, unnest(g) AS gram FROM d)
    SELECT a.id AS one, b.id AS zero, a.copies AS ones, b.copies AS zeros, {sql_six('count(*) / sqrt(a.n::DOUBLE * b.n)')} AS cosine FROM g a JOIN g b ON a.gram = b.gram AND a.quality = 1 AND b.quality = 0 GROUP BY a.id, b.id, a.copies, b.copies, a.n, b.n HAVING count(*) / sqrt(a.n::DOUBLE * b.n) >= 0.95 - 1e-12""")
def near_duplicate_ngrams(spark, sf):
    labelled = catalog(spark, sf).where(F.col("quality").isNotNull()).select("doc_id", "quality", text.grams(F.col("text"), 3).alias("grams"))
    return checks.near_duplicates(labelled, "doc_id", "quality", "grams", 0.95).select("one", "zero", "ones", "zeros", six(F.col("cosine")).alias("cosine"))


@query("""SELECT id, count(DISTINCT event_type) AS classes, count(*) AS uses FROM (
    SELECT event_type, unnest(from_json(js, '["VARCHAR"]')) AS id FROM (SELECT event_type, '["' || user_id || '","k' || json_extract_string(props, '$.k') || '"' || CASE WHEN event_id % 10 = 0 THEN '' ELSE ']' END AS js FROM events) WHERE json_valid(js)) GROUP BY id HAVING count(DISTINCT event_type) > 1""")
def json_expand_ids(spark, sf):
    """Identifiers in JSON lists that occur in several classes; malformed lists hold none."""
    k = F.get_json_object("props", "$.k")
    js = F.concat(F.lit('["'), F.col("user_id").cast("string"), F.lit('","k'), k, F.lit('"'), F.when(F.col("event_id") % 10 == 0, "").otherwise("]"))
    each = table(spark, sf, "events").select("event_type", F.explode(text.json_list(js)).alias("id"))
    return each.groupBy("id").agg(F.count_distinct("event_type").alias("classes"), F.count("*").alias("uses")).where("classes > 1")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') WHEN event_id % 3 = 1 THEN event_type END AS found FROM events""")
def json_first_nonempty(spark, sf):
    """The first usable field among records with empty, unknown and missing ones."""
    last = F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("unknown")
    js = F.concat(F.lit('[{"v":""},{"v":"Unknown"},{},{"v":"'), last, F.lit('"}]'))
    records = text.json_list(js, "array<struct<v:string>>")
    return table(spark, sf, "events").select("event_id", text.first_usable(records, "v").alias("found"))


WORDS = "list_distinct(string_split(lower(text), ' '))"


@query(f"""WITH w AS (SELECT item_id, {WORDS} AS a FROM benchmark), p AS (SELECT w.item_id, w.a, n.a AS b, len(list_intersect(w.a, n.a)) AS shared FROM w JOIN w n ON n.item_id = w.item_id + 1)
    SELECT item_id, len(b) - shared AS gained, len(a) - shared AS lost, {sql_six('shared / (len(a) + len(b) - shared)')} AS jaccard FROM p""")
def set_delta_jaccard(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("a"))
    after = words.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    delta = words.join(after, "item_id").select("item_id", text.set_delta(F.col("a"), F.col("b")).alias("d"))
    return delta.select("item_id", long(F.col("d.gained")).alias("gained"), long(F.col("d.lost")).alias("lost"), six(F.col("d.jaccard")).alias("jaccard"))


@query("SELECT o_orderkey, sha256('42:' || o_orderkey) AS turn, (('0x' || substr(sha256('42:' || o_orderkey), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS u FROM orders")
def hash_order(spark, sf):
    """Seeded hash order and a uniform number from the same digest."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", F.sha2(F.concat_ws(":", F.lit("42"), key), 256).alias("turn"), text.hash_uniform(F.lit("42"), key).alias("u"))


@query("SELECT item_id, generate_subscripts(string_split(s, ''), 1) AS pos, unnest(string_split(s, '')) AS letter FROM (SELECT item_id, substr(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g'), 1, 256) AS s FROM benchmark) WHERE length(s) > 0")
def sequence_onehot(spark, sf):
    """Sparse one-hot rows (position, letter) of the first 256 letters."""
    s = F.substring(text.as_sequence(F.col("text")), 1, 256)
    rows = table(spark, sf, "benchmark").select("item_id", s.alias("s")).where("length(s) > 0")
    return rows.select("item_id", F.posexplode(F.split("s", "")).alias("pos", "letter")).select("item_id", (F.col("pos") + 1).cast("long").alias("pos"), "letter")


@query("""SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, printf('%.4f', avg(n_chars)) AS mean_chars FROM documents GROUP BY source""")
def sorted_concat(spark, sf):
    """Sorted distinct values as one text, and a formatted number."""
    out = table(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"), F.avg("n_chars").alias("m"))
    return out.select("source", F.array_join(F.array_sort("langs"), ",").alias("langs"), F.format_string("%.4f", "m").alias("mean_chars"))


@query("SELECT conv_id, turn, substr(text, greatest(length(text) // 2 - 7, 1), 15) AS around, round((length(text) // 2) / length(text), 6) + 0.0 AS relative FROM conversations WHERE length(text) > 0")
def window_around(spark, sf):
    """Text around a position, and its relative place."""
    n = F.length("text")
    half = F.floor(n / 2)
    return table(spark, sf, "conversations").where("length(text) > 0").select("conv_id", "turn", F.substring(F.col("text"), F.greatest(half - 7, F.lit(1)).cast("int"), F.lit(15)).alias("around"), six(half / n).alias("relative"))


@query("""WITH h AS (SELECT page_id, lower(split_part(split_part(url, '://', 2), '/', 1)) AS host, lower(trim(split_part(url, ':', 1))) AS scheme FROM pages)
    SELECT scheme, host, count(*) AS pages, scheme IN ('http', 'https') AS known FROM h GROUP BY ALL""")
def provenance_prefix(spark, sf):
    """The prefix and the host of an identifier, with a check of the prefix's domain."""
    scheme = F.lower(F.trim(F.split_part("url", F.lit(":"), F.lit(1))))
    host = F.lower(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    return table(spark, sf, "pages").groupBy(scheme.alias("scheme"), host.alias("host")).agg(F.count("*").alias("pages")).withColumn("known", F.col("scheme").isin("http", "https"))


@query("""SELECT p_type AS type, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected FROM (SELECT p_type, regexp_matches(p_brand, '^Brand#[1-3][0-9]*$') AND p_size <= 40 AS ok FROM part) GROUP BY p_type""")
def accepted_rejected(spark, sf):
    """Rows split by an alphabet rule and a size limit."""
    ok = F.col("p_brand").rlike("^Brand#[1-3][0-9]*$") & (F.col("p_size") <= 40)
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("type")).agg(F.sum(ok.cast("long")).alias("accepted"), F.sum((~ok).cast("long")).alias("rejected"))


@query("""SELECT s.n_nationkey, s.code, list_sort(list_distinct(list_filter(s.codes, lambda c: regexp_matches(c, '^[A-Z]{4}$')))) AS codes FROM (
    SELECT n_nationkey, split_part(upper(n_name), '_', 1) AS code, [upper(substr(n_name, 1, 4)), upper(substr(n_name, 2, 4)), upper(substr(n_name, 1, 4)), 'a1'] AS codes FROM nation) s""")
def codes_of_ids(spark, sf):
    """A leading code, and the sorted distinct codes that match a pattern."""
    name = F.upper("n_name")
    codes = F.array(F.substring(name, 1, 4), F.substring(name, 2, 4), F.substring(name, 1, 4), F.lit("a1"))
    fine = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.rlike("^[A-Z]{4}$"))))
    return table(spark, sf, "nation").select("n_nationkey", F.split_part(name, F.lit("_"), F.lit(1)).alias("code"), fine.alias("codes"))


# Checks


@query(f"""SELECT 'repeated id' AS "check", count(*) AS rows FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
    UNION ALL SELECT 'length', count(*) FROM documents WHERE n_chars <> length(text)
    UNION ALL SELECT 'language', count(*) FROM documents WHERE lang NOT IN ('en', 'de', 'fr', 'es') OR lang IS NULL
    UNION ALL SELECT 'source', count(*) FROM documents WHERE coalesce(trim(source), '') = ''
    UNION ALL SELECT 'label', count(*) FROM labels WHERE quality NOT IN (0, 1)
    UNION ALL SELECT 'repeated text', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
    UNION ALL SELECT 'unknown label', count(*) FROM labels l ANTI JOIN documents d USING (doc_id)
    UNION ALL SELECT 'class missing in split', count(*) FROM (SELECT split FROM {CATALOG} GROUP BY split HAVING count(DISTINCT quality) < 2)""")
def catalog_violations(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    broken = {
        "repeated id": checks.repeated_keys(docs, ["doc_id"]),
        "length": docs.where(F.col("n_chars") != F.length("text")),
        "language": docs.where(~F.col("lang").isin("en", "de", "fr", "es") | F.col("lang").isNull()),
        "source": docs.where(F.coalesce(F.trim("source"), F.lit("")) == ""),
        "label": labels.where(~F.col("quality").isin(0, 1)),
        "repeated text": checks.repeated_keys(docs.select(F.sha2("text", 256).alias("digest")), ["digest"]),
        "unknown label": labels.join(docs, "doc_id", "left_anti"),
        "class missing in split": catalog(spark, sf).groupBy("split").agg(F.count_distinct("quality").alias("n")).where("n < 2"),
    }
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("check"), "rows") for name, df in broken.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"SELECT sha256(text) AS digest, count(DISTINCT split) AS splits, count(*) AS rows FROM {CATALOG} GROUP BY sha256(text) HAVING count(DISTINCT split) > 1")
def group_leakage(spark, sf):
    return checks.crossing_groups(catalog(spark, sf).withColumn("digest", F.sha2("text", 256)), "digest", "split")


@query(f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS state, a.split AS was, b.split AS now
    FROM (SELECT doc_id, split FROM {CATALOG} WHERE doc_id % 11 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'val' ELSE split END AS split FROM {CATALOG} WHERE doc_id % 13 <> 0) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.split IS DISTINCT FROM b.split""")
def split_equality(spark, sf):
    rows = catalog(spark, sf).select("doc_id", "split")
    other = rows.where("doc_id % 13 <> 0").withColumn("split", F.when(F.col("doc_id") % 17 == 0, "val").otherwise(F.col("split")))
    return checks.changed_rows(rows.where("doc_id % 11 <> 0"), other, "doc_id", "split")


@query("""SELECT side, seed, unit FROM (SELECT 'a' AS side, * FROM (SELECT l_linenumber::BIGINT AS seed, l_orderkey AS unit FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT 1, l_orderkey FROM lineitem WHERE l_linenumber = 2)
    UNION ALL SELECT 'b' AS side, * FROM (SELECT 1::BIGINT, l_orderkey FROM lineitem WHERE l_linenumber = 2 EXCEPT ALL SELECT 1, l_orderkey FROM lineitem WHERE l_linenumber = 1))""")
def cohort_identity(spark, sf):
    """Units of one repetition that the other lacks, in both directions, copies counted."""
    lines = table(spark, sf, "lineitem")
    a, b = (lines.where(F.col("l_linenumber") == n).select(F.lit(1).cast("long").alias("seed"), F.col("l_orderkey").alias("unit")) for n in (1, 2))
    return checks.set_difference(a, b).select("side", "seed", "unit")


@query("""SELECT l_linenumber::BIGINT AS seed, count(DISTINCT l_orderkey) AS units, (SELECT count(*) FROM orders) AS expected, count(DISTINCT l_orderkey) = (SELECT count(*) FROM orders) AS complete FROM lineitem GROUP BY l_linenumber""")
def coverage_gate(spark, sf):
    """Units of each repetition against the number expected."""
    expected = table(spark, sf, "orders").agg(F.count("*").alias("expected"))
    own = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("seed")).agg(F.count_distinct("l_orderkey").alias("units"))
    return own.crossJoin(F.broadcast(expected)).withColumn("complete", F.col("units") == F.col("expected"))


# Joins


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING' LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_lookup(spark, sf):
    customers = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey", "left").join(F.broadcast(nations), "c_nationkey", "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def anti_exclude(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_orderkey, o_totalprice FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) ON o_orderkey = l_orderkey")
def semi_cohort(spark, sf):
    chosen = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(chosen, "o_orderkey", "left_semi")


@query(f"""SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS lines, {sql_six('avg(l_quantity)')} AS mean FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 3 GROUP BY ALL""")
def three_way_effects(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("priority"))
    lines = table(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return lines.join(orders, "o_orderkey").join(customers, "o_custkey").groupBy("segment", "priority").agg(F.count("*").alias("lines"), six(F.avg("l_quantity")).alias("mean"))


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL) SELECT a.l_orderkey AS unit, {sql_six('b.q - a.q')} AS delta FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2""")
def state_delta_selfjoin(spark, sf):
    """Two states of a unit against one another."""
    a, b = (table(spark, sf, "lineitem").where(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias("unit")).agg(F.sum("l_quantity").alias(c)) for n, c in ((1, "a"), (2, "b")))
    return checks.joined(a, b, ["unit"], expect="1:1").select("unit", six(F.col("b") - F.col("a")).alias("delta"))


@query(f"""WITH u AS (SELECT l_orderkey, l_shipmode, avg(d) AS d FROM (SELECT h.l_orderkey, h.l_returnflag AS l_shipmode, h.l_discount - c.l_discount AS d FROM lineitem h JOIN lineitem c ON h.l_orderkey = c.l_orderkey AND h.l_linenumber = 1 AND c.l_linenumber > 1) GROUP BY ALL)
    SELECT l_shipmode AS class, count(*) AS units, {sql_six('avg(d)')} AS contrast FROM u GROUP BY l_shipmode""")
def paired_contrast(spark, sf):
    """Contrasts of a chosen row with its controls: the mean per unit, then over units."""
    lines = table(spark, sf, "lineitem")
    chosen = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_returnflag").alias("class"), F.col("l_discount").alias("h"))
    controls = lines.where("l_linenumber > 1").select("l_orderkey", F.col("l_discount").alias("c"))
    units = chosen.join(controls, "l_orderkey").groupBy("l_orderkey", "class").agg(F.avg(F.col("h") - F.col("c")).alias("d"))
    return units.groupBy("class").agg(F.count("*").alias("units"), six(F.avg("d")).alias("contrast"))


# Summaries


@query(f"""SELECT quality, count(*) AS n, {sql_six('avg(n_chars)')} AS mean, {sql_six('stddev_samp(n_chars)')} AS std, min(n_chars) AS min, {', '.join(sql_six(f'quantile_cont(n_chars, {q})') + f' AS q{int(q * 100)}' for q in (.25, .5, .75))}, max(n_chars) AS max FROM {CATALOG} GROUP BY quality""")
def class_describe(spark, sf):
    quartiles = [six(F.percentile("n_chars", q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return catalog(spark, sf).groupBy("quality").agg(F.count("*").alias("n"), six(F.avg("n_chars")).alias("mean"), six(F.stddev_samp("n_chars")).alias("std"), F.min("n_chars").alias("min"), *quartiles, F.max("n_chars").alias("max"))


@query(f"SELECT source, coalesce(quality::VARCHAR, 'missing') AS class, count(*) AS n, count(*) - count(DISTINCT text) AS copies, count(DISTINCT lang) AS langs FROM {CATALOG} GROUP BY ALL")
def bias_counts(spark, sf):
    digest = F.sha2("text", 256)
    return catalog(spark, sf).groupBy("source", F.coalesce(F.col("quality").cast("string"), F.lit("missing")).alias("class")).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(digest)).alias("copies"), F.count_distinct("lang").alias("langs"))


@query(f"SELECT split, count(*) AS n, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS ones, count(*) FILTER (WHERE quality = 0) AS zeros, {sql_six('avg(quality)')} AS prevalence FROM {CATALOG} GROUP BY split")
def prevalence_by_split(spark, sf):
    of = lambda c: F.sum(F.when(F.col("quality") == c, 1).otherwise(0))
    return catalog(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), of(1).alias("ones"), of(0).alias("zeros"), six(F.avg("quality")).alias("prevalence"))


QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


@query(f"""SELECT o_orderpriority AS priority, {sql_six('avg(o_totalprice)')} AS mean, {sql_six('stddev_pop(o_totalprice)')} AS std, {', '.join(sql_six(f'quantile_cont(o_totalprice, {q})') + f' AS q{int(q * 100)}' for q in QUANTILES)}, {', '.join(sql_six(f'avg((o_totalprice < {x})::INT)') + f' AS below_{x}' for x in (50000, 100000, 200000))} FROM orders GROUP BY o_orderpriority""")
def distribution_summary(spark, sf):
    price = F.col("o_totalprice")
    below = [six(F.avg((price < x).cast("int"))).alias(f"below_{x}") for x in (50000, 100000, 200000)]
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(six(F.avg(price)).alias("mean"), six(F.stddev_pop(price)).alias("std"), *(six(F.percentile(price, q)).alias(f"q{int(q * 100)}") for q in QUANTILES), *below)


# Bins


@query("SELECT bin, count(*) AS n FROM (SELECT CASE WHEN l_discount * 10 < 0.2 THEN 0 WHEN l_discount * 10 < 0.4 THEN 1 WHEN l_discount * 10 < 0.6 THEN 2 WHEN l_discount * 10 < 0.8 THEN 3 ELSE 4 END::BIGINT AS bin FROM lineitem) GROUP BY bin")
def bin_left_closed(spark, sf):
    p = F.col("l_discount") * 10
    place = text.binned(p, [0.2, 0.4, 0.6, 0.8], ["0", "1", "2", "3", "4"]).cast("long")
    return table(spark, sf, "lineitem").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT event_type, stratum, count(*) AS n FROM (SELECT event_type, CASE WHEN value < 70 THEN 'low' WHEN value < 90 THEN 'medium' WHEN value IS NOT NULL THEN 'high' END AS stratum FROM events) GROUP BY ALL")
def strata_open(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", text.binned(F.col("value"), [70.0, 90.0], ["low", "medium", "high"]).alias("stratum")).agg(F.count("*").alias("n"))


DECILES = [i / 10 for i in range(1, 10)]


@query(f"""WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, {DECILES})) AS e FROM lineitem) SELECT bin, count(*) AS n, {sql_six('avg(l_quantity)')} AS mean, {sql_six('avg(l_extendedprice)')} AS trend FROM (SELECT len(list_filter(e.e, lambda x: x < l_quantity)) AS bin, l_quantity, l_extendedprice FROM lineitem, e) GROUP BY bin""")
def quantile_bins(spark, sf):
    """Right-closed bins by deciles, equal edges dropped, with the trend of a second column."""
    lines = table(spark, sf, "lineitem")
    edges = lines.agg(F.array_distinct(F.percentile("l_quantity", F.lit(DECILES))).alias("e"))
    placed = lines.select("l_quantity", "l_extendedprice").crossJoin(F.broadcast(edges))
    return placed.groupBy(F.size(F.filter("e", lambda x: x < F.col("l_quantity"))).cast("long").alias("bin")).agg(F.count("*").alias("n"), six(F.avg("l_quantity")).alias("mean"), six(F.avg("l_extendedprice")).alias("trend"))


@query(f"""WITH e AS (SELECT quantile_cont(o_totalprice, {DECILES}) AS e FROM orders WHERE o_orderkey % 4 <> 0) SELECT bin, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS new FROM (SELECT o_orderkey, len(list_filter(e.e, lambda x: x <= o_totalprice)) AS bin FROM orders, e) GROUP BY bin""")
def train_edge_digitize(spark, sf):
    """Bins of all rows by quantiles of the training rows, outer bins open."""
    orders = table(spark, sf, "orders")
    edges = orders.where("o_orderkey % 4 <> 0").agg(F.percentile("o_totalprice", F.lit(DECILES)).alias("e"))
    placed = orders.crossJoin(F.broadcast(edges)).select("o_orderkey", F.size(F.filter("e", lambda x: x <= F.col("o_totalprice"))).cast("long").alias("bin"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.sum((F.col("o_orderkey") % 4 == 0).cast("long")).alias("new"))


# Windows, sets and reshapes


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_group(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("x")).select("o_custkey", "x.*")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_duplicate(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - l_quantity AS offset_before, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem")
def group_offsets(spark, sf):
    """Cumulative offsets inside each group."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.sum("l_quantity").over(own) - F.col("l_quantity")).alias("offset_before"), F.row_number().over(own).cast("long").alias("place"))


@query("SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS batch, doc_id FROM documents")
def batches_of_sixteen(spark, sf):
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf, "documents").select("source", F.floor(place / 16).alias("batch"), "doc_id")


@query(f"""SELECT user_id, event_id, {sql_six('(t - w) / nullif(n - k, 0)')} AS without FROM (SELECT user_id, event_id, sum(value) OVER u AS t, count(value) OVER u AS n, sum(value) OVER r AS w, count(value) OVER r AS k FROM events WINDOW u AS (PARTITION BY user_id), r AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))""")
def window_ablation(spark, sf):
    """The group's mean without a window around each position, edges clipped."""
    own = Window.partitionBy("user_id")
    near = own.orderBy("event_id").rowsBetween(-2, 2)
    v = F.col("value")
    rest = F.count(v).over(own) - F.count(v).over(near)
    return table(spark, sf, "events").select("user_id", "event_id", six((F.sum(v).over(own) - F.sum(v).over(near)) / F.when(rest != 0, rest)).alias("without"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS url FROM customer UNION ALL SELECT page_id, NULL, NULL, url FROM pages")
def union_by_name(spark, sf):
    """Tables with different columns, one above the other."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("SELECT 'shared' AS kind, count(*) AS ids FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'missing', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def set_operations(spark, sf):
    shared = table(spark, sf, "customer").select("c_nationkey").intersect(table(spark, sf, "supplier").select("s_nationkey"))
    missing = table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id").distinct())
    count = lambda df, kind: df.distinct().agg(F.count("*").alias("ids")).select(F.lit(kind).alias("kind"), "ids")
    return count(shared, "shared").unionByName(count(missing, "missing"))


@query(f"""SELECT l_linenumber::BIGINT AS seed, {', '.join(f"{sql_six(f'avg(l_discount) FILTER (WHERE l_returnflag = {chr(39)}{f}{chr(39)})')} AS {f}_discount, {sql_six(f'avg(l_tax) FILTER (WHERE l_returnflag = {chr(39)}{f}{chr(39)})')} AS {f}_tax" for f in "ANR")} FROM lineitem GROUP BY l_linenumber""")
def pivot_views(spark, sf):
    """Long to wide with two value columns."""
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("seed")).pivot("l_returnflag", list("ANR"))
    return wide.agg(six(F.avg("l_discount")).alias("discount"), six(F.avg("l_tax")).alias("tax"))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25")
def sorted_head(spark, sf):
    """A top-25 report."""
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice").orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(25)


@query("SELECT s.seed, f.family, v.view FROM (SELECT unnest(range(42, 52)) AS seed) s, (SELECT unnest(['linear', 'tree']) AS family) f, (SELECT DISTINCT l_returnflag AS view FROM lineitem) v")
def parameter_grid(spark, sf):
    """Every combination of a few seeds, families and views."""
    seeds = spark.range(42, 52).withColumnRenamed("id", "seed")
    families = spark.createDataFrame([("linear",), ("tree",)], "family string")
    views = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("view")).distinct()
    return seeds.crossJoin(F.broadcast(families)).crossJoin(F.broadcast(views))


@query("SELECT conv_id, unnest(range(lo, hi + 1)) AS position FROM (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY conv_id)")
def range_expansion(spark, sf):
    ends = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    return ends.select("conv_id", F.explode(F.sequence("lo", "hi")).alias("position"))


@query("SELECT o_custkey, max(a) AS most, min(b) FILTER (WHERE b > 0) AS least, count(DISTINCT s) AS states FROM (SELECT o_custkey, o_totalprice AS a, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -1 END AS b, o_orderstatus AS s FROM orders) GROUP BY o_custkey")
def record_reduce(spark, sf):
    """The extremes of a unit's records, unusable ones ignored."""
    usable = F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 0), F.col("o_totalprice"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"), F.min(usable).alias("least"), F.count_distinct("o_orderstatus").alias("states"))
