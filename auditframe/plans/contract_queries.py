"""Contracts of records, manifests and identifiers, and the scalar expressions and joins they use."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.functions import text
from auditframe.operators import checks, names
from auditframe.plans.registry import query, six, sql_six, table
from auditframe.plans.relational_queries import CATALOG, catalog
from auditframe.plans.vector_queries import LONG, embeddings

# Records: documents with a declared length, tier and digest, some of them wrong

UPPER = f"regexp_replace(translate(coalesce(text, ''), '{text.LOWER}', '{text.UPPER}'), '[^A-Z]', '', 'g')"
RECORDS = f"""(SELECT doc_id, source || CASE WHEN doc_id % 19 = 0 THEN chr(9) ELSE '-' END || doc_id AS id, s, ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS tier, quality, split,
    CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN length(s) + 1 ELSE length(s) END AS declared, CASE WHEN doc_id % 13 = 0 THEN sha256(s || '!') ELSE sha256(s) END AS digest FROM (SELECT *, {UPPER} AS s FROM {CATALOG}))"""


def records(spark, sf):
    s, i = F.col("s"), F.col("doc_id")
    rows = catalog(spark, sf).withColumn("s", text.as_sequence(F.coalesce("text", F.lit(""))))
    return rows.select(
        "doc_id", F.concat("source", F.when(i % 19 == 0, "\t").otherwise("-"), i.cast("string")).alias("id"), "s", F.element_at(F.array(*map(F.lit, "ABCD")), (i % 4 + 1).cast("int")).alias("tier"), "quality", "split",
        F.when(i % 10 == 1, F.length(s) + 1).when(i % 10 != 0, F.length(s)).alias("declared"), F.when(i % 13 == 0, F.sha2(F.concat(s, F.lit("!")), 256)).otherwise(F.sha2(s, 256)).alias("digest"),
    )


@query(f"""SELECT 'alphabet' AS "check", count(*) AS rows FROM {RECORDS} WHERE NOT regexp_full_match(s, '[{text.LETTERS}]+') UNION ALL SELECT 'tier', count(*) FROM {RECORDS} WHERE tier NOT IN ('A', 'B', 'C')
    UNION ALL SELECT 'length', count(*) FROM {RECORDS} WHERE coalesce(declared, length(s)) <> length(s) UNION ALL SELECT 'id', count(*) FROM {RECORDS} WHERE regexp_matches(id, '[[:cntrl:]]') OR id <> trim(id) OR NOT regexp_full_match(id, '[A-Za-z0-9_.-]+')
    UNION ALL SELECT 'digest', count(*) FROM {RECORDS} WHERE digest <> sha256(s) UNION ALL SELECT 'repeated sequence', count(*) FROM (SELECT s FROM {RECORDS} GROUP BY s HAVING count(*) > 1) UNION ALL SELECT 'label', count(*) FROM {RECORDS} WHERE quality IS NULL
    UNION ALL SELECT 'sequence in several splits', count(*) FROM (SELECT s FROM {RECORDS} GROUP BY s HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'splits', 3 - count(DISTINCT split) FROM {RECORDS}""")
def record_contract(spark, sf):
    """Every rule of the record contract with the number of records that break it."""
    rows = records(spark, sf)
    s = F.col("s")
    broken = {
        "alphabet": rows.where(~s.rlike(f"^[{text.LETTERS}]+$")),
        "tier": rows.where(~F.col("tier").isin("A", "B", "C")),
        "length": rows.where(F.coalesce("declared", F.length(s)) != F.length(s)),
        "id": rows.where(F.col("id").rlike(r"\p{Cntrl}") | (F.col("id") != F.trim("id")) | ~F.col("id").rlike("^[A-Za-z0-9_.-]+$")),
        "digest": rows.where(F.col("digest") != F.sha2(s, 256)),
        "repeated sequence": checks.repeated_keys(rows, ["s"]),
        "label": rows.where("quality IS NULL"),
        "sequence in several splits": checks.crossing_groups(rows, "s", "split"),
    }
    splits = rows.agg((3 - F.count_distinct("split")).alias("rows")).select(F.lit("splits").alias("check"), "rows")
    return checks.tally(broken).unionByName(splits)


FORBIDDEN = ["label", "source", "quality", "split", "tier", "text"]


@query("""SELECT 'documents' AS view, unnest(['source', 'text']) AS "column" UNION ALL SELECT 'embeddings', 'label' UNION ALL SELECT 'labels', 'quality' UNION ALL SELECT 'conversations', 'text'""")
def forbidden_columns(spark, sf):
    """Columns of feature views that would give the label away."""
    names = ("documents", "embeddings", "labels", "conversations", "events")
    found = [(n, c) for n in names for c in checks.forbidden_columns(table(spark, sf, n), FORBIDDEN)]
    return spark.createDataFrame(found, "view string, column string")


MANIFEST = "(SELECT vec_id AS id, 'v/' || (CASE WHEN vec_id % 29 = 0 THEN vec_id + 1 ELSE vec_id END) AS path, CASE WHEN vec_id % 31 = 0 THEN 'float16' ELSE 'float32' END AS dtype, len(embedding) AS width FROM embeddings WHERE vec_id % 23 <> 0)"


@query(f"""SELECT 'missing' AS "check", count(*) AS rows FROM embeddings ANTI JOIN {MANIFEST} m ON vec_id = m.id UNION ALL SELECT 'extra', count(*) FROM {MANIFEST} m ANTI JOIN (SELECT vec_id FROM embeddings WHERE label <> 3) e ON m.id = e.vec_id
    UNION ALL SELECT 'repeated id', count(*) FROM (SELECT id FROM {MANIFEST} GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'repeated path', count(*) FROM (SELECT path FROM {MANIFEST} GROUP BY path HAVING count(*) > 1)
    UNION ALL SELECT 'other signature', count(*) FROM (SELECT dtype, width FROM {MANIFEST} GROUP BY ALL) WHERE dtype <> 'float32'""")
def manifest_audit(spark, sf):
    """A manifest against the vectors it lists: ids one to one, paths unique, one signature."""
    vectors = embeddings(spark, sf)
    i = F.col("vec_id")
    manifest = vectors.where(i % 23 != 0).select(i.alias("id"), F.concat(F.lit("v/"), F.when(i % 29 == 0, i + 1).otherwise(i).cast("string")).alias("path"), F.when(i % 31 == 0, "float16").otherwise("float32").alias("dtype"), F.size("embedding").alias("width"))
    ids = vectors.select(i.alias("id"), "label")
    broken = {
        "missing": checks.subset(ids, manifest, ["id"]),
        "extra": checks.subset(manifest, ids.where("label <> 3"), ["id"]),
        "repeated id": checks.repeated_keys(manifest, ["id"]),
        "repeated path": checks.repeated_keys(manifest, ["path"]),
        "other signature": checks.one_signature(manifest, ["dtype", "width"]),
    }
    return checks.tally(broken)


# Scalars


@query("SELECT CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1")
def value_remap(spark, sf):
    """Values renamed by a table, all others by a default."""
    names = F.create_map(*(F.lit(x) for pair in {"click": "c", "view": "v"}.items() for x in pair))
    return table(spark, sf, "events").groupBy(F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_custkey, lower(substr(c_mktsegment, 1, 4)) AS code, chr((65 + c_custkey % 26)::INT) AS l, c_custkey % 3 AS n FROM customer) SELECT c_custkey, code, CASE WHEN n = 0 THEN l WHEN n = 1 THEN l || '7,' || l ELSE l || 'b12,' || l || 'b,' || l END AS chains FROM c""")
def structure_ids(spark, sf):
    letter = F.char((F.lit(65) + F.col("c_custkey") % 26).cast("int"))
    name = F.concat(F.substring("c_mktsegment", 1, 4), F.lit("_"), letter, F.when(F.col("c_custkey") % 3 == 1, "7").when(F.col("c_custkey") % 3 == 2, "b12").otherwise(""))
    found = text.structure_id(name)
    return table(spark, sf, "customer").select("c_custkey", found["code"].alias("code"), F.array_join(found["chains"], ",").alias("chains"))


@query(f"SELECT DISTINCT l_discount * 10 AS p, {sql_six('ln(greatest(least(l_discount * 10, 1 - 1e-6), 1e-6) / (1 - greatest(least(l_discount * 10, 1 - 1e-6), 1e-6)))')} AS logit FROM lineitem")
def clipped_logit(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("p")).distinct().select("p", six(text.clipped_logit(F.col("p"))).alias("logit"))


@query("SELECT doc_id, (ceil(n_chars / 16) * 16)::BIGINT AS padded, (row_number() OVER (PARTITION BY lang, source ORDER BY ceil(n_chars / 16), doc_id) - 1) // 16 AS archive FROM documents")
def padded_archives(spark, sf):
    """Lengths padded to 16, and archives of sixteen in the order of padded length."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", text.padded_length(F.col("n_chars")).alias("padded"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy("padded", "doc_id")) - 1
    return rows.select("doc_id", "padded", F.floor(place / 16).alias("archive"))


@query(f"""SELECT coalesce(why, 'fine') AS why, count(*) AS n, sum(length(s) - length(replace(s, 'X', ''))) AS unknown FROM (SELECT replace(s, 'U', 'X') AS s, CASE WHEN length(s) = 0 THEN 'empty' WHEN length(s) > 1022 THEN 'too long' END AS why FROM (SELECT {UPPER} AS s FROM documents)) GROUP BY 1""")
def residue_eligibility(spark, sf):
    """Sequences that can be represented, and why others can't."""
    s = table(spark, sf, "documents").select(text.residues(text.as_sequence(F.coalesce("text", F.lit("")))).alias("s"))
    unknown = F.length("s") - F.length(F.replace(F.col("s"), F.lit("X"), F.lit("")))
    return s.groupBy(F.coalesce(text.ineligible(F.col("s")), F.lit("fine")).alias("why")).agg(F.count("*").alias("n"), F.sum(unknown).cast("long").alias("unknown"))


@query("""WITH r AS (SELECT label, count(*) AS length, count(*) FILTER (WHERE vec_id % 3 <> 0) AS second FROM embeddings GROUP BY label) SELECT label, length, (SELECT max(length) FROM r) - length AS padding, second, second = length AS second_complete FROM r""")
def ragged_masks(spark, sf):
    """Groups of different length in long form: rows are the mask, padding is what a tensor would add,
    and a second view is available where its rows are."""
    first = embeddings(spark, sf).select("label", "vec_id")
    second = first.where("vec_id % 3 <> 0").withColumn("has", F.lit(True))
    lengths = first.join(second, ["label", "vec_id"], "left").groupBy("label").agg(F.count("*").alias("length"), F.count("has").alias("second"))
    longest = lengths.agg(F.max("length").alias("longest"))
    return lengths.crossJoin(F.broadcast(longest)).select("label", "length", (F.col("longest") - F.col("length")).alias("padding"), "second", (F.col("second") == F.col("length")).alias("second_complete"))


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"user_id":' || user_id || '}') AS digest FROM events""")
def canonical_json_digest(spark, sf):
    """Digest of a record as JSON with sorted names and no blanks."""
    js = text.canonical_json(user_id=F.col("user_id"), event_type=F.col("event_type"), k=F.get_json_object("props", "$.k").cast("long"))
    return table(spark, sf, "events").select("event_id", F.sha2(js, 256).alias("digest"))


@query("SELECT n_regionkey, sha256(string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey || ',' || n_name)) AS digest FROM nation GROUP BY n_regionkey")
def frame_digest(spark, sf):
    """Digest of each group's rows as sorted lines."""
    lines = F.collect_list(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name"))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(lines), "\n"), 256).alias("digest"))


@query("SELECT o_orderkey, ('0x' || substr(d, 1, 16))::UBIGINT::VARCHAR AS big, ('0x' || substr(d, 15, 2) || substr(d, 13, 2) || substr(d, 11, 2) || substr(d, 9, 2) || substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2))::UBIGINT::VARCHAR AS little FROM (SELECT o_orderkey, sha256('s:' || o_orderkey) AS d FROM orders)")
def digest_seed(spark, sf):
    d = F.sha2(F.concat(F.lit("s:"), F.col("o_orderkey").cast("string")), 256)
    return table(spark, sf, "orders").select("o_orderkey", text.digest_seed(d).alias("big"), text.digest_seed(d, little=True).alias("little"))


@query(f"""SELECT item_id, channel, count(*) AS n, min(pos) AS first FROM (SELECT item_id, pos, CASE WHEN instr('{text.LETTERS}', letter) > 0 THEN instr('{text.LETTERS}', letter) - 1 ELSE 20 END AS channel FROM (
    SELECT item_id, generate_subscripts(string_split(s, ''), 1) AS pos, unnest(string_split(s, '')) AS letter FROM (SELECT item_id, substr({UPPER}, 1, 256) AS s FROM benchmark) WHERE length(s) > 0)) GROUP BY ALL""")
def onehot_channels(spark, sf):
    """One-hot channels of the first 256 letters; letters beyond the twenty share one."""
    s = table(spark, sf, "benchmark").select("item_id", F.substring(text.as_sequence(F.col("text")), 1, 256).alias("s")).where("length(s) > 0")
    each = s.select("item_id", F.posexplode(F.split("s", "")).alias("pos", "letter"))
    return each.groupBy("item_id", text.channel(F.col("letter")).alias("channel")).agg(F.count("*").alias("n"), (F.min("pos") + 1).cast("long").alias("first"))


@query(f"""SELECT item_id, '{{' || string_agg('"' || letter || '":' || n, ',' ORDER BY letter) || '}}' AS composition FROM (SELECT item_id, letter, count(*) AS n FROM (SELECT item_id, unnest(string_split({UPPER}, '')) AS letter FROM benchmark) WHERE letter <> '' GROUP BY ALL) GROUP BY item_id""")
def json_composition(spark, sf):
    """Composition of each sequence as a JSON object with sorted names."""
    letters = table(spark, sf, "benchmark").select("item_id", F.explode(F.split(text.as_sequence(F.col("text")), "")).alias("name")).where("name <> ''")
    counts = letters.groupBy("item_id", "name").agg(F.count("*").alias("n"))
    return counts.groupBy("item_id").agg(text.counts_json(F.collect_list(F.struct("name", "n"))).alias("composition"))


@query("""WITH c AS (SELECT conv_id, turn, translate(upper(role), ' ', '') AS s FROM conversations) SELECT conv_id, (SELECT s FROM c d WHERE d.conv_id = c.conv_id ORDER BY turn LIMIT 1) AS query, count(*) AS depth FROM c GROUP BY conv_id""")
def alignment_depth(spark, sf):
    """Query and depth of alignments: a conversation's roles as records, in the order of turns."""
    record = F.concat(F.lit(">"), F.col("turn").cast("string"), F.lit("\nab"), F.upper("role"), F.lit("\n"))
    made = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", record.alias("r")))), lambda x: x["r"]), "").alias("a3m"))
    found = text.alignment_records(F.col("a3m"))
    return made.select("conv_id", found["query"].alias("query"), found["depth"].alias("depth"))


@query("""SELECT source, string_agg(x, ';' ORDER BY x) AS means FROM (SELECT source, printf('%.8g', round(avg(n_chars) / 7, 9)) AS x FROM documents GROUP BY source, lang) GROUP BY source""")
def general_concat(spark, sf):
    """Sorted numbers with eight significant digits as one text."""
    means = table(spark, sf, "documents").groupBy("source", "lang").agg(F.round(F.avg("n_chars") / 7, 9).alias("m"))
    return means.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(text.general8(F.col("m")))), ";").alias("means"))


# Joins, unions and reshapes


@query(f"""WITH k AS (SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT a.l_partkey, a.l_suppkey, a.l_returnflag, {sql_six('b.q - a.q')} AS delta FROM k a JOIN k b USING (l_partkey, l_suppkey, l_returnflag) WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O'""")
def three_key_states(spark, sf):
    """Two states joined on three keys, one row a key on either side."""
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    sums = table(spark, sf, "lineitem").groupBy(*keys, "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    a, b = (sums.where(F.col("l_linestatus") == s).select(*keys, F.col("q").alias(n)) for s, n in (("F", "a"), ("O", "b")))
    return a.join(b, keys).select(*keys, six(F.col("b") - F.col("a")).alias("delta"))


@query(f"""SELECT a.lang AS lang_a, b.lang AS lang_b, count(*) AS n, count(*) FILTER (WHERE a.quality = b.quality) AS agree FROM (SELECT * FROM {CATALOG} WHERE quality IS NOT NULL) a JOIN (SELECT * FROM {CATALOG} WHERE quality IS NOT NULL) b ON b.doc_id = a.doc_id + 1 GROUP BY ALL""")
def label_agreement(spark, sf):
    """Equally named columns of two sides under suffixes, and how often their labels agree."""
    rows = catalog(spark, sf).where("quality IS NOT NULL").select("doc_id", "lang", "quality")
    a = rows.select("doc_id", *(F.col(c).alias(f"{c}_a") for c in ("lang", "quality")))
    b = rows.select((F.col("doc_id") - 1).alias("doc_id"), *(F.col(c).alias(f"{c}_b") for c in ("lang", "quality")))
    return a.join(b, "doc_id").groupBy("lang_a", "lang_b").agg(F.count("*").alias("n"), F.sum((F.col("quality_a") == F.col("quality_b")).cast("long")).alias("agree"))


@query("SELECT doc_id FROM documents WHERE doc_id % 6 <> 0")
def excluded_subset(spark, sf):
    """Rows without the excluded ones, after a check that all excluded ones exist."""
    docs = table(spark, sf, "documents").select("doc_id")
    gone = docs.where("doc_id % 6 = 0")
    checks.enforce(checks.subset(gone, docs, ["doc_id"]), "excluded ids that don't exist")
    return docs.join(gone, "doc_id", "left_anti")


@query("SELECT o.o_orderkey AS ordinal, d.doc_id, d.n_chars FROM (SELECT o_orderkey, (o_orderkey * 7919) % 1000 AS doc_id FROM orders) o LEFT JOIN documents d USING (doc_id)")
def reindexed(spark, sf):
    """Values in the order of a list of ids, repeats and missing ones included."""
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") * 7919 % 1000).alias("id"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "doc_id", "n_chars")
    return wanted.join(docs, "id", "left").select("ordinal", "doc_id", "n_chars")


@query(f"SELECT vec_id, count(*) AS width, {sql_six('sum(x * (dim + 1))')} AS weighted FROM (SELECT vec_id, dim, x FROM {LONG} UNION ALL SELECT doc_id, 64, n_chars::DOUBLE FROM documents SEMI JOIN embeddings ON doc_id = vec_id) SEMI JOIN documents ON doc_id = vec_id GROUP BY vec_id")
def concatenated_columns(spark, sf):
    """Two feature blocks of the same rows side by side."""
    a = embeddings(spark, sf).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.array(F.col("n_chars").cast("double")).alias("b"))
    whole = checks.joined(a, b, ["vec_id"], expect="1:1").select("vec_id", F.concat("a", "b").alias("x"))
    weighted = F.aggregate(F.transform("x", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return whole.select("vec_id", F.size("x").cast("long").alias("width"), six(weighted).alias("weighted"))


@query("SELECT id, first(name ORDER BY turn) AS name, count(*) AS offers FROM (SELECT c_custkey % 50 AS id, c_name AS name, c_custkey AS turn FROM customer UNION ALL SELECT s_suppkey % 70, s_name, 1000000 + s_suppkey FROM supplier) GROUP BY id")
def first_of_union(spark, sf):
    """Two tables one under the other; the first row of each key stays."""
    a = table(spark, sf, "customer").select((F.col("c_custkey") % 50).alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("turn"))
    b = table(spark, sf, "supplier").select((F.col("s_suppkey") % 70).alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") + 1000000).alias("turn"))
    return a.unionByName(b).groupBy("id").agg(F.min_by("name", "turn").alias("name"), F.count("*").alias("offers"))


@query(f"SELECT lang, source, count(*) FILTER (WHERE toxic = 0) AS toxic_0, count(*) FILTER (WHERE toxic = 1) AS toxic_1 FROM {CATALOG} GROUP BY lang, source")
def unstacked_labels(spark, sf):
    """Counts with a column for both labels, also where one never occurs."""
    n = lambda c: F.sum(F.when(F.col("toxic") == c, 1).otherwise(0)).cast("long").alias(f"toxic_{c}")
    return catalog(spark, sf).groupBy("lang", "source").agg(n(0), n(1))


@query(f"""WITH a AS (SELECT label, vec_id, dim AS feature, x FROM {LONG} WHERE x > 0.1 AND dim % 5 = 0), n AS (SELECT label, vec_id, count(*) AS k FROM a GROUP BY ALL) SELECT e.label, e.vec_id, coalesce(k, 0) AS entries, (sum(coalesce(k, 0)) OVER (PARTITION BY e.label ORDER BY e.vec_id) - coalesce(k, 0))::BIGINT AS start FROM embeddings e LEFT JOIN n USING (label, vec_id)""")
def selected_rows(spark, sf):
    """Coordinates of chosen features as compressed rows: entries and start of every row of a group."""
    from auditframe.operators import vectors

    chosen = spark.range(64).where("id % 5 = 0").select(F.col("id").cast("int").alias("dim"))
    entries = vectors.long(embeddings(spark, sf), ["label", "vec_id"], "embedding").where("x > 0.1").join(F.broadcast(chosen), "dim", "left_semi").groupBy("label", "vec_id").agg(F.count("*").alias("entries"))
    rows = embeddings(spark, sf).select("label", "vec_id").join(entries, ["label", "vec_id"], "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    before = F.sum("entries").over(Window.partitionBy("label").orderBy("vec_id")) - F.col("entries")
    return rows.select("label", "vec_id", "entries", before.alias("start"))


# Resolution of names and archives

#: SQL of the distinct tokens of a name, in order.
TOKENS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')))"


@query(f"""WITH q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'P' || lpad((doc_id % 100000)::VARCHAR, 5, '0') WHEN 1 THEN lower(source) || ' x' ELSE {UPPER} END AS q FROM documents) SELECT doc_id, CASE WHEN regexp_full_match(q, '[OPQ][0-9][A-Z0-9]{{3}}[0-9]') THEN 'accession' WHEN regexp_full_match(q, '[A-Z]{{10,}}') THEN 'sequence' WHEN q = '' THEN 'empty' ELSE 'name' END AS kind,
    CASE WHEN regexp_full_match(q, '[OPQ][0-9][A-Z0-9]{{3}}[0-9]') THEN q WHEN regexp_full_match(q, '[A-Z]{{10,}}') THEN 'sequence_' || substr(sha256(q), 1, 12) END AS id FROM q""")
def resolved_ids(spark, sf):
    """Accessions as they are, sequences under an id made from their digest; names are left to look up."""
    i = F.col("doc_id")
    sequence = text.as_sequence(F.coalesce("text", F.lit("")))
    q = F.when(i % 3 == 0, F.concat(F.lit("P"), F.lpad((i % 100000).cast("string"), 5, "0"))).when(i % 3 == 1, F.concat(F.lower("source"), F.lit(" x"))).otherwise(sequence)
    rows = table(spark, sf, "documents").select("doc_id", q.alias("q"))
    return rows.select("doc_id", text.query_kind(F.col("q")).alias("kind"), text.query_id(F.col("q")).alias("id"))


@query(f"""WITH q AS (SELECT p_partkey AS id, {TOKENS.format("upper(p_type) || ', ' || p_name || ' (' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'no ' || p_partkey END || ')'")} AS t FROM part WHERE p_partkey % 3 = 0),
    c AS (SELECT p_partkey AS candidate, {TOKENS.format("p_name || ' ' || p_brand || ' ' || p_type")} AS k FROM part), d AS (SELECT DISTINCT t FROM q), e AS (SELECT DISTINCT k FROM c),
    n AS (SELECT t, k, len(list_intersect(t, k)) AS shared FROM d, e), s AS (SELECT t, k, shared / (len(t) + len(k) - shared) AS similarity FROM n WHERE shared >= 0.6 * (len(t) + len(k) - shared) - 1e-9)
    SELECT id, rank, candidate, {sql_six('similarity')} AS similarity, similarity = 1 AS exact FROM (SELECT q.id, c.candidate, s.similarity, row_number() OVER (PARTITION BY q.id ORDER BY s.similarity DESC, c.candidate) AS rank FROM q JOIN s USING (t) JOIN c USING (k)) WHERE rank <= 5""")
def name_candidates(spark, sf):
    """Names written another way, resolved to ranked catalog entries by the tokens they share."""
    parts = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    i = F.col("id")
    last = F.when(i % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("no "), i.cast("string")))
    asked = parts.where(i % 3 == 0).select("id", F.concat(F.upper("p_type"), F.lit(", "), "p_name", F.lit(" ("), last, F.lit(")")).alias("query"))
    entries = parts.select(i.alias("entry"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    found = names.candidates(asked, "id", "query", entries, "entry", "name", 0.6, 5)
    return found.withColumn("similarity", six(F.col("similarity")))


@query("""WITH a AS (SELECT vec_id % 4 AS archive, vec_id FROM embeddings WHERE vec_id % 37 <> 0 UNION ALL SELECT 3, vec_id FROM embeddings WHERE vec_id % 41 = 0), s AS (SELECT vec_id % 4 AS archive, vec_id FROM embeddings WHERE vec_id % 43 <> 0)
    SELECT archive, count(*) FILTER (WHERE a AND NOT s) AS unlisted, count(*) FILTER (WHERE s AND NOT a) AS missing, count(*) FILTER (WHERE other > 1) AS shared FROM (SELECT coalesce(a.archive, s.archive) AS archive, a.vec_id IS NOT NULL AS a, s.vec_id IS NOT NULL AS s, coalesce(o.n, 0) AS other
    FROM (SELECT DISTINCT * FROM a) a FULL JOIN s ON a.archive = s.archive AND a.vec_id = s.vec_id LEFT JOIN (SELECT vec_id, count(DISTINCT archive) AS n FROM a GROUP BY vec_id) o ON o.vec_id = coalesce(a.vec_id, s.vec_id)) GROUP BY archive""")
def archive_membership(spark, sf):
    """Members of archives against their lists, and members that several archives hold."""
    ids = embeddings(spark, sf).select((F.col("vec_id") % 4).alias("archive"), "vec_id")
    members = ids.where("vec_id % 37 <> 0").unionByName(ids.where("vec_id % 41 = 0").withColumn("archive", F.lit(3).cast("long"))).distinct().withColumn("a", F.lit(True))
    listed = ids.where("vec_id % 43 <> 0").withColumn("s", F.lit(True))
    several = members.groupBy("vec_id").agg(F.count_distinct("archive").alias("n"))
    both = members.join(listed, ["archive", "vec_id"], "full").join(several, "vec_id", "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return both.groupBy("archive").agg(n(F.col("s").isNull()).alias("unlisted"), n(F.col("a").isNull()).alias("missing"), n(F.col("n") > 1).alias("shared"))


@query(f"SELECT label, sum(v)::BIGINT AS entries, {sql_six('sum(x)')} AS total FROM (SELECT label, 1 AS v, x FROM {LONG} WHERE x > 0.2) GROUP BY label")
def sparse_artifact(spark, sf):
    """A sparse table written, read back and summed by group."""
    from auditframe.operators import vectors
    from auditframe.sources.scratch import shared_dir
    from auditframe.sources.tables import write_sparse

    path = f"{shared_dir(spark)}/sparse-{uuid.uuid4().hex}"
    write_sparse(vectors.long(embeddings(spark, sf), ["label", "vec_id"], "embedding").where("x > 0.2").select("label", "vec_id", F.col("dim").alias("feature"), F.col("x").alias("activation")), path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("entries"), six(F.sum("activation")).alias("total"))
