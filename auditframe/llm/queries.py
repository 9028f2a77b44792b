"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.common import held_out, saved, table

#: The key of the registered pseudonym query; a deployment passes its own secret.
KEY = "registered-query-key"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.sampled_pieces import decode, sample_encode

    model = vocabulary("piece_bpe_32k.model")
    encoded = sample_encode(table(spark, sf_dir, "documents"), model, seed=1)
    text = F.coalesce("text", F.lit(""))
    described = encoded.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        F.xxhash64(text).alias("text_hash"),
        "piece_ids",
    )
    back = decode(described, model)
    same = (F.xxhash64("decoded") == F.col("text_hash")) & (F.octet_length("decoded") == F.col("n_bytes"))
    return back.select("doc_id", "n_bytes", "n_pieces", "ids_hash", same.alias("lossless"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.katz import katz_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = katz_scores(docs, ~held_out("doc_id", 10, 0))
    return scores.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.vector_links import linked_vectors

    return linked_vectors(table(spark, sf_dir, "embeddings"), least_cosine=0.9)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    scored = score(docs, net)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.curve_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.simhash import fingerprints, near_groups

    prints = saved(fingerprints(table(spark, sf_dir, "documents"), words=3, seeds=(42,)), "prints")
    groups = near_groups(prints, "doc_id", ["fp0"], max_bits=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.repeats import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=200).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_bytes",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0)).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), capacity=2048, end_id=0, with_ids=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.privacy import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, KEY)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.rules import fit, judged

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return judged(docs, trees)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.llm.hard_negatives import hard_negatives

    turned = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, turned, positives=5, negatives=10)


QUERIES = {f.__name__: f for f in (op1_sampled_pieces, op2_katz, op3_vector_links, op4_quality, op5_curve_search, op6_simhash, op7_repeats, op8_packing, op9_token_counts, op10_pseudonyms, op11_collocations, op12_rules, op13_hard_negatives)}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        sizes AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM words),
        places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sizes WHERE len(w) >= k),
        every AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM every WHERE k = 1 GROUP BY lang),
        counts AS (SELECT * FROM every WHERE f >= 30),
        parts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM counts WHERE k >= 2),
        cuts AS (SELECT lang, k, phrase, a, p, unnest(range(1, k)) AS c FROM parts),
        scored AS (
            SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, (2000000 * a::HUGEINT) // (x.f + y.f) AS score
            FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(p[1:c], ' ') JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(p[c + 1:cuts.k], ' ')
        ), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        spans AS (SELECT lang, a, k, p, unnest(range(2, k)) AS m FROM parts WHERE k > 2),
        inner_places AS (SELECT lang, a, p, m, unnest(range(1, k - m + 2)) AS i FROM spans),
        inner_phrases AS (SELECT lang, array_to_string(p[i:i + m - 1], ' ') AS phrase, max(a) AS whole FROM inner_places GROUP BY ALL),
        remaining AS (SELECT worst.* FROM worst LEFT JOIN inner_phrases USING (lang, phrase) WHERE whole IS NULL OR 100 * whole::HUGEINT < 80 * a::HUGEINT)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM remaining JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
    "op13_hard_negatives": """
        WITH known AS (
            SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), scored AS (
            SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label AS own, b.row AS row, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM known a JOIN known b ON a.row <> b.row AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
        ), positives AS (SELECT * FROM scored WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id, s.row)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON s.anchor = p.anchor AND s.own <> s.label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
    """,
}
