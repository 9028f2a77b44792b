"""Collocations, quality rules and hard negatives against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from auditframe.llm import collocations, hard_negatives, queries, rules  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def phrases(rows, least, top=2000, longest=4):
    """The result by dictionaries over all phrases."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    absorbed = {(lang, w[i:j]) for (lang, w), a in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= 80 * f[lang, w[i:j]]}
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in absorbed:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


def as_set(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_collocations_of_the_documents(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = as_set(queries.op11_collocations(spark, SMALL))
    assert found and found == phrases(rows, 30)


def test_collocations_with_small_shards_and_crowded_counters(spark):
    texts = ["the cat sat, the cat sat; THE CAT\tsat on  the mat", "a a a a a a", None, "", " ... ", "x" * 3000 + " y", "naïve Ünï 漢字 naïve Ünï 漢字", "one two three four five. " * 40, "one\x0btwo one two\x1cthree", "  one two  ", "of the of the of the", "é é é É"]
    rows = [(lang, t) for t in texts for lang in ("en", None, "und", "de") for _ in range(3)]
    rows += [("en", "hot pair " * 500), ("en", "hot pair of words, " * 300)] * 5
    df = spark.createDataFrame([(lang, t, "x", 1, 2) for lang, t in rows], "lang string, text string, phrase string, shard int, f int").repartition(7)
    for least, longest, top in ((3, 4, 2000), (6, 3, 5), (1, 4, 2000), (300, 4, 2000)):
        found = as_set(collocations.collocations(df, least=least, longest=longest, top=top, shard_bytes=700, counter_bytes=1e9))
        assert found == phrases(rows, least, top, longest), (least, longest, top)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("text IS NULL")).count() == 0


def test_sketch_segments_come_back_as_they_went():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 5 * collocations.SEGMENT, 5000)).astype(np.uint64)
    back = np.concatenate([collocations.unpacked(low, blocks) + k * collocations.SEGMENT for k, _, low, blocks in collocations.packed(values)])
    assert (back == values).all()
    members = collocations.Members(values)
    some = np.r_[values[::3], values[::3] + np.uint64(1)]
    assert (members.of(some) == np.isin(some, values)).all()
    assert not collocations.Members(values[:0]).of(some).any()


NASTY = [None, "", " \n\n ", "word", "a b c a b c", "a a a a", "a a a", "x\nx\nx\n\n y\n y\n", "# * $ % & | < > #", "é" * 70 + " 漢字 " * 60, "tab\tsplit\x0bhere\x0cand\rthere", "same line\nsame line\r\nsame line", "w " * 49, "w " * 50, "long " * 40_000, "  no break"]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_count_and_fail_as_stated(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(3, "word"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1.5, 9) for i, t in rows], "doc_id long, text string, score double, n_words int")
    labels = spark.createDataFrame([(1000, 1), (1001, 0), (4, None), (5, 1), (5, 0), (77777, 1)], "doc_id long, quality int")
    want = Counter((i, *counts(t)) for i, t in rows)
    for known in (labels, labels.limit(0), labels.where("quality = 0")):
        trees = rules.fit(docs, known, F.lit(True))
        found = rules.judged(docs, trees).collect()
        assert Counter((r.doc_id, *(r[c] for c in rules.COUNTS)) for r in found) == want
        for r in found:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and 0 <= r.score <= 1
            assert r.kept == (not r.base_failed and r.score >= 0.5)
    assert rules.judged(docs.limit(0), trees).count() == 0


def test_rules_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op12_rules(spark, folder).collect()
    own = [(quality[r.doc_id], r.score >= 0.5) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and quality.get(r.doc_id) is not None]
    accuracy, majority = sum(a == b for a, b in own) / len(own), max(np.bincount([a for a, _ in own])) / len(own)
    assert accuracy > max(0.85, majority + 0.05), (accuracy, majority)


def test_trees_are_monotonic_and_flat_scoring_equals_walking():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 4))
    x[:, 3] = rng.integers(0, 3, 800)  # ties
    y = (np.sin(2 * x[:, 0]) + x[:, 1] - 0.7 * np.abs(x[:, 2]) + rng.normal(scale=0.4, size=800) > 0).astype(float)
    trees = rules.grow(x, y, falling=(0,), rising=(1,))
    free = rules.grow(x, y)
    grid = np.linspace(-3, 3, 60)
    turns = 0
    for row in x[:60]:
        for f, sign in ((0, -1), (1, 1)):
            line = np.repeat(row[None], len(grid), axis=0)
            line[:, f] = grid
            assert (sign * np.diff(trees.score(line)) >= -1e-12).all()
            turns += (np.diff(free.score(line)) * sign < -1e-9).any()
    assert turns  # without the constraint some lines turn
    assert ((free.score(x) >= 0.5) == y).mean() > 0.85

    def walk(row):
        z = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            z += trees.value[node]
        return 1 / (1 + math.exp(-z))

    assert np.allclose([walk(r) for r in x[:50]], trees.score(x[:50]), atol=1e-12)
    assert (rules.grow(x[:0], y[:0]).score(x[:3]) == 0.5).all() and len(rules.grow(x, np.ones(800)).roots) == 0


def brute(rows, divisor=100, k=5, negatives=10):
    """rows: (vec_id, vector, label); labels as they are."""
    known = [(i, label, [math.floor(256 * v) if abs(v) < 2**60 else int(v) * 256 for v in x]) for i, x, label in rows if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, (i, label, q) in enumerate(known):
        if i % divisor:
            continue
        scored = sorted((-sum(u * v for u, v in zip(q, p, strict=True)), j, b, own) for b, (j, own, p) in enumerate(known) if b != a and len(p) == len(q))
        for s, j, _, own in [x for x in scored if x[3] == label][:k]:
            fit = [(t, n) for t, n, _, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, r, n, *(x if abs(x) < 2**63 else None for x in (-s, -t))) for r, (t, n) in enumerate(fit, 1)]
    return Counter(out)


def as_counter(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_hard_negatives_of_the_embeddings(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = as_counter(queries.op13_hard_negatives(spark, SMALL))
    assert found and found == brute(rows)


def test_hard_negatives_with_odd_rows_and_small_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, 6))
    rows = [(i, (centres[i % 3] + rng.normal(scale=0.8, size=6)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 1 + i % 2) for i in range(60)]  # ties
    rows += [rows[0], rows[100], (100, rows[3][1], 2), (500, [1.0, 2.0], 1), (501, [1.0, 2.0], 1), (502, [0.5, 0.9], 2), (600, [], 1), (601, [], 1)]
    rows += [(700, [0.0] * 6, 0), (701, None, 0), (702, [1.0] * 5 + [None], 0), (703, [1.0] * 5 + [math.nan], 0), (704, [math.inf] + [1.0] * 5, 0), (800, [1.0] * 6, None)]
    big = [(0, [3e12, 1.0, 1.0], 1), (1, [2e12, 5.0, 3.0], 1), (2, [1.5e12, 1.0, 1.0], 2), (3, [1.4e12, -1.0, 7.0], 2), (100, [1e30, 1.0, 0.0], 3), (101, [1e30, 0.0, 0.0], 3), (102, [5e29, 0.0, 1.0], 2), (103, [0.25, 0.25, 0.25], 1)]
    for data in (rows, big, rows + big):
        df = spark.createDataFrame([(*r, 5, "x") for r in data], "vec_id long, embedding array<double>, label int, row int, v string").repartition(5)
        want = brute(data)
        assert want
        for block_bytes in (1 << 25, 2000):
            assert as_counter(hard_negatives.hard_negatives(df, F.col("id") % 100 == 0, block_bytes=block_bytes)) == want
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id % 100 != 0"), F.col("id") % 100 == 0).count() == 0


def test_a_segment_of_the_sketch_holds_few_bytes():
    """A task of the sketch holds all entries of its segment, a low part of two bytes and a count for each: at one for every four bytes of text they stay below 32 MB."""
    assert collocations.SEGMENT * 4 * 2 <= 32 << 20 and collocations.SEGMENT % collocations.BLOCK == 0
