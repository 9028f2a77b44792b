"""Alignments against a quadratic program over three states."""

import random

import numpy as np
from pyspark.sql import functions as F

from auditframe.operators import alignment
from auditframe.operators.alignment import EXTEND, MATCH, MISMATCH, OPEN, letters


def best_score(a, b, local):
    low = -(10**9)
    n, m = len(a), len(b)
    h, e, f = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    top = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                f[i][j] = max(h[i - 1][j] + OPEN, f[i - 1][j] + EXTEND)
            if j:
                e[i][j] = max(h[i][j - 1] + OPEN, e[i][j - 1] + EXTEND)
            pair = h[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH) if i and j else low
            h[i][j] = max(pair, e[i][j], f[i][j], 0 if local or not (i or j) else low)
            top = max(top, h[i][j])
    return top if local else h[n][m]


def global_score(a, b, pairs):
    """Score of a map with the gaps at both ends."""
    total = alignment.score_of(a, b, pairs)
    first, last = (pairs[0], pairs[-1]) if pairs else ((len(a), len(b)), (len(a) - 1, len(b) - 1))
    for gap in (*first, len(a) - 1 - last[0], len(b) - 1 - last[1]):
        total += OPEN + EXTEND * (gap - 1) if gap else 0
    return total


def pairs_of_texts(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        a = "".join(rng.choice("AB" if k % 3 else "ABCDEFGH") for _ in range(rng.randint(1, 60)))
        b = list(a[rng.randint(0, len(a) // 2) :])
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            kind = rng.random()
            if kind < 0.4:
                b[at : at + rng.randint(1, 5)] = []
            elif kind < 0.7:
                b[at:at] = [rng.choice("ABCDZ") for _ in range(rng.randint(1, 5))]
            elif at < len(b):
                b[at] = "Z"
        yield a, "".join(b) or "A"


def test_maps_reach_the_best_score(monkeypatch):
    for whole in (1 << 14, 6):  # solved at once, and halved down to single rows
        monkeypatch.setattr(alignment, "WHOLE", whole)
        for a, b in pairs_of_texts(250, whole):
            score, pairs = alignment.local_pairs(a, b)
            assert score == best_score(a, b, True) == (alignment.score_of(a, b, pairs) if pairs else 0), (a, b)
            assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
            pairs = alignment.global_pairs(letters(a), letters(b))
            assert global_score(a, b, pairs) == best_score(a, b, False), (a, b)


def test_long_sequences_take_linear_memory():
    rng = random.Random(1)
    a = "".join(rng.choice("ABCD") for _ in range(6000))
    b = a[500:2500] + a[2600:5000] + "DDDD" + a[5000:5900]
    score, pairs = alignment.local_pairs(a, b)
    assert score == alignment.score_of(a, b, pairs) and sum(a[i] == b[j] for i, j in pairs) >= 5290


def test_mapped_gates(spark):
    base = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVV"
    cases = [
        (base, base[10:40], "exact"), (base, base[5:30] + base[33:60], "aligned"), (base, base[5:30] + "WW" + base[30:60], "aligned"), (base, "W".join(base[i : i + 3] for i in range(0, 60, 3)), "unmapped"),
        (base, "CCCCCCCC", "unmapped"), (None, "A", "unmapped"), (base, "", "unmapped"), ("", "A", "unmapped"), (base, base[10:30] + "C" * 20, "unmapped"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "id int, a string, b string")
    for r in df.select("id", "a", "b", alignment.mapped("a", "b").alias("m")).collect():
        assert r.m.how == cases[r.id][2], r
        assert len(r.m.target) == len(r.m.query) and (r.m.how == "unmapped") == (not r.m.target)
        if r.m.how == "exact":
            assert all(r.a[i] == r.b[j] for i, j in zip(r.m.target, r.m.query, strict=True))
        if r.m.how == "aligned":
            assert np.isclose(r.m.identity, np.mean([r.a[i] == r.b[j] for i, j in zip(r.m.target, r.m.query, strict=True)])) and np.isclose(r.m.coverage, len(r.m.query) / len(r.b))


def test_best_in_band_equals_aligning_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randint(30, 50))) for _ in range(25)]
    texts = base + [s[:k] + "W" + s[k + 1 :] for s in base for k in (5, 20)] + [s[:9] + s[12:] for s in base] + ["ACA", "ACG", "A", "", "AAAAAAAA" * 5, "AAAAAAAA" * 5]
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id long, s string")
    for least, band in ((0.9, 4), (0.6, 2)):
        found = {r.id: (r.best, round(r.identity, 9)) for r in alignment.best_in_band(df, df, "id", "s", band, least).collect()}
        want = {}
        for i, a in enumerate(texts):
            scored = []
            for j, b in enumerate(texts):
                if i != j and a and b and abs(len(a) - len(b)) <= band:
                    same = sum(a[p] == b[q] for p, q in alignment.global_pairs(letters(a), letters(b)))
                    if same / max(len(a), len(b)) >= least:
                        scored.append((-round(same / max(len(a), len(b)), 9), j))
            if scored:
                want[i] = (min(scored)[1], -min(scored)[0])
        assert found == want, least
    assert alignment.best_in_band(df.limit(0), df, "id", "s", 3, 0.9).count() == 0
    assert df.select(F.size(alignment.grams("s", 3)).alias("n")).where("n > 100").count() == 0


def test_best_in_band_of_numbered_names(spark):
    """Names that differ in their digits only share nearly all grams; few pairs are aligned, and the result is that of all pairs."""
    texts = [f"Supplier#{i:09d}" for i in (*range(0, 240, 3), *range(100_000, 100_030))] + ["Supplier#000000003", "Suplier#000000009", "Supplier#0000000123"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id long, s string")
    rows = df.select("id", F.col("s").alias("a"))
    own = df.select(F.col("s").alias("b"), F.col("id").alias("first")).groupBy("b").agg(F.min("first").alias("first")).select("b", "first", F.lit(None).cast("long").alias("second"), F.xxhash64("b").alias("text"))
    assert 0 < alignment._by_ways(rows, own, 2, 0.9).count() < 12 * len(texts)
    assert alignment._by_grams(rows, own, 2, 0.9, 3).count() == 0
    found = {r.id: (r.best, round(r.identity, 9)) for r in alignment.best_in_band(df, df, "id", "s", 2, 0.9).collect()}
    want = {}
    for i, a in enumerate(texts):
        scored = [(-round(same / max(len(a), len(b)), 9), j) for j, b in enumerate(texts) if i != j and len(set(a) ^ set(b)) <= 4 and (same := alignment.equal_letters(a, b)) >= 0.9 * max(len(a), len(b))]
        if scored:
            want[i] = (min(scored)[1], -min(scored)[0])
    assert found == want and len(want) > 60


def test_equal_letters_without_a_gap():
    rng = random.Random(9)
    for _ in range(300):
        a = "".join(rng.choice("ab01") for _ in range(rng.randint(1, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = rng.choice("ab01")
        b = "".join(b)
        assert alignment.equal_letters(a, b) == sum(a[i] == b[j] for i, j in alignment.global_pairs(letters(a), letters(b)))
