"""Small frames with results known by hand, and invariants of sequential operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.functions import text
from auditframe.operators import causal, checks, cohort, controls, hotspots, inference, metrics, near_pairs, ranks, sparse, structure, vectors
from auditframe.sources import bundles, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_metrics_by_hand(spark):
    df = frame(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, p double")
    assert metrics.auroc(df, "y", "p").first().auroc == 0.75
    assert math.isclose(metrics.average_precision(df, "y", "p").first().average_precision, (1 + 2 / 3) / 2)
    assert metrics.binary_metrics(df, "y", "p").first().accuracy == 0.75


def test_metrics_with_ties_and_one_class(spark):
    ties = frame(spark, [(1, 0.5), (0, 0.5)], "y int, p double")
    assert metrics.auroc(ties, "y", "p").first().auroc == 0.5 and metrics.average_precision(ties, "y", "p").first().average_precision == 0.5
    ones = frame(spark, [(1, 0.5), (1, 0.9)], "y int, p double")
    row = metrics.binary_metrics(ones, "y", "p").first()
    assert row.auroc is None and row.sensitivity == 1 and row.specificity is None


def test_metrics_of_many_rows(spark):
    """Products of counts leave the longs here; by hand from the counts."""
    n = 3_000_000
    df = spark.range(n).select((F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 10 < 3, 0.9).otherwise(0.2).alias("p"))
    row = metrics.binary_metrics(df, "y", "p").first()
    tp, fp, fn, tn = (n // 10 * k for k in (1, 2, 4, 3))  # of ids ending 0 to 2, one is odd
    assert (row.n, row.accuracy) == (n, (tp + tn) / n)
    assert math.isclose(row.mcc, (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    assert math.isclose(row.auroc, (tp / (tp + fn) + tn / (tn + fp)) / 2)


def test_bins_and_strata(spark):
    df = frame(spark, [(0.0,), (0.1,), (1.0,)], "p double")
    assert [r[0] for r in df.select(metrics.equal_bin(F.col("p"))).collect()] == [0, 1, 9]
    df = frame(spark, [(69.9,), (70.0,), (89.9,), (90.0,), (None,)], "v double")
    assert [r[0] for r in df.select(text.binned(F.col("v"), [70.0, 90.0], ["low", "medium", "high"])).collect()] == ["low", "medium", "medium", "high", None]


def test_benjamini_hochberg(spark):
    df = frame(spark, [(0.01,), (0.04,), (0.03,), (0.20,), (None,)], "p double")
    found = {r.p: r.fdr for r in ranks.benjamini_hochberg(df, "p").collect()}
    assert found[None] is None
    assert np.allclose([found[p] for p in (0.01, 0.03, 0.04, 0.20)], [0.04, 0.16 / 3, 0.16 / 3, 0.20])
    with pytest.raises(Exception, match="p-value"):
        ranks.benjamini_hochberg(frame(spark, [(1.5,)], "p double"), "p").collect()


def test_sign_flips(spark):
    df = frame(spark, [("a", i, 1.0) for i in range(10)] + [("b", i, float(i)) for i in (1, 2, 3)] + [("c", i, 1.0) for i in range(25)], "k string, u int, d double")
    exact = {r.k: r.p for r in inference.sign_flip_exact(df, ["k"], "d", "u").collect()}
    assert exact == {"a": 2 / 1024, "b": 0.25, "c": None}
    assert math.isclose({r.k: r.p for r in inference.sign_flip_exact(df, ["k"], "d", "u", plus_one=True, tolerance=1e-12).collect()}["b"], 3 / 9)
    sampled = {r.k: r.p for r in inference.sign_flip_sampled(df, ["k"], "d", "u", draws=20_000).collect()}
    assert abs(sampled["b"] - 0.25) < 0.02 and sampled["c"] < 0.001


def test_rank_statistics(spark):
    df = frame(spark, [("x", 1.0, 1), ("x", 1.0, 1), ("x", 1.0, 0), ("x", 1.0, 0), ("x", 1.0, 0)], "k string, v double, y int")
    row = inference.rank_biserial(df, ["k"], "v", "y").first()
    assert (row.u, row.p, row.rank_biserial) == (3.0, 1.0, 0.0)
    assert inference.smd(df, ["k"], "y", "v").first().smd == 0
    assert math.isclose(inference.normal_tail(1.959963984540054), 0.05, rel_tol=1e-12)
    assert math.isclose(inference.gamma_tail(0.5, 3.841458820694124 / 2), 0.05, rel_tol=1e-9) and math.isclose(inference.gamma_tail(2, 11.0), math.exp(-11) * 12, rel_tol=1e-9)


def test_sparse_ranks(spark):
    active = frame(spark, [("g", 0, 2, 3.0), ("g", 0, 4, 1.0)], "g string, f int, pos int, v double")
    rows = ranks.sparse_average_ranks(active, frame(spark, [("g", 5)], "g string, L int"), ["g", "f"], "v").collect()
    assert {r.pos: r["rank"] for r in rows} == {2: 5.0, 4: 4.0} and {r.zero_rank for r in rows} == {2.0}


def test_text_functions(spark):
    row = frame(spark, [("AAC", "{", '["a","b"]')], "s string, bad string, good string").select(
        text.letter_fraction(F.col("s"), "A").alias("a"), text.entropy([text.letter_fraction(F.col("s"), c) for c in text.LETTERS]).alias("h"),
        text.json_list(F.col("bad")).alias("bad"), text.json_list(F.col("good")).alias("good"), text.grams(F.lit("abcab"), 3).alias("g"), text.grams(F.lit("ab"), 3).alias("none"),
        text.set_delta(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("d"), text.clipped_logit(F.lit(0.0)).alias("l"),
    ).first()
    assert math.isclose(row.a, 2 / 3) and abs(row.h - 0.63651) < 1e-5
    assert row.bad == [] and row.good == ["a", "b"] and row.g == ["abc", "bca", "cab"] and row.none == []
    assert row.d.asDict() == {"gained": 0, "lost": 0, "jaccard": 1.0} and row.l < -13


def test_pooling(spark):
    df = frame(spark, [("p", [1.0, 2.0]), ("p", [3.0, 4.0])], "id string, vec array<double>")
    rows = vectors.pooled(vectors.long(df, ["id"], "vec"), ["id"]).orderBy("dim").collect()
    assert [(r.mean, r.std, r.max) for r in rows] == [(2, 1, 3), (3, 1, 4)]


def test_checks(spark):
    df = frame(spark, [(1, "g", "train"), (2, "g", "test"), (3, "h", "train")], "id int, g string, split string")
    assert [r.g for r in checks.crossing_groups(df, "g", "split").collect()] == ["g"]
    with pytest.raises(ValueError, match="repeat"):
        checks.joined(df, df.select("g", F.lit(1).alias("x")), ["g"])
    with pytest.raises(ValueError):
        checks.enforce(df, "rows")
    sets = frame(spark, [(1, 1, list("abcdefghij")), (2, 0, list("abcdefghij")), (3, 0, list("abcdefghij")), (4, 0, list("abcdexyz")), (5, 1, [])], "id int, y int, g array<string>")
    assert [(r.one, r.zero, r.ones, r.zeros, r.cosine) for r in checks.near_duplicates(sets, "id", "y", "g").collect()] == [(1, 2, 1, 2, 1.0)]


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        base = set(range(40 * (i % 8), 40 * (i % 8) + 40))
        rows.append((i, int(rng.integers(0, 2)), [str(x) for x in base - set(rng.choice(sorted(base), rng.integers(0, 5)).tolist())]))
    found = {(r.one, r.zero) for r in checks.near_duplicates(frame(spark, rows, "id int, y int, g array<string>"), "id", "y", "g", 0.95).collect()}
    first = {}
    for i, y, g in rows:
        first.setdefault((y, frozenset(g)), i)
    want = {(a, b) for (y, g), a in first.items() for (z, h), b in first.items() if y == 1 and z == 0 and len(g & h) / math.sqrt(len(g) * len(h)) >= 0.95}
    assert found == want and want


def test_part_signatures_miss_no_near_pair():
    """Sets of all sizes, those at the very bound among them, meet in a part; empty parts alone decide nothing."""
    rng = np.random.default_rng(11)
    for least in (0.8, 0.95, 1.0):
        met = pairs = 0
        for n in [*range(1, 40), 97, 400, 1500]:
            for m in {n, math.ceil(n * least * least - 1e-9), math.floor(n / (least * least) + 1e-9)}:
                shared = math.ceil(least * math.sqrt(n * m) - 1e-9)
                if m < 1 or shared > min(n, m):
                    continue
                a = rng.integers(-(2**63), 2**63, n)
                b = np.r_[a[:shared], rng.integers(-(2**63), 2**63, m - shared)]
                one = {int(x) for _, s in near_pairs.part_signatures([a], (0,), least) for x in s}
                other = {int(x) for _, s in near_pairs.part_signatures([b], (-1, 0, 1), least) for x in s}
                met, pairs = met + bool(one & other), pairs + 1
        assert met == pairs > 40
    far = [rng.integers(-(2**63), 2**63, 300) for _ in range(2)]
    sides = [{int(x) for _, s in near_pairs.part_signatures([x], levels, 0.95) for x in s} for x, levels in zip(far, ((0,), (-1, 0, 1)), strict=True)]
    assert not sides[0] & sides[1]


def test_signatures_of_one_side_are_not_shuffled(spark):
    """Of far sets nearly no signature is left, of near ones all that meet."""
    rng = np.random.default_rng(12)
    sets = [(i, rng.integers(-(2**63), 2**63, 400).tolist()) for i in range(60)]
    one, other = (frame(spark, some, "member int, h array<long>") for some in (sets[:30], sets[29:]))
    there = near_pairs.bitmap(near_pairs.signed(other, "member", "h", (-1, 0, 1), 0.95), 1 << 20)
    whole, left = (near_pairs.signed(one, "member", "h", (0,), 0.95, bits) for bits in (None, there))
    assert left.where("member = 29").count() == whole.where("member = 29").count() > 40
    assert left.count() < 1.5 * whole.count() / 30 + 60
    assert [tuple(r) for r in near_pairs.candidates(one, other, 0.95).collect()] == [(29, 29)]


def test_near_duplicates_of_odd_tables(spark):
    """Null and empty sets are near nothing, null labels count as no class, an empty table gives no pair."""
    schema = "id int, y int, g array<string>, a int, b int, h int"
    rows = [(1, 1, ["x"], 0, 0, 0), (2, 0, ["x", "x"], 0, 0, 0), (3, 0, [], 0, 0, 0), (4, 1, None, 0, 0, 0), (5, None, ["x"], 0, 0, 0), (6, 0, ["y"], 0, 0, 0)]
    assert [tuple(r) for r in checks.near_duplicates(frame(spark, rows, schema), "id", "y", "g").collect()] == [(1, 2, 1, 1, 1.0)]
    assert checks.near_duplicates(frame(spark, [], schema), "id", "y", "g").count() == 0


def test_grams_are_of_characters(spark):
    """Line ends are characters, and so is one beyond the basic plane."""
    row = frame(spark, [("a\nb\U0001f600c", None)], "s string, n string").select(text.grams(F.col("s"), 3).alias("g"), text.grams(F.col("n"), 3).alias("n")).first()
    assert row.g == ["a\nb", "\nb\U0001f600", "b\U0001f600c"] and row.n is None


def test_grouped_split(spark):
    rows = [(i, f"g{i % 60}", int(i % 60 < 20)) for i in range(600)]
    out = cohort.grouped_split(frame(spark, rows, "id int, g string, y int"), "g", "y")
    assert checks.crossing_groups(out, "g", "split").count() == 0
    shares = {r.split: (r["count"], r.ones) for r in out.groupBy("split").agg(F.count("*").alias("count"), F.sum("y").alias("ones")).collect()}
    assert abs(shares["train"][0] - 420) <= 20 and all(abs(ones / n - 1 / 3) < 0.1 for n, ones in shares.values())


def test_grouped_split_of_many_small_groups(spark):
    """Groups of one to three rows and a few large ones; the result doesn't depend on partitions."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") < 9000, F.floor(F.col("id") / 3000)).otherwise(F.floor(F.col("id") / F.lit(2)) * 2).alias("g"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    out = cohort.grouped_split(rows, "g", "y")
    assert checks.crossing_groups(out, "g", "split").count() == 0 and out.where("split IS NULL").count() == 0
    shares = {r.split: (r.n / 60_000, r.y) for r in out.groupBy("split").agg(F.count("*").alias("n"), F.avg("y").alias("y")).collect()}
    assert abs(shares["train"][0] - 0.7) < 0.01 and abs(shares["val"][0] - 0.15) < 0.01 and all(abs(y - 0.3) < 0.02 for _, y in shares.values())
    again = cohort.grouped_split(rows.repartition(7), "g", "y")
    assert out.select("id", "split").exceptAll(again.select("id", "split")).count() == 0
    none = cohort.grouped_split(frame(spark, [(1, None, 1), (2, "a", 0)], "id int, g string, y int"), "g", "y")
    assert {r.id: r.split is None for r in none.collect()} == {1: True, 2: False}
    assert cohort.grouped_split(rows.limit(0), "g", "y").count() == 0


def test_pruning_beyond_the_hand(spark):
    """A hand of few pairs reaches the target, too, and keeps at least the least share."""
    rng = np.random.default_rng(2)
    n = 300
    values = frame(spark, [(i, float(rng.normal() + 0.4 * (i >= n)), float(rng.normal())) for i in range(2 * n)], "id long, a double, b double")
    pairs = spark.range(n).select(F.col("id").alias("zero"), (F.col("id") + n).alias("one"), F.lit(0.0).alias("distance"))
    x = {r.id: (r.a, r.b) for r in values.collect()}

    def worst(rows):
        one, zero = (np.array([x[r[c]] for r in rows]) for c in ("one", "zero"))
        return (np.abs(one.mean(0) - zero.mean(0)) / np.sqrt((one.var(0) + zero.var(0)) / 2)).max()

    whole, by_hand = (causal.pruned_pairs(pairs, values, "id", ["a", "b"], hand=h).collect() for h in (2000, 40))
    assert worst(whole) <= 0.10 < worst(pairs.collect()) and worst(by_hand) <= 0.10
    assert n * 0.4 <= len(whole) and abs(len(whole) - len(by_hand)) <= 5


def test_matching_of_equal_logits(spark):
    """Rows with one logit are dealt to stretches, too, and rows without a logit have no partner."""
    rows = [(i, i % 2, 0, 0.5, [0.5]) for i in range(400)] + [(1000, 1, 0, None, [0.5]), (1001, 0, None, 0.1, [0.1]), (1002, 1, None, 0.1, [0.1])]
    df = frame(spark, rows, "id long, y int, bin int, logit double, z array<double>")
    found = causal.matched_pairs(df, ["bin"], "id", "y", 0.3, stretch=50).collect()
    units = [u for r in found for u in (r.zero, r.one)]
    assert len(units) == len(set(units)) and 1000 not in units and {1001, 1002} <= set(units)
    assert all(r.zero % 2 == 0 and r.one % 2 == 1 for r in found if r.zero < 1000) and len(found) >= 180


def test_matching_in_stretches(spark):
    """Pairs that a cut would part are found in the second round."""
    rows = [(i, i % 2, i / 100.0, [i / 100.0], 0) for i in range(400)]
    df = frame(spark, rows, "id int, y int, logit double, z array<double>, bin int")
    found = causal.matched_pairs(df, ["bin"], "id", "y", 0.3, stretch=50).collect()
    assert len({r.zero for r in found}) == len({r.one for r in found}) == len(found) == 200
    assert all(r.zero % 2 == 0 and r.one % 2 == 1 and r.distance <= 0.3 for r in found)


def test_matching_pruning_and_residuals(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):  # the assignment is a cheapest one
        cost = rng.random((4, 6))
        import itertools

        best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(6), 4))
        assert math.isclose(cost[np.arange(4), causal.assignment(cost)].sum(), best)
    n = 400
    y = rng.integers(0, 2, n)
    a, b = rng.normal(size=n) + 0.5 * y, rng.normal(size=n)
    df = frame(spark, [(i, int(y[i]), float(a[i]), float(b[i]), float(a[i] + b[i]), i % 4 != 0) for i in range(n)], "id int, y int, a double, b double, c double, train boolean")
    scored = causal.propensity(df, "y", ["a", "b"], "train")
    pairs = causal.matched_pairs(scored, ["bin"], "id", "y", 0.3)
    rows = pairs.collect()
    assert rows and all(y[r.zero] == 0 and y[r.one] == 1 and r.distance <= 0.3 for r in rows)
    assert len({r.zero for r in rows}) == len({r.one for r in rows}) == len(rows)
    kept = causal.pruned_pairs(pairs, df, "id", ["a", "b"]).collect()
    gap = lambda ps, x: abs(np.mean([x[p.one] for p in ps]) - np.mean([x[p.zero] for p in ps]))
    assert 0 < len(kept) <= len(rows) and max(gap(kept, a), gap(kept, b)) <= max(gap(rows, a), gap(rows, b)) + 1e-9
    outputs = df.select("id", F.lit(0).alias("dim"), (2 * F.col("a") - F.col("b") + F.sin("id")).alias("x"))
    own = causal.residuals(df, "id", ["a", "b", "c"], outputs, "train")  # c = a + b: collinear
    r = np.array([row.residual for row in own.orderBy("id").collect()])
    train = np.arange(n) % 4 != 0
    assert max(abs(r[train].sum()), abs((r * a)[train].sum()), abs((r * b)[train].sum())) < 1e-6


def test_structure_kernels(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3)) * 5
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn[:, 0] *= np.sign(np.linalg.det(turn))
    moved = x @ turn.T + [3, -1, 2]
    df = frame(spark, [("s", i, *map(float, x[i]), *map(float, moved[i])) for i in range(30)], "k string, pos int, a double, b double, c double, d double, e double, f double")
    assert structure.rmsd(structure.superposed(df, ["k"], "pos", ["a", "b", "c"], ["d", "e", "f"]), ["k"]).first().rmsd < 1e-6
    pairs = df.select("a").count()
    near = structure.near_points(df, "pos", "k", ["a", "b", "c"], 4.0).count()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert pairs == 30 and near == int((np.triu(d <= 4.0, 1)).sum())
    assert structure.global_identity("ACDEFG", "ACDEFG") == (1.0, 1.0)


def test_permutation_null_is_uniform_without_signal(spark):
    rng = np.random.default_rng(3)
    active = frame(spark, [(0, i, f, float(rng.random())) for i in range(200) for f in range(20) if rng.random() < 0.3], "g int, pos int, feature int, activation double")
    targets = frame(spark, [(0, i, float(rng.normal())) for i in range(200)], "g int, pos int, y double")
    p = [r.p for r in sparse.permutation_null(active, targets, "g", "pos", "y", draws=99, seed=1).collect()]
    assert len(p) == 20 and min(p) >= 1 / 100 and 0.2 < np.mean(p) < 0.8


def test_permutation_null_broadcasts_no_draws(spark, monkeypatch):
    """All draws of all positions are far more than the planner reckons; none of them goes through the driver."""
    plans, save = {}, sparse.saved

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return save(df, label)

    monkeypatch.setattr(sparse, "saved", seen)
    active = frame(spark, [(i % 2, i, i % 3, 1.0) for i in range(60)], "g int, pos int, feature int, activation double")
    targets = frame(spark, [(i % 2, i, float(i * i % 7)) for i in range(60)], "g int, pos int, y double")
    assert sparse.permutation_null(active, targets, "g", "pos", "y", draws=9).count() == 3
    assert "SortMergeJoin" in plans["draw-sums"] and "Broadcast" not in plans["draw-sums"]


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select(F.lit("k").alias("k"), (F.col("id") % 10).cast("double").alias("v"), "id")
    row = inference.bootstrap_mean(df, ["k"], "v", draws=300).first()
    assert row.low < 4.5 < row.high and row.high - row.low < 1


def test_tables(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    tables.write_csv(frame(spark, [("a", 1), ("", 2)], "s string, n int"), path)
    assert tables.read_table(spark, path, "s string, n int", keep_empty=True).where("s = ''").count() == 1
    with pytest.raises(ValueError):
        tables.read_table(spark, path)
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.bin")
    assert tables.read_or_empty(spark, f"{tmp_path}/none.parquet", "a int").count() == 0
    keyed = f"{tmp_path}/k.parquet"
    for run, n in (("one", 3), ("two", 4), ("one", 5)):
        tables.write_keyed(spark.range(n), keyed, run)
    assert {r.config_hash: r["count"] for r in spark.read.parquet(keyed).groupBy("config_hash").count().collect()} == {"one": 5, "two": 4}


def test_tails_and_intervals(spark):
    """Known values of Student's t, and a correlation's tail against its definition for n = 4."""
    for freedom, want in ((1, 12.706204736432095), (6, 2.4469118511449692), (30, 2.0422724563012378), (1000, 1.9623390808264078)):
        assert math.isclose(inference.t_975(freedom), want, rel_tol=1e-9)
    df = frame(spark, [(0.5, 4), (-0.5, 4), (0.0, 10), (1.0, 5), (0.3, 2), (None, 9)], "r double, n int")
    p = [r.p for r in df.select(inference.pearson_tail(F.col("r"), F.col("n")).alias("p")).collect()]
    # With two degrees of freedom the tail is 1 - |r|.
    assert math.isclose(p[0], 0.5, rel_tol=1e-9) and p[1] == p[0] and p[2] == 1.0 and p[3] < 1e-9 and all(x is None or math.isnan(x) for x in p[4:])
    rows = frame(spark, [("a", i, 0.5 + i % 3) for i in range(8)] + [("b", i, (-1.0) ** i) for i in range(40)], "k string, u int, d double")
    found = {r.k: r for r in inference.sign_flip_test(rows, ["k"], "d", "u", draws=4000).collect()}
    assert found["a"].p == 2 / 256 and found["b"].p > 0.9 and found["b"].n == 40


def test_alignment_in_linear_space():
    rng = np.random.default_rng(3)

    def full(a, b):
        n, m = len(a), len(b)
        score = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n + 1):
            for j in range(m + 1):
                if i == 0 or j == 0:
                    score[i][j] = -2 * (i + j)
                else:
                    score[i][j] = max(score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), score[i - 1][j] - 2, score[i][j - 1] - 2)
        i, j, same, pairs = n, m, 0, 0
        while i and j:
            if score[i][j] == score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
                same, pairs, i, j = same + (a[i - 1] == b[j - 1]), pairs + 1, i - 1, j - 1
            elif score[i][j] == score[i - 1][j] - 2:
                i -= 1
            else:
                j -= 1
        return same / max(1, pairs), pairs / m

    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(1, 14))) for _ in range(2))
        assert structure.global_identity(a, b) == full(a, b), (a, b)


def test_controls_by_hand(spark):
    rows = [("g", i, i, float(v), l) for i, (v, l) in enumerate([(9, "A"), (1, "B"), (2, "A"), (8, "B"), (0, "C"), (3, "B")])]
    df = frame(spark, rows, "g string, u int, pos int, x double, l string")
    found = {r.matched: r.pos for r in hotspots.hotspot_controls(df, "g", "pos", "x", "l", hotspots=2, controls=2).where("kind = 'control'").collect()}
    assert found == {0: 2, 3: 1}
    a = frame(spark, [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 2.0), (3, 2, 1.0)], "row int, feature int, activation double")
    b = frame(spark, [(1, 7, 1.0), (2, 7, 2.0), (3, 8, 5.0)], "row int, feature int, activation double")
    assert [(r.left, r.right, round(r.cosine, 9)) for r in controls.matched_features(a, b, ["row"], 0.5).orderBy("left").collect()] == [(0, 7, 1.0), (2, 8, 1.0)]


def test_structures_that_fall_apart(spark):
    rng = np.random.default_rng(4)
    rows = [("near", i, *map(float, rng.normal(size=3) * 4), 1.0, float(i), 0.5) for i in range(12)] + [("far", i, 100.0 * i, 0.0, 0.0, 1.0, 0.0, 0.0) for i in range(4)]
    out = structure.response_scan(frame(spark, rows, "s string, i int, x double, y double, z double, mx double, my double, mz double"), "s", "i", ["x", "y", "z"], ["mx", "my", "mz"], directions=20).collect()
    near, far = ([r for r in out if r.s == s] for s in ("near", "far"))
    assert len(near) == 12 and sum(r.is_top for r in near) == 1 and all(r.max_absolute >= abs(r.max_overlap) - 1e-12 and r.half_delta >= 0 for r in near)
    assert len(far) == 4 and all(r.is_top is None and (r.max_overlap is None or math.isnan(r.max_overlap)) for r in far)


def test_registered_models():
    import hashlib

    registry = {"m": {"sha256": hashlib.sha256(b"weights").hexdigest(), "features": ["a", "b"]}}
    checks.registered_model(registry, "m", b"weights", ["a", "b"])
    for name, payload, features in (("n", b"weights", ["a", "b"]), ("m", b"other", ["a", "b"]), ("m", b"weights", ["b", "a"])):
        with pytest.raises(ValueError):
            checks.registered_model(registry, name, payload, features)


def test_plans_are_immutable():
    plan = {"seed": 1, "views": ["a", "b"]}
    plan["digest"] = checks.plan_digest(plan)
    checks.unchanged(plan, {"views": ["a", "b"], "seed": 1})
    for own, rebuilt in ((plan | {"seed": 2}, plan), (plan, {"seed": 1, "views": ["b"]})):
        with pytest.raises(ValueError):
            checks.unchanged(own, rebuilt)


def test_bundles(spark, tmp_path):
    """A round trip; contracts without the bytes; every broken rule is an error."""
    made = {(f"e{i}", m): np.arange(6 * (i + 1), dtype=d).reshape(-1, 6) for i in range(3) for m, d in (("residues", "float32"), ("pairs", "float64"))}
    df = frame(spark, [(e, m, *bundles.pack(a)) for (e, m), a in made.items()], "entity string, modality string, shape array<long>, dtype string, data binary")
    path = f"{tmp_path}/bundles"
    bundles.write_bundles(df, path)
    back = {(r.entity, r.modality): bundles.unpack(r.shape, r.dtype, r.data) for r in bundles.read_bundles(spark, path, ranks={"pairs": 2}, dtypes={"pairs": "float64"}).collect()}
    assert back.keys() == made.keys() and all((back[k] == made[k]).all() and back[k].dtype == made[k].dtype for k in made)
    assert bundles.read_bundles(spark, path, ["pairs"]).count() == 3
    plan = bundles.contract(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "data" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError, match="no bundle"):
        bundles.read_bundles(spark, path, ["pairs", "other"])
    good = frame(spark, [("e", "m", *bundles.pack(np.ones((2, 3))))], df.schema).withColumn("sha256", F.sha2("data", 256))
    bad = {
        "digest": good.withColumn("sha256", F.lit("0")), "type": good.withColumn("dtype", F.lit("float8")), "size": good.withColumn("shape", F.array(F.lit(7).cast("long"))),
        "not finite": frame(spark, [("e", "m", *bundles.pack(np.array([1.0, np.nan])))], df.schema).withColumn("sha256", F.sha2("data", 256)),
    }
    for why, rows in bad.items():
        assert [r.why for r in bundles.broken(rows).collect()] == [why]
    assert [r.why for r in bundles.broken(good, ranks={"m": 3}).collect()] == ["rank"] and [r.why for r in bundles.broken(good, dtypes={"m": "float32"}).collect()] == ["expected type"]
    assert bundles.broken(good).count() == 0


def test_tables_are_swapped_whole(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    for n in (3, 5):
        tables.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("t.parquet")] == ["t.parquet"]
    tables.write_report(f"{tmp_path}/report", spark.range(4), spark.range(2), {"seed": 1})
    row = spark.read.parquet(f"{tmp_path}/report/manifest.parquet").first()
    assert row.manifest == '{"rows":{"metrics":2,"predictions":4},"seed":1}'
