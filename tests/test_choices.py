"""Hotspots with controls, resampled metrics and naive Bayes against programs of their own."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.operators import checks, controls, hotspots, models, resampling
from auditframe.sources import resume, tables


def chosen_by_hand(rows, hotspots_most, controls, quantile):
    """Whole groups as lists, picked one by one."""
    out = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        n = len(own)
        if n < 2:
            continue
        rank = {r[1]: i + 1 for i, r in enumerate(own)}
        hot = own[: min(hotspots_most, max(1, n // 2))]
        cut = sorted(r[2] for r in own)[math.ceil((n - 1) * quantile)]
        left = [r for r in own[len(hot) :] if r[2] <= cut]
        left = left if len(left) >= controls else own[len(hot) :]
        for h in hot:
            out.add((g, h[1], "hotspot", rank[h[1]], h[1], True, 0))
        for h in hot[: min(controls, len(left))]:
            best = min(left, key=lambda r: (not (r[3] is not None and r[3] == h[3]), abs(r[1] - h[1]), r[1]))
            left.remove(best)
            out.add((g, best[1], "control", rank[best[1]], h[1], best[3] is not None and best[3] == h[3], abs(best[1] - h[1])))
    return out


@pytest.mark.parametrize(("most", "controls", "quantile"), [(5, 5, 0.5), (3, 5, 0.2), (5, 2, 0.9), (4, 4, 0.0)])
def test_hotspots_equal_a_program_of_whole_groups(spark, most, controls, quantile):
    rng = random.Random(most * 10 + controls)
    rows = [(g, pos, float(rng.randrange(6)), rng.choice(["A", "B", "C", None])) for g, n in enumerate([1, 2, 3, 5, 9, 10, 11, 40, 200]) for pos in rng.sample(range(-n, 3 * n), n)]
    df = spark.createDataFrame(rows, "g int, pos int, x double, l string")
    out = hotspots.hotspot_controls(df, "g", "pos", "x", "l", hotspots=most, controls=controls, quantile=quantile, strict=False).collect()
    assert {(r.g, r.pos, r.kind, r["rank"], r.matched, r.letter_matched, r.apart) for r in out} == chosen_by_hand(rows, most, controls, quantile)
    assert all(math.isclose(r.quantile, (n - r["rank"] + 1) / n) for r in out for n in [sum(x[0] == r.g for x in rows)])


def test_hotspots_of_odd_tables(spark):
    schema = "g int, pos int, x double, l string"
    one = spark.createDataFrame([(1, 0, 2.0, "A"), (2, 0, 1.0, "A"), (2, 1, 1.0, "A")], schema)
    with pytest.raises(Exception, match="no control"):
        hotspots.hotspot_controls(one, "g", "pos", "x", "l").collect()
    nulls = spark.createDataFrame([(1, 0, 2.0, "A"), (1, 1, None, "A"), (None, 2, 1.0, "A"), (1, None, 1.0, "A"), (1, 4, 0.0, None)], schema)
    assert {(r.pos, r.kind, r.letter_matched) for r in hotspots.hotspot_controls(nulls, "g", "pos", "x", "l").collect()} == {(0, "hotspot", True), (4, "control", False)}
    assert {r.letter_matched for r in hotspots.hotspot_controls(nulls, "g", "pos", "x").collect()} == {None}
    assert hotspots.hotspot_controls(one.where("false"), "g", "pos", "x", "l").collect() == []


def metrics_by_hand(y, p, w):
    """All metrics of weighted rows, each by its definition."""
    pos, neg, hit = y == 1, y == 0, p >= 0.5
    tp, fp, ones, zeros = w[pos & hit].sum(), w[neg & hit].sum(), w[pos].sum(), w[neg].sum()
    n, fn, tn = ones + zeros, ones - tp, zeros - fp
    pairs = [(w[i] * w[j], 1.0 if p[i] > p[j] else 0.5 if p[i] == p[j] else 0.0) for i in np.flatnonzero(pos) for j in np.flatnonzero(neg)]
    gain = sum((w[pos & (p == t)].sum() / ones) * w[pos & (p >= t)].sum() / w[p >= t].sum() for t in set(p.tolist()))
    bins = np.minimum(np.searchsorted(np.linspace(0, 1, 11)[1:], p, side="right"), 9)
    ece = sum(abs((w * (y - p))[bins == b].sum()) for b in range(10)) / n
    spread = math.sqrt((tp + fp) * ones * zeros * (tn + fn))
    return {
        "prevalence": ones / n, "mean_p": (w * p).sum() / n, "predicted_positive": (tp + fp) / n, "accuracy": (tp + tn) / n, "balanced_accuracy": (tp / ones + tn / zeros) / 2, "sensitivity": tp / ones, "specificity": tn / zeros,
        "fnr": fn / ones, "fpr": fp / zeros, "f1": 2 * tp / (tp + fp + ones), "mcc": (tp * tn - fp * fn) / spread if spread else 0.0, "brier": (w * (y - p) ** 2).sum() / n, "ece": ece,
        "auroc": sum(a * b for a, b in pairs) / sum(a for a, _ in pairs), "average_precision": gain,
    }


def test_resampled_metrics_equal_their_definitions(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 60), np.round(rng.random(60), 1)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "u int, y int, p double")
    draws = {}
    for r in resampling.weighted(df, "u", 6, 3).collect():
        draws.setdefault(r.draw, np.zeros(60))[r.u] = r.w
    found = {r.draw: r for r in resampling.stratified_metrics(df, "u", "y", "p", 6, 3).collect()}
    assert len(found) == 6
    for draw, w in draws.items():
        scaled = np.where(y == 1, w * y.sum() / w[y == 1].sum(), w * (1 - y).sum() / w[y == 0].sum())
        for name, value in metrics_by_hand(y, p, scaled).items():
            assert math.isclose(found[draw][name], value, abs_tol=1e-9), name


def test_resampled_metrics_of_one_class_and_of_nothing(spark):
    ones = spark.createDataFrame([(i, 1, i / 10) for i in range(9)] + [(10, None, 0.5), (11, 1, None)], "u int, y int, p double")
    out = {r.metric: r for r in resampling.bootstrap_metrics(ones, "u", "y", "p", 20).collect()}
    assert set(resampling.METRICS) - set(out) == {"balanced_accuracy", "specificity", "fpr", "auroc", "average_precision"}
    assert out["prevalence"].low == out["prevalence"].high == 1 and out["sensitivity"].draws == 20
    assert resampling.bootstrap_metrics(ones.where("false"), "u", "y", "p", 20).collect() == []


def test_naive_bayes_equals_a_direct_one_and_keeps_digits(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 4)) + y[:, None] + 1e6
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(90)] + [(90, None, [0.0] * 4), (91, 1, None)], "id int, y int, v array<double>")
    model = models.gaussian_bayes(df, "v", "y")
    found = {(r.id, r.smoothing): (r.predicted, r.p) for r in models.bayes_classes(df.where("id < 90"), "id", "v", model, [1e-9, 1e-2]).collect()}
    for s in (1e-9, 1e-2):
        logs = np.stack([np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * v).sum() + ((x - m) ** 2 / v).sum(axis=1)) for c in range(3) for m in [x[y == c].mean(axis=0)] for v in [x[y == c].var(axis=0) + s * x.var(axis=0).max()]])
        q = np.exp(logs - logs.max(axis=0))
        q /= q.sum(axis=0)
        for i in range(90):
            assert found[i, s][0] == q[:, i].argmax() and math.isclose(found[i, s][1], q[:, i].max(), rel_tol=1e-6)
    with pytest.raises(ValueError, match="length"):
        models.gaussian_bayes(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "y int, v array<double>"), "v", "y")
    with pytest.raises(ValueError, match="no rows"):
        models.gaussian_bayes(df.where("false"), "v", "y")


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    path, seen = str(tmp_path / "run"), []
    df = spark.createDataFrame([(i, i % 7, None if i % 5 == 0 else i) for i in range(100)], "batch_no int, row int, key int")

    def work(part):
        if len(seen) == 2:
            seen.append("broken")
            raise RuntimeError("lost")
        seen.append(part.count())
        return part.groupBy("row").agg(F.count("*").alias("n"), F.sum("batch_no").alias("ids"))

    with pytest.raises(RuntimeError):
        resume.advance(df, "row", path, {"a": 1}, work, batches=5)
    assert len(resume.done(spark, path)) == 2
    with pytest.raises(ValueError, match="have not ended"):
        resume.result(spark, path)
    for other, batches in (({"a": 2}, 5), ({"a": 1}, 6)):
        with pytest.raises(ValueError, match="another configuration"):
            resume.advance(df, "row", path, other, work, batches=batches)
    assert resume.advance(df, "row", path, {"a": 1}, work, batches=5, most=1) == 2
    assert resume.advance(df.where("false"), "row", path, {"a": 1}, work, batches=5) == 0  # the rows of the beginning count
    assert resume.advance(df, "row", path, {"a": 1}, work, batches=5) == 0 and len(seen) == 6 and sum(s for s in seen if s != "broken") == 100
    want = {(r, sum(i % 7 == r for i in range(100)), sum(i for i in range(100) if i % 7 == r)) for r in range(7)}
    assert {tuple(r) for r in resume.result(spark, path).collect()} == want
    assert not [p.name for p in (tmp_path / "run" / "parts").iterdir() if ".new-" in p.name]


def test_runs_of_an_empty_table_and_null_keys(spark, tmp_path):
    empty = spark.createDataFrame([], "k int")
    assert resume.advance(empty, "k", str(tmp_path / "e"), {}, lambda d: d, batches=3) == 0
    assert resume.result(spark, str(tmp_path / "e")).collect() == []
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "k int")
    assert resume.advance(nulls, "k", str(tmp_path / "n"), {}, lambda d: d, batches=3) == 0
    assert sorted(str(r.k) for r in resume.result(spark, str(tmp_path / "n")).collect()) == ["1", "None", "None"]


def test_embedding_faults_one_by_one(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    fine = {"sequence_sha256": sha("MUK"), "rows": 3, "width": 8, "dtype": "float32", "model_id": "m", "model_revision": "1", "representation": "esm2_final_hidden_state", "output_dtype": "float32", "policy": None, "model_sequence_sha256": None}
    cases = {
        None: [{}, {"policy": "none"}, {"policy": "U_to_X", "model_sequence_sha256": sha("MXK")}], "sequence digest": [{"sequence_sha256": sha("MXK")}, {"sequence_sha256": None}], "shape": [{"rows": 4}, {"width": None}], "dtype": [{"dtype": "float16"}, {"dtype": None}],
        "model": [{"model_id": ""}, {"model_revision": None}], "representation": [{"representation": "x"}, {"representation": None}], "output dtype": [{"output_dtype": None}], "policy": [{"policy": "other"}],
        "model digest": [{"policy": "U_to_X"}, {"model_sequence_sha256": sha("MXK")}],
    }
    flat = [(fault, change) for fault, changes in cases.items() for change in changes]
    schema = "id int, " + ", ".join(f"{k} {'int' if k in ('rows', 'width') else 'string'}" for k in fine)
    rows = [(i, *(fine | change).values()) for i, (_, change) in enumerate(flat)]
    rows += [(100, *fine.values())] * 2
    catalog = spark.createDataFrame([(i, "MUK") for i in [*range(len(flat)), 100, 101]], "id int, sequence string")
    found = {r.id: r.fault for r in checks.embedding_faults(catalog, spark.createDataFrame(rows, schema), 8).collect()}
    assert found == {i: fault for i, (fault, _) in enumerate(flat)} | {100: "repeated", 101: "missing"}


def test_dataset_faults(spark):
    schema = "y int, split string, g int"
    good = [(y, s, i) for i, (y, s) in enumerate((y, s) for s in ("train", "val", "test") for y in (0, 1))]
    faults = lambda rows: {r.rule: r.n for r in checks.dataset_faults(spark.createDataFrame(rows, schema), "y", "split", "g").collect()}
    none = {"columns": 0, "splits": 0, "labels": 0, "classes": 0, "groups": 0}
    assert faults(good) == none
    assert faults([*good, (2, "train", 50), (None, "val", 51)]) == none | {"labels": 2}
    assert faults([*good, (0, None, 50), (0, "dev", 50)]) == none | {"splits": 2}
    assert faults([r for r in good if r[1] != "test"] + [(0, "test", 0), (0, "test", None), (1, "train", None)]) == none | {"classes": 1, "groups": 1}
    assert faults([]) == none | {"splits": 3, "classes": 3}
    assert [tuple(r) for r in checks.dataset_faults(spark.createDataFrame(good, schema), "y", "part", "group").collect()] == [("columns", 2)]


def test_sets_of_latents_against_decodings_without_them(spark):
    rng = np.random.default_rng(2)
    x, weights, coef = rng.normal(size=(40, 6)), rng.normal(size=(5, 6)), rng.normal(size=6)
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>")
    sets = {"pair": [1, 3, 3], "all": [0, 1, 2, 3, 4], "none": []}
    found = {(r.g, r.name): (r.before, r.after, r["drop"]) for r in controls.ablated_sets(df, "g", "v", weights, coef.tolist(), sets, shift=0.1, bias=0.05, top=2, intercept=0.3).collect()}
    assert len(found) == 9
    for g in range(3):
        a = np.maximum((x[np.arange(40) % 3 == g] - 0.1) @ weights.T + 0.05, 0)
        a[np.arange(len(a))[:, None], np.argsort(-a, axis=1)[:, 2:]] = 0
        prob = lambda codes: 1 / (1 + math.exp(-(0.3 + (codes @ weights + 0.1).mean(axis=0) @ coef)))
        for name, latents in sets.items():
            cut = a.copy()
            cut[:, latents] = 0
            assert np.allclose(found[g, name], (prob(a), prob(cut), prob(a) - prob(cut)))


def test_digests_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, content in {"a/x.bin": b"abc", "y.bin": b"x" * 9, "z.txt": b"no", "empty.bin": b""}.items():
        (tmp_path / name).write_bytes(content)
    found = {(r.name, r.size, r.sha256) for r in tables.file_digests(spark, str(tmp_path), "*.bin").collect()}
    assert found == {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in {"x.bin": b"abc", "y.bin": b"x" * 9}.items()}  # of z.txt and the empty file there are none
