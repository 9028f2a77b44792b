"""Cross-validated penalised logistic models, calibration and exact nearest neighbours.

All folds and penalties are fitted together: each Newton step is one scan whose sums, a gradient and a
Hessian a model, come to the driver. Their size follows the number of features and models, never the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from auditframe.operators import metrics
from auditframe.sources.scratch import drop_saved, saved

#: Features and models beyond which the sums of a step are no longer small.
MOST_SUMS = 1 << 24


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int, large: float = 0.001) -> DataFrame:
    """``group`` and ``fold``: whole groups dealt to folds so that each fold has its share of every class.

    Groups with over ``large`` of all rows, of which there are at most 1 / ``large``, are placed first on the driver, from the largest
    down, each where it leaves the shares of the classes most even. All others are dealt in parallel: the groups of a
    commonest class (ties: the greater label) lie one after another in the order of a keyed hash, as long as they have rows, and this line
    is cut in proportion to what each fold still lacks of the class. Rows without a group are left out.
    """
    counts = saved(df.where(F.col(group).isNotNull()).groupBy(group, F.col(label).alias("__class")).agg(F.count("*").alias("__n")), "group-classes")
    totals = {r["__class"]: r["n"] for r in counts.groupBy("__class").agg(F.sum("__n").alias("n")).collect()}
    rows = sum(totals.values())
    own = counts.groupBy(group).agg(F.sum("__n").alias("__size"), F.max_by("__class", F.struct("__n", "__class")).alias("__class"))
    heavy = own.where(F.col("__size") > rows * large).select(group, "__size")
    parts = counts.join(F.broadcast(heavy), group).collect()
    held = {c: [0] * folds for c in totals}
    placed: dict = {}
    profiles: dict = {}
    for r in parts:
        profiles.setdefault(r[group], {})[r["__class"]] = r["__n"]
    for g, profile in sorted(profiles.items(), key=lambda item: (-sum(item[1].values()), str(item[0]))):
        def uneven(f: int) -> tuple:
            return sum(((held[c][f] + n) ** 2 - held[c][f] ** 2) / totals[c] ** 2 for c, n in profile.items()), sum(held[c][f] for c in totals), f  # noqa: B023

        placed[g] = min(range(folds), key=uneven)
        for c, n in profile.items():
            held[c][placed[g]] += n
    lacking = {c: np.maximum(0, totals[c] - folds * np.array(held[c])) for c in totals}
    ends = df.sparkSession.createDataFrame([(c, [int(v) for v in np.cumsum(d)]) for c, d in lacking.items()], df.select(F.col(label).alias("__class")).schema.add("__ends", ArrayType(LongType())))
    small = own.where(F.col("__size") <= rows * large).withColumn("__key", F.sha2(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")), 256)).withColumn("__stretch", F.substring("__key", 1, 3))
    line = Window.partitionBy("__class", "__stretch").orderBy("__key", group).rowsBetween(Window.unboundedPreceding, -1)
    sizes = small.groupBy("__class", "__stretch").agg(F.sum("__size").alias("__sum"))
    of_class = Window.partitionBy("__class")  # over 4096 stretches at most
    sizes = sizes.select("__class", "__stretch", F.coalesce(F.sum("__sum").over(of_class.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__sum").over(of_class).alias("__all"))
    laid = small.withColumn("__own", F.coalesce(F.sum("__size").over(line), F.lit(0))).join(sizes, ["__class", "__stretch"]).join(F.broadcast(ends), "__class")
    lacks = F.element_at("__ends", -1)
    middle = (2 * (F.col("__own") + F.col("__before")) + F.col("__size")) * lacks / (2.0 * F.col("__all"))
    fold = F.when(lacks > 0, F.least(F.size(F.filter("__ends", lambda e: e <= middle)), F.lit(folds - 1))).otherwise(0)
    out = laid.select(group, fold.cast("int").alias("fold"))
    fixed = df.sparkSession.createDataFrame(list(placed.items()), df.select(group).schema.add("fold", IntegerType()))
    return out.unionByName(fixed)


@dataclass(frozen=True)
class Penalty:
    """Inverse strength ``c`` of the penalty on standardised coefficients; ``kind`` is "l1" or "l2"."""

    kind: str
    c: float

    @property
    def name(self) -> str:
        return f"logistic_{self.kind}_C{self.c}"


def _moments(rows: DataFrame, width: int) -> pd.DataFrame:
    """Rows, means and population variances of each fold and class, in one pass."""
    x = [F.col("x")[i] for i in range(width)]
    return rows.groupBy("fold", "y").agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in x)).alias("m"), F.array(*(F.var_pop(c) for c in x)).alias("v")).toPandas()


def _combined(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Means, scales (1 where constant) and class sizes of some folds together, from centred moments."""
    n = parts["n"].to_numpy(dtype=float)
    m, v = (np.stack(parts[c].to_numpy()).astype(float) for c in "mv")
    mean = (n[:, None] * m).sum(axis=0) / n.sum()
    var = (n[:, None] * (v + (m - mean) ** 2)).sum(axis=0) / n.sum()
    scale = np.where(var > 0, np.sqrt(np.where(var > 0, var, 1)), 1.0)
    return mean, scale, {int(k): float(s) for k, s in parts.groupby("y")["n"].sum().items()}


class _Fit:
    """One model: rows outside ``fold`` (all rows for None), and where its Newton steps stand."""

    def __init__(self, fold, penalty: Penalty, parts: pd.DataFrame, balanced: bool):
        self.fold, self.penalty = fold, penalty
        self.mean, self.scale, sizes = _combined(parts)
        total = sum(sizes.values())
        self.weight = [total / (2 * sizes[k]) if balanced and sizes.get(k) else 1.0 for k in (0, 1)]
        self.usable = len(sizes) == 2
        self.w = np.zeros(len(self.mean) + 1)
        self.before, self.loss, self.done = None, np.inf, not self.usable

    def step(self, loss: float, gradient: np.ndarray, hessian: np.ndarray, tolerance: float) -> None:
        """Take sums at ``w`` and move on; where the loss has grown, go halfway back instead."""
        strength, free = 1 / self.penalty.c, self.w[1:]
        loss += strength * (np.abs(free).sum() if self.penalty.kind == "l1" else 0.5 * free @ free)
        if self.before is not None and loss > self.loss + 1e-9 * (1 + abs(self.loss)):
            self.w = (self.w + self.before) / 2
            return
        self.loss, self.before = loss, self.w
        if self.penalty.kind == "l2":
            ridge = np.r_[0.0, np.full(len(free), strength)]
            move = -np.linalg.lstsq(hessian + np.diag(ridge), gradient + ridge * self.w, rcond=None)[0]
        else:
            move = _lasso_move(self.w, gradient, hessian, strength)
        self.w = self.w + move
        self.done = bool(np.abs(move).max() <= tolerance)

    def raw(self) -> tuple[float, list[float]]:
        coefficients = self.w[1:] / self.scale
        return float(self.w[0] - coefficients @ self.mean), coefficients.tolist()


def _lasso_move(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, strength: float) -> np.ndarray:
    """The step that minimises the quadratic model with an absolute penalty on all but the first coefficient."""
    move = np.zeros_like(w)
    slope = gradient.copy()  # of the quadratic model at ``move``
    for _ in range(1000):
        greatest = 0.0
        for j in range(len(w)):
            curve = max(hessian[j, j], 1e-12)
            wanted = w[j] + move[j] - slope[j] / curve
            if j:
                wanted = np.sign(wanted) * max(abs(wanted) - strength / curve, 0.0)
            change = wanted - w[j] - move[j]
            move[j] += change
            slope += hessian[:, j] * change
            greatest = max(greatest, abs(change))
        if greatest < 1e-12:
            break
    return move


def _sums(rows: DataFrame, fits: list[_Fit]) -> dict[int, np.ndarray]:
    """Loss, gradient and upper Hessian of each model, packed, from one scan."""
    size = len(fits[0].w)
    upper = np.triu_indices(size)
    state = [(f.fold, f.mean, f.scale, f.weight, f.w) for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 + size + len(upper[0])) for _ in state]
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, y, x = (batch.column(c) for c in ("fold", "y", "x"))
            x, y, fold = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), y.to_numpy(zero_copy_only=False).astype(float), fold.to_numpy(zero_copy_only=False)
            for total, (own, mean, scale, weight, w) in zip(totals, state, strict=True):
                use = np.ones(len(y), dtype=bool) if own is None else fold != own
                z = np.c_[np.ones(int(use.sum())), (x[use] - mean) / scale]
                s = np.where(y[use] == 1, weight[1], weight[0])
                eta = z @ w
                p = 0.5 * (1 + np.tanh(eta / 2))
                total[0] += (s * (np.logaddexp(0, eta) - y[use] * eta)).sum()
                total[1 : 1 + size] += z.T @ (s * (p - y[use]))
                total[1 + size :] += ((z * (s * p * (1 - p))[:, None]).T @ z)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(state)), pa.int32()), pa.array([t.tolist() for t in totals], pa.list_(pa.float64()))], ["model", "sums"])

    parts = rows.mapInArrow(run, "model int, sums array<double>").select("model", F.posexplode("sums").alias("place", "value"))
    found = parts.groupBy("model", "place").agg(F.sum("value").alias("value")).toPandas()
    out = {i: np.zeros(1 + size + len(upper[0])) for i in range(len(fits))}
    for model, own in found.groupby("model"):
        out[int(model)][own["place"].to_numpy()] = own["value"].to_numpy()
    return out


def logistic_folds(df: DataFrame, features: list[str], label: str, fold: str | None, penalties: list[Penalty], *, balanced: bool = True, steps: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """fold, candidate, intercept, coefficients (on raw features), steps and converged, for each fold and penalty: fitted
    on the rows of all other folds, or one fit on all rows where ``fold`` is None.

    Features are standardised by the rows of the fit; classes weigh alike if ``balanced``. Rows with a null label, fold
    or feature take no part. A fit whose rows have one class only has null coefficients.
    """
    spark, width = df.sparkSession, len(features)
    x = F.array(*(F.col(f).cast("double") for f in features))
    rows = df.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), F.col(label).cast("int").alias("y"), x.alias("x"))
    rows = saved(rows.where(F.col("y").isin(0, 1) & F.col("fold").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))), "logistic-rows")
    parts = _moments(rows, width)
    own = sorted(parts["fold"].unique().tolist()) if fold else ([None] if len(parts) else [])
    if len(own) * len(penalties) * (width + 2) ** 2 > 2 * MOST_SUMS:
        raise ValueError("too many features, folds and penalties for sums on the driver")
    fits = [_Fit(f, p, parts if f is None else parts[parts["fold"] != f], balanced) for f in own for p in penalties if f is None or (parts["fold"] != f).any()]
    upper, taken = np.triu_indices(width + 1), 0
    while taken < steps and (open_ := [f for f in fits if not f.done]):
        for fit, sums in zip(open_, _sums(rows, open_).values(), strict=True):
            hessian = np.zeros((width + 1, width + 1))
            hessian[upper] = sums[width + 2 :]
            fit.step(float(sums[0]), sums[1 : width + 2], hessian + hessian.T - np.diag(np.diag(hessian)), tolerance)
        taken += 1
    drop_saved(rows)
    data = [(f.fold, f.penalty.name, *(f.raw() if f.usable else (None, None)), taken, f.done and f.usable) for f in fits]
    return spark.createDataFrame(data, "fold int, candidate string, intercept double, coefficients array<double>, steps int, converged boolean")


def probabilities(df: DataFrame, features: list[str], fits: DataFrame, fold: str | None = None) -> DataFrame:
    """``df`` once for each candidate with ``candidate`` and ``probability``: each row by the model that did not see its fold."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    own = fits.select(*([F.col("fold").alias(fold)] if fold else []), "candidate", "intercept", "coefficients")
    joined = df.join(F.broadcast(own), fold) if fold else df.crossJoin(F.broadcast(own))
    eta = F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), F.col("intercept"), lambda total, v: total + v)
    return joined.withColumn("probability", 1 / (1 + F.exp(-eta))).drop("intercept", "coefficients")


def cross_validated(df: DataFrame, features: list[str], label: str, fold: str, penalties: list[Penalty], primary: str = "auroc", measures: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold probabilities, and a report for each candidate: metrics over all rows (``measures``, all if None), and mean and
    population deviation of the ``primary`` metric over the folds. It compares fixed candidates and chooses none."""
    df = saved(df, "cross-validated")
    predicted = saved(probabilities(df, features, logistic_folds(df, features, label, fold, penalties), fold), "out-of-fold")
    drop_saved(df)
    whole = metrics.binary_metrics(predicted, label, "probability", ["candidate"], measures=measures)
    each = metrics.binary_metrics(predicted, label, "probability", ["candidate", fold], measures=[primary])
    spread = each.groupBy("candidate").agg(F.avg(primary).alias("cv_mean"), F.stddev_pop(primary).alias("cv_std"))
    return predicted, whole.join(spread, "candidate")


def platt(df: DataFrame, logit: str, label: str, c: float = 1.0, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept that calibrate ``logit``; the slope has a quadratic penalty of inverse strength ``c``.

    The table is read once, into sums of each distinct logit; each Newton step adds up five sums of those. Rows with a
    null logit or label take no part. Without rows of both classes the slope is 1 and the intercept 0.
    """
    x, y = F.col(logit).cast("double"), F.col(label).cast("double")
    counted = saved(df.where(x.isNotNull() & ~F.isnan(x) & y.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("ones")), "platt")
    n, ones = counted.agg(F.sum("n"), F.sum("ones")).first()
    slope, intercept = (0.0, 0.0) if n and 0 < ones < n else (1.0, 0.0)
    for _ in range(steps if slope == 0.0 else 0):
        eta = slope * F.col("x") + intercept
        p = 1 / (1 + F.exp(-eta))
        off, curve = F.col("n") * p - F.col("ones"), F.col("n") * p * (1 - p)
        g1, g0, h11, h10, h00 = counted.agg(F.sum(off * F.col("x")), F.sum(off), F.sum(curve * F.col("x") ** 2), F.sum(curve * F.col("x")), F.sum(curve)).first()
        move = np.linalg.lstsq(np.array([[h11 + 1 / c, h10], [h10, h00]]), -np.array([g1 + slope / c, g0]), rcond=None)[0]
        slope, intercept = slope + float(move[0]), intercept + float(move[1])
        if np.abs(move).max() < 1e-12:
            break
    drop_saved(counted)
    return slope, intercept


def calibrated(logit: Column, fitted: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(fitted[0] * logit + fitted[1])))


def _dealt(df: DataFrame, unit: str, per_block: int) -> tuple[DataFrame, int]:
    blocks = max(1, -(-df.count() // per_block))
    return df.withColumn("__block", F.pmod(F.xxhash64(unit), F.lit(blocks)).cast("int")), blocks


def maybe_nearest(x: np.ndarray, known: np.ndarray, norms: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of ``x`` the places of ``known`` (squared lengths ``norms``) that can be among its ``k`` nearest: all that products
    put no farther than the k-th, and by as much more as products can round away. All of them, where a number isn't finite."""
    own = (x**2).sum(axis=1)
    near = own[:, None] + norms[None, :] - 2 * (x @ known.T)
    bound = np.partition(near, k - 1, axis=1)[:, k - 1] + 1e-9 * (own + norms.max())
    for row, most in zip(near, bound, strict=True):
        yield np.flatnonzero(row <= most) if np.isfinite(most) else np.arange(len(known))


def nearest_neighbours(queries: DataFrame, known: DataFrame, unit: str, vec: str, label: str, k: int, per_block: int = 4096) -> DataFrame:
    """``unit`` and ``near``: the ``k`` nearest rows of ``known``, nearest first with distance, id and label, ties to the smaller id.

    Both sides are dealt into blocks of about ``per_block`` rows; every block of queries meets every block of known rows in a
    task of its own, which keeps ``k`` a query, and an aggregate merges those. A query is copied as often as there are known blocks,
    a known row as often as there are query blocks. Distances are sums of squared differences; products only choose the few rows that are measured.
    """
    q, q_blocks = _dealt(queries.select(F.col(unit).alias("id"), F.col(vec).alias("v")), "id", per_block)
    t, t_blocks = _dealt(known.select(F.col(unit).alias("id"), F.col(vec).alias("v"), F.col(label).cast("int").alias("label")), "id", per_block)
    q = q.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(t_blocks - 1)), lambda b: b + F.col("__block") * t_blocks)))
    t = t.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(q_blocks - 1)), lambda b: b * t_blocks + F.col("__block"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("id", kind="stable")
            ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
            known_ = np.stack(right["v"].to_numpy()).astype(float)
            x = np.stack(left["v"].to_numpy()).astype(float)
            step = max(1, (1 << 22) // len(ids))
            norms, few = (known_**2).sum(axis=1), min(k, len(ids))
            for at in range(0, len(x), step):
                some = x[at : at + step]
                for i, (unit_, chosen) in enumerate(zip(left["id"].iloc[at : at + step], maybe_nearest(some, known_, norms, few), strict=True)):
                    square = np.zeros(len(chosen))
                    for d in range(x.shape[1]):
                        square += (some[i, d] - known_[chosen, d]) ** 2
                    best = np.argsort(square, kind="stable")[:few]
                    out.append((unit_, np.sqrt(square[best]), ids[chosen[best]], labels[chosen[best]]))
        return pd.DataFrame(out, columns=["id", "distance", "other", "label"])

    kind = queries.schema[unit].dataType.simpleString()
    found = q.groupBy("pair").cogroup(t.groupBy("pair")).applyInPandas(meet, f"id {kind}, distance array<double>, other array<{kind}>, label array<int>")
    best = found.select("id", F.arrays_zip("distance", "other", "label").alias("near")).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.withColumnRenamed("id", unit)


def neighbour_votes(near: DataFrame, unit: str, k: int, weights: str) -> DataFrame:
    """``unit``, ``label`` and ``share``: the weight of each class among the first ``k``; by 1 / distance, where equal vectors
    outweigh all others, or uniform."""
    first = F.slice("near", 1, k)
    exact = F.exists(first, lambda r: r["distance"] == 0)
    w = F.lit(1.0) if weights == "uniform" else F.when(F.col("exact"), (F.col("r.distance") == 0).cast("double")).otherwise(1 / F.col("r.distance"))
    rows = near.select(unit, exact.alias("exact"), F.explode(first).alias("r")).select(unit, F.col("r.label").alias("label"), w.alias("w"))
    sums = rows.groupBy(unit, "label").agg(F.sum("w").alias("w"))
    return sums.select(unit, "label", (F.col("w") / F.sum("w").over(Window.partitionBy(unit))).alias("share"))


@dataclass(frozen=True)
class GaussianBayes:
    """Log shares, means and variances (classes x features) of a fitted model; ``widest`` is the greatest variance of a feature over all rows."""

    classes: list
    log_shares: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    widest: float


def gaussian_bayes(train: DataFrame, vec: str, label: str) -> GaussianBayes:
    """Moments of each class and feature from one scan; Spark's variances are taken about the means, so that far from zero no digits go.

    Rows without a label or vector don't count; all vectors have one length. What reaches the driver has the size of classes x features.
    """
    rows = train.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(F.col(label).alias("c"), F.col(vec).cast("array<double>").alias("v"))
    long = rows.select("c", F.posexplode("v").alias("d", "x"))
    found = long.groupBy("c", "d").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s")).limit(MOST_SUMS + 1).toPandas()
    if len(found) > MOST_SUMS:
        raise ValueError("too many classes and features")
    if not len(found):
        raise ValueError("no rows to fit")
    n, m, s = (found.pivot(index="c", columns="d", values=x) for x in ("n", "m", "s"))
    if n.isna().any(axis=None) or (n.nunique(axis=1) > 1).any():
        raise ValueError("vectors differ in length")
    sizes = n.to_numpy(dtype=float)[:, 0]
    share, means, variances = sizes / sizes.sum(), m.to_numpy(dtype=float), s.to_numpy(dtype=float)
    centre = share @ means
    return GaussianBayes(list(n.index), np.log(share), means, variances, float((share @ (variances + (means - centre) ** 2)).max()))


def bayes_classes(df: DataFrame, key: str, vec: str, model: GaussianBayes, smoothings: list[float]) -> DataFrame:
    """``key``, ``smoothing``, ``predicted`` class (ties: the first) and its probability ``p``, for each smoothing in one pass.

    A smoothing is the part of the widest variance that is added to all variances. Rows without a vector are left out; one that isn't as long as
    the model's is an error.
    """
    kind = df.schema[key].dataType.simpleString()
    names = "long" if isinstance(model.classes[0], (int, np.integer)) else "string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024]
                x = np.stack(part["v"].to_numpy())
                off = (x[:, None, :] - model.means) ** 2
                for smoothing in smoothings:
                    v = model.variances + smoothing * model.widest
                    scores = model.log_shares - 0.5 * (np.log(2 * np.pi * v).sum(axis=1) + (off / v).sum(axis=2))
                    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
                    best = scores.argmax(axis=1)
                    yield pd.DataFrame({key: part[key].to_numpy(), "smoothing": smoothing, "predicted": [model.classes[i] for i in best], "p": 1.0 / scores.sum(axis=1)})

    rows = df.where(F.col(vec).isNotNull()).select(key, F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, f"`{key}` {kind}, smoothing double, predicted {names}, p double")
