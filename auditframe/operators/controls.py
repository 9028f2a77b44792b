"""Controls, balance gates, encodings and descriptors around chosen units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.operators.causal import assignment
from auditframe.operators.inference import smd


def balance(before: DataFrame, after: DataFrame, keys: list[str], label: str, value: str, gate: float) -> DataFrame:
    """Standardised mean difference of each covariate before and after, and whether it passes after.

    A covariate without rows of both classes afterwards doesn't pass.
    """
    a, b = (smd(df, keys, label, value).select(*keys, F.col("smd").alias(n)) for df, n in ((before, "before"), (after, "after")))
    return a.join(b, keys, "left").withColumn("passes", F.coalesce(F.abs("after") <= gate, F.lit(False)))


def matched_draws(df: DataFrame, group: str, pos: str, letter: str, chosen: str, unit: str, radius: int, seed: int) -> DataFrame:
    """``chosen_id`` and ``control_id``: a position of the group with the same letter, more than ``radius``
    from every chosen one, drawn by hash without replacement; null where none is left.

    Positions near a chosen one are named one by one and removed by an anti join.
    """
    near = df.where(chosen).select(group, F.explode(F.sequence(F.col(pos) - radius, F.col(pos) + radius)).alias(pos)).distinct()
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(unit).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(group, letter).orderBy(order, unit))
    free = df.where(~F.col(chosen)).join(near, [group, pos], "left_anti").select(group, letter, F.col(unit).alias("control_id"), turn.alias("turn"))
    wanted = df.where(chosen).select(group, letter, F.col(unit).alias("chosen_id"), turn.alias("turn"))
    return wanted.join(free, [group, letter, "turn"], "left").select("chosen_id", "control_id")


def matched_features(a: DataFrame, b: DataFrame, keys: list[str], least: float) -> DataFrame:
    """``left``, ``right``, ``cosine``: features of two models over the same rows in a matching of greatest
    total cosine; pairs below ``least`` go. A row yields its active features' products alone.

    The driver solves the matching; features are columns of a model, so they are few (checked: 4096).
    """
    norms = {}
    for side, df in (("left", a), ("right", b)):
        found = df.groupBy(F.col("feature").alias(side)).agg(F.sqrt(F.sum(F.col("activation").cast("double") ** 2)).alias("norm")).limit(4097).collect()
        if len(found) > 4096:
            raise ValueError("more than 4096 features on one side")
        norms[side] = {r[side]: r["norm"] for r in found}
    left, right = (df.select(*keys, F.col("feature").alias(s), F.col("activation").cast("double").alias(f"x_{s}")) for s, df in (("left", a), ("right", b)))
    dots = left.join(right, keys).groupBy("left", "right").agg(F.sum(F.col("x_left") * F.col("x_right")).alias("dot")).collect()
    rows, columns = sorted(norms["left"]), sorted(norms["right"])
    cosine = np.zeros((len(rows), len(columns)))
    at, to = ({f: i for i, f in enumerate(x)} for x in (rows, columns))
    for r in dots:
        cosine[at[r["left"]], to[r["right"]]] = r["dot"] / (norms["left"][r["left"]] * norms["right"][r["right"]] or 1.0)
    turned = len(rows) > len(columns)
    best = assignment(-(cosine.T if turned else cosine)) if cosine.size else []
    pairs = [(int(j), i) if turned else (i, int(j)) for i, j in enumerate(best)]
    found = [(int(rows[i]), int(columns[j]), float(cosine[i, j])) for i, j in pairs if cosine[i, j] >= least]
    return a.sparkSession.createDataFrame(found, "left long, right long, cosine double")


def _codes(x: np.ndarray, weights: np.ndarray, shift: float, bias: float, top: int) -> np.ndarray:
    """Rectified codes with all but the ``top`` greatest of each row at zero; ties to the first."""
    a = np.maximum((x - shift) @ weights.T + bias, 0)
    order = np.argsort(-np.round(a, 9), axis=1, kind="stable")[:, top:]
    np.put_along_axis(a, order, 0.0, axis=1)
    return a


def _matrix(batch: pd.DataFrame, vec: str) -> np.ndarray:
    return np.stack(batch[vec].to_numpy()).astype(float)


def encoded(vectors: DataFrame, keys: list[str], vec: str, weights: np.ndarray, *, shift: float, bias: float, top: int) -> DataFrame:
    """``keys``, number of active latents and mean squared error of each vector's decoding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch, vec)
                a = _codes(x, weights, shift, bias, top)
                yield batch[keys].assign(active=(a > 0).sum(axis=1), mse=((x - a @ weights - shift) ** 2).mean(axis=1))

    schema = ", ".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in keys)
    return vectors.select(*keys, vec).mapInPandas(run, schema + ", active long, mse double")


def ablated(vectors: DataFrame, group: str, vec: str, weights: np.ndarray, coefficients: list[float], *, shift: float, bias: float, top: int) -> DataFrame:
    """``group``, ``latent`` and ``score_drop`` for each latent that is active in the group.

    Decoding, pooling by the mean and scoring are linear, so a latent's share of the score is its mean
    activation times the score of its weights: tasks sum activations, nothing is decoded.
    """
    worth = weights @ np.asarray(coefficients)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a = _codes(_matrix(batch, vec), weights, shift, bias, top)
                row, latent = np.nonzero(a)
                yield pd.DataFrame({group: batch[group].to_numpy()[row], "latent": latent, "a": a[row, latent]}).groupby([group, "latent"], as_index=False).sum()

    kind = vectors.schema[group].dataType.simpleString()
    sums = vectors.select(group, vec).mapInPandas(run, f"`{group}` {kind}, latent int, a double").groupBy(group, "latent").agg(F.sum("a").alias("a"))
    sizes = vectors.groupBy(group).agg(F.count("*").alias("n"))
    value = F.element_at(F.lit(worth.tolist()), F.col("latent") + 1)
    return sums.join(sizes, group).select(group, F.col("latent").cast("long").alias("latent"), (value * F.col("a") / F.col("n")).alias("score_drop"))


def ablated_sets(vectors: DataFrame, group: str, vec: str, weights: np.ndarray, coefficients: list[float], sets: dict[str, list[int]], *, shift: float, bias: float, top: int, intercept: float = 0.0) -> DataFrame:
    """``group``, ``name``, ``before``, ``after`` and ``drop`` of the probability of a group's pooled decoding when a set of latents is taken out together.

    The score is linear in the latents, so a set's share is the sum of its latents' shares, and all sets come from one pass over the vectors;
    only the probability isn't linear. A set without active latents changes nothing; a latent named twice in a set counts once.
    """
    if not sets:
        raise ValueError("no sets of latents")
    single = ablated(vectors, group, vec, weights, coefficients, shift=shift, bias=bias, top=top)
    members = {n: F.lit(sorted(set(latents))).cast("array<long>") for n, latents in sets.items()}
    base = intercept + shift * float(np.sum(coefficients))
    shares = [F.sum(F.when(F.array_contains(m, F.col("latent")), F.col("score_drop")).otherwise(0.0)).alias(f"__{i}") for i, m in enumerate(members.values())]
    sums = single.groupBy(group).agg(F.sum("score_drop").alias("__all"), *shares)
    sums = vectors.select(group).distinct().join(sums, group, "left").fillna(0.0, ["__all", *(f"__{i}" for i in range(len(sets)))])
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"__{i}").alias("share")) for i, n in enumerate(members)))).alias("s")
    logistic = lambda x: 1 / (1 + F.exp(-x))
    out = sums.select(group, (F.col("__all") + base).alias("__score"), each).select(group, "s.name", logistic(F.col("__score")).alias("before"), logistic(F.col("__score") - F.col("s.share")).alias("after"))
    return out.withColumn("drop", F.col("before") - F.col("after"))


def unscaled(model: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coefficients (``dim``, ``coef``) for raw values from those for standardised ones (``dim``, ``mean``,
    ``scale``, ``coef``), and the ``shift`` that the intercept loses. A scale of zero counts as one."""
    raw = model.select("dim", "mean", (F.col("coef") / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)).alias("coef"))
    return raw.select("dim", "coef"), raw.agg(F.sum(F.col("coef") * F.col("mean")).alias("shift"))


def geometry(points: DataFrame, group: str, order: str, axes: list[str]) -> DataFrame:
    """Number of points, gyration radius, relative shape anisotropy and distance between the ends.

    The anisotropy is 1 - 3 I / T**2 with the gyration tensor's trace T and the sum I of its principal
    minors, so no eigenvalues are needed; 0 where all points coincide.
    """
    tensor = {(i, j): F.covar_pop(axes[i], axes[j]) for i in range(3) for j in range(i, 3)}
    ends = [F.max_by(c, order) - F.min_by(c, order) for c in axes]
    stats = points.groupBy(group).agg(F.count("*").alias("n"), *(c.alias(f"t{i}{j}") for (i, j), c in tensor.items()), F.sqrt(sum((e * e for e in ends), F.lit(0.0))).alias("end_to_end"))
    t = lambda i, j: F.col(f"t{i}{j}")
    trace = t(0, 0) + t(1, 1) + t(2, 2)
    minors = t(0, 0) * t(1, 1) + t(1, 1) * t(2, 2) + t(0, 0) * t(2, 2) - t(0, 1) * t(0, 1) - t(0, 2) * t(0, 2) - t(1, 2) * t(1, 2)
    return stats.select(group, "n", F.sqrt(trace).alias("radius"), F.when(trace > 0, 1 - 3 * minors / F.when(trace > 0, trace * trace)).otherwise(0.0).alias("anisotropy"), "end_to_end")
