"""Covariate adjustment: propensity, matching in bins, pruning for balance, residuals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.operators.ranks import cumulated
from auditframe.sources.scratch import saved

#: Tasks that the stretches of a matching are dealt to.
MOST_TASKS = 2000

def propensity(df: DataFrame, label: str, covariates: list[str], train) -> DataFrame:
    """``df`` with the clipped logit of label 1 from a balanced logistic model of standardised
    covariates, fitted on training rows, and ``bin`` by its training vigintiles."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = VectorAssembler(inputCols=covariates, outputCol="raw").transform(df)
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(made.where(train)).transform(made)
    shares = scaled.where(train).groupBy(label).count().collect()
    total = sum(r["count"] for r in shares)
    weight = F.lit(1.0)
    for r in shares:
        weight = F.when(F.col(label) == r[label], total / (2 * r["count"])).otherwise(weight)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", regParam=1 / total, maxIter=200).fit(scaled.withColumn("weight", weight).where(train))
    p = F.greatest(F.least(vector_to_array(F.col("probability"))[1], F.lit(1 - 1e-6)), F.lit(1e-6))
    scored = model.transform(scaled).withColumn("logit", F.ln(p / (1 - p)))
    edges = scored.where(train).select(F.percentile("logit", [i / 20 for i in range(21)])).first()[0]
    inner = sorted(set(edges))[1:-1]
    place = F.size(F.filter(F.lit(inner) if inner else F.array().cast("array<double>"), lambda e: e <= F.col("logit")))
    return scored.select(*df.columns, "logit", place.alias("bin"), vector_to_array("scaled").alias("z"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment; no more rows than columns.

    Shortest augmenting paths with potentials: a row after the other is matched over reduced costs.
    """
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        distance, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, reached, at = i, 0.0, -1
        while True:
            open_ = ~done
            reduced = reached + cost[row] - u[row] - v
            better = open_ & (reduced < distance)
            distance[better], back[better] = reduced[better], at
            nxt = int(np.where(open_, distance, np.inf).argmin())
            reached, at = distance[nxt], nxt
            done[nxt] = True
            if row_of[nxt] < 0:
                break
            row = row_of[nxt]
        closed = done & (distance < reached)
        u[i] += reached
        u[row_of[closed]] += reached - distance[closed]
        v[closed] -= reached - distance[closed]
        while at >= 0:
            before = back[at]
            row_of[at] = i if before < 0 else row_of[before]
            at = before
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def matched_pairs(df: DataFrame, keys: list[str], unit: str, label: str, caliper: float, stretch: int = 2000) -> DataFrame:
    """One-to-one pairs of the classes within each group of ``keys``, cheapest by the distance of ``z``;
    pairs whose logits differ by more than ``caliper`` go.

    An assignment costs the cube of its rows, so groups are solved in stretches of about ``stretch`` rows
    along the logit. What a stretch leaves over, for want of the other class or beyond the caliper, is
    assigned again in stretches that are shifted by half, so a cut parts no pair for good. A group of up
    to ``stretch`` rows is solved whole in the first round. Rows without a logit have no partner.
    """

    def match(group: pd.DataFrame) -> pd.DataFrame:
        zero, one = (group[group[label] == c].sort_values(["logit", unit]) for c in (0, 1))
        small, large = (zero, one) if len(zero) <= len(one) else (one, zero)
        if not len(small):
            return pd.DataFrame({"zero": [], "one": [], "distance": []})
        a, b = np.stack(small["z"].to_numpy()), np.stack(large["z"].to_numpy())
        cost = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))
        other = large.iloc[assignment(cost)]
        out = pd.DataFrame({"s": small[unit].to_numpy(), "l": other[unit].to_numpy(), "distance": np.abs(small["logit"].to_numpy() - other["logit"].to_numpy())})
        out = out.rename(columns={"s": "zero", "l": "one"} if small is zero else {"s": "one", "l": "zero"})
        return out[out["distance"] <= caliper][["zero", "one", "distance"]]

    kind = df.schema[unit].dataType.simpleString()
    schema = f"zero {kind}, one {kind}, distance double"
    # A row's half-stretch follows from its place in the group, so stretches keep their size in groups of any
    # size; equal logits are spread by a hash of the unit.
    placed = cumulated(df.where(F.col("logit").isNotNull()).withColumn("n", F.lit(1)), "logit", ["n"], keys)
    sizes = placed.groupBy(*keys).agg(F.sum("n").alias("size")).select(*(F.col(k).alias(f"__{k}") for k in keys), "size")
    same = lambda other, names: [F.col(k).eqNullSafe(other[f"__{k}"]) for k in names]
    edges = placed.join(sizes, same(sizes, keys)).select(*(F.col(k).alias(f"__{k}") for k in (*keys, "logit")), F.col("n").alias("__n"), (F.col("cum_n") - F.col("n")).alias("__before"), F.col("size").alias("__size"))
    turn = F.col("__before") + F.pmod(F.xxhash64(unit), F.col("__n"))
    half = F.floor(turn * (2 * F.ceil(F.col("__size") / stretch)) / F.col("__size"))
    rows = df.join(edges, same(edges, (*keys, "logit"))).withColumn("half", half).select(*keys, unit, label, "logit", "z", "half")
    rows = saved(rows, "placed")
    # Stretches have few bytes and much work: a number of tasks of their own keeps Spark from packing them into one.
    groups = rows.select(*keys, F.floor(F.col("half") / 2)).distinct().count()
    tasks = min(max(groups, 1), MOST_TASKS)
    solved = lambda part: part.repartition(tasks, *keys, "part").groupBy(*keys, "part").applyInPandas(match, schema)
    first = saved(solved(rows.withColumn("part", F.floor(F.col("half") / 2))), "matches")
    taken = first.select(F.explode(F.array("zero", "one")).alias(unit))
    left = rows.join(taken, unit, "left_anti").withColumn("part", F.floor((F.col("half") + 1) / 2))
    return first.unionByName(saved(solved(left), "matches"))


class Balance:
    """Sums of both sides of the pairs that are left, and the imbalance they make."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums  # sides x powers x columns

    def worst(self, n, sums) -> np.ndarray:
        """Greatest absolute standardised mean difference, for one or many sets of sums."""
        mean = sums[..., 0, :] / n
        spread = np.maximum(sums[..., 1, :] / n - mean**2, 0).mean(axis=-2)
        gap = np.abs(mean[..., 0, :] - mean[..., 1, :])
        return np.where(spread > 1e-15, gap / np.sqrt(np.maximum(spread, 1e-15)), 0.0).max(axis=-1)

    def now(self) -> float:
        return float(self.worst(self.n, self.sums))

    def without(self, own: np.ndarray) -> np.ndarray:
        """The imbalance after the removal of each of these pairs alone."""
        return self.worst(self.n - 1, self.sums[None] - own)

    def remove(self, own: np.ndarray) -> None:
        self.n, self.sums = self.n - 1, self.sums - own


def pruned_pairs(pairs: DataFrame, values: DataFrame, unit: str, columns: list[str], target: float = 0.10, least_share: float = 0.4, hand: int = 2000) -> DataFrame:
    """Pairs left when those that drive imbalance are removed one at a time.

    A pair goes if that lowers the greatest absolute standardised difference of all pairs most, until
    ``target`` is reached, nothing is gained or only ``least_share`` of the pairs are left. Each round Spark
    ranks all pairs by the imbalance that their removal leaves, from sums over all of them; the first
    ``hand`` come to the driver, which removes up to half of them, each time the best of the hand by
    updated sums. Up to ``hand`` pairs this is the whole greedy choice; beyond, a pair outside the hand
    waits for the next round.
    """
    names = pairs.columns
    side = {c: values.select(F.col(unit).alias(c), F.array(*(F.col(x).cast("double") for x in columns)).alias(f"x_{c}")) for c in ("zero", "one")}
    rows = pairs.join(side["zero"], "zero").join(side["one"], "one")
    rows = saved(rows, "pairs")
    k = len(columns)
    at = [(c, p, i) for c in ("one", "zero") for p in (1, 2) for i in range(k)]
    value = lambda c, p, i: F.pow(F.col(f"x_{c}")[i], p)
    found = rows.agg(F.count("*").alias("n"), *(F.sum(value(*a)).alias(f"s{j}") for j, a in enumerate(at))).first()
    if not found["n"]:
        return pairs
    state = Balance(found["n"], np.array([found[f"s{j}"] for j in range(len(at))], dtype=float).reshape(2, 2, k))
    floor, gone = max(2, math.ceil(found["n"] * least_share)), []
    live = rows
    while state.n > floor and state.now() > target:
        n = float(state.n - 1)
        sums = {a: F.lit(float(s)) - value(*a) for a, s in zip(at, state.sums.ravel(), strict=True)}
        imbalance = []
        for i in range(k):
            mean = {c: sums[c, 1, i] / n for c in ("one", "zero")}
            spread = sum(F.greatest(sums[c, 2, i] / n - mean[c] * mean[c], F.lit(0.0)) for c in mean) / 2
            imbalance.append(F.when(spread > 1e-15, F.abs(mean["one"] - mean["zero"]) / F.sqrt(F.greatest(spread, F.lit(1e-15)))).otherwise(0.0))
        after = F.greatest(*imbalance) if k > 1 else imbalance[0]
        best = live.orderBy(after, "zero", "one").limit(hand).collect()
        own = np.array([[[np.power(r[f"x_{c}"], p) for p in (1, 2)] for c in ("one", "zero")] for r in best], dtype=float)
        open_, removed = np.ones(len(best), dtype=bool), []
        whole = len(best) == state.n
        while state.n > floor and state.now() > target and open_.any() and (whole or 2 * len(removed) < len(best)):
            left = np.where(open_, state.without(own), np.inf)
            first = int(left.argmin())
            if left[first] >= state.now() - 1e-9:
                break
            state.remove(own[first])
            open_[first] = False
            removed.append((best[first]["zero"], best[first]["one"]))
        if not removed:
            break
        gone += removed
        taken = pairs.sparkSession.createDataFrame(removed, ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("zero", "one")))
        live = live.join(taken, ["zero", "one"], "left_anti")
        if whole:
            break
        live = saved(live, "pairs")
    return live.select(*names)


def residuals(df: DataFrame, unit: str, covariates: list[str], outputs: DataFrame, train) -> DataFrame:
    """Outputs (``unit``, dim, x) less their least-squares fit on an intercept and standardised
    covariates; the fit is from training rows, by normal equations summed in Spark.

    The design may be collinear: the minimum-norm solution is taken.
    """
    stats = df.where(train).agg(*(F.avg(c).alias(f"m_{c}") for c in covariates), *(F.stddev_pop(c).alias(f"s_{c}") for c in covariates)).first()
    z = [F.lit(1.0), *((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in covariates)]
    design = df.select(unit, F.expr(train).alias("fit") if isinstance(train, str) else train.alias("fit"), F.array(*z).alias("z"))
    k = len(z)
    gram = design.where("fit").agg(*(F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k))).first()
    matrix = np.array([[gram[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    moments = outputs.join(design.where("fit"), unit).groupBy("dim").agg(*(F.sum(F.col("x") * F.col("z")[i]).alias(f"b{i}") for i in range(k)))
    inverse = np.linalg.pinv(matrix)
    weights = moments.select("dim", F.array(*(sum((F.col(f"b{j}") * float(inverse[i, j]) for j in range(k)), F.lit(0.0)) for i in range(k))).alias("beta"))
    fitted = F.aggregate(F.zip_with("z", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return outputs.join(design, unit).join(weights, "dim").select(unit, "dim", "fit", (F.col("x") - fitted).alias("residual"))
