"""Paired tests, resampling and tails of distributions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.operators.ranks import average_ranks, benjamini_hochberg

def sign_flip_exact(df: DataFrame, keys: list[str], difference: str, unit: str, *, plus_one: bool = False, tolerance: float = 0.0) -> DataFrame:
    """Exact two-sided sign-flip p-value of the mean difference of each group of at most 20 units.

    Every sign pattern is a row of its group, so the work is shared out over tasks. ``plus_one`` counts
    the observed pattern once more. Groups of more units give a null; use ``sign_flip_sampled``.
    """
    gathered = df.where(F.col(difference).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(unit, difference))).alias("d"), F.count("*").alias("n"))
    values = F.transform("d", lambda x: x[difference])
    observed = F.abs(F.aggregate(values, F.lit(0.0), lambda a, x: a + x))
    patterns = gathered.where(F.col("n") <= 20).select(*keys, "n", values.alias("v"), observed.alias("observed"), F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.col("n")).cast("long") - 1)).alias("mask"))
    flipped = F.abs(F.aggregate(F.transform("v", lambda x, i: F.when(F.shiftright(F.col("mask"), 0).bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x))
    hits = F.sum(F.when(flipped >= F.col("observed") - tolerance, 1).otherwise(0))
    add = 1 if plus_one else 0
    tested = patterns.groupBy(*keys).agg(((hits + add) / (F.count("*") + add)).alias("p"))
    means = gathered.select(*keys, "n", (F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("mean_difference"))
    return means.join(tested, keys, "left")


def sign_flip_sampled(df: DataFrame, keys: list[str], difference: str, unit: str, draws: int = 100_000, block: int = 10_000, seed: int = 0) -> DataFrame:
    """(k + 1) / (draws + 1) over random sign patterns, drawn in seeded blocks that tasks share."""
    gathered = df.where(F.col(difference).isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(unit, difference))), lambda x: x[difference]).alias("v"))
    blocks = gathered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(draws / block) - 1))))

    def run(batches):
        for batch in batches:
            hits = []
            for v, b in zip(batch["v"], batch["block"], strict=True):
                v = np.asarray(v, dtype=float)
                rng = np.random.default_rng([seed, int(b)])
                n = min(block, draws - int(b) * block)
                null = (rng.integers(0, 2, (n, len(v))) * 2 - 1) @ v
                hits.append(int((np.abs(null) >= abs(v.sum())).sum()))
            yield batch[keys].assign(hits=hits)

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    done = blocks.repartition(*keys, "block").select(*keys, "v", "block").mapInPandas(run, schema + ", hits long")
    return done.groupBy(*keys).agg(((F.sum("hits") + 1) / (draws + 1)).alias("p"))


def sign_flip_test(df: DataFrame, keys: list[str], difference: str, unit: str, *, most_exact: int = 20, draws: int = 100_000, seed: int = 0) -> DataFrame:
    """``keys``, n, mean_difference and p: exact for groups of up to ``most_exact`` units (20 at most), sampled
    for larger ones."""
    usable = df.where(F.col(difference).isNotNull())
    sizes = usable.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(difference).alias("mean_difference"))
    small = usable.join(sizes.where(F.col("n") <= min(20, most_exact)).select(*keys), keys, "left_semi")
    large = usable.join(sizes.where(F.col("n") > min(20, most_exact)).select(*keys), keys, "left_semi")
    p = sign_flip_exact(small, keys, difference, unit, tolerance=1e-12).select(*keys, "p")
    return sizes.join(p.unionByName(sign_flip_sampled(large, keys, difference, unit, draws=draws, seed=seed).select(*keys, "p")), keys)


def paired_views(metrics: DataFrame, unit: str, view: str, value: str, baseline: str, views: list[str]) -> DataFrame:
    """Difference of each view from a baseline, paired by ``unit``: exact test and joint adjustment."""
    wide = metrics.groupBy(unit).pivot(view, [baseline, *views]).agg(F.first(value))
    long = wide.select(unit, F.explode(F.array(*(F.struct(F.lit(v).alias("view"), (F.col(v) - F.col(baseline)).alias("difference")) for v in views))).alias("x")).select(unit, "x.*")
    return benjamini_hochberg(sign_flip_test(long, ["view"], "difference", unit), "p")


def paired_table(differences: DataFrame, keys: list[str], metric: str, unit: str, difference: str) -> DataFrame:
    """Sign-flip test over units for each of ``keys`` and metric, exact up to 20 units, adjusted within each metric."""
    tested = sign_flip_test(differences, [*keys, metric], difference, unit)
    return benjamini_hochberg(tested, "p", [metric])


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction on the side where it converges."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Steed's form, evaluated from the far end with enough terms for double precision.
    terms = 200 + int(5 * math.sqrt(max(a, b)))
    value = 0.0
    for n in range(terms, 0, -1):
        m = n // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if n % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = d / (1 + value)
    return front / (1 + value)


def pearson_tail(r, n):
    """Two-sided p-value of a correlation over n rows from Student's t; null below three rows.

    A correlation of one counts as 1 - 1e-15.
    """

    @F.pandas_udf("double")
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        def tail(r, n):
            if pd.isna(r) or pd.isna(n) or n < 3:
                return math.nan
            r = min(abs(r), 1 - 1e-15)
            return beta_tail((n - 2) / 2, 0.5, 1 - r * r)

        return pd.Series([tail(a, b) for a, b in zip(r, n, strict=True)], dtype=float)

    return run(r, n)


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: no group is gathered.

    Each row gets ``draws`` Poisson weights, seeded by its own hash; a task sums them for its rows and
    the sums of tasks are added. Groups whose weights are all zero in a draw skip that draw.
    """

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            weights = np.stack([np.random.default_rng([seed, int(h)]).poisson(1.0, draws) for h in batch["h"]])
            x = batch["x"].to_numpy(dtype=float)
            for key, own in batch.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "w": [weights[own].sum(axis=0).astype(float)], "wx": [x[own] @ weights[own]]})

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"), F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)).alias("h"))
    parts = rows.mapInPandas(run, types + ", w array<double>, wx array<double>")
    each = parts.select(*keys, F.posexplode(F.arrays_zip("w", "wx")).alias("draw", "s")).groupBy(*keys, "draw").agg(F.sum("s.w").alias("w"), F.sum("s.wx").alias("wx"))
    means = each.where("w > 0").select(*keys, (F.col("wx") / F.col("w")).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: by its series below a + 1, else a fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    # Lentz's evaluation of the continued fraction.
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * out


#: Up to so many rows of the smaller class, and so many values of U, the distribution of U is counted.
EXACT_SIDE, EXACT_VALUES = 8, 1 << 24


@lru_cache(maxsize=256)
def u_upper(small: int, large: int) -> np.ndarray:
    """P(U >= u) for each u, of two samples without ties.

    The orders of the samples with each U are counted by the Gaussian binomial: the product over i of
    (1 - q**(large + i)) / (1 - q**i), one factor after another. All features of equal sizes share the table.
    """
    counts = np.zeros(small * large + 1)
    counts[0] = 1.0
    for i in range(1, small + 1):
        raised = counts.copy()
        raised[large + i :] -= counts[: -(large + i)] if large + i < len(counts) else 0
        for offset in range(i):  # dividing by 1 - q**i sums every i-th number
            raised[offset::i] = np.cumsum(raised[offset::i])
        counts = raised / (large + i) * i  # kept as shares: the binomial grows by (large + i) / i
    return np.minimum(1.0, np.cumsum(counts[::-1])[::-1])


def u_tail(n1: int, n0: int, u: float) -> float:
    """Exact two-sided p-value of U for samples without ties."""
    upper = u_upper(min(n1, n0), max(n1, n0))
    return float(min(1.0, 2 * upper[round(max(u, n1 * n0 - u))]))


def rank_biserial(df: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """Mann-Whitney U of label 1 over 0, rank-biserial correlation and two-sided p-value.

    The p-value is exact where the smaller class has at most ``EXACT_SIDE`` rows and no values are equal (``exact``), else normal with correction for
    ties and continuity. A constant feature has p = 1 and correlation 0.
    """
    ranks = average_ranks(df.select(*keys, value), value, keys)
    each = df.groupBy(*keys, value).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("ones"))
    n = F.col("n").cast("double")
    sums = ranks.join(each, [*keys, value]).groupBy(*keys).agg(F.sum(F.col("ones") * F.col("rank")).alias("r"), F.sum("ones").alias("n1"), F.sum("n").alias("size"), F.sum(n * n * n - n).alias("ties"))
    n1, n0, size = F.col("n1").cast("double"), (F.col("size") - F.col("n1")).cast("double"), F.col("size").cast("double")
    u = F.col("r") - n1 * (n1 + 1) / 2
    sums = sums.where((n1 > 0) & (n0 > 0)).select(*keys, "n1", n0.cast("long").alias("n0"), u.alias("u"), (2 * u / (n1 * n0) - 1).alias("rank_biserial"), F.col("ties"), (n1 * n0 / 12 * (size + 1 - F.col("ties") / (size * (size - 1)))).alias("variance"))
    z = F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n0") / 2) - 0.5, F.lit(0.0)) / F.sqrt(F.when(F.col("variance") > 0, F.col("variance")))
    exact = (F.least("n1", "n0") <= EXACT_SIDE) & (F.col("ties") == 0) & (F.col("n1").cast("double") * F.col("n0") <= EXACT_VALUES)

    def tails(batches):
        for batch in batches:
            normal = batch["z"].map(normal_tail, na_action="ignore").astype(float).fillna(1.0)
            own = [u_tail(int(n1), int(n0), u) if e else p for n1, n0, u, e, p in zip(batch["n1"], batch["n0"], batch["u"], batch["exact"], normal, strict=True)]
            yield batch.assign(p=np.array(own, dtype=float)).drop(columns="z")

    done = sums.withColumn("z", z).withColumn("exact", exact).drop("variance", "ties")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema if f.name != "z")
    return done.mapInPandas(tails, schema + ", p double")


def kruskal(df: DataFrame, value: str, group: str, least: int = 5) -> DataFrame:
    """Kruskal-Wallis H with tie correction, its chi-squared p-value and eta squared.

    Groups of fewer than ``least`` members and the group "unknown" are left out. Constant values, or a
    single group, give null or NaN.
    """
    sizes = df.groupBy(group).count().where((F.col("count") >= least) & (F.col(group).cast("string") != "unknown"))
    own = df.join(sizes.select(group), group, "left_semi")
    ranks = average_ranks(own.select(value), value)
    each = own.join(ranks, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.avg(value).alias("m"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    n = F.col("n").cast("double")
    ties = ranks.agg(F.sum(n * n * n - n).alias("ties"))
    total = each.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("r"), F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(n * F.col("m") * F.col("m")).alias("between"), F.sum(n * F.col("m")).alias("s"), F.sum("ss").alias("ss")).crossJoin(F.broadcast(ties))
    h = F.try_divide(F.try_divide(12 * F.col("r"), n * (n + 1)) - 3 * (n + 1), 1 - F.try_divide(F.col("ties"), n * n * n - n))
    center = F.try_divide(F.col("s") * F.col("s"), n)

    @F.pandas_udf("double")
    def tail(h: pd.Series, groups: pd.Series) -> pd.Series:
        return pd.Series([math.nan if pd.isna(x) or g < 2 else gamma_tail((g - 1) / 2, x / 2) for x, g in zip(h, groups, strict=True)])

    return total.select("groups", "n", h.alias("h"), tail(h, "groups").alias("p"), F.try_divide(F.col("between") - center, F.col("ss") - center).alias("eta_squared"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks; null for constants and fewer than three rows."""
    keys = keys or []
    rx, ry = (average_ranks(df.select(*keys, c), c, keys).select(*keys, c, F.col("rank").alias(f"r_{c}")) for c in (x, y))
    ranked = df.select(*keys, x, y).join(rx, [*keys, x]).join(ry, [*keys, y])
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (F.count("*") < 3)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(constant, None).otherwise(F.corr(f"r_{x}", f"r_{y}")).alias("rho"))


@lru_cache(maxsize=4096)
def t_975(freedom: int) -> float:
    """The point that Student's t exceeds in 2.5 % of cases, by bisection."""
    low, high = 0.0, 20.0
    for _ in range(80):
        t = (low + high) / 2
        low, high = (t, high) if beta_tail(freedom / 2, 0.5, freedom / (freedom + t * t)) > 0.05 else (low, t)
    return (low + high) / 2


def t_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and half-width of the 95 % Student interval over any number of repetitions; null for one."""
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))

    @F.pandas_udf("double")
    def points(n: pd.Series) -> pd.Series:
        return n.map(lambda k: t_975(int(k) - 1) if k > 1 else math.nan).astype(float)

    t = points("n")
    return stats.withColumn("half_width", F.when(F.col("n") > 1, t * F.col("sd") / F.sqrt("n"))).drop("sd")


def leave_one_out_smd(df: DataFrame, keys: list[str], unit: str, label: str, value: str) -> DataFrame:
    """Standardised mean difference of the group without each unit, from the group's totals.

    Population variances; 0 where the pooled variance is 0. Null if a class would be empty.
    """
    x = F.col(value).cast("double")
    sums = [f(F.when(F.col(label) == c, y)).alias(f"{n}{c}") for c in (0, 1) for n, f, y in (("n", F.count, x), ("s", F.sum, x), ("q", F.sum, x * x))]
    names = [f"{n}{c}" for c in (0, 1) for n in "nsq"]
    # Totals of groups and of units, pre-aggregated; null keys are groups, too.
    total = df.groupBy(*keys).agg(*sums).select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.coalesce(n, F.lit(0)).alias(f"t_{n}") for n in names))
    own = df.groupBy(*keys, unit).agg(*sums, F.count("*").alias("rows"))
    both = own.join(total, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    left = {n: F.col(f"t_{n}") - F.coalesce(n, F.lit(0)) for n in names}
    some = {c: F.when(left[f"n{c}"] > 0, left[f"n{c}"]) for c in (0, 1)}
    m = {c: left[f"s{c}"] / some[c] for c in (0, 1)}
    v = {c: left[f"q{c}"] / some[c] - m[c] * m[c] for c in (0, 1)}
    pooled = (v[0] + v[1]) / 2
    each = both.select(*keys, unit, "rows", F.when(pooled <= 1e-12, 0.0).otherwise((m[1] - m[0]) / F.sqrt(F.when(pooled > 1e-12, pooled))).alias("smd"))
    # A row for each row of the unit
    return each.select(*keys, unit, "smd", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("col")


def smd(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    one, zero = (F.when(F.col(label) == c, x) for c in (1, 0))
    pooled = (F.var_pop(one) + F.var_pop(zero)) / 2
    return df.groupBy(*keys).agg(F.avg(one).alias("mean_1"), F.avg(zero).alias("mean_0"), F.when(pooled == 0, 0.0).otherwise((F.avg(one) - F.avg(zero)) / F.sqrt(F.when(pooled > 0, pooled))).alias("smd"))
