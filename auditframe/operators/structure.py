"""Sequence alignment and superposition of point sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_identity(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2) -> tuple[float, float]:
    """Identity over aligned positions and coverage of ``b`` in a best global alignment.

    Ties prefer a pair, then a gap in ``b``. Rows are filled at once: a running maximum of scores less
    their gap costs gives the best run of gaps to the left. Memory is linear in the length of ``b``.
    """
    if not a or not b:
        return 0.0, 0.0
    x, y = (np.frombuffer(s.encode("utf-32-le"), dtype="<u4") for s in (a, b))
    steps = gap * np.arange(len(y) + 1)
    place = np.arange(len(y) + 1)
    # Along the path that a traceback would take, each cell has equal letters and pairs so far: two rows.
    score, same, pairs = steps.copy(), np.zeros(len(y) + 1, dtype=np.int64), np.zeros(len(y) + 1, dtype=np.int64)
    for char in x:
        equal = y == char
        pair = np.r_[np.iinfo(np.int32).min, score[:-1] + np.where(equal, match, mismatch)]
        up = score + gap
        best = np.maximum(pair, up)
        most = np.maximum.accumulate(best - steps)
        # The nearest cell to the left (or the cell itself) from which gaps alone lead here.
        origin = np.maximum.accumulate(np.where(best - steps == most, place, 0))
        paired = pair >= up
        same = np.where(paired, np.r_[0, same[:-1] + equal], same)[origin]
        pairs = np.where(paired, np.r_[0, pairs[:-1] + 1], pairs)[origin]
        score = most + steps
    return int(same[-1]) / max(1, int(pairs[-1])), int(pairs[-1]) / len(b)


def align(a: str, b: str):
    """A struct of identity and coverage of two text columns."""

    @F.pandas_udf("identity double, coverage double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([global_identity(p or "", q or "") for p, q in zip(a, b, strict=True)], columns=["identity", "coverage"])

    return run(a, b)


def _rotation(h):
    """Proper rotation for a 3 x 3 covariance, row by row."""

    def turn(values) -> list[float]:
        u, _, vt = np.linalg.svd(np.asarray(values, dtype=float).reshape(3, 3))
        u[:, 2] *= np.sign(np.linalg.det(u @ vt)) or 1.0
        return (u @ vt).ravel().tolist()

    @F.pandas_udf("array<double>")
    def run(h: pd.Series) -> pd.Series:
        return h.map(turn)

    return run(h)


def superposed(points: DataFrame, keys: list[str], position: str, a: list[str], b: list[str]) -> DataFrame:
    """Displacement of each position after the best rigid superposition of ``a`` on ``b``.

    Sums in Spark give each group's 3 x 3 covariance; only those nine numbers reach Python. Groups of
    fewer than three positions are left out.
    """
    own = Window.partitionBy(*keys)
    centred = points.where(F.forall(F.array(*a, *b), lambda x: x.isNotNull()))
    centred = centred.select(*keys, position, F.count("*").over(own).alias("n"), *((F.col(c) - F.avg(c).over(own)).alias(f"c_{c}") for c in (*a, *b))).where("n >= 3")
    sums = centred.groupBy(*keys).agg(*(F.sum(F.col(f"c_{p}") * F.col(f"c_{q}")).alias(f"h{i}{j}") for i, p in enumerate(a) for j, q in enumerate(b)))
    turns = sums.select(*keys, _rotation(F.array(*(f"h{i}{j}" for i in range(3) for j in range(3)))).alias("r"))
    turned = [sum((F.col(f"c_{p}") * F.col("r")[3 * i + j] for i, p in enumerate(a)), F.lit(0.0)) for j in range(3)]
    square = sum(((F.col(f"c_{q}") - t) * (F.col(f"c_{q}") - t) for q, t in zip(b, turned, strict=True)), F.lit(0.0))
    return centred.join(turns, keys).select(*keys, position, F.sqrt(square).alias("displacement"))


def rmsd(displacements: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("displacement")
    return displacements.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmsd"))


def near_points(points: DataFrame, key: str, group: str, axes: list[str], radius: float, apart: str | None = None, least_apart: int = 0) -> DataFrame:
    """Pairs of a group at most ``radius`` from each other: an equality join over grid cells.

    Cells are as wide as the radius, so a point meets its own cell and the neighbours. ``apart``: a
    position of which pairs must differ by more than ``least_apart``.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    placed = points.select(key, group, *axes, *([apart] if apart and apart != key else []), *(cell(c).alias(f"g_{c}") for c in axes))
    around = placed
    for c in axes:
        around = around.withColumn(f"g_{c}", F.explode(F.array(*(F.col(f"g_{c}") + d for d in (-1, 0, 1)))))
    names = {c: f"{c}_2" for c in {key, *axes, *([apart] if apart else [])}}
    other = placed.select(group, *(f"g_{c}" for c in axes), *(F.col(c).alias(n) for c, n in names.items()))
    square = sum(((F.col(c) - F.col(names[c])) * (F.col(c) - F.col(names[c])) for c in axes), F.lit(0.0))
    near = (F.col(key) < F.col(names[key])) & (square <= radius * radius)
    if apart:
        near = near & (F.abs(F.col(apart) - F.col(names[apart])) > least_apart)
    joined = around.join(other, [group, *(f"g_{c}" for c in axes)]).where(near)
    return joined.select(group, F.col(key).alias("left"), F.col(names[key]).alias("right"), F.sqrt(square).alias("distance"))


def elastic_modes(coords: np.ndarray, start: float = 9.5, stop: float = 12.0, step: float = 0.5) -> tuple[np.ndarray, float] | None:
    """Pseudo-inverse of the elastic network's Hessian at the least cutoff that leaves six zero modes.

    None where the network stays disconnected up to the last cutoff.
    """
    n = len(coords)
    delta = coords[:, None, :] - coords[None, :, :]
    square = (delta**2).sum(axis=2)
    for cutoff in np.arange(start, stop + step / 2, step):
        near = (square > 0) & (square <= cutoff * cutoff)
        blocks = -np.einsum("ijk,ijl->ijkl", delta, delta) * (near / np.where(near, square, 1))[..., None, None]
        blocks[np.arange(n), np.arange(n)] = -blocks.sum(axis=1)
        values, vectors = np.linalg.eigh(blocks.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n))
        moving = values > max(1e-8 * max(values[-1], 1.0), 1e-12)
        if (~moving).sum() == 6:
            return (vectors[:, moving] / values[moving]) @ vectors[:, moving].T, float(cutoff)
    return None


def response_scan(points: DataFrame, key: str, position: str, axes: list[str], moves: list[str], directions: int = 200, seed: int = 0, top_share: float = 0.05) -> DataFrame:
    """Overlap of the response to random forces on each position with ``moves``: greatest and mean, signed
    and absolute, how much the greatest differs from that of the first half of the directions, and whether
    the position is among the first ``top_share`` of its group.

    A group is one structure, whose matrix is dense; groups are shared out over tasks. A structure whose
    network stays disconnected has nulls.
    """
    names = ["max_overlap", "mean_overlap", "max_absolute", "mean_absolute", "half_delta", "cutoff"]

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(position)
        out = group[[key, position]].reset_index(drop=True)
        target = group[moves].to_numpy(dtype=float).ravel()
        modes = elastic_modes(group[axes].to_numpy(dtype=float))
        if modes is None:
            return out.assign(**dict.fromkeys(names, np.nan), is_top=None)
        covariance, cutoff = modes
        rng = np.random.default_rng([seed, len(group)])
        force = rng.normal(size=(directions, 3))
        force /= np.linalg.norm(force, axis=1, keepdims=True)
        response = covariance.reshape(len(target), len(group), 3) @ force.T
        norm = np.linalg.norm(response, axis=0) * np.linalg.norm(target)
        overlap = np.einsum("a,abd->bd", target, response) / np.where(norm > 1e-12, norm, np.inf)
        most, size = overlap.max(axis=1), np.abs(overlap)
        half = overlap[:, : max(1, directions // 2)].max(axis=1)
        first = np.argsort(-most, kind="stable")[: max(1, math.ceil(top_share * len(group)))]
        values = dict(zip(names, (most, overlap.mean(axis=1), size.max(axis=1), size.mean(axis=1), most - half, cutoff), strict=True))
        return out.assign(**values, is_top=np.isin(np.arange(len(group)), first))

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.groupBy(key).applyInPandas(scan, f"`{key}` {kinds[key]}, `{position}` {kinds[position]}, " + ", ".join(f"{n} double" for n in names) + ", is_top boolean")
