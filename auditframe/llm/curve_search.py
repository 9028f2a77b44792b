"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected at random to a few dimensions, shifted, cut to a grid and numbered along a
Hilbert curve; this is done for several projections and shifts. The grid's lines are quantiles of the
projected coordinates, so cells are about equally full whatever the vectors' distribution; they come
from a bounded sample (``sample_rows`` vectors, those with the least hash), while every row is indexed.
Spark range-partitions all rows by (curve, key, id), which gives each its place along the curve. Places
are cut into strips; the queries of a strip are held by one task, which lets the candidates of the strip
and of half a window on either side stream past. A query meets the candidates around its own place, a
share ``window`` of each curve in all, keeps its best by exact inner products, and what it finds on all
curves is merged.

The window is a share of the rows rather than a number of them: recall then holds at every size, for
work in proportion to that share. For vectors without cluster structure, such as the test tables',
neighbours are hardly nearer than strangers and recall needs a wide window (README).

Of equal vectors only the k + 1 with the least ids are indexed; no other can be among the k nearest
of any query, as ties go to the smaller id. Null vectors, zero vectors and those with a null or
non-finite component take no part. Vectors of different lengths have no inner product: each length is
searched by itself, the driver going from one length to the next. Rows that repeat an id stand for it
together: the score of two ids is the greatest of any two of their rows, and an id is no candidate of
its own. Null ids take no part. Other columns are ignored. An empty table or no query gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import saved
from auditframe.llm.vector_links import usable


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (0 to 2**bits - 1 each).

    From the top bit down, a coordinate's bit turns or swaps the lower bits as the curve does on
    entering that half; a Gray code then orders the orthants, and the bits are interleaved.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for low in ((1 << b) - 1 for b in range(bits - 1, 0, -1)):
        for i, axis in enumerate(axes):
            upper = (axis & (low + 1)) != 0
            swap = np.where(upper, 0, (axes[0] ^ axis) & low)
            axes[0] = axes[0] ^ np.where(upper, low, swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] & (1 << b), (1 << b) - 1, 0)
    keys = np.zeros(len(cells), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << 1) | (((axis ^ flip) >> b) & 1)
    return keys


class Curves:
    """Projections, grids and shifts: the same for every row, from a seed and a sample."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int, lines: int = 256):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.bits, dims = bits, min(dims, width)
        self.turns = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)]
        self.shifts = rng.random((curves, dims)) / 2
        self.share = np.linspace(0, 1, lines + 1)
        self.quantiles = [np.quantile(sample @ turn, self.share, axis=0) for turn in self.turns]

    def keys(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each curve, the place of each vector. Quantiles take up half of each axis of the grid,
        which leaves room for the shift."""
        for turn, shift, quantiles in zip(self.turns, self.shifts, self.quantiles, strict=True):
            y = x @ turn
            place = np.stack([np.interp(y[:, i], quantiles[:, i], self.share) for i in range(y.shape[1])], axis=1)
            cells = ((place / 2 + shift) * (1 << self.bits)).astype(np.int64)
            yield hilbert_keys(np.clip(cells, 0, (1 << self.bits) - 1), self.bits)


class Strip:
    """The queries of one strip of a curve, in the order of their places; candidates stream past."""

    def __init__(self, rows: pd.DataFrame, k: int, half: int):
        self.ids, self.place = rows["id"].to_numpy(), rows["place"].to_numpy()
        self.x = np.stack(rows["vec"].to_numpy()).astype(float)
        self.k, self.half = k, half
        self.least = np.full(len(rows), -np.inf)  # of the k best so far
        self.found = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]  # query's number, id, score
        self.new: list[tuple] = []

    def meet(self, rows: pd.DataFrame) -> None:
        """Candidates in the order of their places."""
        place, ids = rows["place"].to_numpy(), rows["id"].to_numpy()
        y = np.stack(rows["vec"].to_numpy()).astype(float)
        for at in range(0, len(y), 1024):
            own = slice(at, at + 1024)
            begin, end = np.searchsorted(self.place, (place[own][0] - self.half, place[own][-1] + self.half + 1))
            if begin == end:
                continue
            score = self.x[begin:end] @ y[own].T
            score[self.ids[begin:end, None] == ids[None, own]] = -np.inf
            # Sums can round differently here and below.
            least = self.least[begin:end] - 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(self.least[begin:end]), self.least[begin:end], 1)))
            many = np.flatnonzero((score >= least[:, None]).sum(axis=1) > self.k)
            if len(many):
                kth = np.partition(score[many], score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
                least[many] = np.maximum(least[many], kth - 1e-9 * np.maximum(1, np.abs(kth)))
            row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            # Row by row, so that equal vectors get equal sums wherever they lie.
            exact = (self.x[begin + row] * y[at + col]).sum(axis=1)
            self.new.append((begin + row, ids[at + col], exact))
            if sum(len(x[0]) for x in self.new) > 200_000:
                self._settle()

    def _settle(self) -> None:
        """Only the best ``k`` of each query stay."""
        row, ids, score = (np.concatenate(x) for x in zip(self.found, *self.new, strict=True))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        again = np.r_[False, (row[1:] == row[:-1]) & (ids[1:] == ids[:-1]) & (score[1:] == score[:-1])]
        row, ids, score = row[~again], ids[~again], score[~again]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == self.k - 1
        self.least[row[last]] = score[last]
        self.found, self.new = [x[rank < self.k] for x in (row, ids, score)], []

    def best(self) -> pd.DataFrame:
        self._settle()
        row, ids, score = self.found
        return pd.DataFrame({"query_id": self.ids[row], "vec_id": ids, "score": score})


def visit(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows in the order of strip, queries first, and place: the best candidates there of each query."""
    number, held, strip = None, [], None
    for batch in batches:
        for key, rows in batch.groupby("strip", sort=False):
            if key != number:
                if strip is not None:
                    yield strip.best()
                number, held, strip = key, [], None
            if len(own := rows[~rows["candidate"]]):
                held.append(own)
            if len(candidates := rows[rows["candidate"]]) and held:
                strip = strip or Strip(pd.concat(held), k, int(candidates["half"].iat[0]))
                strip.meet(candidates)
    if strip is not None:
        yield strip.best()


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    k: int = 20,
    curves: int = 8,
    dims: int = 4,
    bits: int = 10,
    window: float = 0.15,
    strip_rows: int = 65_536,
    sample_rows: int = 20_000,
    seed: int = 3,
) -> DataFrame:
    """query_id, rank, vec_id and score (inner product) of the ``k`` nearest found of each query.

    ``is_query``: a condition over a column ``id``. A query is no candidate of its own. No task holds more
    than the queries among ``strip_rows`` rows.
    """
    spark = vectors.sparkSession
    clean = usable(vectors, id_col, vec_col).where("id IS NOT NULL").withColumn("width", F.size("vec"))
    sizes = {r["width"]: r["count"] for r in clean.groupBy("width").count().orderBy("width").collect()}
    found = None
    for width, rows in sizes.items():
        own = clean.where(F.col("width") == width).drop("width")
        sample = np.stack(own.orderBy(F.xxhash64("id", "vec")).limit(sample_rows).toPandas()["vec"].to_numpy()).astype(float)
        part = _visited(own, is_query, Curves(sample, curves, dims, bits, seed), rows, k, curves, window, strip_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A pair found on several curves, or by several rows of one id, is one.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _visited(clean: DataFrame, is_query: Column, grid: Curves, rows: int, k: int, curves: int, window: float, strip_rows: int) -> DataFrame:
    """query_id, vec_id and score of the best candidates that each query meets on each curve."""
    spark = clean.sparkSession
    copies = Window.partitionBy("vec").orderBy("id")
    marked = clean.where(is_query).select("id", "vec", F.lit(False).alias("candidate"))
    indexed = clean.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).select("id", "vec", F.lit(True).alias("candidate"))
    kind = clean.schema["vec"].dataType.simpleString()

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vec"].to_numpy()).astype(float)
                for curve, keys in enumerate(grid.keys(x)):
                    yield batch.assign(curve=curve, key=keys)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row's number among those of its curve in the partition, which come in order."""
        curve, seen = None, 0
        for batch in batches:
            for own, group in batch.groupby("curve", sort=False):
                curve, seen = own, seen if own == curve else 0
                yield group[["id", "vec", "candidate", "curve", "part"]].assign(n=seen + np.arange(len(group)))
                seen += len(group)

    # Small inputs still make a few strips for each core.
    cores = spark.sparkContext.defaultParallelism
    strip = min(strip_rows, max(4096, math.ceil(curves * rows / (4 * cores))))
    placed = marked.unionByName(indexed).mapInPandas(keyed, f"id long, vec {kind}, candidate boolean, curve int, key long")
    placed = placed.repartitionByRange(math.ceil(curves * rows / strip), "curve", "key", "id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("curve", "key", "id")
    placed = saved(placed.mapInPandas(counted, f"id long, vec {kind}, candidate boolean, curve int, part int, n long"), "curves")
    # A row for each curve in each partition: how many rows of the curve lie before it.
    along = Window.partitionBy("curve")
    sizes = placed.groupBy("curve", "part").agg(F.count("*").alias("rows"))
    starts = sizes.select("curve", "part", (F.sum("rows").over(along.orderBy("part")) - F.col("rows")).alias("start"), F.sum("rows").over(along).alias("all"))
    placed = placed.join(starts, ["curve", "part"]).withColumn("place", F.col("start") + F.col("n")).withColumn("half", F.ceil(F.col("all") * (window / 2)))
    first, last = (F.floor(x / strip) for x in (F.greatest(F.col("place") - F.col("half"), F.lit(0)), F.least(F.col("place") + F.col("half"), F.col("all") - 1)))
    strips = F.when(F.col("candidate"), F.sequence(first, last)).otherwise(F.array(F.floor(F.col("place") / strip)))
    met = placed.withColumn("own", F.explode(strips)).select((F.col("curve").cast("long") * (1 << 40) + F.col("own")).alias("strip"), "candidate", "place", "half", "id", "vec")
    ordered = met.repartition("strip").sortWithinPartitions("strip", "candidate", "place")
    return ordered.mapInPandas(lambda batches: visit(batches, k), "query_id long, vec_id long, score double")
