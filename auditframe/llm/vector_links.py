"""Exact near-duplicate vectors by a metric range join.

Unit vectors live in the metric of angles. Pivots, chosen far from one another in a bounded sample,
partition all vectors into cells, each to its nearest pivot; neighbouring cells are joined to blocks of
a few thousand home vectors, and a large cell is dealt over several blocks by a hash. A vector x can be
within the threshold angle t of a vector in cell j only if, by the triangle inequality,

* x lies at most t outside the ring between that cell's least and greatest angle from pivot j,
* it does so for the cell's ring around each of some reference pivots, and
* its angles to pivot j and to its own nearest pivot differ by at most 2t.

Exactly the vectors that satisfy all this for a cell of a block are replicated to the block. Each block
joins its home vectors with all that were sent to it, alone; every link of a home vector is found there,
once. In clustered data the rings are narrow and a vector goes to few blocks. Between vectors without
clusters all angles are near 90 degrees, no ring excludes anything and every block meets every vector:
the work then grows with the square of the rows (README).

Equal vectors are joined as one with their number, so copies are never expanded into pairs. A block
holds its home vectors, lets the others stream past, and returns a count of links for each home
vector and links that keep every linked part together, not all pairs. Products are taken in single
precision; those nearer to the threshold than its rounding error are decided by a sum in double
precision that is the same for both directions.

Null vectors, zero vectors and those with a null or non-finite component link with nothing, and
vectors of different lengths don't link; each length is joined by itself, the driver going from one
length to the next. Repeated rows are vectors of their own that link to one another; rows with one id
and different vectors are kept apart, each with its own links. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import saved
from auditframe.llm.components import components

#: Slack for rounding in angles that decide replication; it only ever replicates more.
SLACK = 1e-6
#: Vectors from which pivots are chosen, and pivots whose rings all cells keep.
SAMPLE, REFERENCES = 4096, 16
#: Vectors for each pivot, as long as there are fewer than the most.
PIVOT_ROWS = 512


def marked(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``vec``, null where a vector can't link. Components stay floats if they are."""
    kind = "float" if vectors.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    vec = F.transform(vec_col, lambda x: x.cast(kind))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("id"), F.when(fine, vec).alias("vec"))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``vec`` of the vectors that can link."""
    return marked(vectors, id_col, vec_col).where("vec IS NOT NULL")


def unit(block: np.ndarray) -> np.ndarray:
    block = block / np.abs(block).max(axis=1, keepdims=True)
    return block / np.sqrt(np.einsum("ij,ij->i", block, block))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; equal for (a, b) and (b, a)."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


class Block:
    """Home vectors of one block, held; all others stream past them."""

    def __init__(self, homes: pd.DataFrame, least: float):
        self.ids, self.least = homes["rep"].to_numpy(), least
        self.raw = _matrix(homes["vec"])
        self.x = np.ascontiguousarray(unit(self.raw).astype(np.float32).T)
        #: More than single precision can be wrong by in a product of unit vectors.
        self.band = 1.3e-7 * (self.raw.shape[1] + 8)
        self.counts = np.zeros(len(self.ids), dtype=np.int64)
        self.parent = np.arange(len(self.ids))

    def _roots(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[i]
            if (up == i).all():
                return i
            self.parent[i] = self.parent[up]
            i = up

    def meet(self, others: pd.DataFrame, same: bool = False) -> Iterator[pd.DataFrame]:
        """Count the links to ``others`` (the homes themselves if ``same``); links of a forest."""
        ids, mult, raw = others["rep"].to_numpy(), others["mult"].to_numpy().astype(float), _matrix(others["vec"])
        y = unit(raw).astype(np.float32)
        step = max(1, 4_000_000 // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            product = y[at : at + step] @ self.x
            found = np.flatnonzero(product >= self.least - self.band)
            row, col = np.divmod(found, len(self.ids))
            near = product.ravel()[found] >= self.least + self.band
            for part in np.array_split(np.flatnonzero(~near), 1 + (~near).sum() // 100_000):
                near[part] = cosines(raw[at + row[part]], self.raw[col[part]]) >= self.least
            if same:
                near &= at + row != col
            row, col = row[near], col[near]
            self.counts += np.bincount(col, weights=mult[at + row], minlength=len(self.ids)).astype(np.int64)
            if not len(row):
                continue
            # Each of the others links to its first home, and its further homes are joined to that.
            begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            first = np.repeat(col[begins], np.diff(np.r_[begins, len(row)]))
            yield self._links(ids[at + row[begins]], self.ids[col[begins]])
            a, b = first, col
            while len(a):
                a, b = self._roots(a), self._roots(b)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
                if not pairs.shape[1]:
                    break
                # One link for each upper root at a time, so that every one kept joins two trees.
                keep = np.unique(pairs[1], return_index=True)[1]
                self.parent[pairs[1, keep]] = pairs[0, keep]
                yield self._links(self.ids[pairs[1, keep]], self.ids[pairs[0, keep]])
                a, b = pairs

    @staticmethod
    def _links(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": a, "b": b, "n": 0})[a != b]

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"a": self.ids, "b": self.ids, "n": self.counts})


def join_blocks(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Rows in the order of block, home vectors first: counts of the home vectors, and links."""
    number, homes, block = None, [], None

    def opened() -> Iterator[pd.DataFrame]:
        nonlocal block
        if block is None and homes:
            own = pd.concat(homes)
            block = Block(own, least)
            yield from block.meet(own, same=True)

    def closed() -> Iterator[pd.DataFrame]:
        yield from opened()
        if block is not None:
            yield block.found()

    for batch in batches:
        for key, rows in batch.groupby("block", sort=False):
            if key != number:
                yield from closed()
                number, homes, block = key, [], None
            if len(own := rows[rows["home"]]):
                homes.append(own)
            if len(others := rows[~rows["home"]]):
                yield from opened()
                if block is not None:
                    yield from block.meet(others)
    yield from closed()


class Cells:
    """Pivots, the cells around them and their rings; what decides where a vector is sent.

    Angles are compared by their cosines, which fall as angles grow.
    """

    def __init__(self, sample: np.ndarray, n_pivots: int, reach: float):
        """Each pivot is the sample's vector farthest from those before it."""
        chosen, near = [0], sample @ sample[0]
        while len(chosen) < min(n_pivots, len(sample)) and near.min() < math.cos(reach):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, sample @ sample[chosen[-1]])
        pivots = sample[chosen]
        # In the order of a walk from each pivot to the nearest one left, so that blocks are compact.
        between, order = pivots @ pivots.T, [0]
        left = np.ones(len(pivots), dtype=bool)
        left[0] = False
        while left.any():
            order.append(int(np.where(left, between[order[-1]], -np.inf).argmax()))
            left[order[-1]] = False
        self.pivots, self.reach = pivots[order], reach
        self.references = np.argsort(order)[:REFERENCES]

    def cosines(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = x @ self.pivots.T
        return found, found.argmax(axis=1)

    def rings(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each cell, the rows of a task and their least and greatest cosine to its own pivot and to
        the reference pivots."""
        shape = (len(self.pivots), 1 + len(self.references))
        n, lo, hi = np.zeros(shape[0], dtype=np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            if len(batch):
                found, cell = self.cosines(unit(_matrix(batch["vec"])))
                own = np.concatenate([found[np.arange(len(cell)), cell][:, None], found[:, self.references]], axis=1)
                np.add.at(n, cell, 1)
                np.minimum.at(lo, cell, own)
                np.maximum.at(hi, cell, own)
        has = np.flatnonzero(n)
        if len(has):
            yield pd.DataFrame({"cell": has, "n": n[has], "lo": list(lo[has]), "hi": list(hi[has])})

    def around(self, rings: pd.DataFrame, home_rows: int, least_blocks: int) -> None:
        """Bounds of what can be near each cell, and the blocks of each."""
        n, size = len(self.pivots), np.zeros(len(self.pivots), dtype=np.int64)
        rings = rings[rings["cell"].notna()]
        at = rings["cell"].to_numpy(dtype=np.int64)
        size[at] = rings["n"]
        self.lo, self.hi = np.full((n, 1 + len(self.references)), np.inf), np.full((n, 1 + len(self.references)), -np.inf)
        lo, hi = (np.arccos(np.clip(np.stack(rings[c].to_numpy()), -1, 1)) for c in ("hi", "lo"))  # angles
        self.hi[at], self.lo[at] = np.cos(np.maximum(lo - self.reach, 0)) + SLACK, np.cos(np.minimum(hi + self.reach, math.pi)) - SLACK
        room = max(1, min(home_rows, math.ceil(size.sum() / least_blocks)))
        self.blocks = np.maximum(1, np.ceil(size / room)).astype(np.int64)  # of a cell
        self.base = np.zeros(n, dtype=np.int64)
        block, held = 0, 0
        for cell in range(n):
            if held and held + size[cell] > room:
                block, held = block + 1, 0
            self.base[cell] = block
            held += size[cell]
            if self.blocks[cell] > 1:
                block, held = block + self.blocks[cell], 0
        self.n = int(block + 1)

    def home(self, cell: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return self.base[cell] + slot % self.blocks[cell]

    def targets(self, found: np.ndarray, cell: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the blocks each of them is sent to, its home block among them."""
        own = np.arccos(np.clip(found[np.arange(len(cell)), cell], -1, 1))
        near = found >= np.cos(np.minimum(own + 2 * self.reach, math.pi))[:, None] - SLACK
        near &= (found >= self.lo[:, 0]) & (found <= self.hi[:, 0])
        for i, r in enumerate(self.references, start=1):
            near &= (found[:, r, None] >= self.lo[:, i]) & (found[:, r, None] <= self.hi[:, i])
        row, target = np.nonzero(near)
        n = self.blocks[target]
        row, block = np.repeat(row, n), np.repeat(self.base[target], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.unique(np.concatenate([row * self.n + block, np.arange(len(cell)) * self.n + home]))
        return key // self.n, key % self.n


def _found(distinct: DataFrame, least_cosine: float, home_rows: int, most_pivots: int) -> DataFrame:
    """Counts (a = b) and links (a < b or a > b) of vectors of one length: a, b, n."""
    spark = distinct.sparkSession
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toPandas()
    n_pivots = min(most_pivots, max(8, math.ceil(distinct.count() / PIVOT_ROWS)))
    cells = Cells(unit(_matrix(sample["vec"])), n_pivots, math.acos(least_cosine) + SLACK)
    each = distinct.select("vec").mapInPandas(cells.rings, "cell int, n long, lo array<double>, hi array<double>")
    k = 1 + len(cells.references)
    bounds = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(k)]
    rings = each.groupBy("cell").agg(F.sum("n").alias("n"), *bounds)
    rings = rings.select("cell", "n", *(F.array(*(f"{c}{i}" for i in range(k))).alias(c) for c in ("lo", "hi")))
    # Small inputs still make as many blocks as there are cores, of a thousand vectors at least.
    rings = rings.toPandas()  # a row for each pivot
    rows = int(rings["n"].sum())
    cells.around(rings, home_rows, max(1, min(spark.sparkContext.defaultParallelism, rows // 1024)))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector for its home block and for every block that may hold a vector near it."""
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                found, cell = cells.cosines(unit(_matrix(part["vec"])))
                own = cells.home(cell, part["slot"].to_numpy())
                row, block = cells.targets(found, cell, own)
                yield pd.DataFrame({"block": block, "home": block == own[row], "rep": part["rep"].to_numpy()[row], "mult": part["mult"].to_numpy()[row], "vec": part["vec"].to_numpy()[row]})

    kind = distinct.schema["vec"].dataType.simpleString()
    sent = distinct.select("rep", "mult", F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).alias("slot"), "vec")
    sent = sent.mapInPandas(dealt, f"block long, home boolean, rep long, mult long, vec {kind}")
    ordered = sent.repartition(cells.n, "block").sortWithinPartitions("block", F.desc("home"))
    return ordered.mapInPandas(lambda batches: join_blocks(batches, least_cosine), "a long, b long, n long")


def linked_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, least_cosine: float = 0.9, home_rows: int = 16_384, most_pivots: int = 512
) -> DataFrame:
    """``id_col``, n_links, component_id and kept of every vector.

    ``home_rows``: home vectors of a block at most; ``most_pivots`` bounds what every task gets, and
    cells larger than a block are dealt over several.
    """
    everything = marked(vectors, id_col, vec_col)
    # Copies meet under the vector itself; the least id stands for them. Ids that repeat with other
    # vectors, or are null, are told apart by a number of their own.
    distinct = everything.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("mult"))
    distinct = saved(distinct.withColumn("key", F.xxhash64("vec")), "vectors")
    clash = distinct.groupBy("least").count().where("count > 1 OR least IS NULL").select(F.col("least").alias("clash"))
    clashes = clash.limit(1).count() > 0
    rep = F.col("least").cast("long")
    if clashes:
        distinct = distinct.join(clash, F.col("least").eqNullSafe(F.col("clash")), "left_semi").withColumn("rep", F.col("key")).unionByName(distinct.join(clash, F.col("least").eqNullSafe(F.col("clash")), "left_anti").withColumn("rep", rep))
    else:
        distinct = distinct.withColumn("rep", rep)
    distinct = distinct.select("vec", "mult", "least", "rep", F.size("vec").alias("width"))
    distinct = saved(distinct, "vectors") if clashes else distinct
    widths = [r["width"] for r in distinct.groupBy("width").count().orderBy("width").collect()]
    parts = [_found(distinct.where(F.col("width") == w), least_cosine, home_rows, most_pivots) for w in widths]
    if not parts:
        return everything.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = saved(found, "vector-links")
    groups = components(found.where("a != b"))
    counts = found.where("a = b").select(F.col("a").alias("rep"), F.col("n").alias("others"))
    per_rep = distinct.join(counts, "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    if clashes:  # representatives are no ids then: the least id of each component
        per_rep = per_rep.join(per_rep.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    else:
        per_rep = per_rep.withColumn("component_id", F.col("root"))
    per_vec = per_rep.select("vec", (F.col("others") + F.col("mult") - 1).alias("n_links"), "component_id")
    result = everything.join(per_vec, "vec", "left")
    result = result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return result.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
