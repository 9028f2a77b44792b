"""Hard negatives by blocked matrix products: for each anchor and positive, the nearest rows of other labels in a window.

Components become floor(256 x); a score is the integer inner product of two rows. Products are taken in float64, exact as
no partial sum passes 2**50; rows with larger components go through Python integers, so every score is exact.

1. Anchors are dealt into blocks of at most about ``block_bytes``, the only data that is broadcast. For each block, tasks multiply it with
   the candidates batch by batch and keep, for every anchor, the best ``positives`` rows of its label seen so far.
   These lists merge: the lists of all tasks are joined into one for each anchor.
2. A second pass over the candidates keeps, for every anchor and positive, the best ``negatives`` rows of other
   labels whose score lies within ``window`` percent of the positive's.

The lists that a task sends have a bounded length whatever the data, so copies of one vector or one
common label make no longer lists. Equal scores go by the smaller id.

Rows with a null label, a null vector or a null or non-finite component take no part. Rows are told apart by
their place in the table: a repeated row is a row like any other, and a positive of its copy. Vectors of another
length than the anchor's are not compared with it. A score beyond 64 bits counts, but is given as null. Without anchors,
positives or negatives there are no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import drop_saved, saved

#: A row whose squares sum to less gives exact products with others of its kind.
EXACT = float(1 << 50)
#: Products held at a time: as many candidates are multiplied as give about this number with the anchors of a block.
WORK = 1 << 22


def quantised(vectors: list, scale: int = 256) -> np.ndarray:
    """floor(scale x) of vectors of one length, in float64 where products of them are exact, else as Python integers."""
    x = np.array(vectors, dtype=np.float64)
    with np.errstate(over="ignore"):
        q = np.floor(x * scale)
        if not x.size or (np.square(q).sum(axis=1) < EXACT).all():
            return q
    whole = np.array([[math.floor(float(v) * scale) if abs(v) < 2**60 else int(v) * scale for v in row] for row in x.tolist()], dtype=object)
    return whole.reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == object or b.dtype == object:
        whole = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in b]
        return np.array([[sum(u * v for u, v in zip(p, q, strict=True)) for q in whole[1]] for p in whole[0]], dtype=object).reshape(len(a), len(b))
    return a @ b.T


@dataclass
class Best:
    """The best ``k`` rows of each of several lists: by score descending, then id, then row."""

    k: int
    score: list | np.ndarray
    vec_id: np.ndarray
    row: np.ndarray
    size: np.ndarray

    @classmethod
    def empty(cls, lists: int, k: int, dtype) -> Best:
        return cls(k, np.zeros((lists, k), dtype=dtype), np.zeros((lists, k), dtype=np.int64), np.zeros((lists, k), dtype=np.int64), np.zeros(lists, dtype=np.int64))

    def beats_last(self, score: np.ndarray, vec_id: np.ndarray) -> np.ndarray:
        """Which scores (lists by rows) can enter their list."""
        last, last_id, full = self.score[:, -1:], self.vec_id[:, -1:], (self.size == self.k)[:, None]
        return (~full | (score > last) | ((score == last) & (vec_id[None, :] <= last_id))).astype(bool)

    def add(self, at: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        """More rows, each for the list ``at``."""
        if not len(at):
            return
        touched = np.unique(at)
        i, j = np.nonzero(np.arange(self.k)[None, :] < self.size[touched][:, None])
        i = touched[i]
        dtype = object if self.score.dtype == object or score.dtype == object else self.score.dtype
        at, vec_id, row = np.r_[i, at], np.r_[self.vec_id[i, j], vec_id], np.r_[self.row[i, j], row]
        score = np.concatenate([self.score[i, j].astype(dtype), score.astype(dtype)])
        order = np.lexsort((row, vec_id, descending(score), at))
        at, score, vec_id, row = at[order], score[order], vec_id[order], row[order]
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
        keep = place < self.k
        at, place = at[keep], place[keep]
        if dtype == object:
            self.score = self.score.astype(object)
        self.score[at, place], self.vec_id[at, place], self.row[at, place] = score[keep], vec_id[keep], row[keep]
        self.size[touched] = np.bincount(at, minlength=len(self.size))[touched]


def descending(score: np.ndarray) -> np.ndarray:
    """Keys that sort scores from the highest; Python integers by their rank."""
    if score.dtype != object:
        return -score
    values = sorted(set(score.tolist()), reverse=True)
    return np.array([dict(zip(values, range(len(values)), strict=True))[s] for s in score.tolist()], dtype=np.int64)


class Block:
    """Anchors of one block, by the length of their vectors."""

    def __init__(self, rows: pd.DataFrame):
        self.parts = []
        lengths = rows["v"].map(len)
        for _, own in rows.groupby(lengths, sort=True):
            self.parts.append((own["row"].to_numpy(np.int64), own["label"].to_numpy(np.int64), quantised(own["v"].tolist())))
        self.sizes = {a.shape[1]: len(a) for _, _, a in self.parts}


def batches_by_length(batches: Iterator[pd.DataFrame], anchors: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        lengths = batch["v"].map(len)
        for n, own in batch.groupby(lengths, sort=True):
            if n not in anchors:
                continue
            step = max(16, WORK // anchors[n])
            for at in range(0, len(own), step):
                some = own.iloc[at : at + step]
                yield n, some["row"].to_numpy(np.int64), some["vec_id"].to_numpy(np.int64), some["label"].to_numpy(np.int64), quantised(some["v"].tolist())


def as_rows(numbers: np.ndarray, best: Best) -> pd.DataFrame:
    """One row for each list that has members. Scores travel as text, of any size."""
    kept = np.flatnonzero(best.size)
    n = best.size
    columns = {"scores": [[str(int(s)) for s in best.score[i, : n[i]]] for i in kept], "ids": [best.vec_id[i, : n[i]] for i in kept], "rows": [best.row[i, : n[i]] for i in kept]}
    return pd.DataFrame({"list": numbers[kept]} | {name: pd.Series(own, dtype=object) for name, own in columns.items()})


LISTS = "list long, scores array<string>, ids array<long>, rows array<long>"


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The lists of all tasks as one for each number. A group has as many rows as there were tasks."""

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        score = np.array([int(s) for part in own["scores"] for s in part], dtype=object)
        if not len(score) or max(abs(int(s)) for s in score) < EXACT:
            score = score.astype(np.float64)
        best = Best.empty(1, k, score.dtype)
        best.add(np.zeros(len(score), dtype=np.int64), score, np.concatenate(own["ids"].tolist()), np.concatenate(own["rows"].tolist()))
        return as_rows(own["list"].to_numpy()[:1], best)

    return lists.groupBy("list").applyInPandas(merge, LISTS)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, *, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), block_bytes: int = 32 << 20, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors where ``is_anchor``
    (over ``id`` and ``label``) holds; ``label`` (likewise) changes labels first."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    known = vectors.where(F.col(f"`{label_col}`").isNotNull() & v.isNotNull() & F.col(f"`{id_col}`").isNotNull())
    known = known.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.cast("array<double>").alias("v"))
    known = known.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    known = known.withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    if label is not None:
        known = known.withColumn("label", label.cast("long"))
    rows = saved(known.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    candidates = rows.select("row", F.col("id").alias("vec_id"), "label", "v")
    anchors = rows.where("anchor").select("row", F.col("id").alias("vec_id"), "label", "v")
    n, longest = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    # The rows of a block follow a hash, so blocks are about equal; half a block is left for those that aren't.
    blocks = max(1, -(-2 * n * max(longest, 1) * 8 // block_bytes))
    found = []
    for b in range(blocks if n else 0):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toPandas().sort_values("row", kind="stable")
        if len(own):
            found.append(_of_block(spark, candidates, own, positives, negatives, window, last=blocks == 1))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    if blocks > 1:
        drop_saved(rows)
    return out


def _of_block(spark, candidates: DataFrame, own: pd.DataFrame, k: int, negatives: int, window: tuple[int, int], last: bool) -> DataFrame:
    sent = spark.sparkContext.broadcast(Block(own))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(row, label, q, Best.empty(len(row), k, np.float64)) for row, label, q in sent.value.parts]
        for n, row, vec_id, label, q in batches_by_length(batches, sent.value.sizes):
            for a_row, a_label, a, best in parts:
                if a.shape[1] != n:
                    continue
                for one in np.intersect1d(label, a_label):  # only rows of a label meet its anchors
                    mine, theirs = np.flatnonzero(a_label == one), np.flatnonzero(label == one)
                    score = products(a[mine], q[theirs])
                    part = Best(k, best.score[mine], best.vec_id[mine], best.row[mine], best.size[mine])
                    can = part.beats_last(score, vec_id[theirs]) & (a_row[mine][:, None] != row[theirs][None, :])
                    i, j = np.nonzero(can)
                    best.add(mine[i], score[i, j], vec_id[theirs][j], row[theirs][j])
        for a_row, _, _, best in parts:
            yield as_rows(a_row, best)

    first = merged(candidates.mapInPandas(nearest, LISTS), k).toPandas().set_index("list")
    low, high = window
    pairs = own[["row", "vec_id", "label"]].merge(first, left_on="row", right_index=True)
    # A list for each anchor and positive, numbered through the block.
    wanted = [(row, vec_id, int(score), int(p)) for row, vec_id, scores, ids in zip(pairs["row"], pairs["vec_id"], pairs["scores"], pairs["ids"], strict=True) for score, p in zip(scores, ids, strict=True)]
    of_pairs = spark.sparkContext.broadcast([(row, s) for row, _, s, _ in wanted])

    def in_window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists: dict[int, list[int]] = {}
        for number, (row, _) in enumerate(of_pairs.value):
            lists.setdefault(row, []).append(number)
        score_of = [s for _, s in of_pairs.value]
        parts = []
        for a_row, a_label, a in sent.value.parts:
            for slot in range(k):
                has = np.array([slot < len(lists.get(r, [])) for r in a_row.tolist()], dtype=bool)
                at = np.flatnonzero(has)
                if not len(at):
                    continue
                number = np.array([lists[r][slot] for r in a_row[at].tolist()], dtype=np.int64)
                # 100 x score lies between low x and high x the positive's, in whole numbers
                bounds = [(-(-low * score_of[i] // 100), high * score_of[i] // 100) for i in number.tolist()]
                fits = all(abs(v) < EXACT for b in bounds for v in b)
                least, most = (np.array([b[s] for b in bounds], dtype=np.float64 if fits else object)[:, None] for s in (0, 1))
                parts.append((number, at, a_label[at], a, least, most, Best.empty(len(at), negatives, np.float64)))
        for n, row, vec_id, label, q in batches_by_length(batches, sent.value.sizes):
            before = score = None
            for _, at, a_label, a, least, most, best in parts:
                if a.shape[1] != n:
                    continue
                if before is not a:
                    before, score = a, products(a, q)
                own_score = score[at]
                can = ((own_score >= least) & (own_score <= most)).astype(bool) & (a_label[:, None] != label[None, :])
                can &= best.beats_last(own_score, vec_id)
                i, j = np.nonzero(can)
                best.add(i, own_score[i, j], vec_id[j], row[j])
        for number, _, _, _, _, _, best in parts:
            yield as_rows(number, best)

    lists = merged(candidates.mapInPandas(in_window, LISTS), negatives)

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = described.value
        for batch in batches:
            out = []
            for number, scores, ids in zip(batch["list"], batch["scores"], batch["ids"], strict=True):
                anchor, positive, s = names[number]
                out += [(anchor, positive, rank, int(i), fitting(s), fitting(int(t))) for rank, (t, i) in enumerate(zip(scores, ids, strict=True), 1)]
            yield pd.DataFrame({n: pd.array([r[c] for r in out], dtype="Int64" if n != "rank" else "Int32") for c, n in enumerate(["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])})

    described = spark.sparkContext.broadcast([(int(a), p, s) for _, a, s, p in wanted])
    out = lists.mapInPandas(spelled, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if last:
        return out
    kept = saved(out, "negatives-block")
    for data in (sent, of_pairs, described):
        data.unpersist()
    return kept


def fitting(score: int) -> int | None:
    return score if -(2**63) <= score < 2**63 else None
