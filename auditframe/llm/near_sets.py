"""Groups of near sets by fingerprints, completed by an exact prefix-filter join.

Sets whose fingerprints are near are the first candidates; the caller finds them (``simhash.near_links``). Sets at
the threshold can have fingerprints far apart, so an exact join completes them.

Two sets with a Jaccard similarity of at least s share an element among the first n - ceil(s n) + 1
of each, in any order common to all sets. The order here puts rare elements first: elements that occur
once come before all others and need no index at all; the others follow by classes of their number,
which bitmaps of fixed size hold. A bitmap that is too small changes the order, never the result.

Links are verified by the whole sets, joined to them by id. In a first round near fingerprints are linked, and the rows of one element
are linked to the least id and to their neighbour only, which joins most of a large group with as many
links as rows. A second round verifies every other pair of one element, of fitting sizes, whose two
rows are in different components so far: a pair inside a component can't change it. The components of
all verified links are therefore those of all near pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import drop_saved, saved
from auditframe.llm.components import components
from auditframe.llm.repeats import _known, gram_filter

#: Least number of an element in each class, and the bits of its bitmap.
CLASSES = ((2, 1 << 27), (5, 1 << 26), (17, 1 << 25), (65, 1 << 24), (257, 1 << 24), (4097, 1 << 24))
#: Links of one row that are joined to one copy of its set.
LINKS = 512
EPS = 1e-9


def prefix(n: int, similarity: float) -> int:
    """Elements of a set of ``n`` among which it shares one with every near set."""
    return n - math.ceil(similarity * n - EPS) + 1


def _ranges(key: np.ndarray) -> Iterator[tuple[int, int]]:
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[begins[1:], len(key)]
    several = ends - begins > 1
    yield from zip(begins[several], ends[several], strict=True)


def _buckets(batches: Iterator[pd.DataFrame], of: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """``of`` for stretches of rows that are ordered by token, none of which is cut."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch["token"].iat[-1]
        cut = int(np.searchsorted(batch["token"].to_numpy(), last))
        if cut == 0 and held and held[-1]["token"].iat[-1] == last:
            held.append(batch)
            continue
        head = pd.concat([*held, batch.iloc[:cut]])
        held = [batch.iloc[cut:]]
        if len(head):
            yield from of(head)
    if held:
        yield from of(pd.concat(held))


def _links(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _fits(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs that meet first in their elements ``at`` can be near."""
    rest = np.minimum(n[i] - at[i], n[j] - at[j])
    return (rest >= similarity / (1 + similarity) * (n[i] + n[j]) - EPS) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - EPS)


def _stars(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Links of each row to the least id of its token and to the id before it."""
    token, ids = rows["token"].to_numpy(), rows["id"].to_numpy()
    first = np.r_[True, token[1:] != token[:-1]]
    least = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
    rest = np.flatnonzero(~first)
    links = _links(np.r_[least[rest], ids[rest - 1]], np.r_[ids[rest], ids[rest]])
    yield links[links["a"] != links["b"]]


def _pairs(rows: pd.DataFrame, similarity: float) -> Iterator[pd.DataFrame]:
    """All pairs of one token that can be near and are in different components."""
    token, ids, part, n, at = (rows[c].to_numpy() for c in ("token", "id", "component", "n", "at"))
    a, b, held = [], [], 0
    for begin, end in _ranges(token):
        if (part[begin:end] == part[begin]).all():
            continue
        own = begin + np.argsort(n[begin:end], kind="stable")
        # Rows are in the order of size; those up to ``to`` are not too large for one.
        to = np.searchsorted(n[own], (n[own] + EPS) / similarity, side="right")
        for x in range(len(own) - 1):
            j = own[x + 1 : to[x]]
            j = j[part[j] != part[own[x]]]
            if len(j):
                j = j[_fits(n, at, np.full(len(j), own[x]), j, similarity)]
                a.append(np.full(len(j), ids[own[x]]))
                b.append(ids[j])
                held += len(j)
                if held > 1_000_000:
                    yield _links(np.concatenate(a), np.concatenate(b))
                    a, b, held = [], [], 0
    if a:
        yield _links(np.concatenate(a), np.concatenate(b))


def _near(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        near = []
        for n, m, x, y in zip(batch["n"], batch["m"], batch["x"], batch["y"], strict=True):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            near.append(shared >= similarity * (n + m - shared))
        yield batch.loc[np.array(near, dtype=bool), ["a", "b"]]


def _verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links ``a``, ``b`` whose sets are near. A set with many links is joined in several copies."""
    links = saved(links, "candidates")
    copies = links.groupBy("a").agg(F.ceil(F.count("*") / LINKS).cast("int").alias("copies"))
    left = sets.join(copies, F.col("id") == F.col("a")).select("a", "n", F.col("shared").alias("x"), "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    salted = links.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("shared").alias("y"))
    both = salted.join(right, "b").join(left.drop("copies"), ["a", "copy"])
    found = saved(both.select("a", "b", "n", "m", "x", "y").mapInPandas(lambda batches: _near(batches, similarity), "a long, b long").distinct(), "near")
    drop_saved(links)
    return found


def fingerprint_links(sets: DataFrame, near_prints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``a``, ``b`` of sets with near fingerprints; those with one fingerprint are linked to their least id."""
    least = sets.groupBy("fp0").agg(F.min("id").alias("a"))
    equal = sets.select("fp0", F.col("id").alias("b")).join(least, "fp0").where("a <> b").select("a", "b")
    return near_prints(least.select(F.col("a").alias("id"), "fp0")).unionByName(equal)


def least_of_near(docs: DataFrame, elements: Callable[[str | None], np.ndarray], similarity: float, fingerprint: Callable[[np.ndarray], int], near_prints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id`` of one row of each group of near sets, the least, and of all rows alone.

    ``docs``: ``id`` (long, not null) and ``text``; ``elements`` gives the distinct elements (64-bit) of
    a text, ``fingerprint`` their fingerprint and ``near_prints`` the links of near ones (of ``id`` and ``fp0``). Near: a Jaccard similarity of at least ``similarity``. Empty sets are near one another.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                h, c = np.unique(np.concatenate([elements(t) for t in batch["text"]]), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "c": c})

    again = docs.select("text").mapInPandas(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    again = saved(again, "elements")
    bitmaps = [gram_filter(again.where(F.col("c") >= least), bits) for least, bits in CLASSES]
    drop_saved(again)

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, text in zip(batch["id"], batch["text"], strict=True):
                found = elements(text).view(np.int64)
                n, shared = len(found), found[_known(bitmaps[0], found)]
                if n and prefix(n, similarity) <= n - len(shared):
                    rows.append((own, n, 0, 0, 0, None))  # near no other
                    continue
                rank = np.zeros(len(shared), dtype=np.int64)
                for bitmap in bitmaps[1:]:
                    rank += _known(bitmap, shared)
                whole = xxhash.xxh3_128_digest(np.sort(found).tobytes())
                k1, k2 = np.frombuffer(whole, dtype=np.int64)
                rows.append((own, n, int(k1), int(k2), fingerprint(found.view(np.uint64)), shared[np.lexsort((shared, rank))]))
            yield pd.DataFrame(rows, columns=["id", "n", "k1", "k2", "fp0", "shared"])

    found = saved(docs.select("id", "text").mapInPandas(ordered, "id long, n long, k1 long, k2 long, fp0 long, shared array<long>"), "sets")
    # Equal sets need only their least id, whatever their number.
    least = found.where("shared IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"))
    sets = saved(found.where("shared IS NOT NULL").join(least, ["k1", "k2", "id"], "left_semi").select("id", "n", "fp0", "shared"), "distinct")

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[batch["n"] > 0]
            firsts = [n - len(x) for n, x in zip(rows["n"], rows["shared"], strict=True)]
            tokens = [x[: prefix(n, similarity) - u] for n, x, u in zip(rows["n"], rows["shared"], firsts, strict=True)]
            if not tokens:
                continue
            sizes = [len(x) for x in tokens]
            at = np.concatenate([np.arange(u, u + k) for u, k in zip(firsts, sizes, strict=True)])
            yield pd.DataFrame({"token": np.concatenate(tokens), "id": np.repeat(rows["id"].to_numpy(), sizes), "n": np.repeat(rows["n"].to_numpy(), sizes), "at": at})

    index = sets.select("id", "n", "shared").mapInPandas(indexed, "token long, id long, n int, at int")
    first = index.select("token", "id").repartition(parts, "token").sortWithinPartitions("token", "id")
    first = first.mapInPandas(lambda batches: _buckets(batches, _stars), "a long, b long")
    first = fingerprint_links(sets.select("id", "fp0"), near_prints).unionByName(first).distinct()
    near = _verified(first, sets, similarity)
    part = components(near)
    known = sets.select("id", "n", "shared").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    second = known.select("id", "n", "shared").mapInPandas(indexed, "token long, id long, n int, at int")
    second = second.join(known.select("id", "component").distinct(), "id").repartition(parts, "token").sortWithinPartitions("token", "id")
    second = second.mapInPandas(lambda batches: _buckets(batches, lambda rows: _pairs(rows, similarity)), "a long, b long").where("a <> b").distinct()
    again = _verified(second, sets, similarity)
    found_parts = components(near.unionByName(again))
    drop_saved(near, again, part)
    heads = sets.select("id").join(found_parts.where("component <> id").select("id"), "id", "left_anti")
    return found.where("shared IS NULL").select("id").unionByName(heads)
