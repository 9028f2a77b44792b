"""Candidate pairs of near sets from signatures of parts of the universe.

Sets of n and m elements with a cosine of at least s differ in at most n (1 / s**2 - 1) elements, n being
either size. A hash deals all elements to d + 1 + SPARE parts, where d is the most that a pair may differ:
each element that differs spoils one part at most, so at least SPARE + 1 parts are the same in both. A part's
signature is a hash of the elements in it, about nine at any size for a cosine of 0.95, so two sets that
meet in one are rarely far apart; a single shared element says nothing in texts, where all are frequent.

d depends on sizes, so sizes fall into levels as wide as the sizes of near sets may differ: a pair's levels
differ by one at most. One side signs at its own level, the other at its own and both neighbours, so that a
pair meets at exactly one.

A part that is empty in both sets agrees, too. Pairs that agree in empty parts only have more than SPARE of
them on each side; only sets with so many sign them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.sources.scratch import saved

SPARE = 4
#: Elements that are signed at a time, unless one set has more.
AT_ONCE = 1_000_000
EPS = 1e-6
#: Bits of a bitmap of signatures.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29


def level_base(least: float) -> float:
    """Ratio of sizes that a level spans, a little over that of near sets: rounding parts none by two levels."""
    return (1 + EPS) / (least * least)


def parts_of(level: np.ndarray, least: float) -> np.ndarray:
    """Number of parts for pairs of which one set's size is of ``level``."""
    largest = np.power(level_base(least), level + 1.0)
    return np.floor(largest * (1 / (least * least) - 1) + EPS).astype(np.int64) + 1 + SPARE


def part_signatures(sets: list[np.ndarray], levels: tuple[int, ...], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of ``sets`` (distinct 64-bit hashes, none empty) and signatures of their parts, at their own level moved by each of ``levels``."""
    sizes = np.array([len(x) for x in sets])
    hashes = np.concatenate(sets).astype(np.int64).view(np.uint64)
    own = np.floor(np.log(sizes) / math.log(level_base(least)))
    for moved in levels:
        level = own + moved
        parts = np.where(level >= 0, parts_of(level, least), 0)
        usable = np.repeat(parts > 0, sizes)
        h = hashes[usable]
        row = np.repeat(np.arange(len(sets)), sizes)[usable]
        starts = np.cumsum(parts) - parts
        slot = starts[row] + (h % parts[row].astype(np.uint64)).astype(np.int64)
        total = int(parts.sum())
        sums, filled = np.zeros(total, dtype=np.uint64), np.bincount(slot, minlength=total) > 0
        np.add.at(sums, slot, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
        of = np.repeat(np.arange(len(sets)), parts)
        empty = parts - np.bincount(of[filled], minlength=len(sets))
        signs = filled | (empty > SPARE)[of]
        place = (np.arange(total) - starts[of]).astype(np.uint64)
        mixed = (sums + place * np.uint64(0x9E3779B97F4A7C15)) ^ ((level[of].astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield of[signs], (mixed ^ (mixed >> np.uint64(29)))[signs].view(np.int64)


def signed(sets: DataFrame, member: str, hashes: str, levels: tuple[int, ...], least: float, there: np.ndarray | None = None) -> DataFrame:
    """``member`` and ``signature``, one row a signed part, and ``need``, how many of the signed parts every near set has, too; of those in the bitmap ``there``; ``hashes`` are distinct 64-bit hashes of a set, none empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch[hashes]], dtype=np.int64)
            turn = (np.cumsum(sizes) - sizes) // AT_ONCE
            for at in np.unique(turn):
                some = batch[turn == at]
                members = some[member].to_numpy()
                own = np.floor(np.log(sizes[turn == at]) / math.log(level_base(least)))
                for moved, (of, signature) in zip(levels, part_signatures(list(some[hashes]), levels, least), strict=True):
                    parts = np.where(own + moved >= 0, parts_of(own + moved, least), 0)
                    need = SPARE + 1 - (parts - np.bincount(of, minlength=len(some)))
                    if there is not None:
                        of, signature = (x[found] for found in [known(there, signature)] for x in (of, signature))
                    yield pd.DataFrame({member: members[of], "signature": signature, "need": need[of]})

    kind = sets.schema[member].dataType.simpleString()
    return sets.select(member, hashes).mapInPandas(run, f"`{member}` {kind}, signature long, need int")


def bitmap(signatures: DataFrame, bits: int) -> np.ndarray:
    """One bit a signature, built in Spark; the driver gets the bitmap alone."""
    place = F.col("signature").bitwiseAND(F.lit(bits - 1)) + 1  # Spark's bitmaps count from 1
    made = signatures.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in made.toLocalIterator():
        own = np.frombuffer(row["bits"], dtype=np.uint8)
        begin = (row["bucket"] - 1) * len(own)
        out[begin : begin + len(own)] = own[: len(out) - begin]
    return out


def known(bits: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """Whether the bitmap has these signatures; the lowest bit of a byte is the first."""
    place = signatures.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def candidates(one: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``: pairs of a set of ``one`` and a set of ``other`` that hold all whose cosine is at least ``least``, each once.

    Both sides have ``member`` and ``h``. Most signatures are those of one side alone: bitmaps leave them out before they are
    shuffled, first those of ``one`` by the signatures of ``other``, then those of ``other`` by what is left. A bitmap that is too full lets
    through more, and never less. A frequent signature is that of one part of many sets; an adaptive join splits it.
    """
    sizes = other.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    wanted = 8 * (3 * sizes * (level_base(least) / (least * least) - 1) + 3 * (2 + SPARE))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(wanted).bit_length()))
    there = bitmap(signed(other, "member", "h", (-1, 0, 1), least), bits)
    left = saved(signed(one, "member", "h", (0,), least, there), "signatures").withColumnRenamed("member", "a")
    there = bitmap(left, bits)
    right = signed(other, "member", "h", (-1, 0, 1), least, there).select(F.col("member").alias("b"), "signature")
    # Texts share a part by chance, but rarely as many as near ones do.
    return left.join(right, "signature").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")
