"""Affine-gap alignment in linear memory with its map of places, and searches that prune before they align.

Scores are whole numbers, twice the published ones: match 4, mismatch -2, first place of a gap -6, each further place -1.
Three states a cell (pair, gap in the row's sequence, gap in the column's); a row is filled at once, as the best gap along it is
a running maximum.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.sources.scratch import saved

MATCH, MISMATCH, OPEN, EXTEND = 4, -2, -6, -1
#: What a gap costs beyond ``EXTEND`` a place.
START = OPEN - EXTEND
NEVER = -(1 << 40)
#: Up to so many cells a block is solved with all its rows kept.
WHOLE = 1 << 14


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _along(base: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Best score of each place with a gap along the row that ends there."""
    best = np.maximum.accumulate(base - EXTEND * place)
    return np.r_[NEVER, best[:-1] + START + EXTEND * place[1:]]


def _rows(a: np.ndarray, b: np.ndarray, top: int):
    """Rows of a global alignment: (best, best that ends in a gap down) after each letter of ``a``; a gap down from the
    top corner starts at the cost ``top``."""
    place = np.arange(len(b) + 1)
    best = np.r_[0, START + EXTEND * place[1:]]
    down = np.full(len(b) + 1, NEVER)
    yield best, down
    for i, char in enumerate(a, 1):
        down = np.maximum(down, best + START) + EXTEND
        down[0] = top + EXTEND * i
        pair = np.r_[NEVER, best[:-1] + np.where(b == char, MATCH, MISMATCH)]
        base = np.maximum(pair, down)
        best = np.maximum(base, _along(base, place))
        yield best, down


def _solved(a: np.ndarray, b: np.ndarray, top: int, bottom: int) -> list[tuple[int, int]]:
    """Pairs of a best global alignment of a small block, traced back through all rows."""
    rows = list(_rows(a, b, top))
    i, j = len(a), len(b)
    down = bool(i) and rows[i][1][j] - START + bottom > rows[i][0][j]
    pairs = []
    while i or j:
        if not i:
            break
        if not j:
            break
        if down:
            down = rows[i][1][j] != rows[i - 1][0][j] + START + EXTEND
            i -= 1
            continue
        best = rows[i][0][j]
        if best == rows[i - 1][0][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best == rows[i][1][j]:
            down = True
        else:
            k = j - 1
            while best != rows[i][0][k] + START + EXTEND * (j - k):
                k -= 1
            j = k
    return pairs[::-1]


def global_pairs(a: np.ndarray, b: np.ndarray, top: int = START, bottom: int = START) -> list[tuple[int, int]]:
    """Paired places of a best global alignment, in memory linear in ``b``: the middle row is crossed
    where the halves' scores add up best, in a pair or inside a gap, and the halves are solved the same way."""
    out, work = [], [(0, len(a), 0, len(b), top, bottom)]
    while work:
        i0, i1, j0, j1, start, end = work.pop()
        x, y = a[i0:i1], b[j0:j1]
        if not len(x) or not len(y):
            continue
        if len(x) == 1 or (len(x) + 1) * (len(y) + 1) <= WHOLE:
            out += [(i0 + i, j0 + j) for i, j in _solved(x, y, start, end)]
            continue
        half = len(x) // 2
        for best, down in _rows(x[:half], y, start):
            pass
        for tail, tail_down in _rows(x[half:][::-1], y[::-1], end):
            pass
        through, inside = best + tail[::-1], down + tail_down[::-1] - START
        j = int(through.argmax())
        k = int(inside.argmax())
        if through[j] >= inside[k]:
            work += [(i0, i0 + half, j0, j0 + j, start, START), (i0 + half, i1, j0 + j, j1, START, end)]
        else:
            work += [(i0, i0 + half - 1, j0, j0 + k, start, 0), (i0 + half + 1, i1, j0 + k, j1, 0, end)]
    return sorted(out)


def local_pairs(a: str, b: str) -> tuple[int, list[tuple[int, int]]]:
    """Score (doubled) and paired places of a best local alignment; of several the one that ends first in ``a``, then in ``b``."""
    x, y = letters(a or ""), letters(b or "")
    if not len(x) or not len(y):
        return 0, []
    place = np.arange(len(y) + 1)
    best, down = np.zeros(len(y) + 1, dtype=np.int64), np.full(len(y) + 1, NEVER)
    # Where the alignment that a cell ends began: row and column in one number.
    wide = len(y) + 1
    begun, down_begun = place.copy(), place.copy()
    top, end, origin = 0, (0, 0), 0
    for i, char in enumerate(x, 1):
        opened = best + START >= down
        down_begun = np.where(opened, begun, down_begun)
        down = np.where(opened, best + START, down) + EXTEND
        pair = np.r_[0, best[:-1] + np.where(y == char, MATCH, MISMATCH)]
        own = np.r_[i * wide, begun[:-1]]
        base = np.maximum(np.maximum(pair, down), 0)
        origin_ = np.where(pair == base, own, down_begun)
        origin_ = np.where(base == 0, i * wide + place, origin_)
        level = base - EXTEND * place
        most = np.maximum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == most, place, 0))
        along = np.r_[NEVER, most[:-1] + START + EXTEND * place[1:]]
        from_ = origin_[np.r_[0, at[:-1]]]
        best = np.maximum(base, along)
        begun = np.where(along > base, from_, origin_)
        if best.max() > top:
            j = int(best.argmax())
            top, end, origin = int(best[j]), (i, j), int(begun[j])
    i0, j0 = divmod(origin, wide)
    pairs = global_pairs(x[i0 : end[0]], y[j0 : end[1]]) if top else []
    return top, [(i0 + i, j0 + j) for i, j in pairs]


def score_of(a: str, b: str, pairs: list[tuple[int, int]]) -> int:
    """Doubled score of a map: its pairs and the gaps between them."""
    total, before = 0, None
    for i, j in pairs:
        total += MATCH if a[i] == b[j] else MISMATCH
        if before:
            for gap in (i - before[0] - 1, j - before[1] - 1):
                total += OPEN + EXTEND * (gap - 1) if gap else 0
        before = (i, j)
    return total


MAPPED = "how string, identity double, coverage double, target array<int>, query array<int>"


def _placed(target: str | None, query: str | None, least_identity: float, least_coverage: float) -> tuple:
    if not target or not query:
        return "unmapped", None, None, [], []
    at = target.find(query)
    if at >= 0:
        return "exact", 1.0, 1.0, list(range(at, at + len(query))), list(range(len(query)))
    _, pairs = local_pairs(target, query)
    if not pairs:
        return "unmapped", 0.0, 0.0, [], []
    identity = sum(target[i] == query[j] for i, j in pairs) / len(pairs)
    coverage = len(pairs) / len(query)
    if identity < least_identity or coverage < least_coverage:
        return "unmapped", identity, coverage, [], []
    return "aligned", identity, coverage, [i for i, _ in pairs], [j for _, j in pairs]


def mapped(target: str | Column, query: str | Column, least_identity: float = 0.90, least_coverage: float = 0.80) -> Column:
    """How ``query`` lies in ``target``: a struct of ``how`` ("exact" as a substring, "aligned" if a best local alignment passes both gates,
    else "unmapped"), identity over paired places, the share of ``query`` that is paired, and the paired places of both, from 0."""

    @F.pandas_udf(MAPPED)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_placed(p, q, least_identity, least_coverage) for p, q in zip(a, b, strict=True)], columns=["how", "identity", "coverage", "target", "query"])

    return run(target, query)


def grams(text: str | Column, n: int) -> Column:
    """A text's grams of ``n`` letters with the number of each, as texts: repeats become items of their own."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    ordered = F.array_sort(plain)
    # An item's number is its place less the place of the first equal one.
    return F.transform(ordered, lambda g, i: F.concat(g, F.lit("#"), (i + 1 - F.array_position(ordered, g)).cast("string")))


#: A text of up to so many ways to leave out the letters that may differ is found by those.
MOST_WAYS = 512


def _may_differ(length: int, least: float) -> int:
    """Places of the longer text that need not be paired with an equal letter."""
    return int((1 - least) * length + 1e-9)


def _few_ways(least: float) -> int:
    """The greatest length up to which all texts have at most ``MOST_WAYS`` ways."""
    length = 0
    while length < 2048 and math.comb(length + 1, _may_differ(length + 1, least)) <= MOST_WAYS:
        length += 1
    return length


def _ways(sequence: str | Column, band: int, least: float, few: int) -> Column:
    """Hashes of what is left of a text without the letters that may differ, for each length of the longer text of a pair up to ``few``.

    A pair whose identity is at least ``least`` has equal letters in order, as many as the longer text's places less those that may differ: it shares a hash.
    """

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            own = set()
            for longer in range(len(text), min(len(text) + band, few) + 1):
                left = longer - _may_differ(longer, least)
                if left <= len(text):
                    own |= {f"{longer}:{''.join(some)}" for some in combinations(text, left)}
            out.append([xxhash.xxh64_intdigest(x) - (1 << 63) for x in own])
        return pd.Series(out)

    return run(F.col(sequence) if isinstance(sequence, str) else sequence)


def _by_ways(q: DataFrame, t: DataFrame, band: int, least: float) -> DataFrame:
    """``id`` and ``text``: pairs of a query (id, a) and a target text (text, b, first, second) of up to ``_few_ways`` places
    that can be the query's best; the texts of a pair differ.

    A target that differs in one letter of a text as long has the greatest identity of those as long; found first, by an
    equality join, the one of the smallest id bars all that can't have a greater identity or an equal one with a smaller id.
    """
    few = _few_ways(least)
    m, k = F.length("a"), F.length("b")
    q, t = q.where(m <= few), t.where(k <= few)

    def without_one(sequence: str) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(1), F.length(sequence)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.overlay(F.col(sequence), F.lit(""), i, F.lit(1)))))

    one = t.where(F.lit((1 - least)) * k + 1e-9 >= 1).select("first", "second", without_one("b").alias("way"))
    other = F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second"))
    bars = q.where(F.lit((1 - least)) * m + 1e-9 >= 1).select("id", without_one("a").alias("way")).join(one, "way").groupBy("id").agg(F.min(other).alias("bar"))
    left = q.join(bars, "id", "left").select("id", "bar", m.alias("m"), F.explode(_ways("a", band, least, few)).alias("way"))
    right = t.select("text", "first", "second", k.alias("k"), F.explode(_ways("b", band, least, few)).alias("way"))
    # The same length: one place at least differs. An equal text is the query's own.
    most = F.when(F.col("m") == F.col("k"), (F.col("m") - 1) / F.col("m")).otherwise(F.least("m", "k") / F.greatest("m", "k"))
    barred = (F.col("m") - 1) / F.col("m")
    open_ = F.col("bar").isNull() | (most > barred + 1e-9) | ((most > barred - 1e-9) & (other <= F.col("bar")))
    return left.join(right, "way").where((F.abs(F.col("m") - F.col("k")) <= band) & other.isNotNull() & open_).select("id", "text").distinct()


def _by_grams(q: DataFrame, t: DataFrame, band: int, least: float, n: int) -> DataFrame:
    """``id`` and ``text``: pairs of a query (id, a) and a target text (text, b), one of which is longer than ``_few_ways``, that share enough grams."""
    few = _few_ways(least)
    spoilt = lambda m: F.floor(n * (1 - least) * m + 1e-9)
    q = q.where(F.length("a") + band > few).withColumn("ga", grams("a", n))
    t = t.where(F.length("b") + band > few).withColumn("gb", grams("b", n))
    often = t.select(F.explode("gb").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    each = q.select("id", F.length("a").alias("m"), F.explode("ga").alias("gram")).join(often, "gram", "left")
    # The longer side has at most m + band places; grams of the query that may be missing from the target.
    may = spoilt(F.col("m") + band)
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("often", F.lit(0)), "gram"))
    keys = each.withColumn("turn", turn).where((F.col("turn") <= may + 1) & F.col("often").isNotNull()).select("id", "m", "gram")
    lengths = t.select("text", F.length("b").alias("k"), F.explode("gb").alias("gram"))
    some = keys.join(lengths, "gram").where(F.abs(F.col("m") - F.col("k")) <= band).select("id", "text").distinct()
    certain = F.size("ga") > spoilt(F.length("a") + band)
    loose = q.where(~certain).select("id", F.length("a").alias("m")).withColumn("k", F.explode(F.sequence(F.col("m") - band, F.col("m") + band))).join(t.select("text", F.length("b").alias("k")), "k").select("id", "text")
    pairs = some.unionByName(loose).distinct().join(q, "id").join(t, "text")
    longer = F.greatest(F.length("a"), F.length("b"))
    return pairs.where((longer > few) & (F.size(F.array_intersect("ga", "gb")) >= longer - n + 1 - spoilt(longer))).select("id", "text")


def equal_letters(a: str, b: str) -> int:
    """Equal pairs of a best global alignment. Texts of one length with at most two places that differ have it without a gap: 4 m - 12 is more than the 4 m - 16 that a gap on either side leaves."""
    x, y = letters(a), letters(b)
    if len(x) == len(y) and (differ := int((x != y).sum())) <= 2:
        return len(x) - differ
    return sum(a[i] == b[j] for i, j in global_pairs(x, y))


def best_in_band(queries: DataFrame, targets: DataFrame, unit: str, sequence: str, band: int, least: float, n: int = 3) -> DataFrame:
    """``unit``, ``best``, ``identity``: for each query the target whose global alignment has the greatest identity of at least ``least``
    among those whose length differs by at most ``band``; ties to the smaller id. Identity is the number of equal pairs over the longer length.

    A query whose own text is another target's is done: no other text has identity 1. Equal targets stand for one text, of their two smallest ids.
    Texts that can be left without what may differ in few ways meet in those (``_by_ways``); longer ones by their rare grams: if a share ``least`` of m
    places is equal, at most (1 - least) m places differ, each spoils up to ``n`` grams, and so at least m - n + 1 - n (1 - least) m grams are
    shared (``n`` letters, repeats counted). Pairs below that are never aligned. Pairs are found by their rare grams: a query shares one of its
    rarest grams, as many as may be spoilt and one more. Where so few are needed that none is certain, all pairs of the band are compared. Empty
    and null sequences match nothing.
    """
    q = queries.where(F.length(sequence) > 0).select(F.col(unit).alias("id"), F.col(sequence).alias("a"))
    t = targets.where(F.length(sequence) > 0).select(F.col(unit).alias("other"), F.col(sequence).alias("b"))
    first = t.groupBy("b").agg(F.min("other").alias("first"))
    second = t.join(first, "b").where(F.col("other") > F.col("first")).groupBy("b").agg(F.min("other").alias("second"))
    texts = saved(first.join(second, "b", "left").withColumn("text", F.xxhash64("b")), "band-texts")
    other = F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second")).alias("other")
    equal = q.join(texts, F.col("a") == F.col("b")).select("id", other, F.lit(1.0).alias("identity")).where("other IS NOT NULL")
    rest = saved(q.join(equal.select("id"), "id", "left_anti"), "band-queries")
    pairs = _by_ways(rest, texts, band, least).unionByName(_by_grams(rest, texts, band, least, n)).distinct()
    pairs = pairs.join(rest, "id").join(texts, "text").select("id", "a", "b", other).where("other IS NOT NULL AND a <> b")

    @F.pandas_udf("int")
    def equal_places(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([equal_letters(p, q) for p, q in zip(a, b, strict=True)], dtype="int32")

    # Dealt anew: an alignment costs much more than its row.
    longer = F.greatest(F.length("a"), F.length("b"))
    scored = pairs.repartition("id", "other").select("id", "other", (equal_places("a", "b") / longer).alias("identity")).where(F.col("identity") >= least).unionByName(equal)
    return scored.groupBy("id").agg(F.min_by("other", F.struct(-F.round("identity", 9), F.col("other"))).alias("best"), F.max("identity").alias("identity")).withColumnRenamed("id", unit)
