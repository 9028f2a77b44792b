"""SimHash fingerprints of word shingles, and near-duplicate groups by deletion variants.

A fingerprint has as many 64-bit words as there are seeds; a bit is 1 if more than half the shingle
hashes have it. Two fingerprints that differ in at most ``max_bits`` of a 64-bit word are found by
cutting it into ``max_bits // 2 + 1`` segments: some segment then differs by at most one bit. Each
segment is indexed once for each of its bits, with that bit deleted, so segments that differ by one
bit or none meet under an equal key. Rows with one key are verified on their whole fingerprints; a
small group gives its linked pairs, a large one the links of a spanning forest, so what is written
stays in proportion to the rows and never to the square of a group. Only distinct fingerprints are
indexed.

Nulls and texts without a word have fingerprint 0 and link with one another like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import saved
from auditframe.llm.components import components
from auditframe.llm.near_sets import least_of_near

#: Groups of up to so many rows give all their linked pairs.
SMALL = 12


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """Hashes of all word shingles, repeats included; of the whole sequence if it is shorter."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([digest(b" ".join(own), seed)], dtype=np.uint64)
    grams = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False))
    return np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64, count=len(own) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """As a signed 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """``id_col`` and fp0, fp1, ... (long), one for each seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"id": batch["id"]}
            for n, seed in enumerate(seeds):
                out[f"fp{n}"] = [fingerprint(shingle_hashes(t, words, seed)) for t in batch["text"]]
            yield pd.DataFrame(out)

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, " + ", ".join(f"fp{n} long" for n in range(len(seeds)))
    return source.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment of 64 bits."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(reps: DataFrame, columns: list[str], max_bits: int) -> DataFrame:
    """A row for each fingerprint word in ``columns``, segment and deleted bit: key and the row."""
    keys = []
    for c, name in enumerate(columns):
        for s, (low, width) in enumerate(segments(max_bits)):
            part = F.shiftrightunsigned(F.col(name), low).bitwiseAND(F.lit((1 << width) - 1))
            place = (c * 64 + s) * 64
            keys += [part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))) + F.lit((place + bit) << 33) for bit in range(width)]
    return reps.select(F.explode(F.array(*keys)).alias("key"), *reps.columns)


def _distance(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    # Unsigned: numpy counts the bits of a signed number's absolute value.
    return [np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16) for x, y in zip(a, b, strict=True)]


def _near(parts: list[np.ndarray], max_bits: int, max_total: int) -> np.ndarray:
    ok = np.minimum.reduce(parts) <= max_bits
    return ok & (sum(parts[1:], parts[0]) <= max_total)


def _forest(ids: np.ndarray, words: list[np.ndarray], max_bits: int, max_total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join each linked part of one group, found by breadth-first search."""
    rest = np.arange(len(ids))
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            some, front = front[:64], front[64:]
            near = _near(_distance([w[some][:, None] for w in words], [w[rest][None, :] for w in words]), max_bits, max_total)
            hit = near.any(axis=0)
            new = rest[hit]
            yield ids[new], np.full(len(new), ids[root])
            rest = rest[~hit]
            front = np.concatenate([front, new])


def near_links(reps: DataFrame, columns: list[str], max_bits: int, max_total: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` between the ids of near fingerprints; their components are exact.

    ``reps``: ``id`` and the fingerprint words, one row per distinct fingerprint. Near: some word
    differs in at most ``max_bits`` bits and all together in at most ``max_total``.
    """
    total = max_bits if max_total is None else max_total

    def linked(key: np.ndarray, ids: np.ndarray, words: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[begins, len(key)])
        size = np.repeat(sizes, sizes)
        small = np.flatnonzero((size > 1) & (size <= SMALL))
        pairs = []
        if len(small):
            k, i, w = key[small], ids[small], [x[small] for x in words]
            for lag in range(1, int(size[small].max())):
                same = np.flatnonzero(k[lag:] == k[:-lag])
                near = same[_near(_distance([x[same] for x in w], [x[same + lag] for x in w]), max_bits, total)]
                pairs.append((i[near], i[near + lag]))
        for begin, n in zip(begins[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            pairs.extend(_forest(ids[begin : begin + n], [x[begin : begin + n] for x in words], max_bits, total))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["key"].iat[-1]
            cut = int(np.searchsorted(batch["key"].to_numpy(), last))
            if cut == 0 and held and held[-1]["key"].iat[-1] == last:
                held.append(batch)
                continue
            head = pd.concat([*held, batch.iloc[:cut]])
            held = [batch.iloc[cut:]]
            if len(head):
                yield from linked(head["key"].to_numpy(), head["id"].to_numpy(), [head[c].to_numpy() for c in columns])
        if held:
            head = pd.concat(held)
            yield from linked(head["key"].to_numpy(), head["id"].to_numpy(), [head[c].to_numpy() for c in columns])

    index = variants(reps.select("id", *columns), columns, max_bits)
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By id, so that forests under different keys have the same roots and most of their links are equal.
    ordered = index.repartition(n, "key").sortWithinPartitions("key", "id")
    return ordered.mapInPandas(run, "a long, b long").distinct()


def near_groups(prints: DataFrame, id_col: str, columns: list[str], max_bits: int, max_total: int | None = None) -> DataFrame:
    """``prints`` with ``component_id``: the smallest id reachable over near fingerprints."""
    reps = prints.groupBy(*columns).agg(F.min(id_col).alias("id"))
    reps = saved(reps, "fingerprints")
    found = components(near_links(reps, columns, max_bits, max_total))
    of_rep = reps.join(found, "id", "left").select(*columns, F.coalesce("component", "id").alias("component_id"))
    return prints.join(of_rep, columns)


def row_numbers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__id``, a number for each id and text: the id itself where it has one text.

    Of several texts of one id, that of the least hash has the id's number; the others get numbers
    beyond all ids.
    """
    own, digest = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    several = docs.groupBy(own.alias("__own")).agg(F.min(digest).alias("__least"), F.max(digest).alias("__most")).where("__least <> __most").select("__own", "__least")
    several = saved(several, "repeated-ids")
    if not several.limit(1).count():
        return docs.withColumn("__id", own)
    numbered = docs.withColumn("__own", own).join(several, "__own", "left")
    beyond = F.lit(1 << 62) + F.pmod(F.xxhash64(own, digest), F.lit(1 << 61))
    return numbered.withColumn("__id", F.when(digest != F.col("__least"), beyond).otherwise(own)).select(*(F.col(f"`{c}`") for c in docs.columns), "__id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest id.

    Near: the sets of word shingles have a Jaccard similarity of at least ``similarity``; a group is a
    component of the near texts. Texts whose fingerprints over distinct shingles differ in at most ``max_bits`` bits are
    found by the index of deletion variants (``near_links``) and verified by their sets; an exact join of the sets
    completes them with the near pairs whose fingerprints are further apart (``near_sets``). Texts without a word are near one another.

    Texts that share an id are documents of their own (``row_numbers``). Of rows equal in id and text one
    stays, that of the least hash of all its columns. Rows with a null id all stay.
    """
    numbered = row_numbers(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    source = numbered.select(F.col("__id").alias("id"), F.col(text_col).alias("text"))
    kept = least_of_near(source, lambda text: np.unique(shingle_hashes(text, words, 42)), similarity, fingerprint, lambda reps: near_links(reps, ["fp0"], max_bits))
    stay = numbered.join(kept.distinct().withColumnRenamed("id", "__id"), "__id", "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = stay.groupBy("__id").count().where("count > 1").select("__id")
    if repeated.limit(1).count():
        one = stay.join(repeated, "__id", "left_semi").groupBy("__id").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
        stay = stay.join(repeated, "__id", "left_anti").select(*columns).unionByName(one)
    return stay.select(*columns).unionByName(docs.where(F.col(id_col).isNull()))
