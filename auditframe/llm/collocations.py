"""Phrase collocations: candidates from a sketch, counted by automata over shards of the texts.

Texts are lower-cased (A-Z only), split at ``. , ; : ! ?`` and line breaks into pieces and those at spaces
and tabs into words; a phrase is 1 to ``longest`` words in a row within a piece. Each language is counted on
its own; a null language is ``und``.

1. The scan deals the texts into shards of about ``shard_bytes``. Each shard counts its phrases in a
   sketch: one counter for each value of a hash of ``width`` values, where ``width`` follows the bytes of all texts. A
   counter holds at least what any of its phrases occurs, so it is an upper bound.
2. Segments of the sketch are summed over the shards, each in one task that holds ``SEGMENT`` counters. A
   shard is sent those of its counters that reach ``least``.
3. Each shard compiles the phrases that meet these counters, guarded by spaces at both ends, into an Aho-Corasick
   automaton and runs it over its texts, overlaps included. The counts are summed over the shards; what does not
   reach ``least`` was a collision of the sketch and goes.

Nothing is broadcast and nothing comes to the driver but the bytes of the texts: shards and segments have a
bounded size, and a phrase that is common everywhere is one entry in each shard. A text longer than a shard is cut
between its pieces.

Null and empty texts count nothing. Repeated rows count as often as they occur. Other columns are ignored. A
table without candidates gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from operator import itemgetter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import drop_saved, saved

#: Lower case, every piece end a line feed, every blank a space; all of these are single bytes of UTF-8.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
SEGMENT = 1 << 22
#: Counters of a sketch at least.
LEAST_WIDTH = 1 << 24
BLOCK = 1 << 16

DEALT = "kind string, shard long, lang string, words long, text binary, segment int, low binary, blocks binary, counts binary"


def plain_parts(text: str, size: int) -> Iterator[bytes]:
    """A text in plain form; one longer than ``size`` in parts that end between pieces."""
    raw = text.encode("utf-8", "replace").translate(PLAIN)
    while len(raw) > size:
        at = raw.rfind(b"\n", 0, size)
        at = at if at > 0 else raw.find(b"\n", size)
        if at < 0:
            break
        yield raw[:at]
        raw = raw[at + 1 :]
    yield raw


class Words:
    """The words of plain texts as numbers; 0 stands between pieces."""

    def __init__(self, raw: bytes):
        self.words = list(filter(None, raw.replace(b"\n", b" \n ").split(b" ")))
        number = defaultdict(count().__next__)
        number[b"\n"]
        self.ids = np.fromiter(map(number.__getitem__, self.words), dtype=np.int64, count=len(self.words))
        self.distinct = list(number)

    def counters(self, lang: str, longest: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``longest`` words: whether a phrase begins at each word, and its counter in the sketch."""
        import xxhash

        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
        own = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.distinct], dtype=np.uint64)[self.ids]
        inside = self.ids != 0
        valid, h = inside, mixed(own)
        for n in range(1, longest + 1):
            if n > 1:
                if len(h) < 2:
                    return
                valid = valid[:-1] & inside[n - 1 :]
                h = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[n - 1 :])
            yield valid, h & np.uint64(width - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def packed(counters: np.ndarray) -> Iterator[tuple[int, slice, bytes, bytes]]:
    """Sorted distinct counters by segment: its number, which they are, their low 16 bits, and how many have
    each higher part."""
    if not len(counters):
        return
    segment = (counters // SEGMENT).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(counters)], strict=True):
        inside = (counters[a:b] % SEGMENT).astype(np.int64)
        blocks = np.bincount(inside // BLOCK, minlength=SEGMENT // BLOCK).astype(np.uint32)
        yield int(segment[a]), slice(a, b), (inside % BLOCK).astype(np.uint16).tobytes(), blocks.tobytes()


def unpacked(low: bytes, blocks: bytes) -> np.ndarray:
    high = np.repeat(np.arange(SEGMENT // BLOCK, dtype=np.int64) * BLOCK, np.frombuffer(blocks, dtype=np.uint32))
    return high + np.frombuffer(low, dtype=np.uint16)


def sketched(texts: dict[str, list[bytes]], shard: int, longest: int, width: int, least: int) -> Iterator[pd.DataFrame]:
    """The rows of one shard: its texts by language, and its part of the sketch by segment."""
    names = [c.split()[0] for c in DEALT.split(", ")]
    rows, found = [], []
    for lang, parts in texts.items():
        raw = b"\n".join(parts)
        words = Words(raw)
        for n, (valid, counters) in enumerate(words.counters(lang, longest, width), 1):
            found.append(counters[valid])
            if n == 1:
                rows.append(("text", shard, lang, int(valid.sum()), zstandard.compress(raw, 1), None, None, None, None))
    yield pd.DataFrame(rows, columns=names)
    every = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    every.sort()
    begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, dtype=np.int64)
    times = np.minimum(np.diff(np.r_[begin, len(every)]), least).astype(np.uint32)
    every = every[begin]
    rows = [("sketch", shard, None, None, None, k, low, blocks, times[own].astype(np.min_scalar_type(least)).tobytes()) for k, own, low, blocks in packed(every)]
    yield pd.DataFrame(rows, columns=names)


def heavy_counters(pieces: pd.DataFrame, least: int) -> pd.DataFrame:
    """One segment: the counters of each shard whose sum over all shards reaches ``least``."""
    total = np.zeros(SEGMENT, dtype=np.min_scalar_type(2 * least))
    for low, blocks, counts in zip(pieces["low"], pieces["blocks"], pieces["counts"], strict=True):
        places = unpacked(low, blocks)
        total[places] = np.minimum(total[places] + np.frombuffer(counts, dtype=np.min_scalar_type(least)), least)
    rows = []
    for shard, segment, low, blocks in zip(pieces["shard"], pieces["segment"], pieces["low"], pieces["blocks"], strict=True):
        places = unpacked(low, blocks)
        for _, _, kept, filled in packed(places[total[places] >= least]):
            rows.append((shard, segment, kept, filled))
    return pd.DataFrame(rows, columns=["shard", "segment", "low", "blocks"])


class Members:
    """Fast membership in a sorted array of counters."""

    def __init__(self, sorted_values: np.ndarray):
        self.values = sorted_values
        self.bits = max(16, int(len(sorted_values)).bit_length() + 3)
        self.maybe = np.zeros(1 << self.bits, dtype=bool)
        self.maybe[self.slot(sorted_values)] = True

    def slot(self, values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def of(self, values: np.ndarray) -> np.ndarray:
        found = self.maybe[self.slot(values)]
        at = np.flatnonzero(found)
        place = np.minimum(np.searchsorted(self.values, values[at]), max(len(self.values) - 1, 0))
        found[at] = self.values[place] == values[at]
        return found


def counted(raw: bytes, lang: str, members: Members, longest: int, width: int) -> list[tuple[int, str, int]]:
    """Words and phrases of one shard and language that meet the given counters, with their occurrences."""
    words = Words(raw)
    ids, rows, phrases, before, pairs = words.ids, [], [], None, None
    for n, (valid, counters) in enumerate(words.counters(lang, longest, width), 1):
        live = valid & members.of(counters)
        if n == 1:
            times = np.bincount(ids[live], minlength=len(words.distinct))
            rows += [(1, words.distinct[i].decode("utf-8", "replace"), int(times[i])) for i in np.flatnonzero(times)]
        else:
            live &= before[:-1] & before[1:]  # no phrase is more frequent than its parts
            at = np.flatnonzero(live)
            if n == 2:
                _, first, code = np.unique(ids[at] * len(words.distinct) + ids[at + 1], return_index=True, return_inverse=True)
                pairs = np.full(len(live), -1, dtype=np.int64)
                pairs[at] = code
                codes = np.full(len(live), -1, dtype=np.int64)
                codes[at] = code
            else:
                _, first, code = np.unique(codes[at] * (int(pairs.max(initial=0)) + 1) + pairs[at + n - 2], return_index=True, return_inverse=True)
                codes = np.full(len(live), -1, dtype=np.int64)
                codes[at] = code
            phrases += [(n, b" ".join(words.words[i : i + n]).decode("utf-8", "replace")) for i in at[first]]
        before = live
    return rows + matched(phrases, b" ".join(words.words).decode("utf-8", "replace"))


def matched(phrases: list[tuple[int, str]], text: str) -> list[tuple[int, str, int]]:
    """Occurrences of phrases of whole words in a text of words with single spaces."""
    import ahocorasick

    if not phrases:
        return []
    automaton = ahocorasick.Automaton()
    for i, (_, phrase) in enumerate(phrases):
        automaton.add_word(f" {phrase} ", i)
    automaton.make_automaton()
    times = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(f" {text} ")), dtype=np.int64), minlength=len(phrases))
    return [(n, phrase, int(k)) for (n, phrase), k in zip(phrases, times, strict=True)]


def phrase_counts(docs: DataFrame, *, least: int = 30, longest: int = 4, shard_bytes: int = 4 << 20, counter_bytes: float = 4.0, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with at least ``least`` occurrences: lang, words, phrase, f; and the
    words of each language: lang, n. The sketch has a counter for every ``counter_bytes`` of text at least."""
    from pyspark import TaskContext

    read = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(LEAST_WIDTH, 1 << int(size / counter_bytes).bit_length())

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, texts = TaskContext.get().partitionId() << 32, 0, {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for part in plain_parts(text, shard_bytes):
                    if held and held + len(part) > shard_bytes:
                        yield from sketched(texts, shard, longest, width, least)
                        shard, held, texts = shard + 1, 0, {}
                    texts.setdefault(lang, []).append(part)
                    held += len(part)
        yield from sketched(texts, shard, longest, width, least)

    dealt = saved(read.mapInPandas(deal, DEALT), "collocation-shards", "kind")
    pieces = dealt.where("kind = 'sketch'").select("shard", "segment", "low", "blocks", "counts")
    heavy = pieces.groupBy("segment").applyInPandas(lambda own: heavy_counters(own, least), "shard long, segment int, low binary, blocks binary")

    def scan(texts: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        sent = sent.sort_values("segment")
        parts = [(unpacked(low, blocks) + segment * SEGMENT).astype(np.uint64) for segment, low, blocks in zip(sent["segment"], sent["low"], sent["blocks"], strict=True)]
        rows = []
        if parts:
            members = Members(np.concatenate(parts))
            for lang, raw in zip(texts["lang"], texts["text"], strict=True):
                rows += [(lang, *row) for row in counted(zstandard.decompress(raw), lang, members, longest, width)]
        return pd.DataFrame(rows, columns=["lang", "words", "phrase", "f"])

    texts = dealt.where("kind = 'text'").select("shard", "lang", "text")
    found = texts.groupBy("shard").cogroup(heavy.groupBy("shard")).applyInPandas(scan, "lang string, words int, phrase string, f long")
    counts = saved(found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "collocation-counts")
    totals = saved(dealt.where("kind = 'text'").groupBy("lang").agg(F.sum("words").alias("n")), "collocation-words")
    drop_saved(dealt)
    return counts, totals


def collocations(docs: DataFrame, *, top: int = 2000, absorbed: tuple[int, int] = (80, 100), longest: int = 4, **options) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase that occurs a times is cut after k words into parts that occur l and r times; its score
    is floor(2,000,000 a / (l + r)) at the lowest-scoring cut, the first of equals. A phrase inside a longer one is
    left out if that has at least ``absorbed`` (80 of 100) of its occurrences, whether that one is left out or not. First
    come high scores, then many occurrences, then the order of bytes. All arithmetic is of integers, in 38 decimal digits.
    """
    counts, totals = phrase_counts(docs, longest=longest, **options)
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("parts"))

    def part(first, n):
        return F.array_join(F.slice("parts", first, n), " ")

    cuts = phrases.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.col("words") - k).alias("tail")))).alias("cut")).select("lang", "phrase", "a", "cut.*")
    heads, tails = (counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(as_)) for name, as_ in (("head", "l"), ("tail", "r")))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    scored = scored.withColumn("score", F.expr("CAST(a AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: part(at, n))))
    longer = phrases.where("words >= 3").select("lang", F.col("a").alias("whole"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    share, base = absorbed
    big = "DECIMAL(19,0)"
    inside = F.expr(f"CAST(whole AS {big}) * {base} >= CAST(a AS {big}) * {share}")
    left = worst.join(longer, ["lang", "phrase"], "left").where(F.col("whole").isNull() | ~inside)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
