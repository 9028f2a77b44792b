"""A Katz backoff model of any order: counts, Good-Turing discounts, exact backoff weights and scores.

A text is its words and one end token; before its first word come starts of the text. A history h is the
words before a token, one less than the order of them; h' is h without its first word. With c a count in
the training texts and c* a discounted count, each order goes back to the one below, down to words:

    p(w | h) = c*(h, w) / c(h)            if (h, w) was seen,
               alpha(h) * p(w | h')       else, with alpha(h) = 1 for a history never seen,
    p(w)     = c*(w) / N                  if w was seen, else the mass that discounting left,

which one class of unseen words shares. In each order counts up to ``k`` are discounted by Katz's Good-Turing
ratios, larger ones by the constant ``tail``, so that every history keeps some mass.
alpha(h) = (1 - sum of p(w | h) over seen w) / (1 - sum of p(w | h') over the same w), summed exactly, so the
probabilities after any history add up to 1.

Texts are tokenized once and kept in sendings of about a million tokens: the words of a sending, and its tokens as
numbers of words. Word counts are aggregated from them first. Then each distinct n-gram of a sending is sent once, to the bucket
of its word, as the hashes of its word and histories and its number in training texts; a word with very many tokens is
spread over all buckets by the word before. Words go to buckets by ranges of their hashes, so that a sending takes the same bytes
for any number of buckets. A bucket has all n-grams of its words. It adds them up and keeps
the counts: of each word, of each pair under its word, of each triple under its pair and so on. It also answers each
sending with the counts of what that one sent, in the same order. One table, partitioned by kind, holds the counts of n-grams, the
answers and the counts of counts. A sending then meets its answers, and its texts are scored token by token.

The backoff weights come from the
stored counts of n-grams, which are then discounted and summed by history. Only n-grams never seen
in training need them; a token that goes back meets the weight of each history on its way in a join.

An n-gram that is very common is still sent once by a sending, so no bucket grows with its share of the corpus in order two;
in higher orders it can by the rarer n-grams that end in one common pair.

Words are known by 52 bits of a hash, longer histories by 64, and texts by 64 bits of a hash of id and text; equal rows share
one and their sums are divided by their number. Null texts are empty texts: one end token. With no
training text every token has probability 1 of being unseen and ``score`` is 0. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import drop_saved, saved
from auditframe.llm.repeats import _known, gram_filter, mixed, row_key

START, END, BITS = 0, 1, 52
#: Tokens of a sending, and tokens for each bucket.
FLUSH, BUCKET_TOKENS = 1_000_000, 700_000
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000


class Codes(dict):
    """Hashes of words; 0 and 1 stand for the start and the end of a text."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = 2 + xxhash.xxh3_64_intdigest(word) % ((1 << BITS) - 2)
        return code


class Places(dict):
    """Numbers of words in the order in which they come, after the start and the end of a text."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = 2 + len(self)
        return place


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def coded(texts: list, codes: Codes | Places) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts, each with its end, and the number of tokens of each."""
    parts, sizes = [], np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        own = words(text)
        sizes[i] = len(own) + 1
        parts.append(np.fromiter(map(codes.__getitem__, own), dtype=np.int64, count=len(own)))
        parts.append(_END)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), sizes


_END = np.array([END], dtype=np.int64)


def histories(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.cumsum(sizes) - sizes] = START
    return h


def contexts(w: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """The history of each token of one word, of two and so on, to one word less than ``order``."""
    out, start = [histories(w, sizes)], np.array([START])
    for _ in range(order - 2):
        start = pair_codes(_END, start)  # no history has an end; START with START would have the code of START again
        h = np.empty_like(w)
        h[1:] = pair_codes(w, out[-1])[:-1]
        h[np.cumsum(sizes) - sizes] = start
        out.append(h)
    return out


def discounted(counts_of_counts: dict[int, int], k: int, tail: float) -> np.ndarray:
    """Discounted counts for 0 to k; where the ratios don't exist, counts less one half."""
    n = [counts_of_counts.get(r, 0) for r in range(k + 2)]
    plain = np.array([0.0] + [r - 0.5 for r in range(1, k + 1)])
    if not n[1] or (k + 1) * n[k + 1] >= n[1]:
        return plain
    common = (k + 1) * n[k + 1] / n[1]
    for r in range(1, k + 1):
        if n[r]:
            value = ((r + 1) * n[r + 1] / n[r] - r * common) / (1 - common)
            if 0 < value <= r - tail / 2:
                plain[r] = value
    return plain


def star(c: np.ndarray, small: np.ndarray, tail: float) -> np.ndarray:
    k = len(small) - 1
    return np.where(c <= k, small[np.minimum(c, k)], c - tail)


def pair_codes(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(mixed(w.astype(np.uint64)) ^ (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes of like significance together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


def stored_grams(grams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each order: the places of the n-grams without their first word in the order below, hashes and counts.

    The hash is the word's in the lowest order and the history's in the others.
    """
    numbers = [_numbers(x) for x in grams]
    out = [(np.zeros(len(numbers[0]), dtype=np.int64), np.cumsum(numbers[0]), numbers[1])]
    for children, hashes, counts in zip(numbers[2::3], numbers[3::3], numbers[4::3], strict=True):
        out.append((np.repeat(np.arange(len(children)), children), np.cumsum(hashes), counts))
    return out


class Grams:
    """The distinct longest n-grams of a sending, in the order of their buckets.

    ``w``: the words; ``hs``: histories, the shortest first, of which the n-grams have those at ``h``; ``at``: the n-gram of each token.
    """

    def __init__(self, row: dict, model: dict):
        self.sizes = _numbers(row["sizes"])
        codes, rank = np.unique(_numbers(row["words"]), return_inverse=True)
        w = rank[_numbers(row["tokens"])]
        if model["order"] == 2:
            self.hs, h = [codes], histories(w, self.sizes)  # the start is the lowest code
        else:
            hs = contexts(codes[w], self.sizes, model["order"])
            _, first, h = np.unique(hs[-1], return_index=True, return_inverse=True)
            self.hs = [x[first] for x in hs]
            del hs
        n = len(self.hs[-1])
        w *= n
        w += h
        grams, place = np.unique(w, return_inverse=True)
        w, h = codes[grams // n], grams % n
        bucket = self.buckets(w, model)
        if len(model["hot"]):
            spread = model["hot"][np.minimum(np.searchsorted(model["hot"], w), len(model["hot"]) - 1)] == w
            bucket[spread] = self.buckets((mixed(self.hs[0][h[spread]].astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64), model)
        order = np.argsort(bucket, kind="stable")
        self.w, self.h, self.bucket = w[order], h[order], bucket[order]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.at = back[place]

    @staticmethod
    def buckets(codes: np.ndarray, model: dict) -> np.ndarray:
        return (codes >> (BITS - 32)) * model["n_buckets"] >> 32

    def pieces(self, sending: int, learnt: np.ndarray) -> Iterator[pd.DataFrame]:
        """What each bucket gets."""
        weight = np.bincount(self.at, weights=np.repeat(learnt, self.sizes), minlength=len(self.w)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]])
        for lo, hi in zip(begin, np.r_[begin[1:], len(self.w)], strict=True):
            w = self.w[lo:hi]
            new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            once, at = np.unique(self.h[lo:hi], return_inverse=True)
            data = [np.diff(w[new], prepend=0), np.diff(new, append=hi - lo), *(np.diff(h[once], prepend=0) for h in self.hs), at, weight[lo:hi]]
            yield pd.DataFrame({"bucket": [self.bucket[lo]], "sending": [sending], "data": [[_planes(x) for x in data]]})


def piece_grams(data: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words, histories and numbers in training texts of a piece's n-grams."""
    new, runs, *hs, at, weight = map(_numbers, data)
    return np.repeat(np.cumsum(new), runs), [np.cumsum(h)[at] for h in hs], weight


class Bucket:
    """What one bucket's n-grams return; see the module's text."""

    def __init__(self, model: dict):
        self.m = model

    def solve(self, w, hs, doc, keys, weight) -> Iterator[pd.DataFrame]:
        """``hs`` are the n-grams' histories, the shortest first; ``doc`` is a place in ``keys``, the sendings, in ascending order;
        ``weight`` is the n-gram's number in training texts of the sending."""
        m, k, top = self.m, self.m["k"], self.m["order"]
        order = np.lexsort((*hs[::-1], w))
        w, hs, weight = w[order], [h[order] for h in hs], weight[order]
        new = np.r_[True, w[1:] != w[:-1]]
        begins, places = [np.flatnonzero(new)], [np.cumsum(new) - 1]
        for h in hs:
            new = new | np.r_[True, h[1:] != h[:-1]]
            begins.append(np.flatnonzero(new))
            places.append(np.cumsum(new) - 1)
        counts = [np.add.reduceat(weight, begin) for begin in begins]
        if len(m["hot"]):
            at = np.minimum(np.searchsorted(m["hot"], w[begins[0]]), len(m["hot"]) - 1)
            hot = m["hot"][at] == w[begins[0]]
            counts[0][hot] = m["hot_counts"][at[hot]]
        # Answers: the counts in the order in which the n-grams came
        ends = np.searchsorted(doc, np.arange(len(keys) + 1))
        answers = [[] for _ in keys]
        for count_of, place in zip(counts, places, strict=True):
            own = np.empty_like(weight)
            own[order] = count_of[place]
            for i, answer in enumerate(answers):
                answer.append(_planes(own[ends[i] : ends[i + 1]]))
        yield pd.DataFrame({"kind": "answer", "key": keys, "grams": answers})
        # Counts of n-grams, each order under the one below
        grams = [_planes(np.diff(w[begins[0]][counts[0] > 0], prepend=0)), _planes(counts[0][counts[0] > 0])]
        for o in range(2, top + 1):
            begin, own, below = begins[o - 1], counts[o - 1], counts[o - 2]
            seen = own > 0
            small = own[seen & (own <= k + 1)]
            yield pd.DataFrame({"kind": "counts", "key": np.arange(k + 2), "other": o, "n": np.bincount(small, minlength=k + 2)})
            children = np.bincount(places[o - 2][begin[seen]], minlength=len(below))[below > 0]
            grams += [_planes(children), _planes(np.diff(hs[o - 2][begin[seen]], prepend=0)), _planes(own[seen])]
        yield pd.DataFrame({"kind": ["grams"], "key": [int((counts[-1] > 0).sum())], "grams": [grams]})


class Scores:
    """Scores of a sending's texts from the answers; n-grams that go back need the weights of their histories yet."""

    def __init__(self, model: dict, smalls: list[np.ndarray]):
        self.m, self.smalls = model, smalls

    def of(self, row: dict, answers: list[list[bytes]]) -> Iterator[pd.DataFrame]:
        m, top = self.m, self.m["order"]
        grams = Grams(row, m)
        counts = [np.concatenate([_numbers(x[o]) for x in answers]) for o in range(top)]
        # The longest n-gram that was seen decides; the count of the longest history is that of the n-gram before.
        c, before = counts[0], counts[-2]
        level = np.ones(len(c), dtype=np.int8)
        for o in range(2, top + 1):
            level[counts[o - 1] > 0] = o
        base = np.log10((c + 0.1) / m["base"])
        rest = np.where((before > 0) & (grams.w != END), -np.log10(np.maximum(before, 1)), 0.0)
        for o in range(1, top + 1):
            use = (level == o) & (counts[o - 1] > 0)
            rest[use] += np.log10(star(counts[o - 1][use], self.smalls[o - 1], m["tail"]) / (m["N"] if o == 1 else 1))
        rest[(level == 1) & (c == 0)] += math.log10(m["unseen"]) if m["unseen"] > 0 else -math.inf
        begins, keys = np.cumsum(grams.sizes) - grams.sizes, _numbers(row["keys"])
        total = lambda x: np.add.reduceat(x[grams.at], begins)
        yield pd.DataFrame({"kind": "text", "key": keys, "n": grams.sizes, "known": total((c > 0).astype(np.int64)), "base": total(base), "score": total(rest)})
        # N-grams never seen in training: how often alpha (n) and how often a division by the history's count (known).
        # That of the longest is in the texts' sums.
        lost = np.flatnonzero((level < top)[grams.at])
        doc, at = np.repeat(keys, grams.sizes)[lost], grams.at[lost]
        level, h = level[at], grams.h[at]
        for size, codes in enumerate(grams.hs, 1):
            longest = size == len(grams.hs)
            use = level <= size + (not longest)
            if use.any():
                out = pd.DataFrame({"key": doc[use], "other": codes[h[use]], "n": (level[use] <= size).astype(np.int64), "known": int(not longest)})
                yield out.groupby(["key", "other"], sort=False).sum().reset_index().assign(kind="unseen")


def katz_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", *, order: int = 2, k: int = 5, tail: float = 0.1, filter_bits: int = 1 << 26, bucket_tokens: int = BUCKET_TOKENS, least_common: int | None = None) -> DataFrame:
    """``id_col``, learnt, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``order``: words of the longest n-grams, 2 at least. ``learn``: a condition over the columns of ``docs``; its rows are the training texts. ``bucket_tokens``:
    tokens of a bucket. ``least_common`` is accepted for older callers: common n-grams no longer take a way of their own.
    """
    if order < 2:
        raise ValueError("order is 2 at least")
    keyed = docs.select(F.col(id_col), row_key(id_col, text_col)[0].alias("key"), F.coalesce(learn, F.lit(False)).alias("learnt"), F.col(text_col).alias("text"))
    ids, texts = keyed.select(id_col, "key", "learnt"), keyed.select("key", "learnt", "text")

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sendings."""
        codes, places, held, size, numbers = Codes(), Places(), [], 0, count()

        def closed() -> pd.DataFrame:
            tokens, sizes, keys, learnt = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            own = np.r_[START, END, np.fromiter(map(codes.__getitem__, places), dtype=np.int64, count=len(places))]
            places.clear()
            if len(codes) > REMEMBERED:
                codes.clear()
            n = np.bincount(tokens, weights=np.repeat(learnt, sizes), minlength=len(own)).astype(np.int64)
            data = {"keys": keys, "learnt": learnt, "sizes": sizes, "words": own, "counts": n, "tokens": tokens}
            sending = (TaskContext.get().partitionId() << 32) | next(numbers)
            return pd.DataFrame({"sending": [sending], "n": [len(tokens)]} | {c: [_planes(x)] for c, x in data.items()})

        for batch in batches:
            tokens, sizes = coded(batch["text"].tolist(), places)
            held.append((tokens.astype(np.int32), sizes, batch["key"].to_numpy(), batch["learnt"].to_numpy(dtype=bool)))
            size += len(tokens)
            if size >= FLUSH:
                yield closed()
                size = 0
        if held:
            yield closed()

    sendings = saved(texts.mapInPandas(gathered, "sending long, n long, keys binary, learnt binary, sizes binary, words binary, counts binary, tokens binary"), "katz-sendings")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, n in zip(batch["words"], batch["counts"], strict=True):
                own, n = _numbers(own), _numbers(n)
                yield pd.DataFrame({"w": own[n > 0], "n": n[n > 0]})

    counts = saved(sendings.select("words", "counts").mapInPandas(counted, "w long, n long").groupBy("w").agg(F.sum("n").alias("c")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count("*").alias("V"), F.coalesce(F.max(F.when(F.col("w") == END, F.col("c"))), F.lit(0)).alias("D")).first()
    if not total["N"]:
        drop_saved(sendings, counts)
        return _untrained(keyed, id_col)
    few = {r["c"]: r["count"] for r in counts.where(F.col("c") <= k + 1).groupBy("c").count().collect()}
    small = discounted(few, k, tail)
    kept = counts.agg(F.sum(F.when(F.col("c") > k, F.col("c") - tail).otherwise(F.element_at(F.lit(small.tolist()), F.least(F.col("c") + 1, F.lit(k + 1)).cast("int"))))).first()[0]
    # Texts that are not learnt from fill the same buckets.
    held = sendings.agg(F.count("*").alias("sendings"), F.sum("n").alias("tokens")).first()
    n_buckets = max(1, math.ceil(held["tokens"] / bucket_tokens))
    hot = counts.where(F.col("c") > total["N"] / (2 * n_buckets)).orderBy("w").toPandas()
    drop_saved(counts)

    model = {
        "order": order, "k": k, "tail": tail, "N": total["N"], "small": small, "unseen": (total["N"] - kept) / total["N"], "base": total["N"] + 0.1 * (total["V"] + 1),
        "hot": hot["w"].to_numpy(dtype=np.int64), "hot_counts": hot["c"].to_numpy(dtype=np.int64), "n_buckets": n_buckets,
    }

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield from Grams(row, model).pieces(row["sending"], _numbers(row["learnt"]))

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, bucket = None, [], Bucket(model)

        def taken() -> tuple:
            """What the bucket's pieces hold; the pieces go."""
            keys, parts = np.array([r["sending"] for r in held]), [piece_grams(r["data"]) for r in held]
            held.clear()
            w, hs, weight = zip(*parts, strict=True)
            doc = np.repeat(np.arange(len(keys)), [len(x) for x in w])
            return np.concatenate(w), [np.concatenate(h) for h in zip(*hs, strict=True)], doc, keys, np.concatenate(weight)

        def closed() -> Iterator[pd.DataFrame]:
            if held:
                for part in bucket.solve(*taken()):
                    part = part.assign(other=number) if part["kind"].iat[0] == "answer" else part
                    yield part.reindex(columns=columns, fill_value=0).assign(grams=part["grams"] if "grams" in part else None)

        for batch in batches:
            for row in batch.to_dict("records"):
                if row["bucket"] != number:
                    yield from closed()
                    number, held = row["bucket"], []
                held.append(row)
        yield from closed()

    columns = ["kind", "key", "other", "n", "grams"]
    pieces = sendings.select("sending", "learnt", "sizes", "words", "tokens").mapInPandas(sent, "bucket long, sending long, data array<binary>")
    n_tasks = max(1, math.ceil(n_buckets / 4))
    parts = saved(pieces.repartition(n_tasks, "bucket").sortWithinPartitions("bucket").mapInPandas(solved, "kind string, key long, other long, n long, grams array<binary>"), "katz-parts", "kind")

    few = {o: {} for o in range(2, order + 1)}
    for r in parts.where("kind = 'counts' AND n > 0").groupBy("other", "key").agg(F.sum("n").alias("n")).collect():
        few[r["other"]][r["key"]] = r["n"]
    smalls = [small, *(discounted(few[o], k, tail) for o in range(2, order + 1))]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A sending comes before its answers, which are in the order of their buckets."""
        sending, answers, scores = None, [], Scores(model, smalls)

        def closed() -> Iterator[pd.DataFrame]:
            if sending is not None:
                for part in scores.of(sending, answers):
                    yield part.reindex(columns=["kind", "key", "other", "n", "known", "base", "score"], fill_value=0)

        for batch in batches:
            for row in batch.to_dict("records"):
                if row["bucket"] < 0:
                    yield from closed()
                    sending, answers = row, []
                else:
                    answers.append(row["grams"])
        yield from closed()

    asked = sendings.select("sending", F.lit(-1).cast("long").alias("bucket"), "keys", "sizes", "words", "tokens")
    answers = parts.where("kind = 'answer'").select(F.col("key").alias("sending"), F.col("other").alias("bucket"), "grams")
    both = asked.unionByName(answers, allowMissingColumns=True).repartition(held["sendings"], "sending").sortWithinPartitions("sending", "bucket")
    scores = saved(both.mapInPandas(scored, "kind string, key long, other long, n long, known long, base double, score double"), "katz-scores", "kind")
    drop_saved(sendings)
    own = scores.where("kind = 'text'").select("key", F.lit(1).alias("copies"), "n", "known", "base", "score")
    unseen = scores.where("kind = 'unseen'").select("key", "other", "n", "known")
    used = gram_filter(unseen.select(F.col("other").alias("h")), filter_bits)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each history that a token goes back from: its count and the two sums in alpha. In the second, counts of
        the order below are yet to be divided by that of the shorter history."""
        for batch in batches:
            for grams in batch["grams"]:
                levels = stored_grams(grams)
                for o in range(2, order + 1):
                    (_, shorter, below), (parent, own, c) = levels[o - 2 : o]
                    use = _known(used, own)
                    parent, own, c = parent[use], own[use], c[use]
                    ids, first, back = np.unique(own, return_index=True, return_inverse=True)
                    lower = star(below[parent], smalls[o - 2], tail) / (total["N"] if o == 2 else 1)
                    sums = {name: np.bincount(back, weights=x, minlength=len(ids)) for name, x in (("c", c), ("kept", star(c, smalls[o - 1], tail)), ("lower", lower))}
                    yield pd.DataFrame({"other": ids, "size": o - 1, "shorter": shorter[parent[first]]} | sums)

    history = parts.where("kind = 'grams'").select("grams").mapInPandas(weighed, "other long, size int, shorter long, c double, kept double, lower double")
    history = history.groupBy("other").agg(F.first("size").alias("size"), F.first("shorter").alias("shorter"), *(F.sum(c).alias(c) for c in ("c", "kept", "lower")))
    if order > 2:
        history = saved(history, "katz-histories")
        of_shorter = history.select(F.col("other").alias("shorter"), F.col("c").alias("c_shorter"))
        history = history.join(of_shorter, "shorter", "left").withColumn("lower", F.when(F.col("size") == 1, F.col("lower")).otherwise(F.col("lower") / F.col("c_shorter")))
    # Of alpha(h) = (1 - kept / c) / (1 - lower), c(h) is divided by apart.
    alpha = history.select("other", F.log10((F.col("c") - F.col("kept")) / (1 - F.col("lower"))).alias("log_alpha"), F.log10("c").alias("log_c"))
    back = F.when(F.col("n") > 0, F.col("n") * F.col("log_alpha")).otherwise(0.0) - F.col("known") * F.col("log_c")
    backed = unseen.join(alpha, "other").groupBy("key").agg(F.sum(back).alias("score"))
    zero = F.lit(0).cast("long")
    every = own.unionByName(backed.select("key", F.lit(0).alias("copies"), zero.alias("n"), zero.alias("known"), F.lit(0.0).alias("base"), "score"))
    sums = ("n", "known", "base", "score")
    every = every.groupBy("key").agg(F.sum("copies").alias("copies"), *(F.sum(c).alias(c) for c in sums))
    every = every.select("key", *((F.col(c) / F.col("copies")).alias(c) for c in sums))
    return ids.join(every, "key").select(
        id_col, "learnt", F.round("n").cast("long").alias("n_tokens"), F.round("known").cast("long").alias("n_known"), F.lit(total["N"]).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("score") - math.log10(total["D"])).alias("score"),
    )


def _untrained(keyed: DataFrame, id_col: str) -> DataFrame:
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1
    return keyed.select(id_col, "learnt", n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), (n * 0.0).alias("base_score"), (n * 0.0).alias("score"))
