"""Quality rules: document statistics and gradient-boosted trees over them, with monotonic constraints.

Each whole text gives a few counts (``COUNTS``) and about twenty shares and logarithms made of counts
(``FEATURES``). Plain rules on the counts reject what is short or repeats itself; trees decide the rest.

The trees are grown on the driver from at most ``sample_rows`` labelled rows, of which only the features leave the executors, by
second-order boosting of the logistic loss over binned features. A feature of ``FALLING`` (more repetition, more
symbols) can only lower the score: a split against its direction isn't made, and the values on both sides of one are kept
apart by bounds handed down the tree. The grown trees are flat arrays of nodes; scoring walks all rows and trees
together, one step for each level.

Null and empty texts have no words and fail the plain rules. Rows without a label or with a null one are scored and
never learned from; a document with several labels is learned from with each. Repeated rows get equal results.
With no usable label all scores are 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "log_distinct", "distinct_share", "word_length", "longest_word", "short_words", "symbol_share", "dup_line_share", "repeat_share", "log_lines", "words_a_line", "ended_lines",
    "upper_share", "digit_share", "mark_share", "beyond_ascii", "blank_share", "letters_entropy", "commonest_word", "at_signs",
]
FALLING = ("symbol_share", "dup_line_share", "repeat_share")

_TO_SPACE = bytes.maketrans(BLANKS.encode(), b" " * len(BLANKS))
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


def repeated_words(ids: np.ndarray, distinct: int, window: int = 3) -> int:
    """How many words lie in windows of words that occur twice or more."""
    if len(ids) < window:
        return 0
    code = ids[: len(ids) - window + 1]
    for j in range(1, window):
        if int(code.max()) >= (1 << 62) // distinct:
            code = np.unique(code, return_inverse=True)[1]
        code = code * distinct + ids[j : len(ids) - window + 1 + j]
    _, place, times = np.unique(code, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    begin = np.flatnonzero(times[place] > 1)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts and the features of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = list(filter(None, raw.translate(_TO_SPACE).split(b" ")))
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    n, distinct = len(words), len(number)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(ids, max(distinct, 1))
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    total, w, k = max(len(raw), 1), max(n, 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    letters = bytes_[97:123] + bytes_[65:91]
    shares = letters[letters > 0] / max(int(letters.sum()), 1)
    ended = sum(line.rstrip(BLANKS)[-1] in ".!?:;\"'" for line in lines)
    most = int(np.bincount(ids).max()) if n else 0
    return [n, chars, symbols, dup, repeat], [
        np.log1p(n), np.log1p(distinct), distinct / w, chars / w, np.log1p(int(lengths.max(initial=0))), int((lengths <= 2).sum()) / w, symbols / w, dup / k, repeat / w, np.log1p(len(lines)), np.log1p(n / k), ended / k,
        int(bytes_[65:91].sum()) / total, int(bytes_[48:58].sum()) / total, int(bytes_[_MARKS].sum()) / total, int(bytes_[128:].sum()) / total, int(bytes_[[9, 10, 11, 12, 13, 32]].sum()) / total, float(-(shares * np.log(shares)).sum()), most / w, int(bytes_[64]) / w,
    ]


@dataclass
class Trees:
    """All trees as one array of nodes; a leaf is its own child on both sides."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        z = np.full(len(x), self.base)
        if len(self.roots):
            node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            at = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                node = np.where(x[at, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            z = z + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least_rows: int = 8, falling: tuple[int, ...] = (), rising: tuple[int, ...] = ()) -> Trees:
    """Boosted trees for labels 0 and 1; features in ``falling`` never raise, those in ``rising`` never lower a score."""
    positive = float(y.mean()) if len(y) else 0.0
    base = float(np.clip(np.log(max(positive, 1e-9) / max(1 - positive, 1e-9)), -4, 4)) if len(y) else 0.0
    nodes: list[tuple] = []
    roots = []
    if 0 < positive < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        direction = np.zeros(x.shape[1])
        direction[list(falling)], direction[list(rising)] = -1, 1
        z = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            leaf = _one_tree(codes, edges, p - y, p * (1 - p), nodes, roots, depth, rate, bins, l2, least_rows, direction)
            z += leaf
    columns = list(zip(*nodes, strict=True)) or [[]] * 5
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Trees(base, np.array(roots, dtype=np.int64), *(np.array(c, dtype=k) for c, k in zip(columns, kinds, strict=True)), depth)


def _one_tree(codes, edges, g, h, nodes, roots, depth, rate, bins, l2, least_rows, direction) -> np.ndarray:
    """Append one tree to ``nodes``; what it adds to the score of each row."""
    n, width = codes.shape
    added = np.zeros(n)

    def weight(gs, hs, low, high):
        return np.clip(-gs / (hs + l2), low, high)

    def gain(gs, hs, w):
        return -(gs * w + 0.5 * (hs + l2) * w * w)

    def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
        own, gs, hs = len(nodes), float(g[rows].sum()), float(h[rows].sum())
        w = float(weight(gs, hs, low, high))
        nodes.append((0, 0.0, own, own, rate * w))
        if level < depth and len(rows) >= 2 * least_rows:
            flat = (codes[rows] + np.arange(width) * bins).ravel()
            sums = [np.bincount(flat, weights=np.repeat(v, width), minlength=width * bins).reshape(width, bins).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows)))]
            lw, rw = weight(sums[0], sums[1], low, high), weight(gs - sums[0], hs - sums[1], low, high)
            better = gain(sums[0], sums[1], lw) + gain(gs - sums[0], hs - sums[1], rw) - gain(gs, hs, w)
            allowed = (sums[2] >= least_rows) & (len(rows) - sums[2] >= least_rows) & (direction[:, None] * (rw - lw) >= 0)
            better = np.where(allowed, better, -np.inf)
            f, b = np.unravel_index(int(better.argmax()), better.shape)
            if better[f, b] > 1e-6 and b < len(edges[f]):
                middle = (lw[f, b] + rw[f, b]) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(direction[f])]
                goes = codes[rows, f] <= b
                kids = [build(side, level + 1, *bound) for side, bound in zip((rows[goes], rows[~goes]), bounds, strict=True)]
                nodes[own] = (int(f), float(edges[f][b]), *kids, 0.0)
                return own
        added[rows] = rate * w
        return own

    roots.append(build(np.arange(n), 0, -np.inf, np.inf))
    return added


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000, **options) -> Trees:
    """Grow trees from at most ``sample_rows`` labelled rows where ``learn`` (over ``id_col``) holds, those with the
    least hash of their id; their whole texts count. The driver gets features only."""
    place = F.xxhash64(F.col(id_col).cast("string"), F.lit("rules"))
    known = labels.where(F.col(label_col).isNotNull() & learn).select(F.col(id_col), F.col(label_col).cast("int").alias("__label"))
    chosen = known.orderBy(place, id_col, "__label").limit(sample_rows)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(chosen), id_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"place": batch["place"], "label": batch["__label"], "features": [statistics(t)[1] for t in batch["__text"]]})

    found = rows.select(place.alias("place"), "__label", "__text").mapInPandas(run, "place long, label int, features array<double>")
    # An id can repeat in the documents, so rows are counted once more.
    sample = found.orderBy("place", "label", "features").limit(sample_rows).toPandas()
    x = np.array(sample["features"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return grow(x, sample["label"].to_numpy(dtype=np.float64), falling=tuple(FEATURES.index(f) for f in FALLING), **options)


def judged(docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50, least_score: float = 0.5) -> DataFrame:
    """The id, the counts, ``base_failed`` (fewer than ``least_words`` words, or over ``most_repeated`` percent of them repeated), ``score``
    and ``kept`` of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [statistics(t) for t in batch["text"]]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
            features = np.array([f for _, f in found], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"id": batch["id"], **dict(zip(COUNTS, counts.T, strict=True)), "score": trees.score(features)})

    own = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = read.mapInPandas(run, f"id {own}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least_score))
    return out.withColumnRenamed("id", id_col)
