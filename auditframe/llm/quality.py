"""A byte-level convolutional network for document quality, in numpy.

Learned filters of a few bytes' width run over every byte of the UTF-8 text. Their outputs are
max-pooled over chunks of 256 bytes that overlap by half and together cover the whole document; the
mean and the maximum over the chunks feed one logistic unit, so a document of any length gets one
probability. Documents are padded with a symbol of weight zero, never cut.

Training uses a bounded sample of labelled rows, those with the least keyed hash of their id: at most
``sample_rows`` of them, and no more than have ``sample_bytes`` bytes of text together. Each of them is
learned from as a whole, in chunks like those of scoring. The same bounds hold at every input size. The
fitted model is a few hundred kilobytes and is shipped to the tasks.

Null and empty texts are one chunk of padding and get a score like any other. Rows without a label
or with a null one are scored and never learned from. Repeated rows get equal scores; if a document
has several labels, each is learned from. With no usable label all scores are 0.5. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import drop_saved, saved

HALF, PAD = 128, 256


@dataclass
class Network:
    filters: np.ndarray  # width x 257 x filters; the padding symbol's row is zero
    bias: np.ndarray
    head: np.ndarray  # two numbers a filter and a constant

    def halves(self, codes: np.ndarray) -> np.ndarray:
        """Greatest output of each filter over each run of HALF symbols."""
        width, _, n = self.filters.shape
        codes = np.concatenate([codes, np.full(width - 1, PAD, dtype=codes.dtype)])
        size = len(codes) - width + 1
        out = np.empty((size // HALF, n), dtype=np.float32)
        for rows, total in self.outputs(codes, size):
            out[rows] = total.max(axis=1)
        return out

    def outputs(self, codes: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Outputs at the first ``size`` symbols, some half chunks at a time: their numbers, and for each
        its symbols by filters. ``codes`` reach a filter's width beyond."""
        width, _, n = self.filters.shape
        step = 256 * HALF
        for at in range(0, size, step):
            m = min(step, size - at)
            total = self.filters[0].take(codes[at : at + m], axis=0)
            for j in range(1, width):
                total += self.filters[j].take(codes[at + j : at + j + m], axis=0)
            yield slice(at // HALF, (at + m) // HALF), total.reshape(-1, HALF, n)

    def score(self, texts: list) -> np.ndarray:
        codes, counts = padded([(t or "").encode("utf-8", "replace") for t in texts], len(self.filters) - 1)
        pooled = np.maximum(self.halves(codes) + self.bias, 0)
        mean, top = over_chunks(pooled, counts)
        z = np.concatenate([mean, top], axis=1) @ self.head[:-1] + self.head[-1]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -60, 60)))


def padded(raw: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind one another, each padded to whole half chunks; half chunks of each.

    A text comes after ``least`` symbols of padding, so no filter reaches from one into the next.
    """
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    counts = np.maximum(1, -(-(lengths + least) // HALF))
    codes = np.full(int(counts.sum()) * HALF, PAD, dtype=np.int16)
    joined = np.frombuffer(b"".join(raw), dtype=np.uint8)
    begin = (np.cumsum(counts) - counts) * HALF + least
    place = np.arange(len(joined)) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    codes[place] = joined
    return codes, counts


def chunk_places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second half of each chunk, and where each document's chunks begin."""
    chunks = np.maximum(counts - 1, 1)
    first = np.arange(chunks.sum()) + np.repeat((np.cumsum(counts) - counts) - (np.cumsum(chunks) - chunks), chunks)
    second = first + np.repeat(counts > 1, chunks)
    return first, second, np.cumsum(chunks) - chunks


def over_chunks(pooled: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, second, begin = chunk_places(counts)
    chunk = np.maximum(pooled[first], pooled[second])
    mean = np.add.reduceat(chunk, begin, axis=0) / np.maximum(counts - 1, 1)[:, None]
    return mean, np.maximum.reduceat(chunk, begin, axis=0)


def train(texts: list[str], labels: np.ndarray, *, filters: int = 16, width: int = 6, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the logistic loss. Only the place of each maximum carries a gradient back."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.2, (width, 257, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters + 1).astype(np.float32))
    net.filters[:, PAD] = 0
    net.head[-1] = 0
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    if len(set(labels.tolist())) < 2:
        net.head[:] = 0
        net.head[-1] = 0 if not len(labels) else (4 if labels[0] else -4)
        return net
    params = [net.filters, net.bias, net.head]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            codes, counts = padded([raw[i] for i in own], width - 1)
            grads = _gradients(net, codes, counts, labels[own].astype(np.float32))
            steps += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
            net.filters[:, PAD] = 0
    return net


def _gradients(net: Network, codes: np.ndarray, counts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    width, _, n = net.filters.shape
    ext = np.concatenate([codes, np.full(width - 1, PAD, dtype=codes.dtype)])
    where, best = np.empty((len(codes) // HALF, n), dtype=np.int64), np.empty((len(codes) // HALF, n), dtype=np.float32)
    for rows, total in net.outputs(ext, len(codes)):
        where[rows] = total.argmax(axis=1)
        best[rows] = np.take_along_axis(total, where[rows][:, None], axis=1)[:, 0]
    pooled = np.maximum(best + net.bias, 0)
    first, second, begin = chunk_places(counts)
    a, b = pooled[first], pooled[second]
    chunk = np.maximum(a, b)
    chunks = np.maximum(counts - 1, 1)
    x = np.concatenate([np.add.reduceat(chunk, begin, axis=0) / chunks[:, None], np.maximum.reduceat(chunk, begin, axis=0)], axis=1)
    z = x @ net.head[:-1] + net.head[-1]
    dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
    dhead = np.concatenate([x.T @ dz, [dz.sum()]]).astype(np.float32) + 1e-4 * net.head
    owner = np.repeat(np.arange(len(y)), chunks)
    top = chunk == x[owner, n:]
    dchunk = dz[owner, None] * (net.head[:n] / chunks[owner, None] + net.head[n : 2 * n] * top)
    dpooled = np.zeros_like(pooled)
    np.add.at(dpooled, first, dchunk * (a >= b))
    np.add.at(dpooled, second, dchunk * (b > a))
    dpooled *= pooled > 0
    place = (np.arange(len(pooled))[:, None] * HALF + where).ravel()
    which = np.tile(np.arange(n), len(pooled))
    g = dpooled.ravel()
    live = g != 0
    place, which, g = place[live], which[live], g[live]
    dfilters = np.stack([np.bincount(ext[place + j].astype(np.int64) * n + which, weights=g, minlength=257 * n).reshape(257, n) for j in range(width)])
    return [dfilters.astype(np.float32), dpooled.sum(axis=0), dhead]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000, sample_bytes: int = 1 << 26, **options) -> Network:
    """Train on a bounded sample of the labelled rows where ``learn`` (over ``id_col``) holds.

    The driver holds at most ``sample_rows`` rows with ``sample_bytes`` bytes of text.
    """
    place = F.xxhash64(F.col(id_col).cast("string"), F.lit("quality"))
    known = labels.where(F.col(label_col).isNotNull() & learn).select(F.col(id_col), F.col(label_col).cast("int").alias("__label"))
    chosen = known.orderBy(place, id_col, "__label").limit(sample_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("__text")).join(F.broadcast(chosen), id_col)
    # An id can repeat in the documents, so rows are counted once more.
    rows = saved(rows.select("*", place.alias("__place"), F.xxhash64("__text").alias("__hash")).orderBy("__place", id_col, "__hash", "__label").limit(sample_rows), "quality-sample")
    before = Window.partitionBy(F.lit(0)).orderBy("__place", id_col, "__hash", "__label")  # over at most sample_rows rows
    lengths = rows.select("__place", id_col, "__hash", "__label", F.octet_length("__text").alias("n"))
    within = lengths.withColumn("sum", F.sum("n").over(before)).where(F.col("sum") <= sample_bytes).drop("n", "sum").distinct()
    sample = rows.join(F.broadcast(within), ["__place", id_col, "__hash", "__label"], "left_semi").toPandas()
    drop_saved(rows)
    sample = sample.sort_values(["__place", "__text", "__label"], kind="stable")
    return train(sample["__text"].tolist(), sample["__label"].to_numpy(), **options)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1 from the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, scores, first = batch[text_col].tolist(), [], 0
            while first < len(texts):
                size, end = 0, first
                while end < len(texts) and (end == first or size < 1_000_000):
                    size += len(texts[end] or "")
                    end += 1
                scores.append(net.score(texts[first:end]))
                first = end
            yield batch.assign(score=np.concatenate(scores) if scores else np.zeros(0))

    names = [f for f in docs.schema if f.name != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    return docs.select(*(F.col(f"`{f.name}`") for f in names)).mapInPandas(run, schema + ", score double")
