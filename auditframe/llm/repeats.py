"""Removal of byte strings that occur more than once, from suffixes sorted in blocks.

Each byte of a document that lies in a string of ``length`` bytes which also starts anywhere else,
in the same document or another, is removed. Sorting all suffixes of a corpus would ship a
document hundreds of times, so suffixes are first put into buckets by content:

* Every window of ``length`` bytes belongs to the gram of ``gram`` bytes inside it with the least
  hash (the leftmost of equal ones). Equal windows have equal grams at equal offsets. Consecutive
  windows with one gram form a run, and a run is kept as two hashes: of the gram, and of all bytes
  of the run's windows. There is about one run in 80 bytes.
* Grams that occur once hold no repeat. Where all runs of a gram are equal, every window of theirs is
  repeated. Only the rest, the borders of repeats, needs bytes: the distinct runs of such a gram are
  one suffix bucket.
* Buckets are dealt to tasks by gram. A task lays out the bytes of several buckets, places the grams
  at equal residues, and sorts the window suffixes a block at a time with a difference cover
  (``suffix_blocks``). Neighbours that agree for ``length`` bytes are repeats.
* A bucket of more than ``bucket_rows`` distinct runs isn't held by one task: its windows are dealt on
  by their SHA-256 digests, pre-aggregated, and equal digests are repeats.

Runs are pre-aggregated before each shuffle, so a passage in a third of all documents is a row for
each task. A filter of fixed size (``filter_bits``) of the grams that occur again keeps most other
rows from being shuffled at all; where it is too small for a corpus it lets more rows pass, to no
other effect. Gram and run hashes have 64 bits each and are compared together, so unequal runs pass for
equal ones with a chance of 2**-128 a pair.

Nulls and texts shorter than ``length`` bytes lose nothing. Rows that are equal in id and text are
repeats of one another; rows with one id and different texts are kept apart. All other columns are
carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from auditframe.llm.common import drop_saved, saved
from auditframe.llm.suffix_blocks import repeated

#: Bytes hashed together; longer texts are taken in pieces. Places in a chunk have fewer bits than PLACE_BITS.
CHUNK, PLACE_BITS = 1_000_000, 24
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLE) == 0 or len(_TABLE[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        ups, downs = np.full(n, BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
        ups[0] = downs[0] = 1
        _TABLE[:] = [np.multiply.accumulate(ups), np.multiply.accumulate(downs)]
    return _TABLE[0], _TABLE[1]


_TABLE: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretches of a byte string, from the sums of its bytes times powers."""

    def __init__(self, text: np.ndarray):
        up, self.down = _powers(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:-size]) * self.down[:n]


def runs(texts: list[bytes], length: int, gram: int) -> pd.DataFrame:
    """The runs of all texts: doc, first window a, number of windows n, gram's place after a, gram
    hash h and run hash c."""
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    hashes = Hashes(text)
    grams = mixed(hashes.all_of(gram)) if len(text) >= length else np.zeros(0, dtype=np.uint64)
    if not windows.any():
        return pd.DataFrame({k: np.zeros(0, dtype=np.int64) for k in ("doc", "a", "n", "at", "h", "c")})
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, wide = length - gram + 1, 1
    while 2 * wide <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < width:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    doc = np.repeat(np.arange(len(texts)), windows)
    first = np.arange(windows.sum()) + np.repeat(begin - (np.cumsum(windows) - windows), windows)
    place = (least[first] & low).astype(np.int64)
    change = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    n = np.diff(np.r_[change, len(place)])
    a, at, doc = first[change], place[change], doc[change]
    run = hashes.of(a, a + n + length - 1)
    shape = mixed(((n.astype(np.uint64) << np.uint64(32)) | (at - a).astype(np.uint64)) + np.uint64(1))
    return pd.DataFrame({"doc": doc, "a": a - begin[doc], "n": n, "at": at - a, "h": grams[at].view(np.int64), "c": mixed(run ^ shape).view(np.int64)})


def _chunks(batch: pd.DataFrame, length: int) -> Iterator[pd.DataFrame]:
    """Rows of ``batch`` by about CHUNK bytes, with ``from``: where in its text a row's piece begins.

    A text of more than CHUNK bytes comes in pieces that overlap by ``length`` - 1 bytes, so each of its
    windows is in one piece. A run may end where a piece does; its gram and bytes are still its own.
    """
    held, size = [], 0
    for n, text in enumerate(batch["text"]):
        for begin in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[begin : begin + CHUNK + length - 1] if len(text) > CHUNK else text
            if held and size + len(piece) > CHUNK:
                yield _rows(batch, held)
                held, size = [], 0
            held.append((n, begin, piece))
            size += len(piece)
            if len(text) <= CHUNK:
                break
    if held:
        yield _rows(batch, held)


def _rows(batch: pd.DataFrame, held: list) -> pd.DataFrame:
    n, begin, piece = zip(*held, strict=True)
    return batch.iloc[list(n)].assign(text=piece, **{"from": begin})


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter has these hashes; the lowest bit of a byte is the first, as in Spark's."""
    place = h.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def gram_filter(hashes: DataFrame, filter_bits: int) -> np.ndarray:
    """A bitmap of fixed size, one bit a hash, built in Spark; the driver gets the bitmap alone."""
    place = F.col("h").bitwiseAND(F.lit(filter_bits - 1)) + 1  # Spark's bitmaps count from 1
    made = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(filter_bits // 8, dtype=np.uint8)
    for row in made.collect():  # filter_bits bits in all
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        begin = (row["bucket"] - 1) * len(bits)
        out[begin : begin + len(bits)] = bits[: len(out) - begin]
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 200, gram: int = 40, bucket_rows: int = 20_000, filter_bits: int = 1 << 26) -> DataFrame:
    """``k1`` and ``k2`` (``row_key``) and ``runs``: pairs of first and last repeated window."""
    keyed = docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    keyed = keyed.where(F.octet_length("text") >= length)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch, length):
                yield runs(part["text"].tolist(), length, gram)[["h", "c"]]

    grams = keyed.select("text").mapInPandas(hashed, "h long, c long")
    again = grams.groupBy("h").agg(F.count("*").alias("rows"), F.min("c").alias("least"), F.max("c").alias("most")).where("rows > 1")
    again = saved(again.select("h", (F.col("least") != F.col("most")).alias("varied")), "grams")
    known, varied = gram_filter(again, filter_bits), gram_filter(again.where("varied"), filter_bits)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of grams that may occur again, with their bytes where the runs may differ."""
        for batch in batches:
            for part in _chunks(batch, length):
                own = runs(part["text"].tolist(), length, gram)
                own = own[_known(known, own["h"].to_numpy())]
                if not len(own):
                    continue
                texts, k1, k2 = part["text"].to_numpy(), part["k1"].to_numpy(), part["k2"].to_numpy()
                ship = _known(varied, own["h"].to_numpy())
                doc, a, e = own["doc"].to_numpy(), own["a"].to_numpy(), (own["a"] + own["n"]).to_numpy() + length - 1
                data = [texts[d][i:j] if s else None for d, i, j, s in zip(doc, a, e, ship, strict=True)]
                yield pd.DataFrame({"k1": k1[doc], "k2": k2[doc], "h": own["h"], "c": own["c"], "a": own["a"] + part["from"].to_numpy()[doc], "n": own["n"], "at": own["at"], "bytes": data})

    placed = keyed.mapInPandas(found, "k1 long, k2 long, h long, c long, a int, n int, at int, bytes binary")
    placed = saved(placed.join(again, "h"), "runs")
    drop_saved(again)
    equal = placed.where("NOT varied").select("k1", "k2", F.array(F.struct(F.col("a").alias("lo"), (F.col("a") + F.col("n") - 1).alias("hi"))).alias("marks"))

    distinct = placed.where("varied").groupBy("h", "c").agg(F.count("*").alias("rows"), F.first("n").alias("n"), F.first("at").alias("at"), F.first("bytes").alias("bytes"))
    distinct = saved(distinct, "buckets")
    large = distinct.groupBy("h").count().where(F.col("count") > bucket_rows).select("h")
    small = distinct.join(large, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    sorted_marks = small.mapInPandas(lambda batches: sort_buckets(batches, length), "h long, c long, marks array<struct<lo:int,hi:int>>")
    counted = _counted(distinct.join(large, "h"), length)
    marked = saved(sorted_marks.unionByName(counted), "marks")
    drop_saved(distinct)
    differing = placed.where("varied").join(marked, ["h", "c"])
    shifted = F.transform("marks", lambda m: F.struct((m["lo"] + F.col("a")).alias("lo"), (m["hi"] + F.col("a")).alias("hi")))
    every = equal.unionByName(differing.select("k1", "k2", shifted.alias("marks")))
    return every.groupBy("k1", "k2").agg(F.flatten(F.collect_list("marks")).alias("runs"))


def sort_buckets(batches: Iterator[pd.DataFrame], length: int, v: int = 64, held_bytes: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Rows in the order of h: the repeated windows of each run, several whole buckets at a time."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        n, at = rows["n"].to_numpy().astype(np.int64), rows["at"].to_numpy().astype(np.int64)
        sizes = n + length - 1
        # Each run begins where its gram falls on a multiple of v, after zeros.
        lead = (-at) % v
        room = lead + sizes + (-(lead + sizes)) % v
        begin = np.cumsum(room) - room + lead
        text = np.zeros(int(room.sum()), dtype=np.uint8)
        joined = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8)
        text[np.arange(len(joined)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)] = joined
        starts = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        owner = np.repeat(np.arange(len(rows)), n)
        hit = repeated(text, starts, length, v) | (rows["rows"].to_numpy() > 1)[owner]
        return _marks(rows, owner[hit], (starts - begin[owner])[hit])

    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        h = batch["h"].to_numpy()
        first = 0
        for cut in [*(np.flatnonzero(h[1:] != h[:-1]) + 1), len(h)]:
            part = batch.iloc[first:cut]
            if held and size >= held_bytes and held[-1]["h"].iat[-1] != part["h"].iat[0]:
                yield settle(pd.concat(held))
                held, size = [], 0
            held.append(part)
            size += int(part["n"].sum()) + length * len(part)
            first = cut
    if held:
        yield settle(pd.concat(held))


def _marks(rows: pd.DataFrame, owner: np.ndarray, window: np.ndarray) -> pd.DataFrame:
    """Stretches of consecutive windows, a list for each of ``rows`` that has any."""
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)]) if len(owner) else np.zeros(0, dtype=np.int64)
    last = np.r_[new[1:], len(owner)] - 1 if len(new) else new
    lists: dict[int, list] = {}
    for o, lo, hi in zip(owner[new].tolist(), window[new].tolist(), window[last].tolist(), strict=True):
        lists.setdefault(o, []).append({"lo": lo, "hi": hi})
    at = np.fromiter(lists, dtype=np.int64, count=len(lists))
    return pd.DataFrame({"h": rows["h"].to_numpy()[at], "c": rows["c"].to_numpy()[at], "marks": list(lists.values())})


def _counted(distinct: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large for one task: windows counted by digest and gram."""
    window = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    each = distinct.select("h", "c", "rows", window.alias("w"), "bytes").withColumn("own", F.substring("bytes", F.col("w") + 1, F.lit(length)))
    each = each.select("h", "c", "rows", "w", F.unhex(F.sha2("own", 256)).alias("digest"))
    twice = each.groupBy("h", "digest").agg(F.sum("rows").alias("total")).where("total > 1").select("h", "digest")
    hit = each.join(twice, ["h", "digest"])
    one = F.struct(F.col("w").alias("lo"), F.col("w").alias("hi"))
    return hit.groupBy("h", "c").agg(F.collect_list(one).alias("marks"))


def row_key(id_col: str, text_col: str) -> list:
    own, text = F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(own, text).alias("k1"), F.xxhash64(text, own, F.lit("second")).alias("k2")]


def _whole(data: bytes, begin: int, end: int) -> bytes:
    """``data[begin:end]`` without what a cut at either end left of a UTF-8 character."""
    part = data[begin:end]
    if begin:
        part = part[next((i for i, b in enumerate(part[:4]) if b & 0xC0 != 0x80), len(part[:4])) :]
    if end < len(data):
        for back in range(1, min(4, len(part)) + 1):
            lead = part[-back]
            if lead & 0xC0 != 0x80:
                if back < (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    part = part[:-back]
                break
    return part


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 200, whole_characters: bool = False, **options) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), n_bytes, spans (start and end of each maximal
    removed stretch) and kept (the remaining bytes).

    With ``whole_characters``, what a cut leaves of a character isn't kept either; spans stay as they are.
    """
    spans = repeated_spans(docs, id_col, text_col, length=length, **options)
    keyed = docs.select(*row_key(id_col, text_col), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")
    joined = keyed.join(spans, ["k1", "k2"], "left").select("row", text.alias("__text"), "runs")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            removed, kept = [], []
            for data, own in zip(batch["__text"], batch["runs"], strict=True):
                merged = merge([] if own is None else own, length)
                removed.append([{"start": s, "end": e} for s, e in merged])
                edges = [0, *(x for span in merged for x in span), len(data)]
                stretches = zip(edges[::2], edges[1::2], strict=True)
                kept.append(b"".join(_whole(data, i, j) if whole_characters else data[i:j] for i, j in stretches) if merged else data)
            yield batch[["row"]].assign(n_bytes=batch["__text"].map(len), spans=removed, kept=kept)

    schema = StructType([StructField("row", joined.schema["row"].dataType), *StructType.fromDDL("n_bytes long, spans array<struct<start:long,end:long>>").fields, StructField("kept", BinaryType())])
    return joined.mapInPandas(cut, schema)


def merge(own, length: int) -> list[tuple[int, int]]:
    """Byte stretches covered by windows, from pairs of first and last window."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((int(m["lo"]), int(m["hi"])) for m in own):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + length))
        else:
            out.append((lo, hi + length))
    return out
