"""Token counts, packing, sampled pieces, fingerprints and repeats against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from auditframe.llm import packing, queries, repeats, sampled_pieces, simhash, token_counts  # noqa: E402
from auditframe.llm.pieces import piece_table  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "A b  c", "\t\n x y", "▁▁ a▁b", "<s> </s> <|endoftext|> <unk>", "naïve Ünïcödé 😀 漢字 ‮", "aaaa" * 900, "x y " * 3000, "퟿", "same", "same", "I'LL we'll 12345 ...!!!"]


@pytest.fixture(scope="module")
def nasty(spark):
    rows = [(i, t, None, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int")


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_token_counts_are_the_librarys(spark, nasty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (nasty, spark.read.parquet(f"{SMALL}/documents.parquet")):
        found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, MODEL).collect()}
        for r in df.collect():
            t = r.text or ""
            assert found[r.doc_id] == (len(t.encode()), len(sp.encode(t))), t[:40]
    assert token_counts.token_counts(nasty.limit(0), MODEL).count() == 0


def test_packing_has_the_librarys_ids_and_no_gaps(spark, nasty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (nasty, spark.read.parquet(f"{SMALL}/documents.parquet")):
        rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
        bins, pieces = {}, {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            pieces.setdefault(r.doc_id, []).append(r)
            assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        total = 0
        for r in df.select("doc_id", "text").collect():
            want = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
            own = sorted(pieces[r.doc_id], key=lambda x: x.piece)
            assert [i for x in own for i in x.ids] == want
            assert [x.piece for x in own] == list(range(len(own))) and all(x.length == 2048 for x in own[1:])
            total += len(want)
        assert len(bins) <= 1.05 * total / 2048 + 8  # a few unfilled sequences a partition
    assert packing.pack(nasty.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_best_fit_decreasing_is_that():
    rng = np.random.default_rng(1)
    for capacity in (1, 2, 7, 64, 100):
        lengths = rng.integers(1, capacity + 1, 200)
        number, offset = packing.best_fit_decreasing(lengths, capacity)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [x for x in room if x >= lengths[i]]
            assert capacity - offset[i] == (min(fits) if fits else capacity)
            if fits:
                room.remove(min(fits))
            room.append(capacity - offset[i] - lengths[i])
        assert len(room) == number.max() + 1


def test_sampled_pieces_are_lossless_reproducible_and_distributed(spark, nasty):
    docs = nasty.union(spark.read.parquet(f"{SMALL}/documents.parquet").limit(50).select(F.col("doc_id") + 1000, "text", F.lit(None).cast("string"), F.lit(1)))
    once = {r.doc_id: r.piece_ids for r in sampled_pieces.sample_encode(docs, MODEL, seed=5).collect()}
    again = {r.doc_id: r.piece_ids for r in sampled_pieces.sample_encode(docs.repartition(5), MODEL, seed=5).collect()}
    assert once == again
    assert once != {r.doc_id: r.piece_ids for r in sampled_pieces.sample_encode(docs, MODEL, seed=6).collect()}
    back = sampled_pieces.decode(sampled_pieces.sample_encode(docs, MODEL, seed=5), MODEL)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    # The law of one short word, from all its segmentations.
    table = piece_table(MODEL)
    word, weight = "▁cat", sampled_pieces.log_weights(table, 100.0)

    def cuts(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in table.ids:
                for rest in cuts(s[n:]):
                    yield (table.ids[s[:n]], *rest)

    law = {c: float(np.exp(sum(weight[i] for i in c))) for c in cuts(word)}
    n = 20_000
    sampler = sampled_pieces.Sampler(MODEL, 1.0, 100.0, 3)
    drawn = [tuple(x.tolist()) for x in sampler.encode(list(range(n)), ["cat"] * n)]
    for c, p in law.items():
        p /= sum(law.values())
        assert abs(drawn.count(c) / n - p) < 5 * (p / n) ** 0.5 + 1e-3
    assert set(drawn) <= set(law)


def brute_fingerprint(text, words=3):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        own = own.replace(c, " ")
    own = [w for w in own.split(" ") if w]
    if not own:
        return 0
    grams = [" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprints_and_groups(spark, nasty, tmp_path):
    rows = texts(spark)
    base = rows[0][1].split()
    extra = [(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(20_000 + i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(60)]
    rows += extra
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, str(tmp_path)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    want = parts(ids, ((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2))
    assert {i: c for i, (_, c) in found.items()} == want


def test_links_of_large_groups_are_complete(spark):
    rng = random.Random(2)
    seen = set()
    at = 0x0123456789ABCDEF
    for _ in range(400):  # a long chain of small steps, and single flips around one fingerprint
        at ^= 1 << rng.randrange(64)
        seen.add(at)
    seen |= {0xF0F0 ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    prints = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(seen))]
    found = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(prints, "doc_id long, fp0 long"), "doc_id", ["fp0"], 2).collect()}
    p = np.array(sorted(seen), dtype=np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= 2, 1))
    assert found == parts(range(len(p)), zip(a.tolist(), b.tolist(), strict=True))


def brute_repeats(data: dict, length: int):
    seen = {}
    for text in data.values():
        for i in range(len(text) - length + 1):
            seen[text[i : i + length]] = seen.get(text[i : i + length], 0) + 1
    out = {}
    for key, text in data.items():
        gone = np.zeros(len(text) + 1, dtype=bool)
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone]))
        out[key] = (len(text), int(gone.sum()), len(edges) // 2, hashlib.sha256(bytes(x for x, g in zip(text, gone, strict=False) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 3}, {"filter_bits": 1 << 18}])
def test_repeats(spark, options):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäé", k=rng.randint(2, 9))) for _ in range(400)]
    passage = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "x" * 500), (3, "x" * 199), (4, "ab" * 150), (5, passage[0]), (6, passage[0])]
    for i in range(7, 60):
        mix = [" ".join(rng.choices(words, k=rng.randint(1, 80)))]
        for p in rng.sample(passage, rng.randint(0, 3)):
            cut = rng.randint(0, 40)
            mix += [p[cut:], " ".join(rng.choices(words, k=rng.randint(1, 60)))]
        rows.append((i, " ".join(mix)))
    rows += [(60, rows[-1][1][3:]), (61, rows[-1][1][:260] + "é")]
    df = spark.createDataFrame([(i, t, "other", i) for i, t in rows], "doc_id long, text string, kept string, row long")
    done = repeats.remove_repeats(df, **options)
    got = {r.row.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in done.collect()}
    assert got == brute_repeats({i: (t or "").encode() for i, t in rows}, 200)


def test_repeats_of_the_documents(spark):
    rows = [r for r in texts(spark)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_repeats(spark, SMALL).collect()}
    assert got == brute_repeats({i: (t or "").encode() for i, t in rows}, 200)


def test_empty_table(spark, nasty):
    none = nasty.limit(0)
    assert repeats.remove_repeats(none).count() == 0
    assert simhash.near_groups(simhash.fingerprints(none), "doc_id", ["fp0"], 2).count() == 0
    assert sampled_pieces.sample_encode(none, MODEL).count() == 0
    assert simhash.drop_near(none.select("doc_id", "text")).count() == 0


def test_repeats_in_very_long_texts(spark):
    """Texts of several chunks; repeats lie across the chunks' borders and in another text."""
    rng = np.random.default_rng(6)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", dtype=np.uint8)
    passage = letters[rng.integers(0, 27, 900)].tobytes()
    texts = []
    for size, places in ((3_300_000, (999_500, 1_999_999, 3_000_100)), (1_000_000, (0, 999_100)), (2_000_000, ())):
        data = bytearray(letters[rng.integers(0, 27, size)].tobytes())
        for at in places:
            data[at : at + 900] = passage
        texts.append(bytes(data))
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.row.doc_id: [(s.start, s.end) for s in r.spans] for r in repeats.remove_repeats(df).select("row", "spans").collect()}
    for i, places in enumerate(((999_500, 1_999_999, 3_000_100), (0, 999_100), ())):
        assert len(found[i]) == len(places)
        # A neighbouring byte can agree by chance.
        assert all(begin - 3 <= start <= begin and begin + 900 <= end <= begin + 903 for (start, end), begin in zip(found[i], places, strict=True))


def test_whole_characters():
    data = "aé漢😀z".encode()
    for begin in range(len(data) + 1):
        for end in range(begin, len(data) + 1):
            kept = repeats._whole(data, begin, end)
            assert kept.decode() == data[begin:end].decode("utf-8", "ignore")


def test_counts_of_text_without_spaces():
    """Random unspaced texts, made of pieces, of few letters or encoded, against the library."""
    import sentencepiece

    sp, table, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_table(MODEL), random.Random(9)
    pieces = [p for p in table.ids if len(p) > 1]
    kinds = [
        lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
        lambda n: "".join(rng.choice(pieces) for _ in range(n // 4 + 1)).replace("▁", ""),
        lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPabcdefghijk0123456789+/") for _ in range(n)),
        lambda n: "".join(rng.choice(["the", "ing", "e", "aa", "ab", "ba", "  ", "é", "漢", "\t"]) for _ in range(n)),
        lambda n: rng.choice("ab=-_.") * n + rng.choice(["", "x", "the"]) * rng.randrange(9),
    ]
    made = [rng.choice(kinds)(rng.choice([5, 60, 300, 2500])) for _ in range(600)] + [kinds[1](400_000)]
    assert token_counts.count_texts(made, table, {}) == [len(sp.encode(t)) for t in made]


ODD = [(1, None), (2, ""), (3, "same row"), (3, "same row"), (3, "another text"), (None, "no id"), (None, None), (4, "tie a"), (5, "tie a"), (6, "long words " * 60_000)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, repeated and clashing ids, ties, a very long text, clashing columns."""
    to = tmp_path_factory.mktemp("odd")
    rows = [(i, t, None, None, None, 1, 2, "x") for i, t in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key long, row string").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, 0, None), (2, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    vectors = [(1, [1.0, 0.0], None), (1, [1.0, 0.0], 2), (20, [0.0, 1.0], 1), (20, [1.0, 0.1], 1), (None, [1.0, 0.0], 1), (40, None, 1), (60, [0.0, 0.0], 1), (80, [1.0, 2.0, 3.0], 1), (100, [2.0, 4.0, 6.0], 1), (120, [float("nan"), 1.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{to}/embeddings.parquet")
    none = tmp_path_factory.mktemp("none")
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{to}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    return str(to), str(none)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_on_odd_and_empty_tables(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd[0]).collect()
    assert queries.QUERIES[name](spark, odd[1]).count() == 0
    if name in ("op3_vector_links", "op5_curve_search"):
        return
    if name == "op11_collocations":  # rows by phrase: the parts of these two are absorbed
        assert {(r.lang, r["rank"], r.phrase, r.a, r.n) for r in rows} == {("und", 1, "long words long words", 59_999, 120_012), ("und", 2, "words long words long", 59_998, 120_012)}
        return
    if name == "op13_hard_negatives":  # the one anchor has no row of another label and of its length
        assert rows == []
        return
    ids = sorted(str(r.doc_id) for r in rows)
    if name == "op8_packing":
        ids = sorted(str(r.doc_id) for r in rows if r.piece == 0)
    assert ids == sorted(str(i) for i, _ in ODD)


def test_vector_queries_on_odd_rows(spark, odd):
    links = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in queries.op3_vector_links(spark, odd[0]).collect())
    assert links == sorted([("1", 3, "1"), ("1", 3, "1"), ("None", 3, "1"), ("20", 3, "1"), ("20", 0, "20"), ("40", 0, "40"), ("60", 0, "60"), ("80", 1, "80"), ("100", 1, "80"), ("120", 0, "120")])
    found = {(r.query_id, r.rank): (r.vec_id, round(r.score, 5)) for r in queries.op5_curve_search(spark, odd[0]).collect()}
    assert found == {(20, 1): (1, 1.0), (80, 1): (100, 28.0), (100, 1): (80, 28.0)}


def test_registered_counts_packing_and_pieces(spark):
    """The registered functions themselves, over the small documents, against the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = dict(texts(spark))
    for r in queries.op9_token_counts(spark, SMALL).collect():
        n = len(sp.encode(own[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((own[r.doc_id] or "").encode()), n, n > 4096)
    tokenizer, pieces, room = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    for r in queries.op8_packing(spark, SMALL).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, rows in pieces.items():
        ids, at = np.array([*tokenizer.encode(own[i] or "", add_special_tokens=False).ids, 0], dtype="<u4"), 0
        for r in sorted(rows, key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == 2048 for r in rows if r.piece)
    assert set(pieces) == set(own) and all(sum(n for _, n in x) <= 2048 for x in room.values())
    for x in room.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist()
    done = queries.op1_sampled_pieces(spark, SMALL).collect()
    assert len(done) == len(own) and all(r.lossless and r.n_bytes == len((own[r.doc_id] or "").encode()) for r in done)
