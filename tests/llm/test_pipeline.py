"""Each stage of the pipeline on its own input against brute force."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from auditframe.llm import quality, queries  # noqa: E402
from auditframe.llm.common import held_out  # noqa: E402

from .independent import plain_score, pseudonymiser  # noqa: E402
from .test_texts import brute_repeats  # noqa: E402

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small documents, near and exact copies of some, and rows with nulls, ties and repeats."""
    to = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng = random.Random(1)
    long = docs.where("n_chars > 2000").orderBy("doc_id").limit(4).collect()
    rows = []
    for n, r in enumerate(long):
        words = r.text.split(" ")
        for c in range(4):
            own = list(words)
            for at in rng.sample(range(len(own)), max(1, len(own) // 100)):
                own[at] = f"word{c}"
            text = " ".join(own) if c else r.text
            rows.append((5000 + 10 * n + c, text, r.lang, r.source, len(text)))
    rows += [(6000, None, None, None, None), (6001, "", "en", "s", 0), (6002, "", "en", "s", 0), (None, "no id", "en", "s", 5), (6003, "Same row", "en", "s", 8), (6003, "Same row", "en", "s", 8)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{to}/labels.parquet")
    return str(to)


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_are_registered():
    assert list(STAGES) == ["quality", "near_copies", "repeats", "personal_data", "packing"]


def test_quality_stage(spark, folder):
    docs = documents(spark, folder)
    net = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"), ~held_out("doc_id", 3, 1))
    kept = corpus_pipeline.keep_quality(spark, docs, folder)
    assert kept.columns == docs.columns
    rows = docs.collect()
    scores = [plain_score(net, r.text) for r in rows]
    assert min(abs(s - 0.5) for s in scores) > 1e-5
    want = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    order = lambda rows: sorted(map(str, rows))
    assert order(kept.collect()) == order(want)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [r.doc_id for r in rows if labels.get(r.doc_id) == 1]
    assert len({r.doc_id for r in want} & set(good)) >= 0.95 * len(good)


def shingles(text):
    own = (text or "").lower().split()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def near(a, b):
    return (not a and not b) or (bool(a & b) and len(a & b) >= 0.8 * len(a | b))


def test_near_copy_stage(spark, folder):
    docs = documents(spark, folder)
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
    sets = {r.doc_id: shingles(r.text) for r in docs.where("doc_id IS NOT NULL").collect()}
    ids = sorted(sets)
    stay = {r.doc_id for r in kept if r.doc_id is not None}
    assert len(stay) == sum(r.doc_id is not None for r in kept) and sum(r.doc_id is None for r in kept) == 1
    parent = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if near(sets[a], sets[b]):
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    assert stay == {i for i in ids if parent[i] == i}
    assert not any(5000 <= i < 6000 for i in stay)


def test_repeat_stage(spark, folder):
    docs = documents(spark, folder).where("doc_id IS NOT NULL AND doc_id <> 6003")
    rows = {r.doc_id: r for r in corpus_pipeline.drop_repeats(spark, docs, folder).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = brute_repeats({i: (t or "").encode() for i, t in texts.items()}, 200)
    for i, text in texts.items():
        n, removed, *_ = found[i]
        if n and removed == n:
            assert i not in rows
        elif not removed:
            assert rows[i].text == text
        else:
            assert n - removed - 6 * found[i][2] <= len(rows[i].text.encode()) <= n - removed and rows[i].n_chars == len(rows[i].text)


def test_personal_data_stage(spark, folder):
    docs = documents(spark, folder)
    done = corpus_pipeline.hide_personal_data(spark, docs, folder)
    assert done.columns == docs.columns
    replace = pseudonymiser(queries.KEY)
    want = [(r.doc_id, replace(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in done.select("doc_id", "text").collect())


def test_run_packs_what_the_stages_keep(spark, folder):
    docs = documents(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= before, name
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    room = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("places"), F.count("*").alias("rows"))
    assert room.where("n > 2048 OR places <> rows").count() == 0


def test_stages_of_an_empty_table(spark, folder):
    none = documents(spark, folder).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def kept_ids(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()}


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_near_copies_at_the_threshold(spark):
    """All planted pairs of similarity 0.8 to 0.9 are found, and pairs just below stay."""
    rng = random.Random(3)
    texts, gone, below = {}, set(), 0
    for n in range(500):
        own = words(rng, 400)
        other = list(own)
        for at in range(1, rng.choice([5, 6, 7, 8, 9, 10, 11])):
            other[at * 30 + rng.randrange(20)] += "x"
        texts[2 * n], texts[2 * n + 1] = " ".join(own), " ".join(other)
        a, b = shingles(texts[2 * n]), shingles(texts[2 * n + 1])
        if near(a, b):
            assert 0.8 <= len(a & b) / len(a | b) <= 0.91
            gone.add(2 * n + 1)
        else:
            below += 1
    assert len(gone) > 300 and below > 20
    assert kept_ids(spark, texts) == set(texts) - gone


def test_equal_shingle_sets_with_repeats(spark):
    """A passage repeated hundreds of times changes fingerprints but not the set of shingles."""
    rng = random.Random(4)
    own, line = words(rng, 300), words(rng, 8)
    once = " ".join(own + line * 2)
    assert kept_ids(spark, {1: once, 2: " ".join(own + line * 400)}) == {1}


def drifted(rng, steps):
    """Texts, each near the next only."""
    out = [words(rng, 400)]
    for _ in range(steps - 1):
        own = list(out[-1])
        for at in rng.sample(range(40), 6):
            own[at * 10] = f"d{rng.randrange(10**9)}"
        out.append(own)
    return [" ".join(x) for x in out]


def test_near_copies_in_a_chain(spark):
    """L1 ~ x ~ y ~ L2 with L1 < L2 < x < y is one group, and so are longer chains in any order of ids."""
    rng = random.Random(5)
    first, x, y, last = drifted(rng, 4)
    sets = [shingles(t) for t in (first, x, y, last)]
    assert [near(a, b) for n, a in enumerate(sets) for b in sets[n + 1 :]] == [True, False, False, True, False, True]
    assert kept_ids(spark, {1: first, 2: last, 3: x, 4: y}) == {1}
    chain = drifted(rng, 60)
    ids = rng.sample(range(1000, 2000), 60)
    assert kept_ids(spark, dict(zip(ids, chain, strict=True))) == {min(ids)}


def test_texts_that_share_an_id(spark):
    """Different texts of one id are documents; equal rows are copies; replacement characters stay."""
    rng = random.Random(6)
    a, b, c = (" ".join(words(rng, 50)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, b, "x"), (3, c + " \ufffd", "x"), (3, c + " \ufffd", "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()]
    # The text of id 1 with the greater hash counts after all ids, so id 2 stays for b if that is it.
    assert sorted(map(str, kept)) in (sorted(map(str, [(1, a), (2, b), (3, c + " \ufffd"), (None, a)])), sorted(map(str, [(1, a), (1, b), (3, c + " \ufffd"), (None, a)])))
    long = "é" * 300
    docs = spark.createDataFrame([(1, "q\ufffdx" + long + "r" * 150 + "1"), (2, "w" + long + "s" * 150 + "\ufffd"), (3, "plain \ufffd")], "doc_id long, text string")
    done = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs, None).collect()}
    assert done[3] == "plain \ufffd" and done[1].startswith("q\ufffdx") and done[2].endswith("s\ufffd") and "é" not in done[1] + done[2]


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """Fingerprints alone, without the exact join, join copies with a few changed words of many."""
    from auditframe.llm import near_sets

    monkeypatch.setattr(near_sets, "_stars", lambda rows: iter(()))
    monkeypatch.setattr(near_sets, "_pairs", lambda rows, similarity: iter(()))
    rng = random.Random(7)
    texts = {}
    for n in range(20):
        own = words(rng, 2000)
        other = list(own)
        other[rng.randrange(2000)] += "x"
        texts[2 * n], texts[2 * n + 1] = " ".join(own), " ".join(other)
    kept = kept_ids(spark, texts)  # one word changes five shingles, and more than three bits now and then
    assert kept >= set(range(0, 40, 2)) and len(kept) <= 25
