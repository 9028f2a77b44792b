"""Name resolution against all pairs, and on odd tables."""

import re

import numpy as np
from pyspark.sql import functions as F

from auditframe.operators import names

WORDS = ["alpha", "beta", "gamma", "kinase", "protein", "human", "mouse", "like", "factor", "2"]


def tokens(name):
    return frozenset(re.findall("[a-z0-9]+", (name or "").lower()))


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(i, " ".join(rng.choice(WORDS, rng.integers(1, 7)))) for i in range(n)]
    asked, known = make(60), make(200)
    q, c = spark.createDataFrame(asked, "id int, q string"), spark.createDataFrame(known, "e int, name string")
    for least in (0.34, 0.5, 0.8, 1.0):
        found = {(r.id, r["rank"], r.candidate, r.exact) for r in names.candidates(q, "id", "q", c, "e", "name", least, 4).collect()}
        want = set()
        for i, name in asked:
            scored = [(len(tokens(name) & tokens(k)) / len(tokens(name) | tokens(k)), e) for e, k in known]
            near = sorted(((-s, e) for s, e in scored if s >= least - 1e-9))[:4]
            want |= {(i, rank, e, s == -1) for rank, (s, e) in enumerate(near, 1)}
        assert found == want and want


def test_odd_tables(spark):
    """Null and wordless names resolve to nothing; repeated entries count once; case and marks don't matter."""
    q = spark.createDataFrame([(1, "P53, Human"), (2, None), (3, "--"), (4, "nothing like it"), (1, "P53, Human")], "id int, q string")
    c = spark.createDataFrame([(7, "human p53", 0), (7, "human p53", 0), (5, "p53 (HUMAN)", 0), (8, None, 0), (None, "p53 human", 0)], "e int, name string, rank int")
    rows = names.candidates(q, "id", "q", c, "e", "name").orderBy("rank").collect()
    assert [(r.id, r["rank"], r.candidate, r.exact) for r in rows] == [(1, 1, 5, True)] * 2 + [(1, 2, 7, True)] * 2
    assert names.candidates(q, "id", "q", c.where(F.lit(False)), "e", "name").count() == 0
    assert names.candidates(q.limit(0), "id", "q", c, "e", "name").count() == 0
