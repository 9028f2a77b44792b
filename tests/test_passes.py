"""How often tables are read and over how many tasks work is dealt."""

from pyspark.sql import functions as F

from auditframe.operators import causal, metrics
from auditframe.plans import queries as library

SMALL = "/root/testdata/sf0.001"


def test_matching_reads_texts_once(spark):
    """What matching returns rests on kept measures, not on another pass over the texts."""
    for name in ("covariate_match", "balance_prune"):
        assert not any("documents.parquet" in f for f in library.QUERIES[name](spark, SMALL).inputFiles()), name


def test_stretches_have_tasks_of_their_own(spark):
    """Stretches of few bytes aren't packed into one task, and all of them have their pairs."""
    df = spark.range(1600).select("id", (F.col("id") % 2).cast("int").alias("y"), F.floor(F.col("id") / 100).alias("bin"), (F.col("id") / 100.0).alias("logit"), F.array(F.col("id") / 100.0).alias("z"))
    found = causal.matched_pairs(df, ["bin"], "id", "y", 0.3, stretch=50)
    assert len(found.inputFiles()) > 4
    assert found.count() == found.select("zero").distinct().count() == 800


def test_cross_validation_ranks_only_what_is_reported(spark):
    """One ranking of the scores in each fold, and no curve that the report leaves out."""
    report = library.QUERIES["cv_candidates"](spark, SMALL)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2


def test_area_leaves_out_null_scores_and_groups(spark):
    rows = [("a", 0.1, 0), ("a", 0.4, 1), ("a", 0.4, 0), ("a", 0.9, 1), ("a", None, 1), (None, 0.2, 1), (None, 0.3, 0), ("b", 0.5, 1), ("c", None, 0)]
    found = metrics.auroc(spark.createDataFrame(rows, "g string, p double, y int"), "y", "p", ["g"])
    assert {r.g: r.auroc for r in found.collect()} == {"a": 0.875, "b": None}
    all_ = metrics.binary_metrics(spark.createDataFrame(rows, "g string, p double, y int"), "y", "p", ["g"])
    some = metrics.binary_metrics(spark.createDataFrame(rows, "g string, p double, y int"), "y", "p", ["g"], measures=["auroc", "brier"])
    assert some.columns == ["g", "auroc", "brier"] and sorted(map(str, some.collect())) == sorted(map(str, all_.select("g", "auroc", "brier").collect()))
