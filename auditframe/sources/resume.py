"""Long runs in batches that go on where they stopped, tied to their configuration."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from auditframe.operators.checks import plan_digest
from auditframe.sources.tables import replace_table


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _moved(df: DataFrame, path: str, *partitions: str) -> None:
    """Write beside ``path`` and rename: what stands at ``path`` is whole. Another run's table that got there first stays."""
    fs, hadoop = _fs(df.sparkSession, path)
    beside = hadoop(f"{path}.new-{uuid.uuid4().hex}")
    df.write.partitionBy(*partitions).parquet(beside.toString())
    if fs.exists(hadoop(path)) or not fs.rename(beside, hadoop(path)):
        fs.delete(beside, True)
        if not fs.exists(hadoop(path)):
            raise OSError(f"{path} can't be put in place")


def done(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the batches that a run at ``path`` has ended."""
    fs, hadoop = _fs(spark, path)
    if not fs.exists(hadoop(f"{path}/parts")):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(f"{path}/parts"))]
    return {int(n.removeprefix("batch_no=")) for n in names if n.startswith("batch_no=") and ".new-" not in n}


def advance(df: DataFrame, key: str, path: str, config: dict, work: Callable[[DataFrame], DataFrame], batches: int = 16, most: int | None = None) -> int:
    """Run ``work`` on the batches of ``df`` that ``path`` lacks, ``most`` of them at most; how many are then left.

    Rows are dealt to batches by a hash of ``key``, so ``work`` sees all rows of a key together. The input is kept at ``path``, partitioned by batch,
    when the run begins: a batch reads its own rows alone, and a run that goes on uses the same rows though ``df`` has changed. Each batch's result
    gets its place by a rename, so a batch that was broken off is done again and none counts twice. A run at ``path`` with another ``config`` or number
    of batches is an error. An empty ``df`` has no rows in any batch; null keys share a batch. Columns may have any names.
    """
    spark = df.sparkSession
    if batches < 1:
        raise ValueError("a run has one batch at least")
    fs, hadoop = _fs(spark, path)
    digest = plan_digest({"config": config, "batches": batches})
    if not fs.exists(hadoop(f"{path}/plan")):
        if fs.exists(hadoop(f"{path}/parts")):
            raise ValueError(f"{path} has results without a plan")
        replace_table(spark.createDataFrame([(digest, batches)], "digest string, batches int"), f"{path}/plan")
    if spark.read.parquet(f"{path}/plan").first().digest != digest:
        raise ValueError(f"the run at {path} has another configuration")
    if not fs.exists(hadoop(f"{path}/input")):
        _moved(df.select(F.struct("*").alias("row"), F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("batch_no")), f"{path}/input", "batch_no")
    left = [b for b in range(batches) if b not in done(spark, path)]
    rows = spark.read.schema(StructType([StructField("row", df.schema), StructField("batch_no", IntegerType())])).parquet(f"{path}/input")
    for b in left[:most]:
        _moved(work(rows.where(F.col("batch_no") == b).select("row.*")), f"{path}/parts/batch_no={b}")
    return len(left[most:]) if most is not None else 0


def result(spark: SparkSession, path: str) -> DataFrame:
    """What a run gave, once all of its batches have ended; before that an error."""
    batches = spark.read.parquet(f"{path}/plan").first().batches
    missing = sorted(set(range(batches)) - done(spark, path))
    if missing:
        raise ValueError(f"batches {missing} have not ended")
    return spark.read.parquet(*(f"{path}/parts/batch_no={b}" for b in range(batches)))
