"""What the operators of this subpackage share: reading tables, id checks, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.sources.scratch import drop_saved, saved, shared_dir  # noqa: F401

#: A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows go to Python a few hundred at a time, as texts can be long.

    Spark reads this setting when a plan runs, so it stays lowered for the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def held_out(column: str, divisor: int, remainder: int):
    """True where crc32 of the id's decimal text leaves ``remainder`` on division by ``divisor``."""
    return F.crc32(F.col(column).cast("string")) % divisor == remainder


def lower_ascii(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
