"""Reading and writing tables by suffix, with declared schemas and keyed, idempotent writes."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

READERS = {".parquet": ("parquet", {}), ".pq": ("parquet", {}), ".csv": ("csv", {"header": True}), ".tsv": ("csv", {"header": True, "sep": "\t"})}


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, *, keep_empty: bool = False, lenient: bool = False) -> DataFrame:
    """A table by its suffix; any other suffix is an error unless ``lenient``, which reads CSV.

    Text formats need ``schema``: types are never inferred. ``keep_empty`` reads empty CSV fields as
    empty strings, not as nulls.
    """
    suffix = next((s for s in READERS if path.endswith(s)), None)
    if suffix is None and not lenient:
        raise ValueError(f"no reader for {path}")
    kind, options = READERS[suffix or ".csv"]
    if kind == "csv" and schema is None:
        raise ValueError(f"{path} needs a schema")
    reader = spark.read.options(**options)
    if keep_empty:
        reader = reader.option("nullValue", "\u0000").option("emptyValue", "")
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table, or no rows of its schema where the path doesn't exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return read_table(spark, path, schema) if there else spark.createDataFrame([], schema)


def write_keyed(df: DataFrame, path: str, config_hash: str) -> None:
    """Parquet partitioned by the hash of the run's configuration: a rerun replaces its own rows."""
    df.withColumn("config_hash", F.lit(config_hash)).write.partitionBy("config_hash").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def content_path(*parts: str):
    """A path of checked components as a column: null if one isn't plain."""
    cols = [F.col(p) for p in parts]
    plain = F.forall(F.array(*cols), lambda c: c.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"))
    return F.when(plain, F.concat_ws("/", *cols))


def file_digests(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``name``, ``size`` and SHA-256 of each file below ``path`` whose name has the glob ``pattern``; files are read in tasks,
    2 GB each at most. Spark's scan leaves empty files out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def replace_table(df: DataFrame, path: str) -> None:
    """Write Parquet beside ``path``, then swap: readers see the old table or the new one, never a part.

    The old table is kept until the new one stands in its place, and comes back if the swap fails.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = uuid.uuid4().hex
    to, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{mark}", f"{path}.old-{mark}"))
    fs = to.getFileSystem(conf)
    df.write.parquet(new.toString())
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(new, to):
        if had:
            fs.rename(old, to)
        raise OSError(f"{path} can't be put in place")
    if had:
        fs.delete(old, True)


def write_report(folder: str, predictions: DataFrame, metrics: DataFrame, manifest: dict) -> None:
    """Predictions, metrics and a one-row manifest with both digests' numbers of rows, each a table of ``folder``."""
    spark = predictions.sparkSession
    replace_table(predictions, f"{folder}/predictions.parquet")
    replace_table(metrics, f"{folder}/metrics.parquet")
    rows = {name: spark.read.parquet(f"{folder}/{name}.parquet").count() for name in ("predictions", "metrics")}
    text = json.dumps(manifest | {"rows": rows}, sort_keys=True, separators=(",", ":"))
    replace_table(spark.createDataFrame([(text, hashlib.sha256(text.encode()).hexdigest())], "manifest string, digest string"), f"{folder}/manifest.parquet")


def write_sparse(active: DataFrame, path: str, group: str = "label") -> None:
    """Coordinates and values of a sparse matrix, partitioned by ``group`` and sorted, so that Parquet's
    statistics and encodings work: the compressed form of a table of mostly zeros."""
    names = [c for c in active.columns if c not in (group, "feature", "activation")]
    active.repartition(group).sortWithinPartitions(group, *names, "feature").write.mode("overwrite").partitionBy(group).parquet(path)
