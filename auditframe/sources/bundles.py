"""Bundles of arrays: a row for each entity and modality, its bytes beside shape, type and SHA-256.

Parquet keeps the columns apart, so contracts and shapes are read without the bytes, and modalities are
pruned by the scan. Digests are made and checked in the JVM where the bytes are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one number of each type that a bundle may hold.
WIDTHS = {"float16": 2, "float32": 4, "float64": 8, "int32": 4, "int64": 8, "bool": 1}
COLUMNS = ["entity", "modality", "shape", "dtype", "data", "sha256"]


def pack(array: np.ndarray) -> tuple[list[int], str, bytes]:
    """Shape, type and little-endian bytes of an array."""
    array = np.ascontiguousarray(array)
    return list(array.shape), array.dtype.name, array.astype(array.dtype.newbyteorder("<")).tobytes()


def unpack(shape: list[int], dtype: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.dtype(dtype).newbyteorder("<")).reshape(shape)


def write_bundles(arrays: DataFrame, path: str) -> None:
    """Write ``entity``, ``modality``, ``shape``, ``dtype`` and ``data``, partitioned by modality, with digests."""
    whole = arrays.withColumn("sha256", F.sha2("data", 256)).select(*COLUMNS)
    whole.write.mode("overwrite").partitionBy("modality").parquet(path)


def contract(spark: SparkSession, path: str) -> DataFrame:
    """Entities, modalities, shapes and types: the scan doesn't read the bytes."""
    return spark.read.parquet(path).select("entity", "modality", "shape", "dtype")


def broken(bundles: DataFrame, *, ranks: dict[str, int] | None = None, dtypes: dict[str, str] | None = None) -> DataFrame:
    """``entity``, ``modality`` and the first rule that a bundle breaks: digest, type, size, rank, expected
    type, values that aren't finite."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda n, d: n * d)
    widths = F.create_map(*(F.lit(x) for pair in WIDTHS.items() for x in pair))
    width = F.try_element_at(widths, F.col("dtype"))
    why = F.when(F.sha2("data", 256) != F.col("sha256"), "digest").when(width.isNull(), "type").when(F.octet_length("data") != size * width, "size")
    for modality, rank in (ranks or {}).items():
        why = why.when((F.col("modality") == modality) & (F.size("shape") != rank), "rank")
    for modality, dtype in (dtypes or {}).items():
        why = why.when((F.col("modality") == modality) & (F.col("dtype") != dtype), "expected type")
    why = why.when(~finite("data", "dtype"), "not finite")
    return bundles.select("entity", "modality", why.alias("why")).where("why IS NOT NULL")


def finite(data: str, dtype: str) -> Column:
    @F.pandas_udf("boolean")
    def run(data: pd.Series, dtype: pd.Series) -> pd.Series:
        return pd.Series([all_finite(d, t) for d, t in zip(data, dtype, strict=True)], dtype=bool)

    return run(data, dtype)


def all_finite(data: bytes, dtype: str) -> bool:
    if not dtype.startswith("float") or dtype not in WIDTHS or len(data) % WIDTHS[dtype]:
        return True
    return bool(np.isfinite(np.frombuffer(data, dtype=np.dtype(dtype).newbyteorder("<"))).all())


def read_bundles(spark: SparkSession, path: str, modalities: list[str] | None = None, **rules) -> DataFrame:
    """Bundles of the chosen modalities, all if none are named. A broken one, or a modality that no
    entity has, is an error."""
    rows = spark.read.parquet(path)
    if modalities is not None:
        rows = rows.where(F.col("modality").isin(modalities))
        missing = set(modalities) - {r["modality"] for r in rows.select("modality").distinct().collect()}
        if missing:
            raise ValueError(f"no bundle has {sorted(missing)}")
    if (bad := broken(rows, **rules).first()) is not None:
        raise ValueError(f"bundle of {bad['entity']}, {bad['modality']}: {bad['why']}")
    return rows.select(*COLUMNS)

