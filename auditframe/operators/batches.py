"""Padded batches of ragged rows: fixed width within a batch, a mask, and which parts are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.operators.ranks import numbered


def padded(values: Column, width: Column, fill: Column) -> Column:
    """An array with ``fill`` up to ``width``; all of it where the array is null."""
    own = F.coalesce(values, F.slice(F.array(fill), 1, 0))
    return F.concat(own, F.array_repeat(fill, (width - F.size(own)).cast("int")))


def padded_batches(df: DataFrame, unit: str, parts: dict[str, Column], size: int, step: int, seed: int = 0) -> DataFrame:
    """One row a batch: ``bucket`` and ``batch``, ``units``, ``width``, and for each of ``parts`` (name to the fill of a place) the
    padded arrays ``{part}`` (one a unit), their ``{part}_mask`` and ``{part}_available``; and ``waste``, the share of places that are padding.

    Rows are put into buckets by their length, the greatest of their parts', rounded up to ``step``, and dealt within a bucket in the order of a keyed hash,
    ``size`` to a batch; so a batch pads less than ``step`` places a row, whatever lengths the table has. The parts of a batch share one width, its
    longest row's. A batch holds at most ``size`` rows; the last of each bucket may hold fewer. A null part is all padding and not available; rows whose
    parts are all null or empty are batches of width 0. Ids must not repeat.
    """
    length = F.greatest(*(F.size(F.coalesce(F.col(p), F.slice(F.array(fill), 1, 0))) for p, fill in parts.items()), F.lit(0))
    rows = df.select(unit, *parts, length.alias("__length"), (F.ceil(length / step) * step).cast("int").alias("bucket"))
    rows = rows.withColumn("__key", F.sha2(F.concat_ws(":", F.lit(seed), F.col(unit).cast("string")), 256))
    placed = numbered(rows, "__key", unit, "__turn", ["bucket"]).withColumn("batch", F.floor((F.col("__turn") - 1) / size))
    held = placed.groupBy("bucket", "batch").agg(F.array_sort(F.collect_list(F.struct("__turn", unit, "__length", *parts))).alias("__rows"), F.max("__length").alias("width"))

    def each(f) -> Column:
        return F.transform("__rows", f)

    def long(r: Column, part: str) -> Column:
        return F.greatest(F.coalesce(F.size(r[part]), F.lit(0)), F.lit(0))

    def of_part(part: str, fill: Column) -> list[Column]:
        mask = each(lambda r: F.concat(F.array_repeat(F.lit(True), long(r, part)), F.array_repeat(F.lit(False), F.col("width") - long(r, part))))
        return [each(lambda r: padded(r[part], F.col("width"), fill)).alias(part), mask.alias(f"{part}_mask"), each(lambda r: r[part].isNotNull()).alias(f"{part}_available")]

    columns = [c for part, fill in parts.items() for c in of_part(part, fill)]
    used = F.aggregate("__rows", F.lit(0).cast("long"), lambda total, r: total + sum((long(r, p) for p in parts), F.lit(0)))
    places = F.size("__rows") * F.col("width") * len(parts)
    waste = F.when(places > 0, 1 - used / F.when(places > 0, places)).otherwise(0.0)
    return held.select("bucket", "batch", each(lambda r: r[unit]).alias("units"), "width", *columns, waste.alias("waste"))
