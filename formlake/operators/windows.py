"""Skew-safe neighbour windows: previous / next row, row numbers and carried-forward values.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task; a key
holding a third of the log would make that task hold a third of the data. Here every key is
split into time buckets: the window runs per (key, bucket), and only one boundary row per
(key, bucket) — its last or first row — is windowed per key to stitch neighbouring buckets
together. The boundary rows are taken from the windowed data (one row per key and bucket),
so the stitching side is small and AQE broadcasts it into the join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = "day"


def time_bucket(col: str, unit: str = DEFAULT_BUCKET) -> Column:
    return F.date_trunc(unit, F.col(col))


def _bucketed(df: DataFrame, keys: list[str], order: list[str], bucket: Column):
    d = df.withColumn("_b", bucket)
    return d, Window.partitionBy(*keys, "_b").orderBy(*order), Window.partitionBy(*keys).orderBy("_b")


def with_previous(df: DataFrame, keys: list[str], order: list[str], payload: list[str], bucket: Column,
                  name: str = "_prev") -> DataFrame:
    """Add ``name``: struct of ``payload`` from the previous row of the same key in ``order``."""
    d, w, wb = _bucketed(df, keys, order, bucket)
    row = F.struct(*payload)
    d = (d.withColumn(name, F.lag(row).over(w)).withColumn("_row", row)
         .withColumn("_first", F.lag(F.lit(1)).over(w).isNull())
         .withColumn("_edge", F.lead(F.lit(1)).over(w).isNull()))
    carry = (d.where("_edge").select(*keys, "_b", F.lag("_row").over(wb).alias("_carry")))
    out = d.join(carry, [*keys, "_b"], "left")
    return (out.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(name)))
            .drop("_b", "_row", "_first", "_edge", "_carry"))


def with_next(df: DataFrame, keys: list[str], order: list[str], col: str, bucket: Column,
              name: str = "_next") -> DataFrame:
    """Add ``name``: ``col`` of the next row of the same key in ``order``."""
    d, w, wb = _bucketed(df, keys, order, bucket)
    d = d.withColumn(name, F.lead(col).over(w)).withColumn("_edge", F.lag(F.lit(1)).over(w).isNull()) \
        .withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    carry = d.where("_edge").select(*keys, "_b", F.lead(col).over(wb).alias("_carry"))
    out = d.join(carry, [*keys, "_b"], "left")
    return (out.withColumn(name, F.when(F.col("_last"), F.col("_carry")).otherwise(F.col(name)))
            .drop("_b", "_edge", "_last", "_carry"))


def with_row_number(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "_n") -> DataFrame:
    """Add ``name``: 1-based position of the row within its key (bucket offsets added)."""
    d, w, wb = _bucketed(df, keys, order, bucket)
    d = d.withColumn(name, F.row_number().over(w)).withColumn("_edge", F.lead(F.lit(1)).over(w).isNull())
    offsets = d.where("_edge").select(
        *keys, "_b", F.coalesce(F.sum(name).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (d.join(offsets, [*keys, "_b"], "left").withColumn(name, F.col(name) + F.col("_off"))
            .drop("_b", "_edge", "_off"))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], cols: list[str], bucket: Column) -> DataFrame:
    """Replace each of ``cols`` by its last non-null value so far within the key (inclusive)."""
    d, w, wb = _bucketed(df, keys, order, bucket)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({c: F.last(c, ignorenulls=True).over(running) for c in cols}) \
        .withColumn("_edge", F.lead(F.lit(1)).over(w).isNull())
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    carry = d.where("_edge").select(*keys, "_b", *[F.last(c, ignorenulls=True).over(before).alias(f"_c_{c}")
                                                   for c in cols])
    out = d.join(carry, [*keys, "_b"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in cols}).drop(
        "_b", "_edge", *[f"_c_{c}" for c in cols])
