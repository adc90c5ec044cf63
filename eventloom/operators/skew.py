"""Ordered operations over keys of any size.

``row_number`` or ``last`` over a plain key sends every row of the key to one task. These
helpers cut each key's timeline into fixed time slices, do the ordered work per
(key, slice), and carry only one row per slice across the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_MS = 600_000


def _slice(ts: str, slice_ms: int) -> Column:
    return F.expr(f"{ts} div {slice_ms}")


def ordinal(
    df: DataFrame, keys: list[str], ts: str, ties: list[str], out: str,
    slice_ms: int = SLICE_MS, require: Column | None = None,
) -> DataFrame:
    """1-based position of each row within its key, by ``ts`` then ``ties``.

    With ``require``, only keys having at least one row for which it holds are kept.
    """
    sliced = df.withColumn("_slice", _slice(ts, slice_ms))
    inside = sliced.withColumn(
        "_pos", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(ts, *ties))
    )
    held = F.lit(1) if require is None else F.when(require, 1).otherwise(0)
    whole_key = Window.partitionBy(*keys)
    before = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"), F.max(held).alias("_held"))
        .withColumns(
            {
                "_before": F.sum("_n").over(whole_key.orderBy("_slice")) - F.col("_n"),
                "_held": F.max("_held").over(whole_key),
            }
        )
        .where("_held = 1")
        .drop("_n", "_held")
    )
    return (
        inside.join(before, [*keys, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_pos"))
        .drop("_slice", "_pos", "_before")
    )


def latest_before(
    df: DataFrame,
    keys: list[str],
    ts: str,
    ties: list[str],
    value: Column,
    out: str,
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """The last non-NULL ``value`` strictly before each row of its key."""
    sliced = df.withColumn("_slice", _slice(ts, slice_ms)).withColumn("_value", value)
    earlier = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(ts, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = sliced.withColumn("_in", F.last("_value", ignorenulls=True).over(earlier))
    slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # Slices and their last values apart: the first aggregates by hash, and only rows with a
    # value pay for ordering.
    ends = (
        sliced.where("_value is not null")
        .groupBy(*keys, "_slice")
        .agg(F.max_by("_value", F.struct(ts, *ties)).alias("_last"))
    )
    carried = (
        sliced.select(*keys, "_slice")
        .distinct()
        .join(ends, [*keys, "_slice"], "left")
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(slices))
        .drop("_last")
    )
    return (
        inside.join(carried, [*keys, "_slice"])
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_slice", "_value", "_in", "_carry")
    )
