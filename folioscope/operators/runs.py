"""Runs, ranks, carried values and interval overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_runs(df: DataFrame, group: list[str], order: list[str], same: list[str], text: str, breaks: Column | None = None) -> DataFrame:
    """Neighbours of equal ``same`` values become one row with their texts joined; empty texts go first, and where ``breaks`` holds nothing merges."""
    kept = df.where(F.col(text) != "")
    w = Window.partitionBy(*group).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if breaks is not None:
        changed = changed | breaks | F.coalesce(F.lag(breaks).over(w), F.lit(False))
    first = F.row_number().over(w) == 1
    island = F.sum(F.when(first | changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = kept.withColumn("run", island)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), "")
    return parts.groupBy(*group, "run").agg(*(F.first(c).alias(c) for c in same), joined.alias("text"), F.count("*").alias("n"))


def number_runs(df: DataFrame, group: list[str], number: str, same: list[str]) -> DataFrame:
    """first, last and n of each maximal run of consecutive numbers with equal ``same`` values."""
    rows = df.select(*group, number, *same).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*group, *same).orderBy(number))
    return (
        rows.withColumn("_island", island)
        .groupBy(*group, *same, "_island")
        .agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"))
        .drop("_island")
    )


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the latest value that isn't null up to each row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def ranked(df: DataFrame, group: list[str], priority: str, order: list[str]) -> DataFrame:
    """rank by priority, a missing one last, then by order."""
    w = Window.partitionBy(*group).orderBy(F.coalesce(priority, F.lit(1 << 30)), *order)
    return df.withColumn("rank", F.row_number().over(w))


def overlapping(points: DataFrame, ranges: DataFrame, group: list[str], at: str, low: str, high: str, strip: int) -> DataFrame:
    """``points`` with the ranges [low, high) of their group that hold them.

    Ranges are cut into strips of a fixed width, so this is an equi-join on group and strip
    with a filter, not a nested loop; ``strip`` is about a usual range's width.
    """
    cut = ranges.withColumn("_strip", F.explode(F.sequence(F.floor(F.col(low) / strip), F.floor((F.col(high) - 1) / strip))))
    met = points.withColumn("_strip", F.floor(F.col(at) / strip)).join(cut, [*group, "_strip"])
    return met.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_strip")
