"""Checks, outcomes and per-adapter summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import comparable_text
from folioscope.sources.scratch import small

#: The checks in their order.
CHECKS = ("opened", "saved", "package-valid", "edit-applied", "content-preserved", "render-similarity", "parts-preserved", "semantic-preserved")


def outcome(timeout: Column, phase: Column, failed: Column) -> Column:
    """error after a timeout or in an early phase, failure with a failed check, else success."""
    return F.when(timeout | phase.isin("open", "edit", "save"), "error").when(failed, "failure").otherwise("success")


def tasks(adapters: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """adapter, file, runs: every available adapter on every file; a file without a target runs nothing.

    Adapters are broadcast where their number allows it.
    """
    able = files.join(targets.select("file").distinct().withColumn("runs", F.lit(True)), "file", "left")
    return able.crossJoin(small(adapters)).select("adapter", "file", F.coalesce("runs", F.lit(False)).alias("runs"))


def check_summary(checks: DataFrame, names: list[str], group: str = "adapter") -> DataFrame:
    """A row per adapter with the scored successes of each check and the number of scored rows."""
    scored = checks.where("scored")
    passed = scored.groupBy(group).pivot("name", names).agg(F.count_if(F.col("outcome") == "success")).na.fill(0)
    return passed.join(scored.groupBy(group).agg(F.count("*").alias("scored_rows")), group)


def feature_preservation(inputs: DataFrame, diffs: DataFrame, results: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """adapter, feature, preserved, present, rate: of the scored files that have a feature, those where it didn't differ.

    results: adapter, file, compared (false if there was no output to compare).
    """
    have = results.join(inputs, "file").select("adapter", "file", "compared", "feature")
    lost = diffs.select("adapter", "file", "feature").distinct().withColumn("lost", F.lit(True))
    each = have.join(lost, ["adapter", "file", "feature"], "left")
    kept = each.groupBy("adapter", "feature").agg(F.count_if(F.col("compared") & F.col("lost").isNull()).alias("preserved"), F.count("*").alias("present"))
    every = results.select("adapter").distinct().crossJoin(small(vocabulary))
    out = every.join(kept, ["adapter", "feature"], "left").na.fill(0, ["preserved", "present"])
    return out.withColumn("rate", F.when(F.col("present") > 0, F.round(F.col("preserved") / F.col("present"), 4)))


def differing_files(diffs: DataFrame) -> DataFrame:
    """adapter, feature, files, most first."""
    return diffs.groupBy("adapter", "feature").agg(F.count_distinct("file").alias("files")).orderBy("adapter", F.desc("files"), "feature")


def median_elapsed(samples: DataFrame, group: list[str], value: str) -> DataFrame:
    """The middle value, or the mean of the two middle values rounded to 3."""
    out = samples.groupBy(*group).agg(F.median(value).alias("m"), F.count(value).alias("n"))
    return out.select(*group, F.when(F.col("n") % 2 == 0, F.round("m", 3)).otherwise(F.col("m")).alias("median_ms"), "n")


def run_status(results: DataFrame, group: list[str]) -> DataFrame:
    """success if there is a scored row and all of them succeed."""
    good = F.coalesce(F.every(F.when(F.col("scored"), F.col("outcome") == "success")), F.lit(False))
    return results.groupBy(*group).agg(F.when(good, "success").otherwise("failure").alias("status"))


def first_samples(df: DataFrame, group: list[str], order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows of each group with their rank."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def check_lists(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, checks: each row's checks (name, outcome) in the order of ``CHECKS``."""
    place = F.array_position(F.array(*(F.lit(c) for c in CHECKS)), F.col("name"))
    listed = F.sort_array(F.collect_list(F.struct(place.alias("place"), "name", "outcome")))
    return checks.groupBy(*keys).agg(listed.alias("l")).select(*keys, F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["outcome"].alias("outcome"))).alias("checks"))


def render_similarity(pages: DataFrame, keys: list[str], expected: str, limit: float) -> DataFrame:
    """keys, pages, worst, outcome over ``pages`` (keys, page, share of differing points, the number of pages expected).

    success if all pages are there and none differs by more than ``limit``.
    """
    found = pages.groupBy(*keys).agg(F.count("share").alias("pages"), F.max("share").alias("worst"), F.max(expected).alias("_wanted"))
    good = (F.col("pages") == F.col("_wanted")) & (F.col("worst") <= limit)
    return found.select(*keys, "pages", "worst", F.when(F.coalesce(good, F.lit(False)), "success").otherwise("failure").alias("outcome"))


def mislocated(located: Column, expected: Column) -> Column:
    """Whether an adapter found another paragraph than it was sent to: the texts differ in more than breaks and drawings."""
    return F.coalesce(comparable_text(located) != comparable_text(F.coalesce(expected, F.lit(""))), F.lit(False))
