"""Screening, deduplication, splitting and selection of candidate files."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.scratch import small

#: Fixed value: file names that announce a damaged or hostile input.
HOSTILE = r"(?i)corrupt|invalid|broken|truncat|fuzz|crash|ofz\d|malformed|damaged|bogus|garbage|poc[-_.]"


def first_reason(rules: Iterable[tuple[str, Column]]) -> Column:
    """The label of the first rule that holds; null if none does."""
    return F.coalesce(*(F.when(F.coalesce(holds, F.lit(False)), F.lit(label)) for label, holds in rules))


def exclusions(candidates: DataFrame, rules: Iterable[tuple[str, Column]], group: list[str], content: Column, order: list[str]) -> DataFrame:
    """``candidates`` with reason: the first rule, else duplicate of an earlier eligible one of its group.

    Only candidates that pass all rules take part in the search for duplicates, so a copy
    that is excluded for another reason hides nothing.  The earliest of each content is a
    partially aggregated minimum, so a content that many files share is no task of its own.
    """
    ruled = candidates.withColumn("reason", first_reason(rules)).withColumn("_content", content)
    place = F.struct(*order)
    firsts = ruled.where("reason IS NULL").groupBy(*group, "_content").agg(F.min(place).alias("_first"))
    met = ruled.join(firsts, [*group, "_content"], "left")
    again = F.col("reason").isNull() & (place > F.col("_first"))
    return met.withColumn("reason", F.when(again, "duplicate").otherwise(F.col("reason"))).select(*candidates.columns, "reason")


def first_wins(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, by a minimum that is partially aggregated."""
    rest = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*group, "_row.*")


def exposure(files: DataFrame, engine: DataFrame) -> DataFrame:
    """file_id, split, locations: files whose bytes stand in ``engine`` (location, size, digest) are dev, the rest holdout.

    Rows of the engine are compared by digest only where some file has their size, so digests
    of other sizes need not be known.
    """
    sizes = files.select("size").distinct()
    hits = engine.join(sizes, "size", "left_semi").select("digest", "location")
    found = files.join(hits, "digest", "left").groupBy("file_id").agg(F.array_sort(F.collect_set("location")).alias("locations"))
    return found.withColumn("split", F.when(F.size("locations") > 0, "dev").otherwise("holdout"))


def lines_digest(lines: DataFrame, line: str) -> DataFrame:
    """SHA-256 of the sorted lines, joined by line feeds.  The text is one value: meant for lists of files, not of rows."""
    return lines.agg(F.sha2(F.expr(f"listagg({line}, '\\n') WITHIN GROUP (ORDER BY {line})").cast("binary"), 256).alias("digest"), F.count("*").alias("n"))


def manifest_counts(files: DataFrame) -> DataFrame:
    """Counts per format, per format and source and split, and per format and split, in one pass."""
    keys = [F.col(c) for c in ("format", "source", "split")]
    grouped = files.groupingSets([keys[:1], keys, [keys[0], keys[2]]], *keys)
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def split_counts(files: DataFrame, splits: tuple[str, ...] = ("holdout", "dev")) -> DataFrame:
    """A row for every format with every source, and a count for each split; zero where there are none."""
    counts = files.groupBy("format", "source").pivot("split", list(splits)).agg(F.count(F.lit(1)))
    every = files.select("format").distinct().crossJoin(small(files.select("source").distinct()))
    return every.join(counts, ["format", "source"], "left").na.fill(0, list(splits))


def wanted(files: DataFrame, kind: str, split: str = "all") -> DataFrame:
    """The files of one format, and of one split unless it is ``all``."""
    found = files.where(F.col("format") == kind)
    return found if split == "all" else found.where(F.col("split") == split)


#: What a report tells of a file.
FIXTURE = ("path", "sha256", "size", "source", "license", "split", "features")


def fixtures(files: DataFrame) -> DataFrame:
    """What a report tells of each of ``files``; its path is its id."""
    return files.select(F.col("path").alias("id"), *FIXTURE)


def files_digest(files: DataFrame, order: str = "path") -> DataFrame:
    """digest: SHA-256 of the rows as one compact JSON list, keys sorted, other than ASCII escaped.  Meant for a list of files."""
    schema = "_at string, _json string"
    names = files.columns

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"_at": [str(r[order]) for r in rows], "_json": [json.dumps({k: r[k] for k in names}, sort_keys=True, separators=(",", ":")) for r in rows]}, schema=pa.schema([("_at", pa.string()), ("_json", pa.string())]))

    listed = files.mapInArrow(run, schema).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_json"))), lambda x: x["_json"]), ",").alias("l"))
    return listed.select(F.sha2(F.concat(F.lit("["), "l", F.lit("]")).cast("binary"), 256).alias("digest"))


def labels(parts: DataFrame, rules: list[tuple[str, str, str | None]], part: str = "part", content: str = "content") -> DataFrame:
    """file_id, label: rules (label, pattern of the part's name, pattern of its content) that a part of the file fits.

    Rules are literals of one expression, so their patterns are compiled once; a null content
    pattern fits any content.
    """
    fits = [F.col(part).rlike(name) & (F.coalesce(F.col(content).rlike(inside), F.lit(False)) if inside else F.lit(True)) for _, name, inside in rules]
    found = F.array_compact(F.array(*(F.when(fit, F.lit(label)) for fit, (label, _, _) in zip(fits, rules))))
    return parts.select("file_id", F.explode(found).alias("label")).distinct()


def gains(pool: DataFrame, covered: DataFrame) -> DataFrame:
    """file_id, gain, n_labels: what each candidate of ``pool`` (file_id, labels) adds to ``covered`` (label, times)."""
    each = pool.select("file_id", F.explode_outer("labels").alias("label")).join(small(covered), "label", "left")
    gain = F.sum(F.when(F.col("label").isNotNull(), 1 / (1 + F.coalesce("times", F.lit(0)))).otherwise(0.0))
    return each.groupBy("file_id").agg(gain.alias("gain"), F.count("label").alias("n_labels"))


def next_pick(pool: DataFrame, covered: DataFrame) -> DataFrame:
    """The candidate of ``pool`` (file_id, labels, size, path) that one greedy round takes."""
    rated = pool.join(gains(pool, covered), "file_id")
    rated = rated.withColumn("gain", F.round("gain", 9))
    return rated.orderBy(F.desc("gain"), F.desc("n_labels"), "size", "path").limit(1).select("file_id", "gain", "n_labels")


def greedy(pool: list[dict], wanted: int, times: dict[str, int]) -> list[dict]:
    """Up to ``wanted`` candidates, one by one, each with the largest gain in labels not yet covered; ``times`` is updated."""
    left, out = list(pool), []
    while left and len(out) < wanted:
        rate = lambda c: (-sum(1 / (1 + times.get(x, 0)) for x in c["labels"]), -len(c["labels"]), c["size"], c["path"])
        best = min(left, key=rate)
        left.remove(best)
        out.append(best)
        for x in best["labels"]:
            times[x] = times.get(x, 0) + 1
    return out


def cover(candidates: DataFrame, quotas: dict[str, int], target: int) -> DataFrame:
    """format, file_id, pick: greedy choice per format, source by source in the order of ``quotas``.

    A source that falls short hands its rest to the next one, coverage is shared by the
    sources of a format, and what is still missing comes from all sources.  The choice is
    sequential by definition: pools are candidate lists per format, thousands of rows at
    most, and one format is one task.
    """

    def of_format(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(r, labels=list(r["labels"])) for r in pdf.to_dict("records")]
        times: dict[str, int] = {}
        chosen, short = [], 0
        for source, quota in quotas.items():
            wanted = quota + short
            got = greedy([r for r in rows if r["source"] == source], wanted, times)
            short = wanted - len(got)
            chosen += got
        taken = {r["file_id"] for r in chosen}
        rank = {s: i for i, s in enumerate(quotas)}
        rest = sorted((r for r in rows if r["file_id"] not in taken), key=lambda r: rank.get(r["source"], len(rank)))
        chosen += greedy(rest, target - len(chosen), times)
        return pd.DataFrame({"format": [pdf["format"].iloc[0]] * len(chosen), "file_id": [r["file_id"] for r in chosen], "pick": range(len(chosen))})

    kind = candidates.schema["file_id"].dataType.simpleString()
    return candidates.groupBy("format").applyInPandas(of_format, f"format string, file_id {kind}, pick long")


def flat_names(paths: list[str]) -> list[str]:
    """A flat name for each path in turn: its last segment, with as many parents as it needs to differ from earlier names, in any case."""
    taken: set[str] = set()
    out = []
    for path in paths:
        segments = path.split("/")
        for n in range(1, len(segments) + 1):
            name = "_".join(segments[-n:])
            if name.lower() not in taken:
                break
        taken.add(name.lower())
        out.append(name)
    return out
