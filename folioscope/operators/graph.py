"""The graph of package parts: dangling references, logical paths, and matching of two packages' parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import natural_key
from folioscope.sources.scratch import written


def dangling(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Internal relationships (pkg, source, rel_id, target, external) whose target is no part of the package."""
    return rels.where("NOT external").join(parts.select("pkg", F.col("part").alias("target")), ["pkg", "target"], "left_anti")


def untyped(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """Parts that have a content type neither by name nor by extension."""
    extension = F.lower(F.regexp_extract("part", r"\.([^./]*)$", 1))
    return parts.join(overrides, ["pkg", "part"], "left_anti").withColumn("extension", extension).join(defaults, ["pkg", "extension"], "left_anti")


def ordinals(rels: DataFrame) -> DataFrame:
    """``rels`` with step: the type and the rank among the relationships of that type of their source, by natural order of targets."""
    rank = F.row_number().over(Window.partitionBy("pkg", "source", "kind").orderBy(natural_key(F.col("target")), "target", "rel_id"))
    return rels.withColumn("step", F.concat(F.lit("/"), "kind", F.lit("#"), rank.cast("string")))


def logical_paths(rels: DataFrame) -> DataFrame:
    """pkg, part, path: the chain of relationship steps by which each part is first reached from the root.

    Breadth first, one join per level, until a level reaches nothing new.  Parts met before are
    dropped by an anti join, so cycles end.  Each level is a written table, so the plan of a
    level doesn't hold those of all levels before.
    """
    steps = written(ordinals(rels.where("NOT external")).select("pkg", F.col("source").alias("part"), "target", "step"), "steps").alias("s")
    level = rels.select("pkg").distinct().select("pkg", F.lit("").alias("part"), F.lit("").alias("path"))
    found = None
    while True:
        reached = level.alias("l").join(steps, ["pkg", "part"]).select("pkg", F.col("s.target").alias("part"), F.concat("l.path", "s.step").alias("path"))
        level = reached.where("part <> ''").groupBy("pkg", "part").agg(F.min("path").alias("path"))
        if found is not None:
            level = level.join(found.select("pkg", "part"), ["pkg", "part"], "left_anti")
        level = written(level, "level")
        if found is not None and level.isEmpty():
            return found
        found = level if found is None else found.unionByName(level)


def map_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """pkg, part, other, method: which part of ``after`` a part of ``before`` became.

    Both have pkg, part, path, type, digest.  By name; then by logical path with an equal
    content type; then by digest, the k-th of the unmatched with the k-th in name order.
    Each pass sees what the ones before left on both sides.
    """
    a, b = before, after
    name = a.join(b.select("pkg", "part"), ["pkg", "part"]).select("pkg", "part", F.col("part").alias("other"), F.lit("name").alias("method"))

    def rest(side: DataFrame, used: DataFrame, column: str) -> DataFrame:
        return side.join(used.select("pkg", F.col(column).alias("part")), ["pkg", "part"], "left_anti")

    a1, b1 = rest(a, name, "part"), rest(b, name, "other")
    path = a1.join(b1.select("pkg", "path", "type", F.col("part").alias("other")), ["pkg", "path", "type"]).where("path IS NOT NULL")
    order = lambda c, by: F.row_number().over(Window.partitionBy("pkg", c).orderBy(by))
    path = path.withColumn("i", order("part", "other")).withColumn("j", order("other", "part")).where("i = 1 AND j = 1")
    path = path.select("pkg", "part", "other", F.lit("path").alias("method"))
    a2, b2 = rest(a1, path, "part"), rest(b1, path, "other")
    nth = F.row_number().over(Window.partitionBy("pkg", "digest").orderBy("part"))
    same = a2.withColumn("nth", nth).join(b2.withColumn("nth", nth).select("pkg", "digest", "nth", F.col("part").alias("other")), ["pkg", "digest", "nth"])
    same = same.select("pkg", "part", "other", F.lit("digest").alias("method"))
    return name.unionByName(path).unionByName(same)


def unmapped(before: DataFrame, after: DataFrame, mapping: DataFrame) -> DataFrame:
    """pkg, part, side: parts lost, and parts that are new."""
    lost = before.select("pkg", "part").join(mapping.select("pkg", "part"), ["pkg", "part"], "left_anti").withColumn("side", F.lit("missing"))
    new = after.select("pkg", "part").join(mapping.select("pkg", F.col("other").alias("part")), ["pkg", "part"], "left_anti").withColumn("side", F.lit("added"))
    return lost.unionByName(new)


def new_problems(df: DataFrame, now: str, known: str) -> DataFrame:
    """``df`` with new: the entries of array ``now`` that array ``known`` hasn't, repeats kept."""
    return df.withColumn("new", F.filter(now, lambda p: ~F.coalesce(F.array_contains(known, p), F.lit(False))))
