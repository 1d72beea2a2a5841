"""Connected components of a link table, by large-star and small-star rounds.

Each partition first replaces its own links by stars (a union-find over the links it holds),
which changes no component and shrinks dense graphs at once.  Rounds of large-star and
small-star then run until the links no longer change.  Minima are partially aggregated and
joined back, so no node's links are gathered in one place, and every round ends in the
shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import cut, drop


def _contract(batches):
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] = parent.setdefault(p, p)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    for at in range(0, len(pairs), 100_000):
        part = pairs[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["u", "v"])


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).collect()[0])


def components(links: DataFrame) -> DataFrame:
    """id, component: every id (long) of ``links`` (a, b) that has a link, with the smallest id that it reaches."""
    pairs = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v")
    now = cut(pairs.mapInArrow(_contract, "u long, v long").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = cut(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(now, large)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
