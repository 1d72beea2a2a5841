"""Embedding near-dedup by int8 tile products.

Equal vectors of a label are one group with a count, so copies cost nothing further.  Groups
of a label go to tiles of a bounded size by a hash of their number; each pair of tiles of a
label is one task-sized product, however many rows a label has.  A tile holds its unit
vectors quantised to int8, u = s q + e, with s and the norm of e per vector.  For two vectors

    |u.v - s t (q.p)| <= |s q| |f| + |e| |t p| + |e| |f| <= (1 + |e|) |f| + |e| (1 + |f|),

as |s q| is 1 + |e| at most; so a pair whose quantised product plus that bound is below the threshold can't be a link, one
whose product minus it is above must be, and only the pairs between are recomputed in double
precision.  A tile pair returns, per group, the rows linked to it and one star edge; pairs
themselves are never emitted.

Defined cases: rows of null label or null id, and vectors that are null, empty, zero or hold
a null or non-finite number link with nothing; labels may be of any kind, and vectors of floats or
doubles are taken as they are; vectors of different lengths don't link.
Repeated rows are vectors of their own and link with each other; rows that share a vec_id
share a component.  Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.scratch import cut, small

THRESHOLD = 0.93

#: Vectors in a tile, about.
TILE = 1024

#: Margin for rounding in double precision.
EPS = 1e-9

_TILE_SCHEMA = "label string, dim int, tile int, tiles int, gid binary, rep binary, n binary, q binary, s binary, err binary, x binary"
_PART_SCHEMA = "gid long, rep long, links long, root long"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of the unit vectors of the rows of ``x``."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    return q, s, np.linalg.norm(u - s[:, None] * q, axis=1)


def linked_pairs(a: dict, b: dict, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tile ``a`` and rows of tile ``b`` whose cosine is at least ``threshold``."""
    exact = np.float32 if a["q"].shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (a["q"].astype(exact) @ b["q"].astype(exact).T).astype(np.float64)
    near *= a["s"][:, None]
    near *= b["s"][None, :]
    long_a, long_b = 1 + a["err"], 1 + b["err"]
    bound = np.outer(long_a, b["err"])
    bound += np.outer(a["err"], long_b)
    bound += EPS
    r, c = np.nonzero(near + bound >= threshold)
    sure = near[r, c] - bound[r, c] >= threshold
    doubt = np.nonzero(~sure)[0]
    ua, ub = a["unit"], b["unit"]
    for at in range(0, len(doubt), 65536):
        k = doubt[at : at + 65536]
        sure[k] = np.einsum("ij,ij->i", ua[r[k]], ub[c[k]]) >= threshold
    return r[sure], c[sure]


def _stars(r: np.ndarray, c: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """For each node the smallest rep that it reaches by the links (r, c)."""
    low = rep.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, r, low[c])
        np.minimum.at(low, c, low[r])
        if (low == before).all():
            return low


def _pack(table: pa.Table) -> pa.Table:
    x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    q, s, err = quantise(x.astype(np.float64))
    get = lambda c: table.column(c)[0].as_py()
    long = lambda c: table.column(c).to_numpy().astype(np.int64).tobytes()
    row = [get("label"), get("dim"), get("tile"), get("tiles"), long("gid"), long("rep"), long("n"), q.tobytes(), s.tobytes(), err.tobytes(), x.tobytes()]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 7
    names = [f.split()[0] for f in _TILE_SCHEMA.split(", ")]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


def _load(row: dict) -> dict:
    dim = row["dim"]
    wide = np.float64 if len(row["x"]) == 8 * len(row["q"]) else np.float32
    x = np.frombuffer(row["x"], wide).reshape(-1, dim).astype(np.float64)
    out = {k: np.frombuffer(row[k], np.int64) for k in ("gid", "rep", "n")}
    out |= {"q": np.frombuffer(row["q"], np.int8).reshape(-1, dim), "s": np.frombuffer(row["s"]), "err": np.frombuffer(row["err"])}
    return out | {"unit": x / np.linalg.norm(x, axis=1)[:, None]}


def _multiply(threshold: float):
    def of_pair(table: pa.Table) -> pa.Table:
        tiles = [_load(row) for row in sorted(table.to_pylist(), key=lambda row: row["tile"])]
        a, b = tiles[0], tiles[-1]
        r, c = linked_pairs(a, b, threshold)
        if a is b:
            upper = r < c
            r, c = r[upper], c[upper]
            nodes = a
        else:
            nodes = {k: np.concatenate([a[k], b[k]]) for k in ("gid", "rep", "n")}
            c = c + len(a["gid"])
        links = np.bincount(r, nodes["n"][c], len(nodes["gid"])) + np.bincount(c, nodes["n"][r], len(nodes["gid"]))
        root = _stars(r, c, nodes["rep"])
        some = links > 0
        cols = [nodes["gid"][some], nodes["rep"][some], links[some].astype(np.int64), root[some]]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in cols], ["gid", "rep", "links", "root"])

    return of_pair


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    held = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(held).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    able = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    groups = vectors.where(able).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    groups = cut(groups.withColumn("gid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "groups")

    counts = cut(groups.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "counts")
    dealt = groups.join(small(counts, 24), ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("gid"), "tiles").cast("int"))
    tiles = cut(dealt.groupBy("label", "dim", "tile").applyInArrow(_pack, _TILE_SCHEMA), "tiles")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    cells = tiles.withColumn("other", other).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    parts = cut(cells.groupBy("label", "dim", "low", "high").applyInArrow(_multiply(threshold), _PART_SCHEMA), "parts")

    linked = parts.groupBy("gid").agg(F.sum("links").alias("links"))
    reach = components(parts.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    about = groups.join(linked, "gid", "left").join(reach, groups["rep"] == reach["id"], "left").select(
        groups["label"], groups["embedding"], (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    met = vectors.where(able).join(about, ["label", "embedding"], "left").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = vectors.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
), low AS (SELECT id, min(other) AS other FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.other, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low.other, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN low ON vec_id = low.id
"""
