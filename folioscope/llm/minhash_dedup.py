"""MinHash near-dedup: one-permutation hashing, banded buckets and star-shaped candidates.

A document's set holds its distinct shingles of five words.  Equal sets are one class with
the smallest doc_id, so copies, however many, make no pairs.  One permutation deals a class's
shingle hashes into bins and keeps the least of each; an empty bin takes the value of the
first non-empty bin along its own fixed random order (optimal densification).  Bands of bins
are bucket keys, and each bucket links its members to its smallest class only, a star, so
candidates grow with members rather than with pairs.  Candidates are confirmed on full sets,
and components of the confirmed links follow.

A star may miss a link between two members that are both unlike its centre.  So buckets that
still hold several components are looked at again: members go to tiles with their sets, each
pair of tiles compares short bitmaps, for which |A - B| >= |bits(A) & ~bits(B)| gives a strict
upper bound of the similarity, and pairs of different components that the bound doesn't
exclude are confirmed on the sets.  A tile pair returns only the links that join components,
so no pairs pile up, and no connection between documents that share a bucket is lost.

Defined cases: null or blank texts have an empty set and link with nothing; a text of fewer
than five words is one shingle.  Rows that share a doc_id but not a text are documents of
their own under one id, and repeated rows get equal results.  A null doc_id links with nothing, has a null component
and is kept.  Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.scratch import cut, small
from folioscope.llm.wordhash import mix, word_hashes

SHINGLE = 5
#: Links: 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 85

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
BITMAP_BITS = 2048
#: Members of a bucket in a tile, about.
TILE = 256

_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_ODDS = np.array(_ODD)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array):
    """Yields (first text, end text, hashes, text numbers): sorted distinct shingle hashes of each of a few whole texts."""
    for first, end, h, doc in word_hashes(texts):
        n = np.bincount(doc - first, minlength=end - first)
        starts = np.concatenate([[0], np.cumsum(n)])
        w = len(h) - SHINGLE + 1
        full = np.zeros(max(w, 0), np.uint64)
        if w > 0:
            for k in range(SHINGLE):
                full = full + h[k : k + w] * _ODD[k]
            full = mix(full)
        sets = []
        for i in range(end - first):
            a, z = starts[i], starts[i + 1]
            if z - a >= SHINGLE:
                sets.append(np.unique(full[a : z - SHINGLE + 1]))
            elif z > a:
                short = (h[a:z] * _ODDS[: z - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(z - a)
                sets.append(mix(short ^ _ODD[4]))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, end, sets


@lru_cache(1)
def _donors() -> np.ndarray:
    """For each bin, the bins it asks in turn: hashed, and at last all by number."""
    tries = 8 * BINS
    asked = mix(np.arange(BINS * tries, dtype=np.uint64) + np.uint64(12345)) % np.uint64(BINS)
    return np.concatenate([asked.reshape(tries, BINS).astype(np.int64), np.arange(BINS)[:, None].repeat(BINS, 1)])


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band keys for each of some non-empty sets."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    bins = (h >> _SHIFT).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (bins[1:] != bins[:-1]) | (doc[1:] != doc[:-1])
    sig = np.full((len(sets), BINS), _EMPTY, np.uint64)
    sig[doc[new], bins[new]] = h[new]
    held = np.zeros((len(sets), BINS), bool)
    held[doc[new], bins[new]] = True
    r, c = np.nonzero(~held)
    for asked in _donors():
        if not len(r):
            break
        got = held[r, asked[c]]
        sig[r[got], c[got]] = sig[r[got], asked[c[got]]]
        r, c = r[~got], c[~got]
    bands = sig.reshape(len(sets), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _ODD[4]
    for k in range(ROWS):
        key = mix(key + bands[:, :, k] * _ODD[k])
    return key


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(values))


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for a set."""
    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([mix(s ^ _ODD[3]).sum(dtype=np.uint64) for s in sets], np.uint64)
    return one, two


def _features(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, end, sets in shingle_sets(texts):
            n = [len(s) for s in sets]
            some = [i for i, k in enumerate(n) if k]
            keys = np.zeros((0, BANDS), np.uint64)
            if some:
                keys = band_keys([sets[i] for i in some])
            one, two = _prints(sets)
            bands = _lists(keys.ravel(), [BANDS if k else 0 for k in n])
            yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(n, pa.int64()), _signed(one), _signed(two), bands], ["doc_id", "n", "f1", "f2", "bands"])


def _full_sets(batches):
    for batch in batches:
        for first, end, sets in shingle_sets(batch.column(1)):
            one, two = _prints(sets)
            held = _lists(np.concatenate(sets), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), _signed(one), _signed(two), held], ["doc_id", "f1", "f2", "shingles"])


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    bits = np.zeros((len(sets), BITMAP_BITS), np.float32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits[row, np.concatenate(sets) & (BITMAP_BITS - 1)] = 1
    return bits


def cell_links(a: list[tuple], b: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of (gid, component, set) rows of two tiles, or of one with itself: as many as joins, at most."""
    x, y = _bitmaps([r[2] for r in a]), _bitmaps([r[2] for r in b])
    both = x @ y.T
    na, nb = np.array([len(r[2]) for r in a])[:, None], np.array([len(r[2]) for r in b])[None, :]
    most = np.minimum(na - (x.sum(1)[:, None] - both), nb - (y.sum(1)[None, :] - both))
    maybe = 100 * most >= percent * (na + nb - most)
    maybe &= np.array([r[1] for r in a])[:, None] != np.array([r[1] for r in b])[None, :]
    if a is b:
        maybe = np.triu(maybe)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(maybe))):
        p, q = root(a[i][1]), root(b[j][1])
        if p != q:
            shared = len(np.intersect1d(a[i][2], b[j][2], assume_unique=True))
            if 100 * shared >= percent * (len(a[i][2]) + len(b[j][2]) - shared):
                parent[p] = q
                out.append((a[i][0], b[j][0]))
    return out


def _cells(percent: int):
    """Streams rows sorted by cell (bucket, low tile, high tile); yields the links found in each."""

    def of_cell(rows: list[tuple], low: int, high: int) -> pa.RecordBatch:
        a = [r[1:] for r in rows if r[0] == low]
        b = a if low == high else [r[1:] for r in rows if r[0] == high]
        found = cell_links(a, b, percent) if a and b else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "low", "high", "tile", "gid", "component")}
            held = batch.column("shingles")
            values, at = held.values.to_numpy(zero_copy_only=False), held.offsets.to_numpy()
            for i in range(batch.num_rows):
                cell = tuple(int(cols[c][i]) for c in ("bucket", "low", "high"))
                if cell != now:
                    if rows:
                        yield of_cell(rows, *now[1:])
                    now, rows = cell, []
                rows.append((int(cols["tile"][i]), int(cols["gid"][i]), int(cols["component"][i]), values[at[i] : at[i + 1]].copy()))
        if rows:
            yield of_cell(rows, *now[1:])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("gid").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("gid").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    wide = 32 if id_type.startswith("struct") else 0
    features = cut(docs.mapInArrow(_features, f"doc_id {id_type}, n long, f1 long, f2 long, bands array<long>"), "features")
    classes = features.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("gid", F.monotonically_increasing_id()), "classes")

    member = classes.select("gid", F.explode("bands").alias("bucket"))
    buckets = cut(member.groupBy("bucket").agg(F.min("gid").alias("centre"), F.count("*").alias("members")).where("members > 1"), "buckets")
    members = cut(member.join(buckets, "bucket"), "members")
    pairs = cut(members.where("gid <> centre").select(F.col("centre").alias("a"), F.col("gid").alias("b")).distinct(), "pairs")

    ids = pairs.select(F.col("a").alias("gid")).union(pairs.select(F.col("b").alias("gid"))).distinct()
    wanted = cut(classes.join(ids, "gid").select("gid", "n", "f1", "f2", F.col("rep").alias("doc_id")), "wanted")
    texts = docs.join(small(wanted.select("doc_id"), 24 + wide), "doc_id", "left_semi")
    sets = texts.mapInArrow(_full_sets, f"doc_id {id_type}, f1 long, f2 long, shingles array<long>")
    sets = cut(sets.join(small(wanted, 48 + wide), ["doc_id", "f1", "f2"]).select("gid", "shingles").dropDuplicates(["gid"]), "sets")
    links = cut(_confirmed(pairs, sets, percent), "links")
    reach = cut(components(links), "components")

    placed = members.where("members > 2").join(reach, members["gid"] == reach["id"], "left").select("bucket", "gid", F.coalesce("component", "gid").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("gid")).alias("mark"), F.sum(F.hash("gid")).alias("mark2"))
    open_ = open_.where("least <> most").groupBy("members", "mark", "mark2").agg(F.min("bucket").alias("bucket"))
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    left = placed.join(open_.select("bucket", tiles.alias("tiles")), "bucket").withColumn("tile", F.pmod(F.hash("gid"), "tiles"))
    left = left.join(sets, "gid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = left.select("bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "gid", "component", "shingles")
    cells = cells.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = cut(cells.mapInArrow(_cells(percent), "a long, b long"), "found")
    if found.limit(1).count():
        reach = cut(components(links.unionByName(found)), "components")

    node = classes.join(reach, classes["gid"] == reach["id"], "left").select("n", "f1", "f2", "rep", "component")
    lowest = node.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("lowest"))
    node = node.join(small(lowest, 24 + wide), "component", "left").select("n", "f1", "f2", F.coalesce("lowest", "rep").alias("component_id"))
    out = features.select("doc_id", "n", "f1", "f2").join(node, ["n", "f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS s5 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s5 = b.s5 AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach(id, other) AS (
  SELECT a, b FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
), low AS (SELECT id, min(other) AS other FROM reach GROUP BY id)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(documents.doc_id, coalesce(low.other, documents.doc_id)) AS component_id,
       documents.doc_id = least(documents.doc_id, coalesce(low.other, documents.doc_id)) AS kept
FROM documents LEFT JOIN n ON documents.doc_id = n.doc_id LEFT JOIN low ON documents.doc_id = low.id
"""
