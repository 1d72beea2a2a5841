"""Line dedup: repeated runs of lines, found on a suffix array of line ids.

The text of the corpus is read as sequences of line ids, one per document, blank lines left
out.  Prefix doubling ranks the prefixes of every suffix: level 0 ranks lines, level k + 1
ranks pairs of level-k ranks that stand 2^k lines apart.  Ranks are dealt by a distributed
sort of the distinct pairs, so the ranks of a level are in the order of the suffixes; suffixes
of equal rank are neighbours in the suffix array and share 2^k lines at least.  Lines, and
pairs, that occur once have no rank: their suffixes are alone in the array from that depth on.

The suffixes that share their first m lines are a longest-common-prefix interval of depth m.
With k = floor(log2 m), it is the set of suffixes with the same level-k ranks at their start
and again m - 2^k lines on, the two halves of m lines overlapping.  A run is worth deleting
from ``min_words`` words on.  Let d(s) be the least depth at which suffix s has so many words.
Of the intervals that hold s, those of depth d(s) to d(s + 1) decide: any longer repeated run
from s is the union of such ones that start at s or later.  d is at most ``min_words`` lines,
so ties beyond that depth do not matter, and doubling ends where two halves reach it, whatever
the lengths of texts and runs.  Intervals whose later members lie at one distance from the first ones, one line
after the other, merge to the maximal repeated runs.

Of each interval the first occurrence in the order (doc_id, text hash, line) stays, and every
other one is a later copy, whose lines are deleted.  A line goes only if an equal line stands
earlier, so one copy of each line always stays.

A line, pair or run that many documents share is counted by partial aggregates; its ranks and
first places come back by joins of written tables, whose hot partitions Spark splits.

Defined cases: an occurrence that overlaps an earlier one counts as a copy, so a periodic run
within a text shrinks to one period.  Very long texts are read whole like any other; a step holds the
lines of one text at most.  A document is a distinct pair of doc_id and text: repeated rows are
one document and get equal results.  A null doc_id comes first in the order.  Null texts stay null, blank lines are never deleted, texts without a deleted line
come back unchanged, and an empty table gives an empty result.  All columns are passed on;
columns that this operator adds replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.scratch import cut, drop

#: Words that a repeated run of lines has at least to be deleted.
MIN_WORDS = 20

DOC = ["doc_id", "doc_hash"]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.doc_hash") == F.col(f"{b}.doc_hash"))


def _ranks(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Ranks, in order, of the values of ``key`` that occur more than once."""
    often = cut(df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "often")
    return cut(often.orderBy(*key).withColumn(name, F.monotonically_increasing_id()), "ranks")


def suffix_ranks(docs: DataFrame, levels: int) -> DataFrame:
    """doc_id, doc_hash, p, line, n_words, r0 .. r<levels>: the lines that occur more than once.

    p counts the lines of a text that aren't blank, line counts all.  r<k> ranks the 2^k lines
    from p on among all such; null if no other place has the same.
    """
    listed = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("s"))), lambda y: y["s"].rlike(r"\S"))
    lines = docs.select("doc_id", text_hash(F.col("text")).alias("doc_hash"), F.posexplode(listed).alias("p", "at")).select(
        *DOC, "p", F.col("at.line").alias("line"), F.expr(r"regexp_count(at.s, '\\S+')").alias("n_words"), F.unhex(F.md5(F.col("at.s").cast("binary"))).alias("id")
    )
    lines = cut(lines, "lines")
    ranks = _ranks(lines, ["id"], "r0")
    active = lines.join(ranks, "id").drop("id")
    active = cut(active.groupBy(*DOC, "p").agg(*(F.first(c).alias(c) for c in ("line", "n_words", "r0"))), "suffixes")
    drop(lines, ranks)
    for k in range(levels):
        ahead = Window.partitionBy(*DOC).orderBy("p").rangeBetween(2**k, 2**k)
        paired = active.withColumn("next", F.max(f"r{k}").over(ahead))
        pairs = paired.where(f"r{k} IS NOT NULL AND next IS NOT NULL").select(F.col(f"r{k}").alias("a"), F.col("next").alias("b"))
        ranks = _ranks(pairs, ["a", "b"], f"r{k + 1}")
        longer = paired.join(ranks, (F.col(f"r{k}") == F.col("a")) & (F.col("next") == F.col("b")), "left").drop("a", "b", "next")
        longer = cut(longer, "suffixes")
        drop(active, ranks)
        active = longer
    return active


def _least_depth(lines: Column, at: Column, min_words: int) -> Column:
    """Lines from ``at`` on until there are ``min_words`` words; 0 if the ranked lines end before."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("over"))
    add = lambda a, x: F.when(
        a["over"] | (x["p"] != at + a["n"]), a
    ).otherwise(F.struct((a["n"] + 1).alias("n"), (a["words"] + x["n_words"]).alias("words"), (a["words"] + x["n_words"] >= min_words).alias("over")))
    return F.aggregate(F.filter(lines, lambda x: x["p"] >= at), start, add, lambda a: F.when(a["over"], a["n"]).otherwise(0))


def intervals(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The suffixes (see ``suffix_ranks``), and doc_id, doc_hash, p, n, a, b: the intervals of depth n that hold the suffix at p.

    a and b name the interval: the ranks of its first and of its last 2^floor(log2 n) lines.
    """
    levels = max(0, min_words.bit_length() - 1)
    suffixes = suffix_ranks(docs, levels)
    reach = Window.partitionBy(*DOC).orderBy("p").rangeBetween(0, min_words)
    near = suffixes.select(*DOC, "p", F.sort_array(F.collect_list(F.struct("p", "n_words")).over(reach)).alias("near"))
    here, after = _least_depth(F.col("near"), F.col("p"), min_words), _least_depth(F.col("near"), F.col("p") + 1, min_words)
    # Where the ranked lines end before the next suffix has enough words, this one is followed to their end.
    ahead = F.size(F.filter(F.transform("near", lambda x, i: x["p"] == F.col("p") + i), lambda same: same))
    depths = near.select(*DOC, "p", here.alias("least"), F.least(F.when(after > 0, after).otherwise(ahead), F.lit(min_words)).alias("most")).where("least > 0")
    wanted = depths.select(*DOC, "p", F.explode(F.sequence("least", F.greatest("least", "most"))).alias("n"))
    wanted = wanted.withColumn("k", F.length(F.bin(F.col("n").cast("long"))) - 1).withColumn("q", F.expr("p + n - cast(shiftleft(1, k) as int)"))

    at_level = lambda alias: F.coalesce(*(F.when(F.col("k") == k, F.col(f"{alias}.r{k}")) for k in range(levels + 1)))
    head = wanted.alias("s").join(suffixes.alias("x"), _same_doc("s", "x") & (F.col("s.p") == F.col("x.p")))
    head = head.select("s.*", at_level("x").alias("a")).where("a IS NOT NULL")
    both = head.alias("s").join(suffixes.alias("x"), _same_doc("s", "x") & (F.col("s.q") == F.col("x.p")))
    return suffixes, cut(both.select("s.doc_id", "s.doc_hash", "s.p", "s.n", "a", at_level("x").alias("b")).where("b IS NOT NULL"), "intervals")


def maximal_runs(held: DataFrame) -> DataFrame:
    """doc_id, doc_hash, p, n, source_id, source_hash, source_p: the maximal later copies of runs, and where they stand first.

    ``held`` is the table of ``intervals``.
    """
    place = F.struct("doc_id", "doc_hash", "p")
    firsts = cut(held.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places"), "firsts")
    later = held.join(firsts, ["n", "a", "b"]).where(place != F.col("first"))
    source = ["source_id", "source_hash", "shift"]
    copies = later.select(*DOC, "p", "n", F.col("first.doc_id").alias("source_id"), F.col("first.doc_hash").alias("source_hash"), (F.col("p") - F.col("first.p")).alias("shift"))
    copies = copies.groupBy(*DOC, *source, "p").agg(F.max("n").alias("n"))
    upto = F.max(F.col("p") + F.col("n")).over(Window.partitionBy(*DOC, *source).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    opens = copies.withColumn("opens", F.when(F.col("p") <= upto, 0).otherwise(1))
    runs = opens.withColumn("run", F.sum("opens").over(Window.partitionBy(*DOC, *source).orderBy("p")))
    runs = runs.groupBy(*DOC, *source, "run").agg(F.min("p").alias("p"), F.max(F.col("p") + F.col("n")).alias("end"))
    return runs.select(*DOC, "p", (F.col("end") - F.col("p")).alias("n"), "source_id", "source_hash", (F.col("p") - F.col("shift")).alias("source_p"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, doc_hash, p, line: every line of a later copy of a repeated run."""
    suffixes, held = intervals(docs, min_words)
    gone = maximal_runs(held).select(*DOC, F.explode(F.sequence("p", F.col("p") + F.col("n") - 1)).alias("p")).distinct()
    return gone.alias("g").join(suffixes.alias("x"), _same_doc("g", "x") & (F.col("g.p") == F.col("x.p"))).select("g.doc_id", "g.doc_hash", "g.p", "x.line")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the lines of later copies deleted from text, and n_lines, n_deleted long."""
    gone = repeated_lines(docs.select("doc_id", "text"), min_words)
    per_doc = cut(gone.groupBy(*DOC).agg(F.sort_array(F.collect_set("line")).alias("gone_lines")), "gone")
    per_doc = per_doc.select(F.col("doc_id").alias("gone_id"), F.col("doc_hash").alias("gone_hash"), "gone_lines")
    right = F.broadcast(per_doc) if _fits(per_doc) else per_doc
    met = docs.join(right, docs["doc_id"].eqNullSafe(right["gone_id"]) & (text_hash(docs["text"]) == right["gone_hash"]), "left")
    lines, gone_lines = F.split(docs["text"], "\n", -1), right["gone_lines"]
    lost = F.coalesce(F.size(gone_lines), F.lit(0))
    # The one-element array binds the lines, so that a text is split once.
    left = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), gone_lines)
    kept = F.transform(F.array(lines), lambda own: F.array_join(F.transform(left(own), lambda i: F.get(own, i)), "\n"))[0]
    text = F.when(gone_lines.isNull(), docs["text"]).otherwise(kept)
    others = [docs[c] for c in docs.columns if c not in {"text", "n_lines", "n_deleted"}]
    return met.select(*others, text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.greatest(lost, F.lit(0)).cast("long").alias("n_deleted"))


def _fits(per_doc: DataFrame, bound: int = 32 << 20) -> bool:
    size = per_doc.agg(F.sum(F.size("gone_lines") * 4 + 64).alias("b")).collect()[0]["b"]
    return (size or 0) <= bound


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs)


SQL = r"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS d, doc_id, text FROM documents),
listed AS (
  SELECT d, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM docs WHERE text IS NOT NULL
), lines AS (
  SELECT d, line, s, len(regexp_extract_all(s, '\S+')) AS n_words, row_number() OVER (PARTITION BY d ORDER BY line) - 1 AS p
  FROM listed WHERE regexp_matches(s, '\S')
), sums AS (
  SELECT *, sum(n_words) OVER (PARTITION BY d ORDER BY p) AS upto, max(p) OVER (PARTITION BY d) AS last FROM lines
), ahead AS (
  SELECT a.d, a.p, min(b.p) AS e FROM sums a JOIN sums b ON a.d = b.d AND b.p BETWEEN a.p AND a.p + 19 AND b.upto - a.upto + a.n_words >= 20 GROUP BY 1, 2
), back AS (
  SELECT b.d, max(a.p) AS p, b.p AS e FROM sums a JOIN sums b ON a.d = b.d AND a.p BETWEEN b.p - 19 AND b.p AND b.upto - a.upto + a.n_words >= 20 GROUP BY b.d, b.p
), runs AS (SELECT d, p, e FROM ahead UNION SELECT d, p, e FROM back),
keyed AS (
  SELECT runs.d, runs.p, runs.e, string_agg(md5(s), ',' ORDER BY lines.p) AS run FROM runs JOIN lines ON lines.d = runs.d AND lines.p BETWEEN runs.p AND runs.e GROUP BY 1, 2, 3
), later AS (
  SELECT d, p, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY d, p) AS k FROM keyed) WHERE k > 1
), gone AS (
  SELECT DISTINCT lines.d, lines.line FROM lines JOIN later ON lines.d = later.d AND lines.p BETWEEN later.p AND later.e
), kept AS (
  SELECT l.d, string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE gone.d IS NULL) AS text, count(*) AS n_lines, count(gone.d) AS n_deleted
  FROM listed l LEFT JOIN gone ON l.d = gone.d AND l.line = gone.line GROUP BY l.d
)
SELECT doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted
FROM docs LEFT JOIN kept ON docs.d = kept.d
"""
