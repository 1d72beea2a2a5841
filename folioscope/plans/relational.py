"""Queries that run the library's relational operators on the driver's tables, with their SQL.

The tables hold no packages, so each operator runs on columns of the same shape: documents as
candidate files, pages as parts, events as runs and samples, orders and lineitem as results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scalars
from folioscope.operators import diff, graph, runs, scoring, selection
from folioscope.sources.scratch import small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Screening and selection.  Candidate rules: a name pattern, too large, too small; then copies.


def rules() -> list[tuple[str, Column]]:
    return [
        ("intentionally-malformed", F.col("text").rlike(selection.HOSTILE)),
        ("too-large", F.col("n_chars") > 10000),
        ("too-small", F.col("n_chars") < 50),
    ]


_RULED = rf"""WITH ruled AS (
  SELECT *, CASE WHEN regexp_matches(text, '{selection.HOSTILE}') THEN 'intentionally-malformed'
    WHEN n_chars > 10000 THEN 'too-large' WHEN n_chars < 50 THEN 'too-small' END AS rule FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, text, rule IS NULL ORDER BY source, doc_id) AS k FROM ruled
), judged AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN rule WHEN k > 1 THEN 'duplicate' END AS reason FROM ranked
)
"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return selection.exclusions(docs, rules(), ["lang"], F.sha2(F.col("text").cast("binary"), 256), ["source", "doc_id"])


@query("SELECT lang AS format, source, count(*) AS n FROM documents GROUP BY lang, source")
def candidates_found(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("format"), "source").agg(F.count("*").alias("n"))


@query(_RULED + "SELECT doc_id, lang AS format, source, reason FROM judged")
def exclusion_reasons(spark, d):
    return judged(spark, d).select("doc_id", F.col("lang").alias("format"), "source", "reason")


@query(_RULED + "SELECT lang AS format, coalesce(reason, 'eligible') AS reason, count(*) AS n FROM judged GROUP BY 1, 2")
def exclusion_counts(spark, d):
    return judged(spark, d).groupBy(F.col("lang").alias("format"), F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, sha256(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first_wins(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return selection.first_wins(docs, ["lang", "digest"], ["doc_id"])


_FILES = """WITH files AS (SELECT doc_id AS file_id, lang AS format, source, strlen(text) AS size, sha256(text) AS digest FROM documents WHERE source <> 'src0'),
engine AS (SELECT strlen(text) AS size, sha256(text) AS digest, 'engine/' || doc_id AS location FROM documents WHERE source = 'src0'),
split AS (
  SELECT files.file_id, any_value(format) AS format, any_value(files.source) AS source, list_sort(list(DISTINCT location) FILTER (WHERE location IS NOT NULL)) AS found
  FROM files LEFT JOIN engine ON files.digest = engine.digest GROUP BY files.file_id
), files_split AS (SELECT file_id, format, source, CASE WHEN len(coalesce(found, [])) > 0 THEN 'dev' ELSE 'holdout' END AS split, coalesce(found, []) AS found FROM split)
"""


def files_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("content", F.col("text").cast("binary"))
    sized = docs.select(F.col("doc_id").alias("file_id"), F.col("lang").alias("format"), "source", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("digest"))
    engine = sized.where("source = 'src0'").select("size", "digest", F.concat(F.lit("engine/"), F.col("file_id").cast("string")).alias("location"))
    files = sized.where("source <> 'src0'")
    return files.select("file_id", "format", "source", "digest").join(selection.exposure(files, engine), "file_id")


@query(_FILES + "SELECT file_id, split, array_to_string(found, ',') AS locations FROM files_split")
def split_semi(spark, d):
    return files_split(spark, d).select("file_id", "split", F.array_join("locations", ",").alias("locations"))


@query(_FILES + "SELECT format, source, split, CAST(grouping_id(format, source, split) AS INTEGER) AS level, count(*) AS n FROM files_split GROUP BY GROUPING SETS ((format), (format, source, split), (format, split))")
def manifest_counts(spark, d):
    return selection.manifest_counts(files_split(spark, d))


@query(_FILES + """SELECT f.format, s.source, count(*) FILTER (WHERE split = 'holdout') AS holdout, count(*) FILTER (WHERE split = 'dev') AS dev
FROM (SELECT DISTINCT format FROM files_split) f CROSS JOIN (SELECT DISTINCT source FROM files_split) s LEFT JOIN files_split x ON x.format = f.format AND x.source = s.source GROUP BY f.format, s.source""")
def split_pivot(spark, d):
    return selection.split_counts(files_split(spark, d))


@query("SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM (SELECT sha256(text) || '  corpus/' || lang || '/' || source || '/' || doc_id AS line FROM documents)")
def holdout_digest(spark, d):
    line = F.concat(F.sha2(F.col("text").cast("binary"), 256), F.lit("  corpus/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return selection.lines_digest(table(spark, d, "documents").select(line.alias("line")), "line")


#: Rules that tell the pages apart: label, pattern of the part's name, pattern of its content.
PAGE_RULES = [
    ("anchors", ".*", r"#top$"), ("queries", ".*", r"\?page="), ("feeds", ".*", r"utm_source=feed"),
    ("english", "/en/", None), ("german", "/de/", None), ("html-names", r"\.html$", None), ("plain-web", "^http:", None), ("links", ".*", r"<a href"), ("lists", ".*", r"<li>"), ("scripts", ".*", r"<script"),
]


def page_labels(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("file_id"), "url", F.concat_ws("\n", "html", "url").alias("content"))
    return selection.labels(pages, PAGE_RULES, part="url")


_LABELS = (
    "WITH rules(label, part_pattern, content_pattern) AS (VALUES " + ", ".join("('{}', '{}', {})".format(a, b, f"'{c}'" if c else "NULL") for a, b, c in PAGE_RULES) + "), labels AS ("
    "SELECT DISTINCT page_id AS file_id, label FROM pages, rules WHERE regexp_matches(url, part_pattern) "
    "AND (content_pattern IS NULL OR regexp_matches(coalesce(html || chr(10), '') || url, content_pattern))) "
)


@query(_LABELS + "SELECT file_id, label FROM labels")
def feature_flags(spark, d):
    return page_labels(spark, d)


@query("SELECT page_id, len(regexp_extract_all(html, '<p')) > 1 AS paragraphs, len(regexp_extract_all(html, '<a ')) > 1 AS links FROM pages")
def feature_counted(spark, d):
    many = lambda pattern: (F.regexp_count("html", F.lit(pattern)) > 1)
    return table(spark, d, "pages").select("page_id", many("<p").alias("paragraphs"), many("<a ").alias("links"))


def pool(spark: SparkSession, d: str) -> DataFrame:
    own = page_labels(spark, d).groupBy("file_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.length("html").alias("size"), F.col("url").alias("path"))
    return pages.join(own, "file_id")


@query(_LABELS + """, covered(label, times) AS (VALUES ('english', 3), ('queries', 1), ('links', 9)),
gains AS (SELECT file_id, sum(1 / (1 + coalesce(times, 0))) AS gain, count(*) AS n_labels FROM labels LEFT JOIN covered USING (label) GROUP BY file_id)
SELECT file_id, round(gain, 9) AS gain, n_labels FROM gains JOIN pages ON page_id = file_id ORDER BY round(gain, 9) DESC, n_labels DESC, length(html), url LIMIT 1""")
def greedy_round(spark, d):
    covered = spark.createDataFrame([("english", 3), ("queries", 1), ("links", 9)], "label string, times int")
    return selection.next_pick(pool(spark, d), covered)


@query()
def greedy_cover(spark, d):
    """Iterative by definition; tests compare it with brute force."""
    docs = pool(spark, d).withColumn("format", F.regexp_extract("path", "/(en|de|fr|es)/", 1)).withColumn("source", F.regexp_extract("path", r"example\.(com|org|net)", 1))
    return selection.cover(docs, {"com": 5, "org": 4, "net": 3}, 15)


@query("SELECT source, count(*) AS parts, sum(CASE WHEN lang = 'en' THEN strlen(text) ELSE 0 END)::BIGINT AS xml_bytes, min(doc_id) AS main_part FROM documents GROUP BY source")
def part_inventory(spark, d):
    size = F.sum(F.when(F.col("lang") == "en", F.octet_length("text")).otherwise(0)).cast("long")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("parts"), size.alias("xml_bytes"), F.min("doc_id").alias("main_part"))


# The graph of parts.


@query("SELECT page_id, i - 1 AS ord, h[i] AS target FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages))")
def href_edges(spark, d):
    targets = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(targets).alias("ord", "target")).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT o_orderkey AS rel_id, 'c' || o_custkey AS target FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AND o_orderstatus <> 'P'")
def dangling_rels(spark, d):
    rels = table(spark, d, "orders").select(F.lit(1).alias("pkg"), F.col("o_orderkey").alias("rel_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target"), (F.col("o_orderstatus") == "P").alias("external"))
    parts = table(spark, d, "customer").where("c_acctbal > 0").select(F.lit(1).alias("pkg"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("part"))
    return graph.dangling(rels, parts).select("rel_id", "target")


@query("""WITH typed AS (SELECT doc_id, source, lang FROM documents WHERE lang NOT IN ('en', 'de'))
SELECT doc_id AS part FROM documents WHERE doc_id % 3 <> 0 AND source NOT IN ('src0', 'src1', 'src2')""")
def untyped_parts(spark, d):
    parts = table(spark, d, "documents").select(F.lit(1).alias("pkg"), F.concat(F.col("doc_id").cast("string"), F.lit("."), "source").alias("part"), "doc_id")
    overrides = parts.where("doc_id % 3 = 0").select("pkg", "part")
    defaults = spark.createDataFrame([(1, "src0"), (1, "src1"), (1, "src2")], "pkg int, extension string")
    return graph.untyped(parts, overrides, defaults).select(F.col("doc_id").alias("part"))


def world(spark: SparkSession, d: str) -> DataFrame:
    """region -> nation -> supplier as relationships of one package."""
    rel = lambda df, source, kind, target: df.select(F.lit(1).alias("pkg"), F.expr(source).alias("source"), F.expr(target).alias("rel_id"), F.lit(kind).alias("kind"), F.expr(target).alias("target"), F.lit(False).alias("external"))
    rows = rel(table(spark, d, "region"), "''", "region", "concat('r', r_regionkey)")
    rows = rows.unionByName(rel(table(spark, d, "nation"), "concat('r', n_regionkey)", "nation", "concat('n', n_nationkey)"))
    rows = rows.unionByName(rel(table(spark, d, "supplier"), "concat('n', s_nationkey)", "supplier", "concat('s', s_suppkey)"))
    return rows.unionByName(rel(table(spark, d, "supplier"), "concat('s', s_suppkey)", "back", "concat('r', s_suppkey % 5)"))


@query("""WITH RECURSIVE rels AS (
  SELECT '' AS source, 'region' AS kind, 'r' || r_regionkey AS target, r_regionkey AS k FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'nation', 'n' || n_nationkey, n_nationkey FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 'supplier', 's' || s_suppkey, s_suppkey FROM supplier
), steps AS (SELECT source, target, '/' || kind || '#' || row_number() OVER (PARTITION BY source, kind ORDER BY k) AS step FROM rels
), paths(part, path) AS (SELECT target, step FROM steps WHERE source = '' UNION ALL SELECT target, path || step FROM paths JOIN steps ON part = source)
SELECT part, path FROM paths""")
def graph_paths(spark, d):
    return graph.logical_paths(world(spark, d)).select("part", "path")


def two_packages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """documents as the parts of a package and of the same after a save that renamed and changed some."""
    docs = table(spark, d, "documents").select(F.lit(1).alias("pkg"), "doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    name = lambda p: F.concat(F.lit(p), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    before = docs.select("pkg", name("p").alias("part"), F.when(F.col("doc_id") % 5 < 2, F.concat(F.lit("/"), "source", F.lit("#"), F.col("doc_id").cast("string"))).alias("path"), F.col("lang").alias("type"), "digest")
    after = docs.where("doc_id % 11 <> 3").select(
        "pkg", F.when(F.col("doc_id") % 5 < 4, F.when(F.col("doc_id") % 5 == 3, name("p")).otherwise(name("q"))).otherwise(name("z")).alias("part"),
        F.when(F.col("doc_id") % 5 < 2, F.concat(F.lit("/"), "source", F.lit("#"), F.col("doc_id").cast("string"))).alias("path"), F.when(F.col("doc_id") % 5 == 1, "other").otherwise(F.col("lang")).alias("type"), "digest",
    )
    return before, after


_TWO = """WITH docs AS (SELECT doc_id, lang, source, sha256(text) AS digest, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS no FROM documents),
a AS (SELECT 'p' || no AS part, CASE WHEN doc_id % 5 < 2 THEN '/' || source || '#' || doc_id END AS path, lang AS type, digest FROM docs),
b AS (SELECT CASE WHEN doc_id % 5 = 3 THEN 'p' WHEN doc_id % 5 = 4 THEN 'z' ELSE 'q' END || no AS part, CASE WHEN doc_id % 5 < 2 THEN '/' || source || '#' || doc_id END AS path,
  CASE WHEN doc_id % 5 = 1 THEN 'other' ELSE lang END AS type, digest FROM docs WHERE doc_id % 11 <> 3),
m1 AS (SELECT a.part, b.part AS other FROM a JOIN b ON a.part = b.part),
a1 AS (SELECT * FROM a WHERE part NOT IN (SELECT part FROM m1)), b1 AS (SELECT * FROM b WHERE part NOT IN (SELECT other FROM m1)),
m2 AS (SELECT a1.part, b1.part AS other FROM a1 JOIN b1 ON a1.path = b1.path AND a1.type = b1.type),
a2 AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY part) AS k FROM a1 WHERE part NOT IN (SELECT part FROM m2)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY part) AS k FROM b1 WHERE part NOT IN (SELECT other FROM m2)),
m3 AS (SELECT a2.part, b2.part AS other FROM a2 JOIN b2 ON a2.digest = b2.digest AND a2.k = b2.k),
m AS (SELECT *, 'name' AS method FROM m1 UNION ALL SELECT *, 'path' FROM m2 UNION ALL SELECT *, 'digest' FROM m3)
"""


@query(_TWO + "SELECT part, other, method FROM m")
def map_parts(spark, d):
    return graph.map_parts(*two_packages(spark, d)).select("part", "other", "method")


@query(_TWO + "SELECT method, count(*) AS n FROM m GROUP BY method")
def map_methods(spark, d):
    return graph.map_parts(*two_packages(spark, d)).groupBy("method").agg(F.count("*").alias("n"))


@query(_TWO + "SELECT part, 'missing' AS side FROM a WHERE part NOT IN (SELECT part FROM m) UNION ALL SELECT part, 'added' FROM b WHERE part NOT IN (SELECT other FROM m)")
def unmapped_parts(spark, d):
    before, after = two_packages(spark, d)
    return graph.unmapped(before, after, graph.map_parts(before, after)).select("part", "side")


@query("""WITH p AS (SELECT l_orderkey, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS now, list(DISTINCT l_returnflag || l_linestatus) FILTER (WHERE l_quantity > 30) AS known
FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_filter(now, lambda x: NOT list_contains(coalesce(known, []), x)), ',') AS problems FROM p""")
def new_problems(spark, d):
    what = F.concat("l_returnflag", "l_linestatus")
    own = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", what.alias("p")))), lambda x: x["p"])
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(own.alias("now"), F.collect_set(F.when(F.col("l_quantity") > 30, what)).alias("known"))
    return graph.new_problems(rows, "now", "known").select("l_orderkey", F.array_join("new", ",").alias("problems"))


# Runs and windows.


@query("""WITH k AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) || ';' END AS t FROM events),
m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND event_type <> 'error' THEN 0 ELSE 1 END AS new FROM k WHERE t <> '' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, string_agg(t, '' ORDER BY event_id) AS text, count(*) AS n FROM i GROUP BY user_id, run""")
def run_merge(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(";")))
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", text.alias("t"))
    return runs.merge_runs(rows, ["user_id"], ["event_id"], ["event_type"], "t", F.col("event_type") == "error")


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem),
i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS g FROM r)
SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM i GROUP BY l_orderkey, l_returnflag, g""")
def column_runs(spark, d):
    return runs.number_runs(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_returnflag"])


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events")
def locf(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("own"))
    return runs.carry_forward(rows, ["user_id"], ["event_id"], "own", "header").drop("own")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderpriority[1] AS INTEGER) END, 1073741824), o_orderkey) AS rank FROM orders")
def priority_rank(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"))
    return runs.ranked(rows, ["o_custkey"], "priority", ["o_orderkey"]).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT event_id AS range_id, user_id, event_id AS lo, event_id + 40 + event_id % 90 AS hi FROM events WHERE event_type = 'purchase'),
p AS (SELECT event_id, user_id FROM events WHERE event_type = 'click')
SELECT p.event_id, p.user_id, range_id FROM p JOIN r ON p.user_id = r.user_id AND p.event_id >= lo AND p.event_id < hi""")
def range_overlap(spark, d):
    events = table(spark, d, "events")
    ranges = events.where("event_type = 'purchase'").select(F.col("event_id").alias("range_id"), "user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 40 + F.col("event_id") % 90).alias("hi"))
    points = events.where("event_type = 'click'").select("event_id", "user_id")
    return runs.overlapping(points, ranges, ["user_id"], "event_id", "lo", "hi", 100).select("event_id", "user_id", "range_id")


# Differences.

_SIDES = """WITH a AS (SELECT c_nationkey AS file, c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 10 <> 1),
b AS (SELECT c_nationkey AS file, c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 0.4 WHEN c_custkey % 7 = 1 THEN c_acctbal - 3 WHEN c_custkey % 70 = 2 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS value FROM customer WHERE c_custkey % 10 <> 2)
"""


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    k, v = F.col("key"), F.col("value")
    moved = F.when(k % 7 == 0, v + 0.4).when(k % 7 == 1, v - 3).when(k % 70 == 2, F.lit(float("nan"))).otherwise(v)
    return rows.where(k % 10 != 1), rows.where(k % 10 != 2).withColumn("value", moved)


@query(_SIDES + "SELECT file, key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'added' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (file, key) WHERE a.value IS DISTINCT FROM b.value")
def diff_keyed(spark, d):
    return diff.keyed(*sides(spark, d), ["file", "key"], "value").select("file", "key", "kind")


@query(_SIDES + "SELECT file, key, CASE WHEN b.value IS NULL THEN 'missing' WHEN a.value IS NULL THEN 'added' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (file, key) WHERE a.value IS NULL OR b.value IS NULL OR isnan(b.value) OR abs(a.value - b.value) > 0.5")
def diff_tolerance(spark, d):
    unlike = diff.differing(F.col("before"), F.col("after"), F.lit(0.5))
    return diff.keyed(*sides(spark, d), ["file", "key"], "value", unlike).select("file", "key", "kind")


@query("""WITH a AS (SELECT c_mktsegment AS file, c_nationkey AS n, c_custkey AS k, c_acctbal AS v FROM customer),
x AS (SELECT * FROM a WHERE NOT (n = 3 AND file < 'C')), y AS (SELECT file, n, k, CASE WHEN k % 50 = 0 THEN v + 1 ELSE v END AS v FROM a WHERE n <> 5 AND k % 40 <> 1),
d AS (SELECT file, n, k, x.v IS NULL AS new, y.v IS NULL AS gone FROM x FULL JOIN y USING (file, n, k) WHERE x.v IS DISTINCT FROM y.v)
SELECT DISTINCT file, CASE WHEN gone AND (file, n) NOT IN (SELECT file, n FROM y) OR new AND (file, n) NOT IN (SELECT file, n FROM x) THEN '/' || n ELSE '/' || n || '/' || k END AS path,
  CASE WHEN gone THEN 'missing' WHEN new THEN 'added' ELSE 'changed' END AS kind FROM d""")
def diff_subtrees(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("file"), F.concat_ws("/", F.lit(""), "c_nationkey", "c_custkey").alias("path"), F.col("c_acctbal").alias("value"), "c_nationkey", "c_custkey")
    a = rows.where("NOT (c_nationkey = 3 AND file < 'C')").select("file", "path", "value")
    b = rows.where("c_nationkey <> 5 AND c_custkey % 40 <> 1").withColumn("value", F.when(F.col("c_custkey") % 50 == 0, F.col("value") + 1).otherwise(F.col("value"))).select("file", "path", "value")
    return diff.subtree_diff(a, b)


@query()
def diff_lists(spark, d):
    """Matching blocks are no SQL; tests compare it with difflib itself."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = turns.where("turn % 5 <> 3").withColumn("text", F.when(F.col("turn") % 4 == 1, F.upper("text")).otherwise(F.col("text")))
    return diff.list_diff(turns, after, ["conv_id"], "turn", "text")


@query("SELECT event_id, '/k' AS path, 'num' AS vtype, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def diff_json_leaves(spark, d):
    return diff.json_leaves(table(spark, d, "events"), ["event_id"], "props")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') AND l_returnflag = 'A' THEN 'formulas' WHEN l_returnflag = 'A' THEN 'cells' ELSE 'styles' END AS feature FROM lineitem""")
def relabel(spark, d):
    feature = F.when(F.col("l_returnflag") == "A", "cells").otherwise("styles")
    diffs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", feature.alias("feature"))
    formulas = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return diff.relabel(diffs, formulas, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "feature")


@query("SELECT DISTINCT user_id, event_type AS feature FROM events WHERE CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'false' ELSE CAST(event_id % 4 AS VARCHAR) END NOT IN ('', 'false')")
def presence(spark, d):
    value = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "false").otherwise((F.col("event_id") % 4).cast("string"))
    return diff.present(table(spark, d, "events").select("user_id", F.col("event_type").alias("feature"), value.alias("value")), ["user_id"])


# Scoring.  Adapters: suppliers; files: parts; checks: line items.


def check_rows(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*(F.lit(c) for c in scoring.CHECKS)), F.col("l_linenumber").cast("int") % 8 + 1)
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("adapter"), F.col("l_partkey").alias("file"), name.alias("name"), F.when(F.col("l_returnflag") == "A", "failure").otherwise("success").alias("outcome"), (F.col("l_discount") > 0.01).alias("scored")
    )


_PICK = " WHEN ".join(f"{i} THEN '{c}'" for i, c in enumerate(scoring.CHECKS))
_CHECKS = f"WITH checks AS (SELECT l_suppkey AS adapter, l_partkey AS file, CASE l_linenumber % 8 WHEN {_PICK} END AS name, CASE WHEN l_returnflag = 'A' THEN 'failure' ELSE 'success' END AS outcome, l_discount > 0.01 AS scored FROM lineitem) "


@query(_CHECKS + "SELECT adapter, " + ", ".join(f"count(*) FILTER (WHERE name = '{c}' AND outcome = 'success') AS \"{c}\"" for c in scoring.CHECKS) + ", count(*) AS scored_rows FROM checks WHERE scored GROUP BY adapter")
def check_summary(spark, d):
    return scoring.check_summary(check_rows(spark, d), list(scoring.CHECKS))


@query(_CHECKS + "SELECT adapter, CASE WHEN coalesce(bool_and(outcome = 'success') FILTER (WHERE scored), false) THEN 'success' ELSE 'failure' END AS status FROM (SELECT adapter * 1000 + file % 1000 AS adapter, outcome, scored FROM checks) GROUP BY adapter")
def run_status(spark, d):
    rows = check_rows(spark, d).withColumn("adapter", F.col("adapter") * 1000 + F.col("file") % 1000)
    return scoring.run_status(rows, ["adapter"])


@query("""WITH inputs AS (SELECT DISTINCT p_partkey AS file, p_type AS feature FROM part UNION SELECT p_partkey, 'size' || p_size % 7 FROM part),
results AS (SELECT DISTINCT s_nationkey AS adapter, l_partkey AS file, l_partkey % 9 <> 0 AS compared FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
diffs AS (SELECT DISTINCT s_nationkey AS adapter, l_partkey AS file, p_type AS feature FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'),
vocabulary AS (SELECT DISTINCT feature FROM inputs UNION SELECT 'absent'),
kept AS (SELECT adapter, r.file, feature, compared AND NOT EXISTS (SELECT 1 FROM diffs d WHERE d.adapter = r.adapter AND d.file = r.file AND d.feature = i.feature) AS ok FROM results r JOIN inputs i ON r.file = i.file),
n AS (SELECT adapter, feature, count(*) FILTER (WHERE ok) AS preserved, count(*) AS present FROM kept GROUP BY ALL)
SELECT a.adapter, v.feature, coalesce(preserved, 0) AS preserved, coalesce(present, 0) AS present, round(preserved / present, 4) AS rate
FROM (SELECT DISTINCT adapter FROM results) a CROSS JOIN vocabulary v LEFT JOIN n ON a.adapter = n.adapter AND v.feature = n.feature""")
def feature_preservation(spark, d):
    part, line = table(spark, d, "part"), table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    inputs = part.select(F.col("p_partkey").alias("file"), F.explode(F.array("p_type", F.concat(F.lit("size"), (F.col("p_size") % 7).cast("string")))).alias("feature")).distinct()
    results = line.select(F.col("s_nationkey").alias("adapter"), F.col("l_partkey").alias("file"), (F.col("l_partkey") % 9 != 0).alias("compared")).distinct()
    diffs = line.where("l_returnflag = 'A'").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_nationkey").alias("adapter"), F.col("l_partkey").alias("file"), F.col("p_type").alias("feature"))
    vocabulary = inputs.select("feature").distinct().union(spark.createDataFrame([("absent",)], "feature string"))
    return scoring.feature_preservation(inputs, diffs, results, vocabulary)


@query("SELECT s_nationkey AS adapter, l_returnflag AS feature, count(DISTINCT l_partkey) AS files FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def differing_files(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return scoring.differing_files(line.select(F.col("s_nationkey").alias("adapter"), F.col("l_returnflag").alias("feature"), F.col("l_partkey").alias("file")))


@query("SELECT user_id, event_type, CASE WHEN count(value) % 2 = 0 THEN round(median(value), 3) ELSE median(value) END AS median_ms, count(value) AS n FROM events GROUP BY user_id, event_type")
def median_elapsed(spark, d):
    return scoring.median_elapsed(table(spark, d, "events"), ["user_id", "event_type"], "value")


@query("SELECT n_nationkey AS adapter, p_partkey AS file, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50) AS runs FROM nation CROSS JOIN part")
def task_cross(spark, d):
    adapters = table(spark, d, "nation").select(F.col("n_nationkey").alias("adapter"))
    files = table(spark, d, "part").select(F.col("p_partkey").alias("file"))
    return scoring.tasks(adapters, files, table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("file")))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events QUALIFY rank <= 10")
def sample_topk(spark, d):
    return scoring.first_samples(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"]).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT event_id, CASE WHEN event_type = 'error' OR value > 90 AND event_id % 5 = 0 THEN 'error' WHEN value > 20 THEN 'failure' ELSE 'success' END AS outcome FROM events")
def outcomes(spark, d):
    phase = F.when(F.col("event_type") == "error", "save").otherwise("done")
    return table(spark, d, "events").select("event_id", scoring.outcome((F.col("value") > 90) & (F.col("event_id") % 5 == 0), phase, F.col("value") > 20).alias("outcome"))


@query(_CHECKS + "SELECT adapter, file, string_agg(name || '=' || outcome, ',' ORDER BY list_position([" + ", ".join(f"'{c}'" for c in scoring.CHECKS) + "], name), name, outcome) AS checks FROM checks GROUP BY adapter, file")
def check_lists(spark, d):
    found = scoring.check_lists(check_rows(spark, d), ["adapter", "file"])
    return found.select("adapter", "file", F.array_join(F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), c["outcome"])), ",").alias("checks"))


@query("""WITH p AS (SELECT a.label, len(list_filter(list_zip(a.embedding, b.embedding), lambda p: abs(p[1] - p[2]) > 0.1)) / len(a.embedding) AS share
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT p.label, count(share) AS pages, max(share) AS worst, CASE WHEN count(share) = max(n - p.label % 2) AND max(share) <= 0.9 THEN 'success' ELSE 'failure' END AS outcome FROM p JOIN n ON p.label = n.label GROUP BY p.label""")
def render_similarity(spark, d):
    rows = table(spark, d, "embeddings")
    a = rows.select("vec_id", "label", "embedding")
    b = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    wanted = rows.groupBy("label").agg(F.count("*").alias("n")).select("label", (F.col("n") - F.col("label") % 2).alias("wanted"))
    pages = a.join(b, "vec_id").join(wanted, "label").select("label", scalars.differing_share(F.col("embedding"), F.col("other"), 0.1).alias("share"), "wanted")
    return scoring.render_similarity(pages, ["label"], "wanted", 0.9)


@query("""SELECT doc_id, doc_id % 3 = 0 AND length(text) > 0 AS mislocated FROM documents""")
def mislocated(spark, d):
    """Texts that differ in breaks only are the same place; one with a letter more is another."""
    docs = table(spark, d, "documents")
    located = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.when(F.length("text") > 0, "x").otherwise(""))).otherwise(F.translate("text", "\n", "\r"))
    return docs.select("doc_id", scoring.mislocated(located, F.col("text")).alias("mislocated"))


@query("""SELECT sha256('[' || string_agg('{"path":"' || s_name || '","size":' || s_suppkey || ',"source":null}', ',' ORDER BY s_name) || ']') AS digest FROM supplier""")
def files_digest(spark, d):
    rows = table(spark, d, "supplier").select(F.lit(None).cast("string").alias("source"), F.col("s_suppkey").alias("size"), F.col("s_name").alias("path"))
    return selection.files_digest(rows)


# Scalars.


@query("SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS pointer, replace(replace(replace(replace(url, '~', '~0'), '/', '~1'), '~1', '/'), '~0', '~') AS url FROM pages")
def pointer_escape(spark, d):
    escaped = scalars.pointer_escape(F.col("url"))
    return table(spark, d, "pages").select("page_id", escaped.alias("pointer"), scalars.pointer_unescape(escaped).alias("url"))


@query("""WITH l AS (SELECT c_custkey, c_custkey % 18278 + 1 AS n FROM customer)
SELECT c_custkey, n AS number, CASE WHEN n <= 26 THEN chr((64 + n)::INTEGER) WHEN n <= 702 THEN chr((65 + (n - 27) // 26)::INTEGER) || chr((65 + (n - 27) % 26)::INTEGER)
  ELSE chr((65 + (n - 703) // 676)::INTEGER) || chr((65 + (n - 703) // 26 % 26)::INTEGER) || chr((65 + (n - 703) % 26)::INTEGER) END AS letters FROM l""")
def col_letters(spark, d):
    letters = scalars.column_letters(F.col("c_custkey") % 18278 + 1)
    return table(spark, d, "customer").select("c_custkey", scalars.column_number(letters).alias("number"), letters.alias("letters"))


@query("SELECT p_partkey, round_even(p_size * CASE p_partkey % 4 WHEN 0 THEN 20.0 WHEN 1 THEN 1440.0 / 2.54 WHEN 2 THEN 1.0 ELSE 15.0 END, 0)::BIGINT AS twips FROM part")
def measure_twips(spark, d):
    unit = F.element_at(F.array(*(F.lit(u) for u in ("pt", "cm", "", "px"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", scalars.twips(F.concat(F.col("p_size").cast("string"), unit)).alias("twips"))


@query("SELECT p_partkey, round_even(c * s / 255, 0)::BIGINT AS shade, round_even(c * s / 255 + 255 - s, 0)::BIGINT AS tint FROM (SELECT p_partkey, p_partkey % 256 AS c, (p_size * 5) AS s FROM part)")
def tint_blend(spark, d):
    c, s = F.col("p_partkey") % 256, F.col("p_size") * 5
    return table(spark, d, "part").select("p_partkey", scalars.blend(c, s, True).alias("shade"), scalars.blend(c, s, False).alias("tint"))


@query("""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^[a-z]+://[^/]*', 0) ELSE upper(url[1:12]) || url[13:] END AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS s, regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1) AS h, u FROM u)
SELECT page_id, s || '://' || lower(h) || CASE WHEN starts_with(substr(u, length(s) + 4 + length(h)), '/') THEN '' ELSE '/' END || substr(u, length(s) + 4 + length(h)) AS url FROM p""")
def url_norm(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", "^[a-z]+://[^/]*", 0)).otherwise(F.concat(F.upper(F.substring("url", 1, 12)), F.substr("url", F.lit(13))))
    return table(spark, d, "pages").select("page_id", scalars.normal_url(url).alias("url"))


@query("SELECT doc_id, replace(replace(replace(replace(t, chr(11), chr(10)), chr(13), chr(10)), chr(8232), chr(10)), chr(12), '') AS text FROM (SELECT doc_id, replace(replace(replace(text, ', ', chr(11)), '. ', chr(12) || chr(8232)), ' d', chr(13)) AS t FROM documents)")
def comparable_text(spark, d):
    raw = F.replace(F.replace(F.replace("text", F.lit(", "), F.lit("\v")), F.lit(". "), F.lit("\f ")), F.lit(" d"), F.lit("\r"))
    return table(spark, d, "documents").select("doc_id", scalars.comparable_text(raw).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 199) || '…' ELSE text END AS clipped FROM documents")
def clip_text(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.clip(F.col("text")).alias("clipped"))


@query("SELECT event_id, datediff('day', DATE '1899-12-30', ts::DATE) + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400 AS serial, datediff('day', DATE '1904-01-01', ts::DATE) + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400 AS serial_1904 FROM events")
def serial_days(spark, d):
    return table(spark, d, "events").select("event_id", scalars.serial_day(F.col("ts")).alias("serial"), scalars.serial_day(F.col("ts"), True).alias("serial_1904"))


@query("""SELECT a.vec_id, len(list_filter(list_zip(a.embedding, b.embedding), lambda p: abs(p[1] - p[2]) > 0.1)) / len(a.embedding) AS share
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pixel_diff(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", scalars.differing_share(F.col("embedding"), F.col("other"), 0.1).alias("share"))


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def contained_items(spark, d):
    """Whole benchmark texts inside documents: a stated list of texts, broadcast where its size allows it, against all rows."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    return table(spark, d, "documents").join(small(items, 4096), F.contains(F.col("text"), F.col("item"))).select("doc_id", "item_id")
