"""URL filter: rules of a host and a path prefix, looked up by hash.

Each URL is expanded into the strings that a rule could have: the last *n* labels of its
host followed by the first *m* characters of its path, for the shapes (n, m) that occur
among the rules.  So the number of strings per URL depends on the rules alone, however
long the URL is, and no possible match is left out.  The strings meet the rules by an
equi-join on the first 32 bits of their SHA-256; the whole digest is compared afterwards,
and the longest rule decides (block before allow among equals).

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the
default verdict; an empty path fits no rule whose path is ``/``.  Repeated pages give
repeated rows, null page ids stay null, an empty table gives an empty result, an empty
rule list gives the default everywhere, and further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.scratch import small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hex digits of a digest that the join compares.
PREFIX_HEX = 8

#: Production rules: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url).

    ``rules``: host, path, verdict.  Their distinct shapes, at most one per rule, are
    gathered on the driver; the rules themselves are broadcast only if they are small.
    """
    shapes = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m"))
        .distinct()
        .collect()
    )
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    listed = rules.select(
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict")
    ).where("rule IS NOT NULL")
    listed = listed.withColumn("rule_digest", digest(F.col("rule"))).withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))

    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    shape_sql = ", ".join(f"named_struct('n', {r.n}, 'm', {r.m})" for r in sorted(shapes))
    strings = (
        F.expr(
            f"filter(transform(array({shape_sql}), s -> IF(size(split(host, '[.]')) >= s.n AND length(path) >= s.m, "
            "concat(substring_index(host, '.', -s.n), substr(path, 1, s.m)), NULL)), x -> x IS NOT NULL)"
        )
        if shapes
        else F.lit(None).cast("array<string>")
    )
    expanded = split.withColumn("string", F.explode_outer(strings)).withColumn("digest", digest(F.col("string")))
    met = expanded.withColumn("short", F.substring("digest", 1, PREFIX_HEX)).join(small(listed, 512), "short", "left")
    fits = F.when(
        F.col("digest") == F.col("rule_digest"),
        F.struct(F.length("rule").alias("long"), (F.col("rule_verdict") == "block").alias("blocks"), "rule", F.col("rule_verdict").alias("verdict")),
    )
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages, rule_table(spark, RULES))


SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0) AS raw, rest, row_number() OVER () AS n FROM cut
), parts AS (
  SELECT n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path
  FROM split
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT n, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM parts LEFT JOIN hits ON parts.n = hits.n AND hits.k = 1
"""
