"""Packages as tables: files, parts, relationships and content types.

A package is one row of bytes; its parts leave the row at once, through Arrow batches of a
bounded number of packages, so no later step carries whole packages.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import features
from folioscope.sources import opc

#: File extensions per format, the plain one and those with macros.
EXTENSIONS = {"xlsx": ("xlsx", "xlsm"), "pptx": ("pptx", "pptm"), "docx": ("docx", "docm")}

_PARTS = "pkg string, part string, member string, type string, is_xml boolean, is_rels boolean, well_formed boolean, size long, digest string, canonical string, data binary, error string"
_RELS = "pkg string, source string, rel_id string, kind string, target string, external boolean"


def read_files(spark: SparkSession, path: str, max_bytes: int = 10_000_000) -> DataFrame:
    """path, format, size, content of the packages below a folder; larger files come without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    kind = F.lit(None).cast("string")
    for name, own in EXTENSIONS.items():
        kind = F.when(extension.isin(*own), name).otherwise(kind)
    rows = files.select("path", kind.alias("format"), extension.alias("extension"), F.col("length").alias("size"), "content")
    return rows.where("format IS NOT NULL").withColumn("content", F.when(F.col("size") <= max_bytes, F.col("content")))


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def explode(packages: DataFrame, duplicates: str = "error", decode: bool = False) -> DataFrame:
    """A row for each part of ``packages`` (pkg, content), or one with an error for an unreadable package."""

    def run(batches):
        for batch in batches:
            for pkg, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = opc.read_package(content or b"", duplicates, decode)
                if found.error:
                    yield batch_of(_PARTS, [(pkg, None, None, None, None, None, None, None, None, None, None, found.error)])
                    continue
                defaults, overrides, _ = opc.content_types(found.parts)
                tokens: dict[str, dict[str, str]] = {}
                for source, rel_id, kind, target, _ in opc.relationships(found.parts):
                    tokens.setdefault(source, {})[rel_id] = f"{kind}:{target}"
                rows = []
                for part, data in sorted(found.parts.items()):
                    kind = opc.type_of(part, defaults, overrides)
                    xml = opc.is_xml(part, kind)
                    digest = hashlib.sha256(data).hexdigest()
                    rows.append((pkg, part, found.members[part], kind, xml, opc.is_rels(part), opc.well_formed(data) if xml else None, len(data), digest, opc.canonical(data, tokens.get(part), part) if xml else digest, data, None))
                yield batch_of(_PARTS, rows)

    return packages.select(F.col("pkg").cast("string"), "content").mapInArrow(run, _PARTS)


def relationships(packages: DataFrame) -> DataFrame:
    """A row for each relationship of ``packages`` (pkg, content)."""

    def run(batches):
        for batch in batches:
            for pkg, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield batch_of(_RELS, [(pkg, *r) for r in opc.relationships(opc.read_package(content or b"", "last").parts)])

    return packages.select(F.col("pkg").cast("string"), "content").mapInArrow(run, _RELS)


def screened(packages: DataFrame) -> DataFrame:
    """pkg, reason: why a package is none to work with, or null."""
    schema = "pkg string, reason string"

    def run(batches):
        for batch in batches:
            yield batch_of(schema, [(p, opc.screen(c or b"")) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])

    return packages.select(F.col("pkg").cast("string"), "content").mapInArrow(run, schema)


def labels(packages: DataFrame) -> DataFrame:
    """pkg, label: the features of each package of ``packages`` (pkg, format, content)."""
    schema = "pkg string, label string"

    def run(batches):
        for batch in batches:
            for pkg, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield batch_of(schema, [(pkg, f) for f in features.of_package(kind, opc.read_package(content or b"", "first").parts)])

    return packages.select(F.col("pkg").cast("string"), "format", "content").mapInArrow(run, schema)


def inventory(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """pkg, parts, xml_bytes, main_part."""
    main = rels.where("source = '' AND kind = 'officeDocument' AND NOT external").groupBy("pkg").agg(F.first("target").alias("main_part"))
    counts = parts.where("part IS NOT NULL").groupBy("pkg").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("is_xml"), F.col("size")).otherwise(0)).alias("xml_bytes"))
    return counts.join(main, "pkg", "left")


def problems(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """pkg, problems: everything wrong with a package, sorted."""
    from folioscope.operators import graph

    unread = parts.where("error IS NOT NULL").select("pkg", F.col("error").alias("problem"))
    some = parts.where("part IS NOT NULL")
    untyped = some.where(f"type IS NULL AND part <> '{opc.CONTENT_TYPES}'").select("pkg", F.concat(F.lit("no content type: "), "part").alias("problem"))
    broken = some.where("NOT well_formed").select("pkg", F.concat(F.lit("malformed: "), "part").alias("problem"))
    lost = graph.dangling(rels, some).select("pkg", F.concat(F.lit("dangling: "), "source", F.lit(" -> "), "target").alias("problem"))
    every = unread.unionByName(untyped).unionByName(broken).unionByName(lost)
    return parts.select("pkg").distinct().join(every, "pkg", "left").groupBy("pkg").agg(F.array_sort(F.collect_list("problem")).alias("problems"))


def first_malformed(parts: DataFrame) -> DataFrame:
    """pkg, part: of each package the first part, by name, that should be XML and isn't well-formed."""
    return parts.where("NOT well_formed").groupBy("pkg").agg(F.min("part").alias("part"))
