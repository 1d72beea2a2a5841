"""Corpus files: source configuration, archives, holdout lists, process output, and the sinks."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.scalars import clip

_MEMBERS = "archive string, path string, size long, content binary, error string"


def read_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sources (id, ord, kind, repo, commit, license) and quotas (format, source, quota) of a configuration file."""
    config = spark.read.option("multiLine", True).json(path)
    named = {f.name: f.dataType for f in config.schema["sources"].dataType.elementType.fields}
    pick = lambda c: F.col(f"s.{c}") if c in named else F.lit(None).cast("string").alias(c)
    sources = config.select(F.posexplode("sources").alias("ord", "s")).select(pick("id"), "ord", *(pick(c) for c in ("kind", "repo", "commit", "license")))
    quotas = config.select(F.from_json(F.to_json("selection.quotas"), "map<string,map<string,int>>").alias("q"))
    quotas = quotas.select(F.explode("q").alias("format", "by")).select("format", F.explode("by").alias("source", "quota")).where("quota IS NOT NULL")
    return sources, quotas


def unpack(archives: DataFrame, strip: int = 0) -> DataFrame:
    """A row for each file of ``archives`` (archive, content): zip, or tar of any compression.

    ``strip`` leading folders go; members that would leave the archive's folder, links and
    devices are passed over.
    """

    def members(content: bytes):
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield info.filename, z.read(info)
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                for info in t:
                    if info.isfile():
                        yield info.name, t.extractfile(info).read()

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    for name, data in members(content or b""):
                        path = name.split("/")[strip:]
                        if path and not name.startswith("/") and ".." not in path:
                            rows.append((archive, "/".join(path), len(data), data, None))
                except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError) as e:
                    rows = [(archive, None, None, None, type(e).__name__)]
                cols = list(zip(*rows)) if rows else [()] * 5
                kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _MEMBERS.split(", ")])

    return archives.select("archive", "content").mapInArrow(run, _MEMBERS)


def holdout_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """digest, format, source, name of the lines of a holdout list."""
    shape = r"^([0-9a-f]{64})  corpus/([^/]+)/([^/]+)/(.+)$"
    pick = lambda i, name: F.regexp_extract(line, shape, i).alias(name)
    return lines.where(F.col(line).rlike(shape)).select(*(pick(i, n) for i, n in enumerate(("digest", "format", "source", "name"), 1)))


def child_events(output: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, seq, event, phase, type, message, elapsed_ms of the lines of a process's output that are JSON objects."""
    lines = output.select(*keys, F.posexplode(F.split(text, "\n")).alias("seq", "line")).where(F.col("line").startswith("{"))
    event = F.from_json("line", "event string, phase string, type string, message string, elapsed_ms double")
    rows = lines.select(*keys, "seq", event.alias("e")).where("e.event IS NOT NULL")
    return rows.select(*keys, "seq", "e.event", "e.phase", "e.type", clip(F.col("e.message")).alias("message"), "e.elapsed_ms")


def redacted(text, places: dict[str, str]):
    """``text`` with each of some paths replaced by its name, in the given order."""
    for path, name in places.items():
        text = F.replace(text, F.lit(path), F.lit(name))
    return text


def write_corpus(files: DataFrame, path: str) -> None:
    """The chosen files' bytes, a folder per format and source; replaces what is there."""
    files.write.mode("overwrite").partitionBy("format", "source").parquet(path)


def write_holdout(lines: DataFrame, path: str, line: str = "line") -> None:
    """One sorted line per file, in one text file."""
    lines.select(line).orderBy(line).coalesce(1).write.mode("errorifexists").text(path)


def manifest(files: DataFrame, meta: dict) -> str:
    """A manifest document of a selection, whose rows are a few hundred by its quotas."""
    rows = [r.asDict(recursive=True) for r in files.orderBy("path").collect()]
    return json.dumps(meta | {"count": len(rows), "files": rows}, indent=2, ensure_ascii=False)


def notices(files: DataFrame, sources: DataFrame) -> str:
    """A text with a section for each source that a file comes from: its address, license and number of files.

    Sources (id, url, license) are a configuration of a few dozen rows.
    """
    used = files.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("files")).join(sources, "id").orderBy("id").collect()
    return "\n".join(f"{r['id']}\n  {r['url']}\n  license: {r['license'] or 'unknown'}\n  files: {r['files']}\n" for r in used)
