"""Intermediate tables in the folder that all executors share.

``cut`` ends a lineage: the frame is written as Parquet below ``spark.checkpoint.dir`` and
read back, so a lost executor costs its own tasks only.  Where the session names no such
folder, a local session gets a temporary one and any other session uses its warehouse.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of a table that is broadcast by hint; measured before each hint.
BROADCAST_BYTES = 32 << 20

#: Rows of an Arrow batch between Spark and Python while an intermediate table is written.
ARROW_ROWS = 1_000

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses; removed when Python ends."""
    path = f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back.  Arrow batches of the write hold few rows, as texts may be long."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(min(int(before), ARROW_ROWS)) if int(before) > 0 else str(ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables made by ``cut`` that no later plan reads."""
    for df in frames:
        _remove(df.sparkSession, df.scratch_path)


def table_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table made by ``cut``."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small(df: DataFrame, row_bytes: int = 64, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows, at ``row_bytes`` each, stay within the bound.

    Beyond the bound the frame goes back as it is and Spark shuffles both sides.
    """
    return F.broadcast(df) if df.count() * row_bytes <= bound else df


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # this session has ended; another may not have
            continue
