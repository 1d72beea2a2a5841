"""Intermediate tables in the folder that all executors share.

``written`` ends a lineage: a lost executor then costs its own tasks only, and what ran once,
such as an adapter, isn't run again.  The folder is the one that the session names in
spark.checkpoint.dir; a session without one gets a folder in its warehouse.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is broadcast by hint, at most.
BROADCAST_BYTES = 32 << 20

_paths: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back; the table is removed when Python ends."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = f"{(found or spark.conf.get('spark.sql.warehouse.dir') + '/_scratch').rstrip('/')}/folioscope/{name}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, stay within the bound at ``row_bytes`` each; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


@atexit.register
def _clean() -> None:
    for spark, path in _paths:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # this session has ended; another may not have
            continue
