"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, mod ``parts``; ids that are null are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def label_sample(labels: DataFrame, label: str, parts: int, held_out: int, most: int) -> DataFrame:
    """doc_id, label: at most ``most`` labelled ids outside fold ``held_out``, the first by a hash.

    An id that is labelled more than once counts as its largest label.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where(fold(F.col("doc_id"), parts) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def first_texts(rows: DataFrame, most: int, most_chars: int) -> DataFrame:
    """Of ``rows`` (doc_id, text, label) the first ``most`` by a hash, as long as they hold ``most_chars`` characters together; with mark.

    ``rows`` belong to a sample of ids already; an id that comes with several texts has a row for each.
    """
    marked = rows.select("doc_id", "text", "label", F.xxhash64("doc_id").alias("mark"), F.xxhash64("text").alias("text_mark")).dropDuplicates(["doc_id", "text"])
    marks = marked.select("doc_id", "mark", "text_mark", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    upto = Window.orderBy("mark", "doc_id", "text_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = marks.withColumn("rank", F.count("*").over(upto)).withColumn("chars", F.sum("n").over(upto)).where((F.col("rank") <= most) & (F.col("chars") <= most_chars))
    return marked.join(kept.select("doc_id", "text_mark"), ["doc_id", "text_mark"]).select("doc_id", "text", "label", "mark")
