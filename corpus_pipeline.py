"""Corpus pipeline: from raw documents to packed training sequences.

Five stages, each an operator of ``folioscope.llm`` with production parameters.  A stage takes
(spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last
return the columns of ``documents``, with n_chars following the text.

Every stage takes nulls in any column, empty texts, repeated rows and empty tables as its
operator's docstring says.  Rows that repeat an id, or a null id, with its text are one
document from the near-dedup on; rows that share an id but not a text are documents of their
own.  Further columns are passed through; the last stage returns pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, line_dedup, minhash_dedup, packing, quality
from folioscope.llm.scratch import cut, small


#: Near duplicates of the pipeline: 100 * |A & B| >= NEAR * |A | B| on shingles; op7's own contract has another bound.
NEAR = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars counts the characters of the text."""
    counted = F.length("text").cast(like.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in like.columns else None
    return docs.select(*(counted if c == "n_chars" else F.col(f"`{c}`") for c in like.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; the others go.

    Null and empty texts have the statistics of an empty one and are judged by the same rules.
    Rows that repeat, or share an id, are judged each.  Without labels every row has the score
    0.5 and goes.  Columns named like the ensemble's own are carried in a struct and stay.
    """
    model = quality.train(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return rows.transform(quality.scores, model).where(F.col("score") >= quality.CUTOFF).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines deleted; a text that loses all its lines goes.

    The first copy in the order of ids (a null one first) and text hashes stays, so ties have one
    winner; repeated rows are one document and lose the same lines.  Null texts, and texts
    without a line to delete, come back as they are; n_chars follows the text.  Columns named
    n_lines or n_deleted are carried in a struct and stay.
    """
    done = line_dedup.line_dedup(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    kept = done.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"\S"))
    return _as_documents(kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns)), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of those with the same id, or none, and the same text.

    A document goes by its id and the hash of its text.  Among near duplicates the one with the
    least id stays, and one without an id only if none has one.  Null and empty texts have no
    shingles and link with nothing; rows that share an id but not a text are judged each.  Further
    columns stay as they are, whatever their names.
    """
    text_hash = line_dedup.text_hash(F.col("text"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text_hash.alias("hash"))
    judged = minhash_dedup.near_duplicates(docs.select(own.alias("doc_id"), "text"), NEAR)
    judged = cut(judged.select(F.col("doc_id.id").alias("met_id"), F.col("doc_id.hash").alias("met_hash"), "kept"), "judged")

    def met(table: DataFrame) -> Column:
        return F.col("doc_id").eqNullSafe(table["met_id"]) & (text_hash == table["met_hash"])

    gone = small(cut(judged.where("NOT kept").select("met_id", "met_hash").distinct(), "gone"), 32)
    left = docs.join(gone, met(gone), "left_anti").select(*docs.columns)
    again = judged.where("kept").groupBy("met_id", "met_hash").agg(F.count("*").alias("rows")).where("rows > 1").select("met_id", "met_hash")
    again = small(cut(again, "again"), 32)
    once = left.join(again, met(again), "left_anti").select(*docs.columns)
    more = left.join(again, met(again), "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(more)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; passages of a single item are cut out of the rest.

    Null and empty texts have no words and stay.  Rows that share an id but not a text are judged
    each, repeated rows alike; without benchmark items nothing changes.  n_chars follows the
    text, and further columns stay as they are, whatever their names.
    """
    items = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _as_documents(decontaminate.clean(docs, items), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequence and offset; a null or empty text is its end token, and every row is packed."""
    return packing.packed(docs.select("doc_id", "text"), packing.production_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier's scores and the packing plan are not SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
