"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words, and pairs with one or
two words between, hashed into 2^20 places.  FTRL-proximal learning with a rate per
coordinate and an L1 term leaves few weights that aren't zero; they are broadcast (at most
2^20 pairs of 12 bytes) and every whole text is scored in one pass without a shuffle.

The model is fitted in one task on whole texts of at most ``SAMPLE`` labelled documents, in the
order of a hash of their id, up to ``SAMPLE_CHARS`` characters in all; that bounds the task.

Defined cases: null, empty and wordless texts get the score of the bias alone; repeated rows
get equal scores; a null doc_id is in fold 0; an id with several texts is learnt with each of them; without a
labelled document every score is 0.  An empty table gives an empty result, and further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.labelled import first_texts, fold, label_sample
from folioscope.llm.scratch import cut, small
from folioscope.llm.wordhash import PUNCTUATION, mix, word_hashes

#: Labelled documents that the model is fitted on, at most, and their characters together.
SAMPLE, SAMPLE_CHARS = 16_000, 80_000_000
#: Rows whose fold is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 5, 0
CUTOFF = 0.5

BITS = 20
#: Distances of the two words of a pair: neighbours and skip-grams.
GAPS = (1, 2, 3)
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 4.0, 0.0

_MASK = np.uint64((1 << BITS) - 1)


def features(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams and skip-grams of words ``h`` of texts ``doc``, and their texts; with repeats.  Place 0 is the bias."""
    places, docs = [mix(h)], [doc]
    for gap in GAPS:
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = h[:-gap] * np.uint64(0xD6E8FEB86659FD93) + h[gap:] * np.uint64(0xA0761D6478BD642F) + np.uint64(gap)
            places.append(mix(pair[same]))
            docs.append(doc[gap:][same])
    return np.maximum(np.concatenate(places) & _MASK, np.uint64(1)).astype(np.int64), np.concatenate(docs)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that aren't zero; place 0 is the bias, which L1 leaves alone."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    l1 = np.full(1 << BITS, L1)
    l1[0] = 0

    def weights(at):
        big = np.abs(z[at]) > l1[at]
        return np.where(big, (np.sign(z[at]) * l1[at] - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = np.nonzero(n)[0]
    w = weights(every)
    return every[w != 0], w[w != 0]


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by([("mark", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    texts, labels, rows = table.column("text").combine_chunks(), table.column("label").to_pylist(), []
    for first, end, h, doc in word_hashes(texts, PUNCTUATION):
        at, of = features(h, doc)
        cuts = np.argsort(of, kind="stable")
        at, of = at[cuts], of[cuts]
        edge = np.searchsorted(of, np.arange(first, end + 1))
        rows += [(np.unique(np.append(at[edge[i] : edge[i + 1]], 0)).astype(np.int32), labels[first + i]) for i in range(end - first)]
    places, w = ftrl(rows)
    return pa.table({"place": pa.array(places, pa.int64()), "weight": pa.array(w, pa.float64())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and weights learnt from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    chosen = cut(label_sample(labels, "toxic", FOLDS, HELD_OUT, sample), "sample")
    rows = first_texts(docs.join(small(chosen, 16), "doc_id").select("doc_id", "text", "label"), sample, SAMPLE_CHARS)
    model = cut(rows.groupBy(F.lit(1).alias("one")).applyInArrow(_fit, "place long, weight double"), "model").toPandas()
    return (model["place"].to_numpy(), model["weight"].to_numpy()) if len(model) else None


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, score for each row of ``docs`` (doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        places, w = sent.value
        table = np.zeros(1 << BITS, np.float32)
        table[places] = w
        bias = float(w[places == 0].sum())
        for batch in batches:
            for first, end, h, doc in word_hashes(batch.column(1), PUNCTUATION):
                at, of = features(h, doc)
                hit = table[at] != 0
                pairs = np.unique(((of[hit] - first) << BITS) | at[hit])
                total = np.bincount(pairs >> BITS, table[pairs & int(_MASK)].astype(float), end - first) + bias
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = scores(docs, train(docs, labels))
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
