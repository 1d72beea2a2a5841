"""The corpus pipeline: each stage's decisions take effect, and odd rows pass."""

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

RNG = random.Random(4)
WORDS = [f"{a}{b}{c}" for a in "bdfgkmt" for b in "aeiou" for c in ("ra", "lo", "ni", "st", "n")]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture
def corpus(spark, docs, tables):
    good = [(i, prose(60)) for i in range(150)]
    bad = [(1000 + i, f"{RNG.choice(WORDS)} " * 40) for i in range(60)]
    passage = prose(55)
    rows = good + bad
    rows += [(2000 + i, f"{prose(40)}\n{passage}\n{prose(30)}") for i in range(5)]
    copy = prose(80)
    near = copy.split()
    rows += [(3000, copy), (3001, " ".join([*near[:40], "changed", *near[41:]]))]
    items = [(1, prose(12)), (2, prose(12))]
    rows += [(4000, f"{prose(30)} {items[0][1]} {prose(30)}"), (4001, f"{prose(20)} {items[0][1]} {prose(9)} {items[1][1]} {prose(20)}")]
    rows += [(5000, None), (5001, ""), (None, prose(50)), (0, good[0][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(i, 1, 0) for i in (5000, 5001)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(rows).withColumn("gone", F.lit("extra"))
    return tables(documents=frame, labels=labels, benchmark=bench), dict(rows), passage, items


def test_stages(spark, corpus):
    d, texts, passage, items = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == docs.columns
            docs = pipeline.cut(out, name)
            seen[name] = {r.doc_id: r for r in docs.collect()}
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in seen[name].values())
    good = set(range(150))
    assert good <= seen["quality"].keys() and not {i for i in seen["quality"] if i and 1000 <= i < 1060}
    assert sum(passage in (r.text or "") for r in seen["line_dedup"].values()) == 1 and good <= seen["line_dedup"].keys()
    assert 3000 in seen["near_dedup"] and 3001 not in seen["near_dedup"] and good <= seen["near_dedup"].keys()
    last = seen["decontamination"]
    assert good <= last.keys() and 4001 not in last and items[0][1] not in last[4000].text
    assert sum(1 for i in last if i == 0) == 1 and None in last
    assert {r.doc_id for r in out.collect()} == last.keys()


def test_run_is_the_stages(spark, corpus):
    d = corpus[0]
    out = pipeline.run(spark, d)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 150


def test_empty_corpus(spark, docs, tables):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    d = tables(documents=docs([(1, "x")]).where("false"), labels=labels, benchmark=bench)
    assert pipeline.run(spark, d).count() == 0


def test_near_stage_takes_pairs_from_80_percent(spark, docs):
    base = prose(200).split()
    near = [f"changed{k}" if k % 50 == 25 else w for k, w in enumerate(base)]
    far = [f"other{k}" if k % 40 == 20 else w for k, w in enumerate(base)]
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    share = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert 0.80 <= share(base, near) < 0.85 and share(base, far) < 0.80 and share(near, far) < 0.80
    out = pipeline.near_stage(spark, docs([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_near_stage_judges_texts_not_ids(spark, docs):
    a, b, c, d = (prose(80) for _ in range(4))
    near = " ".join([*c.split()[:40], "changed", *c.split()[41:]])
    rows = [(3, a), (5, a), (5, b), (7, c), (7, near), (None, a), (None, d), (None, d + " more"), (None, d), (9, ""), (None, None), (8, "")]
    out = pipeline.near_stage(spark, docs(rows), "").collect()
    kept = sorted(((r.doc_id, r.text) for r in out), key=repr)
    assert [r for r in kept if r[1] in (a, b)] == sorted([(3, a), (5, b)], key=repr)
    assert sum(r[1] in (c, near) for r in kept) == 1 and sum((r[1] or "").startswith(d) for r in kept) == 1
    assert [r for r in kept if not r[1]] == sorted([(9, ""), (8, ""), (None, None)], key=repr) and len(kept) == 7
