"""Classifiers: held-out accuracy and defined cases; suffix automata against brute force."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from folioscope.llm import labelled, language_id, quality, toxicity
from folioscope.llm.wordhash import mix, word_hashes

RNG = random.Random(9)
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ra", "lo", "ni", "st")]
BAD = ["vile", "nasty", "awful"]
LANGS = {"aa": ["tor", "ken", "mal"], "bb": ["yüx", "özi", "wéq"], "cc": ["pluf", "snor", "grib"]}


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def toxic_pairs():
    rows = []
    for i in range(700):
        text, bad = prose(RNG.randrange(5, 60)), i % 4 == 0
        rows.append((i, text + (f" {RNG.choice(BAD)}, {prose(3)}" if bad else ""), int(bad)))
    return rows


def accuracy(out, want, col):
    rows = [r for r in out.collect() if r.held_out and r.doc_id in want]
    assert len(rows) > 20
    return sum(r[col] == want[r.doc_id] for r in rows) / len(rows)


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 77, -5)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.f for r in df.select("doc_id", toxicity.fold(F.col("doc_id"), 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in (0, 1, 77, -5)} | {None: 0}


def test_toxicity_on_held_out_documents(spark, docs, tables):
    rows = toxic_pairs()
    odd = [(9001, None), (9002, ""), (9003, " ,. "), (None, "vile"), (9004, prose(20_000)), (0, rows[0][1])]
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(9001, None, None), (None, 1, 1), (0, 0, 0)], "doc_id long, toxic int, quality int")
    d = tables(documents=docs([r[:2] for r in rows] + odd).withColumn("score", F.lit("clash")), labels=labels)
    out = toxicity.query(spark, d).cache()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows) + len(odd)
    assert accuracy(out, {i: y for i, _, y in rows}, "predicted") > 0.97
    by = {r.doc_id: r for r in out.collect()}
    assert by[9001].score == by[9002].score == by[9003].score < 0.5 and all(0 <= r.score <= 1 for r in by.values())


def test_toxicity_without_labels(spark, docs, tables):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    d = tables(documents=docs([(1, "a"), (2, None)]), labels=none)
    assert [r.score for r in toxicity.query(spark, d).collect()] == [0.0, 0.0]


def test_held_out_labels_are_not_learnt(spark, docs, tables):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0][:40]
    rows = [(i, "secretword " + prose(10)) for i in held] + [(i, prose(10)) for i in range(400) if i not in held]
    labels = spark.createDataFrame([(i, int(i in held), 1) for i, _ in rows], "doc_id long, toxic int, quality int")
    out = toxicity.query(spark, tables(documents=docs(rows), labels=labels))
    assert max(r.score for r in out.collect()) < 0.5


def junk(i):
    word = RNG.choice(WORDS)
    return [" ".join([word] * RNG.randrange(20, 60)), prose(30).upper().replace(" ", "!! ") + "!!", prose(30).replace(" ", "%%% ")][i % 3]


def test_quality_on_held_out_documents(spark, docs, tables):
    rows = [(i, junk(i) if i % 5 == 0 else prose(RNG.randrange(20, 80)), int(i % 5 != 0)) for i in range(800)]
    odd = [(9001, None), (9002, ""), (None, "x"), (9003, prose(20_000)), (1, rows[1][1])]
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(5000, 0, None)], "doc_id long, toxic int, quality int")
    d = tables(documents=docs([r[:2] for r in rows] + odd), labels=labels)
    out = quality.query(spark, d).cache()
    assert out.count() == len(rows) + len(odd)
    assert accuracy(out, {i: y for i, _, y in rows}, "predicted") > 0.97
    by = {r.doc_id: r.score for r in out.collect()}
    assert by[9001] == by[9002] and all(0 <= s <= 1 for s in by.values())


def test_quality_is_fitted_in_a_task(spark, docs, monkeypatch):
    pairs = [(i, junk(i) if i % 5 == 0 else prose(RNG.randrange(20, 80))) for i in range(400)] + [(7, "a second text of an id"), (9, None), (9, "")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)], "doc_id long, quality int")
    stats = quality.statistics(F.col("text"))
    learnt = docs(pairs).join(labels, "doc_id").where(labelled.fold(F.col("doc_id"), quality.FOLDS) != quality.HELD_OUT)
    learnt = learnt.select(F.xxhash64("doc_id"), "doc_id", *stats.values(), F.col("quality")).distinct().collect()
    rows = np.array([list(r)[2:] for r in sorted(map(tuple, learnt))], float)
    want = quality.fit(rows[:, :-1], rows[:, -1], list(stats))

    def here(*_):
        raise AssertionError("the driver fits the rules")

    monkeypatch.setattr(quality, "fit", here)
    monkeypatch.setattr(type(labels), "toPandas", here)
    assert quality.train(docs(pairs), labels) == want and want[1]


def test_quality_without_labels(spark, docs, tables):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert [r.score for r in quality.query(spark, tables(documents=docs([(1, "a"), (2, None)]), labels=none)).collect()] == [0.5, 0.5]


def test_compiled_rules_equal_the_fitted_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    names = ["a", "b", "c"]
    bias, rules = quality.fit(x, y, names)
    want = 1 / (1 + np.exp(-(bias + sum(w * quality.holds(r, x, names) for r, w in rules))))
    assert ((want > 0.5) == (y > 0.5)).mean() > 0.97 and 0 < len(rules) < 60
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, s_a double, s_b double, s_c double")
    got = [r.s for r in df.select("i", quality.compiled(bias, rules).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, want)


def test_columns_with_names_of_the_ensemble(spark, docs):
    frame = docs([(1, "A b. C"), (2, None)]).withColumn("_statistics", F.lit("own")).withColumn("log_words", F.lit("own")).withColumn("score", F.lit("own"))
    model = (0.5, [((("log_words", True, 0.1),), 1.0)])
    rows = {r.doc_id: r for r in quality.scores(frame, model).collect()}
    assert round(rows[1].score, 6) == round(1 / (1 + math.exp(-1.5)), 6) and round(rows[2].score, 6) == round(1 / (1 + math.exp(-0.5)), 6) and rows[1].log_words == "own"


def test_quality_with_one_kind_of_label(spark, docs, tables):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "doc_id long, toxic int, quality int")
    out = quality.query(spark, tables(documents=docs([(1, "a"), (2, None)]), labels=labels))
    assert {r.predicted for r in out.collect()} == {1}


def brute_entropy(text, sample, n):
    phrases, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        phrases, i = phrases + 1, i + k
    return max(phrases, 1) * math.log2(max(len(sample), 2)) / max(len(text), 1)


def foreign(lang, n):
    return " ".join("".join(RNG.choice(LANGS[lang]) for _ in range(RNG.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("block", [7, 64, language_id.BLOCK])
def test_cross_parsing_like_brute_force(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    texts = [foreign("aa", 40), foreign("bb", 700), "", "12 ;;", "zzz zzz", foreign("cc", 3).upper(), "torkenmal" * 500, foreign("aa", 60) * 9]
    model = tuple((k, language_id.normalise(pa.array([foreign(k, 60)]))[0].tobytes()) for k in LANGS)
    got = language_id.entropies(pa.array(texts), model)
    for i, text in enumerate(texts):
        plain = language_id.normalise(pa.array([text]))[0].tobytes()
        assert np.allclose(got[i], [brute_entropy(plain, s, len(s)) for _, s in model])


def test_languages_of_held_out_documents(spark, docs, tables):
    rows = [(i, foreign(lang, RNG.randrange(4, 40)), lang) for i, lang in ((i, list(LANGS)[i % 3]) for i in range(300))]
    made = None
    for lang in LANGS:
        part = docs([r[:2] for r in rows if r[2] == lang], lang=lang)
        made = part if made is None else made.unionByName(part)
    odd = docs([(9001, None), (9002, ""), (9003, "12 34 !"), (None, foreign("aa", 9)), (9004, foreign("bb", 30_000))], lang=None)
    out = language_id.query(spark, tables(documents=made.unionByName(odd).withColumn("score", F.lit(1)))).cache()
    assert accuracy(out, {i: lang for i, _, lang in rows}, "lang_pred") > 0.97
    by = {r.doc_id: r for r in out.collect()}
    assert {by[i].lang_pred for i in (9001, 9002, 9003)} == {"und"} and by[9004].lang_pred == "bb" and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in by.values())


def test_samples_are_dealt_evenly():
    assert language_id.dealt([3, 100, 100], 50) == [3, 23, 24] and language_id.dealt([5, 5], 50) == [5, 5] and language_id.dealt([], 9) == []


def test_languages_of_long_texts_only_and_many_languages(spark, docs):
    made = docs([(i, foreign("aa", 30)) for i in range(40)], lang="aa").unionByName(docs([(100 + i, foreign("bb", 9_000)) for i in range(12)], lang="bb"))
    for k in range(5):
        made = made.unionByName(docs([(1000 + 10 * k + i, f"rare{chr(0x4E00 + k) * 3} word") for i in range(4)], lang=f"x{k:03}", repartition=1))
    learnt = [lang for lang, _ in language_id.learn(made)]
    assert {"aa", "bb"} <= set(learnt) and sum(lang.startswith("x") for lang in learnt) >= 4
    assert all(len(sample) <= language_id.LANG_BYTES for _, sample in language_id.learn(made))


def brute_places(text):
    """Places of a text's features, by sets of word pairs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    digest = {}
    for w in set(words):
        (_, _, h, _) = next(iter(word_hashes(pa.array([w]))))
        digest[w] = int(h[0])
    mixed = lambda x: int(mix(np.array([x % (1 << 64)], np.uint64))[0])
    found = {mixed(digest[w]) for w in words}
    for gap in (1, 2, 3):
        found |= {mixed(digest[a] * 0xD6E8FEB86659FD93 + digest[b] * 0xA0761D6478BD642F + gap) for a, b in zip(words, words[gap:])}
    return {max(x % (1 << toxicity.BITS), 1) for x in found} | {0}


def brute_ftrl(rows):
    """Weights by dictionaries, a coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        limit = 0.0 if i == 0 else toxicity.L1
        if abs(z.get(i, 0.0)) <= limit:
            return 0.0
        return (math.copysign(limit, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at, label in rows:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for i in at:
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_toxicity_like_brute_force(spark, docs):
    rows = [(i, f"{prose(RNG.randrange(0, 25))}{' vile, NASTY thing' if i % 3 == 0 else ''}", int(i % 3 == 0)) for i in range(120)]
    odd = [(500, None), (501, ""), (502, "Vile vile vile"), (7, "a second text of an id, vile")]
    frame = docs([r[:2] for r in rows] + odd)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learnt = [(i, t, y) for i, t, y in [*rows, (7, odd[3][1], rows[7][2])] if zlib.crc32(str(i).encode()) % 5]
    marks = {r.doc_id: r.m for r in labels.select("doc_id", F.xxhash64("doc_id").alias("m")).collect()}
    learnt.sort(key=lambda r: (marks[r[0]], r[0], r[1]))
    want = brute_ftrl([(brute_places(t), y) for _, t, y in learnt])
    model = toxicity.train(frame, labels)
    assert dict(zip(model[0].tolist(), np.round(model[1], 9).tolist())) == {i: round(w, 9) for i, w in want.items()}
    total = lambda text: sum(want.get(i, 0.0) for i in brute_places(text))
    got = sorted((r.doc_id, round(r.score, 5)) for r in toxicity.scores(frame, model).collect())
    assert got == sorted((i, round(1 / (1 + math.exp(-total(t))), 5)) for i, t in [r[:2] for r in rows] + odd)


def test_first_texts_bound_rows_and_characters(spark, docs):
    rows = docs([(i, "x" * 100) for i in range(50)] + [(3, "another text")]).withColumn("label", F.lit(1))
    assert labelled.first_texts(rows, 10, 10_000).count() == 10
    assert labelled.first_texts(rows, 100, 750).count() in (7, 8) and labelled.first_texts(rows, 100, 99_999).count() == 51
    assert labelled.first_texts(rows.where("false"), 10, 10).count() == 0


def brute_statistics(text):
    t = text or ""
    words = t.split()
    count = lambda pattern: len(regex.findall(pattern, t))
    n, m, d = max(len(t), 1), max(len(words), 1), len(set(words))
    return [
        math.log1p(len(words)), len(t) / m, d / m, d / max(math.sqrt(len(words)), 1), count(r"\p{Lu}") / n, count(r"\p{Nd}") / n,
        count(r"[^\p{L}\p{N}\s.,()+@_-]") / m, count(r"[.,]") / m, len(words) / (t.count("\n") + 1),
    ]


def test_statistics_like_brute_force(docs):
    texts = [(1, None), (2, ""), (3, "One two, THREE.\n42 & four%four\ttwo two"), (4, "ÄÖ ñandú — x_y (z) + a@b " * 30), (5, "\n\n"), (6, "w " * 50_000)]
    names = list(quality.statistics(F.col("text")))
    got = {r[0]: list(r)[1:] for r in docs(texts).select("doc_id", *(c.alias(k) for k, c in quality.statistics(F.col("text")).items())).collect()}
    assert len(names) == 9
    for i, text in texts:
        assert np.allclose(got[i], brute_statistics(text)), (i, got[i], brute_statistics(text))


def test_languages_without_labels(spark, docs, tables):
    out = language_id.query(spark, tables(documents=docs([(1, "abc")], lang=None)))
    assert [r.lang_pred for r in out.collect()] == ["und"]
