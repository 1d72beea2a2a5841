"""Embedding and MinHash near-dedup, and components, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import embedding_dedup, minhash_dedup
from folioscope.llm.components import components


def classes(nodes, links):
    low = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(500, 700)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(5, 5)]
    nodes = {x for p in links for x in p if p[0] != p[1]}
    out = components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r.id: r.component for r in out.collect()} == classes(nodes, [p for p in links if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(240):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.25, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3 == 0)))
    rows += [(300 + i, rows[0][1], 1) for i in range(40)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 0.0], [2.0, 0.0]]
    rows += [(400 + i, v, 1) for i, v in enumerate(odd)] + [(500, rows[0][1], None), (None, rows[0][1], 1), (600, [1e-30] * 16, 0), (601, [3e-30] * 16, 0)]
    return rows


def brute_vectors(rows, threshold):
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    able = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and c is not None and fine(v)]
    links = [(a[0], b[0]) for k, a in enumerate(able) for b in able[k + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold]
    low = classes([r[0] for r in able], links)
    n = {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    return sorted(((i, n.get(i, 0) if i is not None else 0, low.get(i, i), i is None or low.get(i, i) == i) for i, _, _ in rows), key=repr)


@pytest.mark.parametrize("tile", [1024, 20])
def test_embeddings_like_brute_force(spark, tile):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash")).repartition(4)
    out = embedding_dedup.near_links(df, 0.93, tile)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_vectors(rows, 0.93)


def test_doubles_and_labels_of_text(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=24)
    rows = [(i, [float(x) for x in base + rng.normal(size=24) * 0.3], f"group {i % 2}") for i in range(60)]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    level = float(cos(np.array(rows[0][1]), np.array(rows[2][1])))  # a pair that is at the threshold in doubles only
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    out = {r.vec_id: r.n_links for r in embedding_dedup.near_links(df, level - 1e-12, 16).collect()}
    assert out == {i: sum(c == d and i != j and cos(np.array(v), np.array(w)) >= level - 1e-12 for j, w, d in rows) for i, v, c in rows}


def test_embeddings_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_links(df).count() == 0


def test_quantisation_bound_is_strict():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 48)) * np.exp(rng.normal(size=(200, 1)))
    q, s, err = embedding_dedup.quantise(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    bound = (1 + err)[:, None] * err[None, :] + err[:, None] * (1 + err)[None, :] + 1e-9
    assert (np.abs(u @ u.T - near) <= bound).all()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_texts(pairs, percent):
    sets = [(i, shingles(t)) for i, t in pairs]
    links = [(a[0], b[0]) for k, a in enumerate(sets) for b in sets[k + 1 :] if a[0] is not None and b[0] is not None and a[1] and b[1] and 100 * len(a[1] & b[1]) >= percent * len(a[1] | b[1])]
    low = classes([i for i, _ in pairs], links)
    return sorted(((i, len(s), low[i] if i is not None else None, i is None or low[i] == i) for i, s in sets), key=repr)


def near_texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    pairs, n = [], 0
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 9, 20, 60, 200]))]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            pairs.append((n, " ".join(text)))
            n += 1
    chain = [rng.choice(words) for _ in range(120)]
    for _ in range(40):
        chain[rng.randrange(120)] = rng.choice(words)
        pairs.append((n, " ".join(chain)))
        n += 1
    rng.shuffle(pairs)
    pairs += [(1000, None), (1001, ""), (1002, "  \n "), (1003, "Short One"), (1004, "short\tone"), (1005, "short two"), (1006, "x " * 30_000), (1007, "X " * 20_000), (1008, "y" * 3_000_000), (None, "short one"), (1003, "Short One")]
    return pairs


def test_texts_like_brute_force(docs):
    pairs = near_texts()
    out = minhash_dedup.near_duplicates(docs(pairs).select("*", F.lit(1).alias("n")))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_texts(pairs, 85)


def test_lower_similarity_like_brute_force(docs):
    pairs = near_texts()
    out = minhash_dedup.near_duplicates(docs(pairs), 90)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_texts(pairs, 90)


def test_texts_of_nothing(docs):
    assert minhash_dedup.near_duplicates(docs([(1, "x")]).where("false")).count() == 0
    assert [tuple(r) for r in minhash_dedup.near_duplicates(docs([(1, "a b")])).collect()] == [(1, 1, 1, True)]


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    from folioscope.llm import wordhash

    texts = pa.array(["one two  three", "", None, "É ünï\tone", "two " * 50, "z" * 300])
    every = lambda: [(int(d), int(h)) for _, _, hs, ds in wordhash.word_hashes(texts) for h, d in zip(hs, ds)]
    whole = every()
    monkeypatch.setattr(wordhash, "PIECE", 16)
    assert every() == whole and whole[0][1] == [h for d, h in whole if d == 3][-1]
