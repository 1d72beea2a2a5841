"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each text are Spark columns.  Shallow trees are grown on random halves of a
bounded labelled sample; every path from a root is a rule, a conjunction of thresholds.  A
lasso logistic regression over the rules keeps few of them: the penalty is the largest one whose
loss on a quarter that it was not fitted on is within a standard error of the least.  The rules
are compiled into one Spark column expression, so whole texts are scored within the scan,
without Python.

The sample is at most ``SAMPLE`` labelled documents, chosen by a hash of their id.  The rules
are fitted on its statistics in one task; only the weighted rules come to the driver.

Defined cases: null texts count as empty, and empty texts have all statistics 0 and get the
score that the rules give to those; repeated rows get equal scores; a null doc_id is in fold
0; an id with several texts is learnt with each of them; without labelled documents, or with labels of one kind only, the score is the share of
label 1 (0.5 without any).  An empty table gives an empty result, and further columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.labelled import fold, label_sample
from folioscope.llm.scratch import cut, small

SAMPLE = 16_000
FOLDS, HELD_OUT = 4, 2
CUTOFF = 0.7

TREES, DEPTH, LEAF, SEED = 40, 3, 20, 7
#: The penalties that are tried, least first.
LASSO = tuple(0.0005 * 1.6**k for k in range(12))

#: A rule: (statistic, is above, threshold) each, all of which hold.
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Name and column of each statistic of a text; lengths as logarithms, the rest as shares."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    words = F.array_remove(F.split(t, r"\s+", -1), "")
    n_chars, n_words = F.length(t).cast("double"), F.size(words).cast("double")
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))
    distinct = F.size(F.array_distinct(words)).cast("double")
    return {
        "log_words": F.log1p(n_words),
        "chars_per_word": per(n_chars, n_words),
        "distinct_words": per(distinct, n_words),
        "distinct_to_root": per(distinct, F.sqrt(n_words)),
        "upper": per(count(r"\p{Lu}"), n_chars),
        "digits": per(count(r"\p{Nd}"), n_chars),
        "symbols_per_word": per(count(r"[^\p{L}\p{N}\s.,()+@_-]"), n_words),
        "stops_per_word": per(count(r"[.,]"), n_words),
        "words_per_line": per(n_words, count(r"\n") + 1),
    }


def grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int = DEPTH) -> list[Rule]:
    """Rules of all paths of one tree, which splits by Gini impurity at quantiles of random halves of the statistics."""
    rules: list[Rule] = []

    def split(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        own = y[rows]
        if len(path) >= depth or len(rows) < 2 * LEAF or own.min() == own.max():
            return
        best = (0.0, None, 0.0)
        p = own.mean()
        whole = p * (1 - p)
        for j in rng.choice(len(names), max(1, len(names) // 2), replace=False):
            v = x[rows, j]
            for at in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25))):
                low = v <= at
                n = int(low.sum())
                if LEAF <= n <= len(rows) - LEAF:
                    a, b = own[low].mean(), own[~low].mean()
                    gain = whole - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, j, float(at))
        if best[1] is not None:
            j, at = best[1], best[2]
            low = x[rows, j] <= at
            split(rows[low], (*path, (names[j], False, at)))
            split(rows[~low], (*path, (names[j], True, at)))

    split(np.arange(len(y)), ())
    return rules


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, at in rule:
        v = x[:, names.index(name)]
        out &= (v > at) if above else (v <= at)
    return out


def lasso(r: np.ndarray, y: np.ndarray, n: np.ndarray, strength: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic regression with an L1 penalty, by accelerated proximal gradient steps.

    Row i of ``r`` stands for n[i] rows, of which the share y[i] has label 1.
    """
    share = n / n.sum()
    m = r.shape[1]
    rate = 4.0 / (np.linalg.eigvalsh(r.T @ (r * share[:, None]))[-1] + 1)
    p = float(np.clip(share @ y, 1e-3, 1 - 1e-3))
    w, bias = np.zeros(m), float(np.log(p / (1 - p)))
    v, vb, t = w, bias, 1.0
    for _ in range(steps):
        g = share * (1 / (1 + np.exp(-(r @ v + vb))) - y)
        new = v - rate * (r.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * strength, 0)
        new_b = vb - rate * g.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - bias)
        w, bias, t = new, float(new_b), t_new
    return bias, w


def alike(r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of ``r`` (of truth values), the mean of y of each, and how many there are of each."""
    _, first, of, n = np.unique(np.packbits(r, axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    return r[first].astype(np.float64), np.bincount(of.ravel(), y, len(first)) / n, n.astype(float)


def penalty(r: np.ndarray, y: np.ndarray) -> float:
    """The largest penalty whose loss on every fourth row, fitted on the others, is within a standard error of the least."""
    aside = np.arange(len(y)) % 4 == 3
    if not aside.any() or len(set(y[~aside])) < 2:
        return LASSO[0]
    own, (rows, mean, n), tried = alike(r[~aside], y[~aside]), alike(r[aside], y[aside]), []
    for strength in LASSO:
        bias, w = lasso(*own, strength)
        total = rows @ w + bias
        ones, zeros = np.logaddexp(0, -total), np.logaddexp(0, total)
        loss = float(n @ (mean * ones + (1 - mean) * zeros) / n.sum())
        spread = float(n @ (mean * ones**2 + (1 - mean) * zeros**2) / n.sum()) - loss**2
        tried.append((loss, np.sqrt(max(spread, 0.0) / n.sum())))
    least = min(tried)
    return max(strength for strength, (loss, _) in zip(LASSO, tried) if loss <= least[0] + least[1])


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, list[tuple[Rule, float]]]:
    """Bias and the rules that keep a weight."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return float(np.log(share / (1 - share))), []
    rng, rules = np.random.default_rng(SEED), {}
    for _ in range(TREES):
        some = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        for rule in grow(x[some], y[some], names, rng):
            rules.setdefault(holds(rule, x, names).tobytes(), rule)
    if not rules:
        share = y.mean()
        return float(np.log(share / (1 - share))), []
    held = list(rules.values())
    r = np.stack([holds(rule, x, names) for rule in held], axis=1)
    bias, w = lasso(*alike(r, y), penalty(r, y))
    held, r = [rule for rule, a in zip(held, w) if a != 0], r[:, w != 0]
    if not held:
        return bias, []
    bias, w = lasso(*alike(r, y), LASSO[0])  # the weights of the rules that stay, under the least penalty
    return bias, [(rule, float(a)) for rule, a in zip(held, w) if a != 0]


def compiled(bias: float, rules: list[tuple[Rule, float]], prefix: str = "s_") -> Column:
    """The ensemble's score as an expression over columns ``prefix`` + statistic."""
    total = F.lit(bias)
    for rule, weight in rules:
        fits = F.lit(True)
        for name, above, at in rule:
            c = F.col(prefix + name)
            fits = fits & ((c > at) if above else (c <= at))
        total = total + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


#: A row of the fitted model for each test of each rule, and one without a name for the bias.
MODEL = "rule int, weight double, nth int, name string, above boolean, at double"


def _fit(table: pa.Table) -> pa.Table:
    names = [c for c in table.column_names if c not in {"mark", "label"}]
    table = table.sort_by([(c, "ascending") for c in ("mark", *names, "label")])
    x = np.stack([table.column(c).to_numpy() for c in names], axis=1)
    bias, rules = fit(x, table.column("label").to_numpy().astype(float), names)
    rows = [(-1, bias, 0, None, None, None)] + [(i, w, k, *test) for i, (rule, w) in enumerate(rules) for k, test in enumerate(rule)]
    kinds = (pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.bool_(), pa.float64())
    return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], [c.split()[0] for c in MODEL.split(", ")])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """Bias and weighted rules learnt from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    chosen = cut(label_sample(labels, "quality", FOLDS, HELD_OUT, sample), "sample")
    rows = docs.join(small(chosen, 16), "doc_id").select("doc_id", "label", *(c.alias(k) for k, c in statistics(F.col("text")).items()))
    names = [c for c in rows.columns if c not in {"doc_id", "label"}]
    rows = cut(rows.dropDuplicates(), "statistics").withColumn("mark", F.xxhash64("doc_id")).orderBy("mark", "doc_id", *names).limit(sample)
    found = rows.select("mark", "label", *names).groupBy(F.lit(1).alias("one")).applyInArrow(_fit, MODEL).collect()
    if not found:  # nothing to learn from
        return fit(np.zeros((0, len(names))), np.zeros(0), names)
    weights, tests = {}, {}
    for r in sorted(found, key=lambda r: (r.rule, r.nth)):
        weights[r.rule] = r.weight
        tests.setdefault(r.rule, []).append((r.name, r.above, r.at))
    return weights[-1], [(tuple(tests[i]), w) for i, w in weights.items() if i >= 0]


def scores(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]]) -> DataFrame:
    """``docs`` (with text) and its score."""
    own = statistics(F.col("text"))
    used = sorted({name for rule, _ in model[1] for name, _, _ in rule})
    kept = [c for c in docs.columns if c not in {"score", "_statistics"}]
    held = docs.select(*kept, *(own[k].alias(f"_statistics_{k}") for k in used))
    # The generator keeps a later filter on the score from being pushed below the statistics,
    # where each rule would compute its own once more.
    row = F.struct(*(F.col(f"_statistics_{k}").alias(k) for k in used), F.lit(0).alias("_"))
    held = held.select(*kept, F.explode_outer(F.array(row)).alias("_statistics"))
    return held.select(*kept, compiled(*model, "_statistics.").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = scores(docs, train(docs, labels))
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
