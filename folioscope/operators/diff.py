"""Model differences: keyed leaves, tolerances, whole subtrees, aligned lists, presence and relabelling."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.models.compare import DECK_KEYS, DECK_STICKY


def differing(before: Column, after: Column, tolerance: Column | None = None) -> Column:
    """Numbers differ unless they are equal or within tolerance; not-a-number differs from everything."""
    equal = before == after
    if tolerance is not None:
        equal = equal | (F.abs(before - after) <= tolerance)
    return ~(equal & ~F.isnan(before) & ~F.isnan(after))


#: Path patterns whose numbers may differ, and by how much, absolutely and relatively.
TOLERANCES = {
    "xlsx": [
        (r"^/columns/[^/]+/[^/]+/width$", 0.5 / 5.25, 0.0),
        (r"^/rows/[^/]+/[^/]+/height$", 0.5, 0.0),
        (r"^/page_setup/[^/]+/pageMargins/", 0.5 / 72, 0.0),
        (r"/tint$", 1 / 510, 0.0),
        (r"/gradientFill/", 0.0, 1e-9),
    ],
    "docx": [(r"/(left|right|first_line|before|after|line|width|height|top|bottom|header|footer|gutter|grid)(/[0-9]+)*$", 10.0, 0.0)],
    "pptx": [(r"/geometry/(x|y|cx|cy)$|/line/width$|^/slide-size/", 6350.0, 0.0), (r"/geometry/rot$", 60000 / 360, 0.0), (r"/", 0.0, 1e-9)],
}


def allowance(kind: str, path: Column, size: Column) -> Column:
    """How far a number at ``path`` may be off in a format's model; null where it may not."""
    out = F.lit(None).cast("double")
    for pattern, absolute, relative in reversed(TOLERANCES[kind]):
        out = F.when(path.rlike(pattern), F.lit(absolute) + F.abs(size) * relative).otherwise(out)
    return out


def keyed(before: DataFrame, after: DataFrame, keys: list[str], value: str, unlike: Column | None = None) -> DataFrame:
    """keys, kind (missing, added, changed), before, after: a full outer join on the keys.

    ``unlike`` says over before and after when two values differ; by default, null-safe.
    """
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    unlike = ~F.col("before").eqNullSafe(F.col("after")) if unlike is None else unlike
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(unlike, "changed")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "kind", "before", "after")


def parents(path: Column) -> Column:
    """All containers of a JSON pointer, outermost first, without itself."""
    segments = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda n: F.array_join(F.slice(segments, 1, n), "/"))


def subtree_diff(before: DataFrame, after: DataFrame, file: str = "file", kind: str | None = None) -> DataFrame:
    """file, path, kind: the difference of two leaf tables (file, path, value and perhaps vtype), a lost or new container being one entry.

    Values of two kinds differ even if they are written alike, and not-a-number differs from itself.
    The entry of a leaf is its outermost container that the other side hasn't, else itself.
    ``kind``, a format, allows numbers its tolerances.
    """

    def containers(leaves: DataFrame) -> DataFrame:
        return leaves.select(file, F.explode(F.concat(parents(F.col("path")), F.array("path"))).alias("at")).distinct()

    def entries(own: DataFrame, other: DataFrame, kind: str) -> DataFrame:
        lone = own.join(other.select(file, "path"), [file, "path"], "left_anti")
        chain = lone.select(file, "path", F.posexplode(F.concat(parents(F.col("path")), F.array("path"))).alias("depth", "at"))
        new = chain.join(containers(other), [file, "at"], "left_anti")
        return new.groupBy(file, "path").agg(F.min_by("at", "depth").alias("at")).select(file, F.col("at").alias("path"), F.lit(kind).alias("kind")).distinct()

    same = F.col("a.value").eqNullSafe(F.col("b.value")) & ~F.coalesce(F.col("a.value") == "NaN", F.lit(False))
    if "vtype" in before.columns and "vtype" in after.columns:
        same = F.when(F.col("a.vtype") == "num", same).otherwise(F.col("a.value").eqNullSafe(F.col("b.value"))) & (F.col("a.vtype") == F.col("b.vtype"))
    if kind is not None:
        x, y = F.col("a.value").try_cast("double"), F.col("b.value").try_cast("double")
        same = same | F.coalesce(F.abs(x - y) <= allowance(kind, F.col("path"), x), F.lit(False))
    changed = before.alias("a").join(after.alias("b"), [file, "path"]).where(~same)
    changed = changed.select(file, "path", F.lit("changed").alias("kind"))
    return changed.unionByName(entries(before, after, "missing")).unionByName(entries(after, before, "added"))


def deck_feature(path: Column) -> Column:
    """The feature of a place in a presentation's model: the innermost key that names one, unless a container above keeps it."""
    names = F.create_map(*(F.lit(x) for pair in DECK_KEYS.items() for x in pair))
    below = lambda now, key: (
        F.when(now.isin(*DECK_STICKY), now).when(key == "hidden", F.when(now == "slides", "slide-hidden").otherwise("shapes")).otherwise(F.coalesce(F.try_element_at(names, key), now))
    )
    return F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 20), F.lit("package"), below)


def pair_alike(before: dict, after: dict, same) -> list[tuple[str, str]]:
    """Keys that only one side has, paired where ``same`` holds of their values: the first fit of each, in key order."""
    rest, out = sorted(set(after) - set(before)), []
    for a in sorted(set(before) - set(after)):
        b = next((b for b in rest if same(before[a], after[b])), None)
        if b is not None:
            rest.remove(b)
            out.append((a, b))
    return out


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def aligned(before: list, after: list) -> list[tuple[str, int, object, object]]:
    """(kind, index, before, after) of two lists aligned by their longest matching blocks; replaced blocks pair in order."""
    a, b = [canonical(x) for x in before], [canonical(x) for x in after]
    out: list[tuple[str, int, object, object]] = []
    for tag, i, k, j, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        pairs = min(k - i, m - j)
        out += [("changed", i + n, before[i + n], after[j + n]) for n in range(pairs)]
        out += [("missing", n, before[n], None) for n in range(i + pairs, k)]
        out += [("added", n, None, after[n]) for n in range(j + pairs, m)]
    return out


def list_diff(before: DataFrame, after: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """group, kind, at, before, after: each group's two lists aligned.  A group is one list of one document."""

    cols = [*group, order, value]
    sides = before.select(*cols, F.lit(0).alias("_side")).unionByName(after.select(*cols, F.lit(1).alias("_side")))

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = aligned(*(pdf[pdf["_side"] == side][value].tolist() for side in (0, 1)))
        return pd.DataFrame([(*pdf.iloc[0][group].tolist(), *r) for r in rows], columns=[*group, "kind", "at", "before", "after"])

    kinds = ", ".join(f"{g} {before.schema[g].dataType.simpleString()}" for g in group)
    return sides.groupBy(*group).applyInPandas(of_group, f"{kinds}, kind string, at long, before string, after string")


def json_leaves(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """keys, path, vtype, value: the members of a JSON object column, a row each."""
    entries = F.from_json(document, "map<string,string>")
    leaf = df.select(*keys, F.explode(entries).alias("key", "value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").try_cast("double").isNotNull(), "num").when(F.col("value").isin("true", "false"), "bool").otherwise("str")
    return leaf.select(*keys, F.concat(F.lit("/"), "key").alias("path"), kind.alias("vtype"), "value")


def present(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature: features with a leaf that isn't null, false or empty; zero counts."""
    empty = F.col("value").isNull() | F.col("value").isin("", "false")
    return leaves.where(~empty).select(*keys, "feature").distinct()


def relabel(diffs: DataFrame, formulas: DataFrame, keys: list[str], feature: str = "cells", to: str = "formulas") -> DataFrame:
    """Differences of ``feature`` at places that have a formula count as ``to``."""
    marked = diffs.join(formulas.select(*keys).distinct().withColumn("_f", F.lit(True)), keys, "left")
    return marked.withColumn("feature", F.when((F.col("feature") == feature) & F.col("_f"), to).otherwise(F.col("feature"))).drop("_f")
