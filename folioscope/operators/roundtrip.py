"""From packages to checks: model leaves, edits, adapters, differences and outcomes.

A file and what an adapter made of it are one row; they are compared within that row, part by
part and model by model, so scoring moves no parts and no leaves between tasks.  Runs are
written to the shared folder before they are scored: no adapter runs twice.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import clip
from folioscope.models import FEATURES, compare, docx, model_leaves, pptx, xlsx
from folioscope.operators import processes, scoring
from folioscope.sources import opc, packages, pairing
from folioscope.sources.scratch import written

MODELS = {"xlsx": xlsx, "docx": docx, "pptx": pptx}

#: Fixed value: the text that an edit writes.
MARKER = "Edited by the fidelity check 7f3a"

_LEAVES = "pkg string, feature string, path string, vtype string, value string, error string"
_TARGETS = "pkg string, target string, error string"
_RUNS = "adapter string, pkg string, format string, opened boolean, saved boolean, output binary, phase string, error string, elapsed_ms double"
_SCORES = (
    "adapter string, pkg string, format string, opened boolean, saved boolean, phase string, error string, elapsed_ms double, problems array<string>, input_parts int, "
    "matched map<string,int>, missing array<string>, added int, unlike array<string>, compared int, model_error string, found_at string, default_style boolean, input_features array<string>, "
    "differences array<struct<feature:string,path:string,kind:string,before:string,after:string>>"
)

#: Leaves that go to Spark at a time, at least.
BATCH = 20_000
#: Errors that a damaged document may raise while its model is read.
UNREADABLE = (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError)
#: Fixed value: entries that a report lists of each kind.
LISTED = 25


def _extracted(module, content: bytes) -> tuple[list, str | None]:
    try:
        return model_leaves(module.extract(content)), None
    except UNREADABLE as e:
        return [], f"{type(e).__name__}: {e}"


def leaves(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """The model leaves of ``files`` (pkg, format, content); one row with an error for a file without a model.

    Only leaves whose path matches the regular expression ``wanted`` leave the Python worker.
    """
    keep = re.compile(wanted).search if wanted else None

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for pkg, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows, error = _extracted(MODELS[kind], content or b"")
                held += [(pkg, *row, None) for row in rows if keep is None or keep(row[1])] if error is None else [(pkg, None, None, None, None, error)]
                if len(held) >= BATCH:
                    yield packages.batch_of(_LEAVES, held)
                    held = []
        if held:
            yield packages.batch_of(_LEAVES, held)

    return files.select(F.col("pkg").cast("string"), "format", "content").mapInArrow(run, _LEAVES)


def targets(files: DataFrame) -> DataFrame:
    """pkg, target (JSON), error: where each file is to be edited; a null target has no place for an edit."""

    def run(batches):
        for batch in batches:
            rows = []
            for pkg, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    found = MODELS[kind].edit_target(content or b"")
                    rows.append((pkg, json.dumps(found) if found else None, None))
                except UNREADABLE as e:
                    rows.append((pkg, None, f"{type(e).__name__}: {e}"))
            yield packages.batch_of(_TARGETS, rows)

    return files.select(F.col("pkg").cast("string"), "format", "content").mapInArrow(run, _TARGETS)


def identity(kind: str, content: bytes, target: dict) -> bytes:
    """An adapter that saves what it opened."""
    return content


def patch(kind: str, content: bytes, target: dict) -> bytes:
    """An adapter that makes the edit in its place and leaves all else."""
    return MODELS[kind].apply_edit(content, target, MARKER)


def lossy(kind: str, content: bytes, target: dict) -> bytes:
    """An adapter that makes the edit and loses every part that only an extension reads."""
    edited = opc.read_package(MODELS[kind].apply_edit(content, target, MARKER), "last")
    main = opc.main_part(opc.relationships(edited.parts)) or ""
    kept = {m: edited.parts[k] for k, m in edited.members.items() if k == opc.CONTENT_TYPES or k.endswith(".rels") or k.startswith(main.split("/")[0])}
    return opc.write_package(kept)


def broken(kind: str, content: bytes, target: dict) -> bytes:
    raise RuntimeError("cannot save")


def misplacing(kind: str, content: bytes, target: dict) -> bytes:
    """An adapter that writes the edit's text into another place than it was told."""
    if kind == "xlsx":
        return xlsx.apply_edit(content, target | {"cell": f"B{int(target['cell'][1:]) + 1}"}, MARKER)
    if kind == "docx":
        return docx.apply_edit(content, target, "before " + MARKER)
    return pptx.apply_edit(content, target, "before " + MARKER)


def renaming(kind: str, content: bytes, target: dict) -> bytes:
    """An adapter that makes the edit and gives the edited part another name, its content changed as well."""
    edited = opc.read_package(MODELS[kind].apply_edit(content, target, MARKER), "last")
    old = target["part"]
    folder, _, name = old.rpartition("/")
    new, parts = f"{folder}/renamed-{name}", {}
    for part, data in edited.parts.items():
        at = {old: new, opc.rels_part(old): opc.rels_part(new)}.get(part, edited.members[part])
        if opc.is_rels(part) or part == opc.CONTENT_TYPES:
            data = data.replace(name.encode(), f"renamed-{name}".encode())
        parts[at] = data
    return opc.write_package(parts)


ADAPTERS: dict[str, Callable[[str, bytes, dict], bytes]] = {"identity": identity, "patch": patch, "lossy": lossy, "broken": broken, "misplacing": misplacing, "renaming": renaming}


def chosen(names: list[str]) -> list[str]:
    """The adapters that are asked for, each once, in their order; ``all`` stands for every one."""
    if names == ["all"]:
        return list(ADAPTERS)
    if unknown := [n for n in names if n not in ADAPTERS]:
        raise ValueError(f"unknown adapters: {', '.join(unknown)}")
    return list(dict.fromkeys(names))


def run_adapters(files: DataFrame, edits: DataFrame, names: list[str]) -> DataFrame:
    """A row for each adapter and file that has a target, with the saved bytes.

    Adapters are pure functions of bytes; one that fails gives a row with its error.
    """
    todo = files.select(F.col("pkg").cast("string").alias("pkg"), "format", "content").join(edits.where("target IS NOT NULL").select("pkg", "target"), "pkg")
    todo = todo.withColumn("adapter", F.explode(F.array(*(F.lit(n) for n in names))))

    def run(batches):
        for batch in batches:
            for adapter, pkg, kind, content, target in zip(*(batch.column(i).to_pylist() for i in range(5))):
                began = time.perf_counter()
                try:
                    out, phase, error = ADAPTERS[adapter](kind, content, json.loads(target)), None, None
                except Exception as e:  # an adapter may fail in any way
                    out, phase, error = None, "save", f"{type(e).__name__}: {e}"
                took = round((time.perf_counter() - began) * 1000, 3)
                yield packages.batch_of(_RUNS, [(adapter, pkg, kind, True, bool(out), out, phase, error, took)])

    return todo.select("adapter", "pkg", "format", "content", "target").mapInArrow(run, _RUNS)


@lru_cache(4)
def _expected(kind: str, content: bytes, target: str) -> tuple[dict, dict]:
    """The model of a file, and the model that it should have with the edit made."""
    place, module = json.loads(target), MODELS[kind]
    model = json.loads(json.dumps(module.extract(content)))
    if kind != "xlsx":
        return model, json.loads(json.dumps(module.extract(module.apply_edit(content, place, MARKER))))
    cells = dict(model["cells"])
    cells[place["sheet"]] = {**cells.get(place["sheet"], {}), place["cell"]: {"type": "s", "value": MARKER}}
    return model, {**model, "cells": cells}


def scored(kind: str, content: bytes, output: bytes | None, target: str) -> tuple:
    """What ``_SCORES`` has from problems on, for a file and what an adapter saved of it."""
    given = opc.read_package(content, "last")
    saved = opc.read_package(output, "last") if output else None
    parts: tuple = (None, len(given.parts), None, None, None, None, None)
    if saved is not None and saved.error:
        parts = ([saved.error], len(given.parts), None, None, None, None, None)
    elif saved is not None:
        a, b = pairing.Parts(given.parts), pairing.Parts(saved.parts)
        mapping = pairing.mapped(a, b)
        known = set(a.problems())
        fresh = [p for p in b.problems() if p not in known]
        if b.main() not in b.parts:
            fresh.append("no main document part")
        methods = {m: sum(x == m for _, x in mapping.values()) for m in pairing.METHODS}
        lost = sorted(set(a.parts) - set(mapping))
        parts = (fresh, len(a.parts), [(m, n) for m, n in methods.items() if n], lost, len(b.parts) - len(mapping), pairing.unlike(a, b, mapping), len(mapping))
    place = json.loads(target)
    try:
        model, wanted = _expected(kind, content, target)
    except UNREADABLE as e:
        return (*parts, f"input: {type(e).__name__}: {e}", None, None, None, None)
    present = compare.features_present(kind, model)
    if saved is None:
        return (*parts, None, None, None, present, None)
    try:
        got = json.loads(json.dumps(MODELS[kind].extract(output)))
    except UNREADABLE as e:
        return (*parts, f"output: {type(e).__name__}: {e}", None, None, present, None)
    shown = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x, sort_keys=True, ensure_ascii=False)
    found = [(d.feature, d.path, d.kind, shown(d.before), shown(d.after)) for d in compare.differences(kind, wanted, got)]
    plain = kind == "xlsx" and compare.default_style(wanted, got, place)
    return (*parts, None, compare.edit_found(kind, wanted, got, place, MARKER), plain, present, found)


def scores(files: DataFrame, edits: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each run with all that its checks say, from the bytes of the file and of what was saved."""
    given = files.select(F.col("pkg").cast("string").alias("pkg"), "content").join(edits.select("pkg", "target"), "pkg")
    names = [x.split()[0] for x in _SCORES.split(", ")]
    todo = runs.join(given, "pkg").select(*names[:8], "content", "output", "target")
    texts, rows = pa.list_(pa.string()), [("feature", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("before", pa.string()), ("after", pa.string())]
    kinds = [pa.string()] * 3 + [pa.bool_()] * 2 + [pa.string()] * 2 + [pa.float64(), texts, pa.int32(), pa.map_(pa.string(), pa.int32()), texts, pa.int32(), texts, pa.int32()]
    kinds += [pa.string(), pa.string(), pa.bool_(), texts, pa.list_(pa.struct(rows))]

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for n in range(batch.num_rows):
                row = [c[n].as_py() for c in cols]
                content, output, target = row[8:]
                own = list(scored(row[2], content, output, target))
                own[-1] = None if own[-1] is None else [dict(zip((k for k, _ in rows), d)) for d in own[-1]]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*row[:8], *own], kinds)], names)

    return todo.mapInArrow(run, _SCORES)


def model_differences(pairs: DataFrame) -> DataFrame:
    """pkg, feature, path, kind of what differs between the models of two files of ``pairs`` (pkg, format, before, after)."""
    schema = "pkg string, feature string, path string, kind string"

    def run(batches):
        for batch in batches:
            for pkg, kind, before, after in zip(*(batch.column(i).to_pylist() for i in range(4))):
                a, b = (json.loads(json.dumps(MODELS[kind].extract(x or b""))) for x in (before, after))
                yield packages.batch_of(schema, [(pkg, d.feature, d.path, d.kind) for d in compare.differences(kind, a, b)])

    return pairs.select(F.col("pkg").cast("string"), "format", "before", "after").mapInArrow(run, schema)


@dataclass
class Trial:
    """The tables of a round trip: edits, runs and their scores, each written once.

    ``programs`` are adapters that are programs, by name, killed after ``timeout`` seconds for a
    file; those that this place lacks are in ``unavailable`` with the reason, and run nothing.
    """

    files: DataFrame
    names: list[str]
    programs: dict[str, list[str]] = field(default_factory=dict)
    timeout: float = 120.0
    unavailable: dict[str, str] = field(init=False)
    edits: DataFrame = field(init=False)
    scores: DataFrame = field(init=False)

    def __post_init__(self):
        files, self.names = self.files, chosen(self.names)
        self.unavailable = {n: why for n, why in processes.prepared(self.programs).items() if why}
        self.edits = written(targets(files), "targets")
        runs = run_adapters(files, self.edits, self.names)
        todo = files.select(F.col("pkg").cast("string").alias("pkg"), "format", "content").join(self.edits.where("target IS NOT NULL").select("pkg", "target"), "pkg")
        for name, command in self.programs.items():
            if name not in self.unavailable:
                self.names.append(name)
                edit = todo.withColumn("target", F.to_json(F.struct(F.col("target").alias("place"), F.lit(MARKER).alias("text"))))
                found = processes.run_program(edit, command, self.timeout)
                runs = runs.unionByName(found.withColumn("adapter", F.lit(name)))
        self.scores = written(scores(files, self.edits, written(runs, "runs")), "scores")

    def differences(self) -> DataFrame:
        """adapter, pkg, feature, path, kind, before, after."""
        return self.scores.select("adapter", "pkg", F.explode("differences").alias("d")).select("adapter", "pkg", "d.*")

    def untargeted(self) -> DataFrame:
        """adapter, pkg of the files that no adapter edits, once for each adapter."""
        return self.edits.where("target IS NULL").select(F.explode(F.array(*(F.lit(n) for n in self.names))).alias("adapter"), "pkg")


def preservation(trial: Trial) -> DataFrame:
    """adapter, feature, preserved, present, rate over the files that can be edited.

    An output that wasn't saved, or has no model, preserves nothing.
    """
    read = trial.scores.where("input_features IS NOT NULL")
    each = read.select("adapter", F.explode("input_features").alias("feature"), F.transform("differences", lambda d: d["feature"]).alias("lost"))
    kept = F.coalesce(~F.array_contains("lost", F.col("feature")), F.lit(False))
    out = each.groupBy("adapter", "feature").agg(F.count_if(kept).alias("preserved"), F.count("*").alias("present"))
    return out.withColumn("rate", F.round(F.col("preserved") / F.col("present"), 4))


def differing_features(trial: Trial) -> DataFrame:
    """adapter, pkg, diff_count, features (their counts), sample (the first differences, long values clipped): a row per compared run."""
    found = trial.scores.where("differences IS NOT NULL")
    names = F.transform("differences", lambda d: d["feature"])
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(names)), lambda f: F.struct(f, F.size(F.filter(names, lambda x: x == f)))))
    first = F.transform(F.slice("differences", 1, LISTED), lambda d: F.struct(d["feature"].alias("feature"), d["path"].alias("path"), d["kind"].alias("kind"), clip(d["before"], 200).alias("before"), clip(d["after"], 200).alias("after")))
    return found.select("adapter", "pkg", F.size("differences").alias("diff_count"), counts.alias("features"), first.alias("sample"))


def check_columns() -> dict[str, tuple[Column, Column]]:
    """Name of each check -> (holds, counts towards the outcome), over a row of ``scores``."""
    none = lambda c: F.coalesce(F.size(c) == 0, F.lit(False))
    readable = F.coalesce(~F.startswith("model_error", F.lit("input: ")), F.lit(True))
    return {
        "opened": (F.col("opened"), F.lit(True)),
        "saved": (F.col("saved"), F.lit(True)),
        "package-valid": (F.col("saved") & none("problems"), F.lit(True)),
        "edit-applied": (F.col("found_at").isNotNull(), readable),
        "content-preserved": (none("differences"), readable),
        "parts-preserved": (none("missing"), F.lit(False)),
        "semantic-preserved": (none("unlike"), F.lit(False)),
    }


def checks(files: DataFrame, names: list[str]) -> DataFrame:
    """adapter, pkg, name, outcome, scored: the checks of every adapter on every file.

    A file without a place for the edit has its checks unscored, as have the model's checks of
    a file whose own model can't be read.
    """
    return checks_of(Trial(files, names))


def checks_of(trial: Trial) -> DataFrame:
    row = lambda name, outcome, counts: F.struct(F.lit(name).alias("name"), outcome.alias("outcome"), counts.alias("scored"))
    each, none = [], []
    for name, (holds, counts) in check_columns().items():
        wanted = counts if name in ("edit-applied", "content-preserved") else F.lit(True)
        each.append(row(name, F.when(~wanted, "unscored").when(holds, "success").otherwise("failure"), counts))
        none.append(row(name, F.lit("unscored"), F.lit(False)))
    tried = trial.scores.select("adapter", "pkg", F.explode(F.array(*each)).alias("check"))
    rest = trial.untargeted().select("adapter", "pkg", F.explode(F.array(*none)).alias("check"))
    return tried.unionByName(rest).select("adapter", "pkg", "check.*")


def results(trial: Trial) -> DataFrame:
    """adapter, pkg, outcome, reason, elapsed_ms: a row for each adapter and file.

    error before there is an output, timeout for a run that was stopped, failure with the names
    of the checks that failed, else success; unscored without a place for the edit.
    """
    failed = F.filter(
        F.array(*(F.when(counts & ~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, (holds, counts) in check_columns().items())), lambda x: x.isNotNull()
    )
    late = F.coalesce(F.col("phase") == "timeout", F.lit(False))
    found = trial.scores.select("adapter", "pkg", "opened", "saved", "phase", "elapsed_ms", failed.alias("failed"))
    early = ~(F.col("opened") & F.col("saved"))
    outcome = F.when(late, "timeout").when(early, "error").otherwise(scoring.outcome(late, F.lit(""), F.size("failed") > 0))
    reason = (
        F.when(late, "the adapter took too long").when(~F.col("opened"), "the adapter failed to open").when(early & (F.col("phase") == "edit"), "the adapter failed to apply the edit")
        .when(early, "the adapter failed to save").when(F.size("failed") > 0, F.concat(F.lit("failed: "), F.array_join("failed", ", ")))
    )
    tried = found.select("adapter", "pkg", outcome.alias("outcome"), reason.alias("reason"), "elapsed_ms")
    rest = trial.untargeted().select("adapter", "pkg", F.lit("unscored").alias("outcome"), F.lit("no place for the edit").alias("reason"), F.lit(None).cast("double").alias("elapsed_ms"))
    return tried.unionByName(rest)


def feature_counts(trial: Trial) -> DataFrame:
    """adapter, format, feature, diff_count, rank: differences by feature; rank is the feature's place in its format's list."""
    place = F.lit(None).cast("int")
    for kind, names in FEATURES.items():
        place = F.when(F.col("format") == kind, F.array_position(F.array(*(F.lit(n) for n in names)), F.col("feature")).cast("int")).otherwise(place)
    found = trial.scores.select("adapter", "format", F.explode("differences").alias("d")).groupBy("adapter", "format", F.col("d.feature").alias("feature"))
    return found.agg(F.count("*").alias("diff_count")).withColumn("rank", place)


def default_style_files(trial: Trial) -> DataFrame:
    """adapter, files: the files whose new cell has the default look instead of its row's or column's, in order."""
    return trial.scores.groupBy("adapter").agg(F.array_sort(F.collect_list(F.when(F.col("default_style"), F.col("pkg")))).alias("files"))


def write_run(trial: Trial, path: str) -> None:
    """Checks, results, differences and summary as Parquet below a new folder; a table that is there already is an error.

    What only a run needs (bytes, targets, the path of the edit) isn't written.
    """
    tables = {"checks": checks_of(trial), "results": results(trial), "differences": trial.differences(), "summary": summary(trial), "features": feature_counts(trial)}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")


def summary(trial: Trial) -> DataFrame:
    """A row per adapter: files, those without a target, those whose model is compared, outcomes, byte-identical relations of parts, default styles."""
    by = results(trial).groupBy("adapter").agg(
        F.count("*").alias("files_total"), F.count_if(F.col("outcome") == "unscored").alias("no_edit_target"),
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failure", "error", "timeout")), F.median("elapsed_ms").alias("median_ms"),
    )
    content = trial.scores.groupBy("adapter").agg(
        F.count_if(F.col("input_features").isNotNull()).alias("content_files"), F.count_if(F.col("found_at").isNotNull()).alias("edit_applied"),
        F.count_if(F.size("differences") == 0).alias("content_preserved"), F.count_if("default_style").alias("default_style_files"),
        F.sum(F.size("unlike")).alias("unlike_parts"), F.sum("compared").alias("compared_parts"),
    )
    return by.join(content, "adapter", "left")
