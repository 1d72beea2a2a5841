"""Packages, graphs, selection, differences, scoring and the stream."""

import difflib
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioscope.models import docx, xlsx
from folioscope.operators import diff, graph, roundtrip, runs, scoring, selection
from folioscope.plans.package_queries import DAMAGE, VERDICT, damaged
from folioscope.sources import corpus, opc, packages
from folioscope.streaming import landing

BOOK = xlsx.write({"S": [("A1", "n", 1)]})


def test_duplicate_names():
    content = opc.write_package({"a.xml": b"1", "A.XML": b"2", "%62.xml": b"3"})
    assert opc.read_package(content).error == "duplicate part: a.xml"
    assert opc.read_package(content, "first").parts["a.xml"] == b"1" and opc.read_package(content, "last").parts["a.xml"] == b"2"
    assert "b.xml" in opc.read_package(content, "last", decode=True).parts


@pytest.mark.parametrize(
    "source, target, want",
    [("xl/workbook.xml", "worksheets/s.xml", "xl/worksheets/s.xml"), ("xl/a/b.xml", "../C.xml", "xl/c.xml"), ("", "/x/y.xml", "x/y.xml"), ("a/b", "%20c.xml#frag", "a/ c.xml"), ("a/b", "..\\d+e.xml", "d+e.xml")],
)
def test_resolve(source, target, want):
    assert opc.resolve(source, target) == want


def test_rels_names():
    for owner in ("", "xl/workbook.xml", "a/b/c.xml"):
        assert opc.rels_owner(opc.rels_part(owner)) == owner and opc.is_rels(opc.rels_part(owner))


@pytest.mark.parametrize("how", DAMAGE)
def test_screen(how):
    assert opc.screen(damaged(BOOK, how)) == VERDICT[how]


def test_document_types_are_refused():
    assert not opc.well_formed(b'<!DOCTYPE x [<!ENTITY e "boom">]><x>&e;</x>') and opc.well_formed(b"<x/>")


def test_canonical_ignores_what_no_reader_sees():
    a = b'<x xmlns="u"><b k="1" j="2"> </b><modified>now</modified><!-- c --></x>'
    b = b'<p:x xmlns:p="u">\n<p:b j="2" k="1"/></p:x>'
    part = "docprops/core.xml"  # only there a date of change is no content
    assert opc.canonical(a, part=part) == opc.canonical(b, part=part) != opc.canonical(b.replace(b'"1"', b'"3"'), part=part)
    assert opc.canonical(a.replace(b"<modified>now</modified>", b"")) == opc.canonical(b)


def test_problems(spark):
    parts = {m: d for m, d in ((n, opc.read_package(BOOK).parts[k]) for k, n in opc.read_package(BOOK).members.items())}
    parts["xl/odd.xml"], parts["x.bin"] = b"<open>", b""
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace(b"sheet1", b"gone")
    files = spark.createDataFrame([("p", "xlsx", bytearray(opc.write_package(parts))), ("q", "xlsx", bytearray(b"junk"))], "pkg string, format string, content binary")
    found = {r.pkg: r.problems for r in packages.problems(packages.explode(files), packages.relationships(files)).collect()}
    assert found["p"] == ["dangling: xl/workbook.xml -> xl/worksheets/gone.xml", "malformed: xl/odd.xml", "no content type: x.bin"] and found["q"] == ["unreadable: BadZipFile"]


def test_paths_end_in_cycles_and_map_renamed_parts(spark):
    rel = "pkg int, source string, rel_id string, kind string, target string, external boolean"
    rows = lambda a, b: [(1, "", "r", "main", a, False), (1, a, "r1", "s", b, False), (1, b, "r2", "up", a, False), (1, a, "x", "link", "http://x", True), (1, a, "r9", "s", f"{b}0", False)]
    before = {r.part: r.path for r in graph.logical_paths(spark.createDataFrame(rows("m", "s2"), rel)).collect()}
    after = {r.part: r.path for r in graph.logical_paths(spark.createDataFrame(rows("n", "t2"), rel)).collect()}
    assert before == {"m": "/main#1", "s2": "/main#1/s#1", "s20": "/main#1/s#2"} and after == {"n": "/main#1", "t2": "/main#1/s#1", "t20": "/main#1/s#2"}
    part = "pkg int, part string, path string, type string, digest string"
    a = spark.createDataFrame([(1, p, q, "t", p) for p, q in before.items()] + [(1, "d1", None, "t", "same"), (1, "d2", None, "t", "same"), (1, "lost", None, "t", "l")], part)
    b = spark.createDataFrame([(1, p, q, "t", "new") for p, q in after.items()] + [(1, "e2", None, "u", "same"), (1, "e1", None, "t", "same")], part)
    mapping = graph.map_parts(a, b)
    assert {(r.part, r.other, r.method) for r in mapping.collect()} == {("m", "n", "path"), ("s2", "t2", "path"), ("s20", "t20", "path"), ("d1", "e1", "digest"), ("d2", "e2", "digest")}
    assert [(r.part, r.side) for r in graph.unmapped(a, b, mapping).collect()] == [("lost", "missing")]


def brute_greedy(rows, wanted):
    left, out, times = list(rows), [], {}
    while left and len(out) < wanted:
        best = sorted(left, key=lambda r: (-sum(1 / (1 + times.get(x, 0)) for x in r["labels"]), -len(r["labels"]), r["size"], r["path"]))[0]
        left.remove(best)
        out.append(best["file_id"])
        for x in best["labels"]:
            times[x] = times.get(x, 0) + 1
    return out


def test_cover_and_rounds(spark):
    rng = random.Random(2)
    rows = [{"format": "f", "source": rng.choice("ab"), "file_id": i, "size": rng.randint(1, 9), "path": f"p{i}", "labels": sorted(rng.sample("klmnop", rng.randint(1, 4)))} for i in range(40)]
    schema = "format string, source string, file_id long, size long, path string, labels array<string>"
    pool = spark.createDataFrame([Row(**r) for r in rows], schema)
    alone = selection.cover(pool.withColumn("source", F.lit("a")), {"a": 12}, 12)
    assert [r.file_id for r in alone.orderBy("pick").collect()] == brute_greedy(rows, 12)
    first = selection.next_pick(pool, spark.createDataFrame([], "label string, times int")).first()
    assert first.file_id == brute_greedy(rows, 1)[0]
    short = selection.cover(pool, {"c": 5, "a": 4, "b": 3}, 20).collect()
    by = {r["file_id"]: r["source"] for r in rows}
    assert len(short) == 20 and sum(by[r.file_id] == "a" for r in short if r.pick < 9) == 9


def test_exclusions_do_not_hide_copies(spark):
    rows = [(1, "f", "x", True), (2, "f", "x", False), (3, "f", "x", False), (4, "g", "x", False), (5, "f", "y", None)]
    df = spark.createDataFrame(rows, "id int, format string, c string, bad boolean")
    out = selection.exclusions(df, [("bad", F.col("bad"))], ["format"], F.col("c"), ["id"])
    assert {r.id: r.reason for r in out.collect()} == {1: "bad", 2: None, 3: "duplicate", 4: None, 5: None}


def test_flat_names():
    assert selection.flat_names(["a/x.doc", "b/X.doc", "c/b/x.doc", "q.doc"]) == ["x.doc", "b_X.doc", "c_b_x.doc", "q.doc"]


def test_lists_align_like_difflib():
    rng = random.Random(4)
    for _ in range(100):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        rows = diff.aligned(a, b)
        same = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        missing, added, changed = (sum(r[0] == k for r in rows) for k in ("missing", "added", "changed"))
        assert len(a) == same + missing + changed and len(b) == same + added + changed


def test_containers_are_one_difference(spark):
    leaf = "file string, path string, value string"
    a = spark.createDataFrame([("f", "/c/s1/A1/v", "1"), ("f", "/c/s1/A1/t", "n"), ("f", "/c/s2/B1/v", "2"), ("f", "/k", "x")], leaf)
    b = spark.createDataFrame([("f", "/c/s2/B1/v", "3"), ("f", "/c/s2/B2/v", "4"), ("f", "/c/s2/B2/t", "n"), ("f", "/k", "x")], leaf)
    assert {(r.path, r.kind) for r in diff.subtree_diff(a, b).collect()} == {("/c/s1", "missing"), ("/c/s2/B1/v", "changed"), ("/c/s2/B2", "added")}


def test_tolerances_at_their_limits(spark):
    leaf = "file string, path string, value string"
    a = [("/rows/S/1/height", "10"), ("/rows/S/2/height", "10"), ("/cells/S/A1/value", "1"), ("/page_setup/S/pageMargins/left", "1.0")]
    b = [("/rows/S/1/height", "10.5"), ("/rows/S/2/height", "10.51"), ("/cells/S/A1/value", "1.0000001"), ("/page_setup/S/pageMargins/left", "1.006")]
    made = [spark.createDataFrame([("f", *r) for r in rows], leaf) for rows in (a, b)]
    assert {r.path for r in diff.subtree_diff(*made, kind="xlsx").collect()} == {"/rows/S/2/height", "/cells/S/A1/value"}


def test_not_a_number_never_equals_itself(spark):
    rows = spark.createDataFrame([(1, float("nan"), float("nan")), (2, 1.0, 1.5), (3, 1.0, 1.6), (4, 2.0, 2.0)], "i int, before double, after double")
    out = rows.select("i", diff.differing(F.col("before"), F.col("after"), F.lit(0.5)).alias("d"))
    assert {r.i: r.d for r in out.collect()} == {1: True, 2: False, 3: True, 4: False}


def test_runs_break_at_marks(spark):
    rows = spark.createDataFrame([(1, 1, "b", "x"), (1, 2, "b", "y"), (1, 3, "b", ""), (1, 4, "b", "z"), (1, 5, "c", "q"), (1, 6, None, "r"), (1, 7, None, "s")], "g int, i int, f string, t string")
    out = runs.merge_runs(rows, ["g"], ["i"], ["f"], "t").orderBy("run")
    assert [(r.f, r.text) for r in out.collect()] == [("b", "xyz"), ("c", "q"), (None, "rs")]


def test_run_status_needs_a_scored_row(spark):
    rows = spark.createDataFrame([("a", True, "success"), ("a", False, "failure"), ("b", False, "success"), ("c", True, "failure")], "g string, scored boolean, outcome string")
    assert {r.g: r.status for r in scoring.run_status(rows, ["g"]).collect()} == {"a": "success", "b": "failure", "c": "failure"}


def test_adapters_on_documents(spark):
    files = [("d", "docx", bytearray(docx.write(docx.paragraph_markup("some text")))), ("e", "docx", bytearray(docx.write("<w:p/>"))), ("x", "xlsx", bytearray(BOOK))]
    rows = roundtrip.checks(spark.createDataFrame(files, "pkg string, format string, content binary"), ["identity", "patch", "lossy", "broken"]).collect()
    good = {(r.adapter, r.pkg, r.name) for r in rows if r.outcome == "success"}
    assert {r.pkg for r in rows} == {"d", "e", "x"} and {r.outcome for r in rows if r.pkg == "e"} == {"unscored"}
    for pkg in ("d", "x"):
        assert all(("patch", pkg, n) in good for n in ("opened", "saved", "package-valid", "edit-applied", "content-preserved", "parts-preserved"))
        assert ("identity", pkg, "edit-applied") not in good and ("identity", pkg, "content-preserved") not in good and ("identity", pkg, "parts-preserved") in good
        assert ("broken", pkg, "opened") in good and ("broken", pkg, "saved") not in good


def test_configuration_and_sinks(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"sources": [{"id": "a", "kind": "git"}, {"id": "b", "kind": "tar"}], "selection": {"quotas": {"xlsx": {"a": 3, "b": 1}, "docx": {"b": 2}}}}')
    sources, quotas = corpus.read_config(spark, str(tmp_path / "s.json"))
    assert [(r.id, r.ord) for r in sources.collect()] == [("a", 0), ("b", 1)]
    assert {tuple(r) for r in quotas.collect()} == {("xlsx", "a", 3), ("xlsx", "b", 1), ("docx", "b", 2)}
    corpus.write_holdout(spark.createDataFrame([("b",), ("a",)], "line string"), str(tmp_path / "h"))
    assert [r.value for r in spark.read.text(str(tmp_path / "h")).collect()] == ["a", "b"]
    text = corpus.manifest(spark.createDataFrame([("p2", 1), ("p1", 2)], "path string, size int"), {"schema": "1"})
    assert text.index('"p1"') < text.index('"p2"') and '"count": 2' in text


def test_landing_folder(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    (folder / "a.xlsx").write_bytes(BOOK)
    (folder / "copy.xlsx").write_bytes(BOOK)
    (folder / "bad.xlsx").write_bytes(b"junk")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    landing.screen_stream(spark, str(folder), out, state).awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert len({r.pkg for r in rows if r.part}) == 1 and sum(r.error is not None for r in rows) == 1
    (folder / "new.docx").write_bytes(docx.write(docx.paragraph_markup("x")))
    landing.screen_stream(spark, str(folder), out, state).awaitTermination(120)
    assert len({r.pkg for r in spark.read.parquet(out).collect() if r.part}) == 2


def test_payloads_count_by_their_members():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in reversed(opc.read_package(BOOK).parts.items()):
            z.writestr(name, data)
    assert opc.payload_digest(BOOK) == opc.payload_digest(out.getvalue()) and opc.payload_digest(b"x") != opc.payload_digest(b"y")


def test_deck_features(spark):
    want = {"/slides/0/hidden": "slide-hidden", "/slides/0/shapes/1/hidden": "shapes", "/slides/0/shapes/1/paragraphs/0/runs/0/format/size": "text-format", "/slides/0/shapes/0/table/0/0/text": "tables", "/theme/0/dk1": "theme", "/odd": "package", "/slides/0/shapes/0/children/0/geometry/x": "geometry"}
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", diff.deck_feature(F.col("p")).alias("f"))
    assert {r.p: r.f for r in rows.collect()} == want


def test_alike_values_pair_once():
    near = lambda a, b: abs(a - b) <= 1
    assert diff.pair_alike({"k": 0, "a": 1, "b": 1, "c": 9}, {"k": 5, "x": 2, "y": 2, "z": 2}, near) == [("a", "x"), ("b", "y")]


def test_wheel_tags(spark):
    from folioscope.functions import scalars

    row = spark.createDataFrame([("name-1.0-py2.py3-none-any.whl",)], "f string").select(scalars.wheel_tags(F.col("f")).alias("t")).first()
    assert row.t == ["py2-none-any", "py3-none-any"]
