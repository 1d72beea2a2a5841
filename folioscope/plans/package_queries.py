"""Queries over real packages: rows are written into packages, read back by the library, and compared with plain SQL over the rows."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.models import docx, pptx, xlsx
from folioscope.operators import roundtrip
from folioscope.plans.relational import table
from folioscope.sources import corpus, opc, packages

QUERIES = {}
SQL: dict[str, str] = {}

#: Rows of a package that the queries write.
BLOCK = 500


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def workbooks(spark: SparkSession, d: str) -> DataFrame:
    """pkg, format, content: customers of a nation, ``BLOCK`` keys at a time, as a workbook of one sheet."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c_custkey")
        cells = []
        for i, r in enumerate(pdf.itertuples(), 1):
            cells += [(f"A{i}", "n", int(r.c_custkey)), (f"B{i}", "s", r.c_name), (f"C{i}", "n", float(r.c_acctbal)), (f"D{i}", "b", r.c_acctbal > 0), (f"E{i}", "f", f"a{i} * 2 + $c$1")]
        merged = f'<mergeCells count="1"><mergeCell ref="F1:G{len(pdf) + 1}"/></mergeCells>'
        content = xlsx.write({pdf["sheet"].iloc[0]: cells}, {pdf["sheet"].iloc[0]: merged}, {"first": f"'{pdf['sheet'].iloc[0]}'!$A$1"})
        return pd.DataFrame({"pkg": [pdf["pkg"].iloc[0]], "format": ["xlsx"], "content": [content]})

    rows = table(spark, d, "customer").withColumn("sheet", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    rows = rows.withColumn("pkg", F.concat_ws("-", "sheet", F.floor(F.col("c_custkey") / BLOCK).cast("string")))
    return rows.groupBy("pkg").applyInPandas(write, "pkg string, format string, content binary")


_BOOKS = f"""WITH rows AS (SELECT *, 'N' || c_nationkey AS sheet, 'N' || c_nationkey || '-' || (c_custkey // {BLOCK}) AS pkg FROM customer),
books AS (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY c_custkey) AS i FROM rows) """


@query(_BOOKS + """SELECT pkg, '/cells/' || sheet || '/A' || i || '/value' AS path, CAST(c_custkey AS DOUBLE) AS num, NULL AS str FROM books
UNION ALL SELECT pkg, '/cells/' || sheet || '/B' || i || '/value', NULL, c_name FROM books
UNION ALL SELECT pkg, '/cells/' || sheet || '/C' || i || '/value', c_acctbal, NULL FROM books
UNION ALL SELECT pkg, '/cells/' || sheet || '/D' || i || '/value', NULL, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END FROM books""")
def xlsx_cells_rt(spark, d):
    found = roundtrip.leaves(workbooks(spark, d), "^/cells/.*/value$").where("path IS NOT NULL")
    num = F.when(F.col("vtype") == "num", F.col("value").cast("double"))
    return found.select("pkg", "path", num.alias("num"), F.when(F.col("vtype") != "num", F.col("value")).alias("str"))


@query(_BOOKS + "SELECT pkg, '/formulas/' || sheet || '/E' || i || '/text' AS path, 'A' || i || '*2+$C$1' AS formula FROM books")
def xlsx_formula_rt(spark, d):
    return roundtrip.leaves(workbooks(spark, d), "^/formulas/").where("path IS NOT NULL").select("pkg", "path", F.col("value").alias("formula"))


@query(_BOOKS + "SELECT pkg, any_value(sheet) AS sheet, 'F1:G' || (count(*) + 1) AS merged, '''' || any_value(sheet) || '''!$A$1' AS name FROM books GROUP BY pkg")
def xlsx_merge_rt(spark, d):
    found = roundtrip.leaves(workbooks(spark, d), "^/merged_cells/|^/defined_names/first/formula$").where("path IS NOT NULL")
    split = F.split("path", "/")
    return found.groupBy("pkg").agg(
        F.max(F.when(F.col("feature") == "merged_cells", split[2])).alias("sheet"), F.max(F.when(F.col("feature") == "merged_cells", split[3])).alias("merged"), F.max(F.when(F.col("feature") == "defined_names", F.col("value"))).alias("name")
    )


@query(_BOOKS + "SELECT pkg, any_value(sheet) AS sheet, 'A' || (count(*) + 2) AS cell FROM books GROUP BY pkg")
def xlsx_edit_target(spark, d):
    found = roundtrip.targets(workbooks(spark, d))
    return found.select("pkg", F.get_json_object("target", "$.sheet").alias("sheet"), F.get_json_object("target", "$.cell").alias("cell"))


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """A document per row of documents: a paragraph per line."""

    def write(batches):
        for pdf in batches:
            made = [docx.write("".join(docx.paragraph_markup(x) for x in t.split("\n"))) for t in pdf["text"]]
            yield pd.DataFrame({"pkg": pdf["pkg"], "format": "docx", "content": made})

    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pkg"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(write, "pkg string, format string, content binary")


@query("""SELECT CAST(doc_id AS VARCHAR) AS pkg, '/body/' || (i - 1) || '/text' AS path, lines[i] AS text
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
def docx_paras_rt(spark, d):
    found = roundtrip.leaves(text_files(spark, d), "^/body/[0-9]+/text$").where("path IS NOT NULL")
    return found.select("pkg", "path", F.col("value").alias("text"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS pkg, '/body/0/rows/' || (i - 1) || '/cells/' || c || '/blocks/0/text' AS path, CASE c WHEN 0 THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation), (VALUES (0), (1)) AS v(c)""")
def docx_table_rt(spark, d):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [[r.n_name, str(r.n_nationkey)] for r in pdf.sort_values("n_nationkey").itertuples()]
        return pd.DataFrame({"pkg": [str(pdf["n_regionkey"].iloc[0])], "format": ["docx"], "content": [docx.write(docx.table_markup(rows))]})

    made = table(spark, d, "nation").groupBy("n_regionkey").applyInPandas(write, "pkg string, format string, content binary")
    return roundtrip.leaves(made, "/blocks/0/text$").where("path IS NOT NULL").select("pkg", "path", F.col("value").alias("text"))


def decks(spark: SparkSession, d: str) -> DataFrame:
    """A presentation per conversation, a slide per turn: a shape with the role and one with the text, a paragraph per line."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        slides = [pptx.text_shape(2, [r.role], (int(r.turn) * 100, 0, 1000, 500)) + pptx.text_shape(3, (r.text or "").split("\n")) for r in pdf.sort_values("turn").itertuples()]
        return pd.DataFrame({"pkg": [str(pdf["conv_id"].iloc[0])], "format": ["pptx"], "content": [pptx.write(slides)]})

    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return rows.groupBy("conv_id").applyInPandas(write, "pkg string, format string, content binary")


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS pkg, CAST(i AS BIGINT) AS slide, role, coalesce(text, '') AS text, CAST(turn * 100 AS BIGINT) AS x FROM t""")
def pptx_slides_rt(spark, d):
    found = roundtrip.leaves(decks(spark, d), "^/slides/[0-9]+/shapes/(0/geometry/x|[01]/paragraphs/[0-9]+/text)$").withColumn("s", F.split("path", "/"))
    end = F.concat_ws("/", F.slice("s", 4, 100))
    at = lambda wanted: F.max(F.when(end == wanted, F.col("value")))
    line = F.when(end.rlike("^shapes/1/paragraphs/[0-9]+/text$"), F.struct(F.col("s")[6].cast("int").alias("i"), "value"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["value"]), "\n")
    rows = found.where("s[1] = 'slides' AND size(s) > 4").groupBy("pkg", F.col("s")[2].cast("long").alias("slide"))
    return rows.agg(at("shapes/0/paragraphs/0/text").alias("role"), text.alias("text"), at("shapes/0/geometry/x").cast("long").alias("x"))


@query("SELECT CAST(conv_id AS VARCHAR) AS pkg, 1::BIGINT AS slide, 2::BIGINT AS shape_id FROM conversations GROUP BY conv_id")
def pptx_edit_target(spark, d):
    found = roundtrip.targets(decks(spark, d))
    return found.select("pkg", F.get_json_object("target", "$.slide").cast("long").alias("slide"), F.get_json_object("target", "$.shape_id").cast("long").alias("shape_id"))


# Package level.


@query(_BOOKS + "SELECT DISTINCT pkg, unnest(['[content_types].xml', '_rels/.rels', 'xl/workbook.xml', 'xl/_rels/workbook.xml.rels', 'xl/worksheets/sheet1.xml']) AS part FROM books")
def package_parts(spark, d):
    return packages.explode(workbooks(spark, d)).select("pkg", "part")


@query(_BOOKS + "SELECT DISTINCT pkg, r.source, r.kind, r.target FROM books, (VALUES ('', 'officeDocument', 'xl/workbook.xml'), ('xl/workbook.xml', 'worksheet', 'xl/worksheets/sheet1.xml')) AS r(source, kind, target)")
def package_rels(spark, d):
    return packages.relationships(workbooks(spark, d)).select("pkg", "source", "kind", "target")


#: What is done to a package before it is screened, and what the screening says.
DAMAGE = ["none", "ole", "cut", "macro", "encrypted", "no-main", "bad-xml", "duplicate-part"]
VERDICT = {"none": None, "ole": "encrypted-or-legacy", "cut": "corrupt", "macro": "macro-enabled", "encrypted": "encrypted", "no-main": "corrupt", "bad-xml": "corrupt", "duplicate-part": "corrupt"}


def damaged(content: bytes, how: str) -> bytes:
    if how == "ole":
        return opc.OLE_MAGIC + content
    if how == "cut":
        return content[: len(content) // 2]
    found = opc.read_package(content)
    parts = {found.members[k]: v for k, v in found.parts.items()}
    if how == "macro":
        parts["xl/vbaProject.bin"] = b"x"
    elif how == "encrypted":
        parts["EncryptionInfo"] = b"x"
    elif how == "no-main":
        parts.pop("xl/workbook.xml")
    elif how == "bad-xml":
        parts["xl/workbook.xml"] = b"<workbook>"
    elif how == "duplicate-part":
        parts["XL/WORKBOOK.xml"] = b"<x/>"
    return content if how == "none" else opc.write_package(parts)


_CASES = " WHEN ".join(f"{i} THEN {'NULL' if VERDICT[k] is None else repr(VERDICT[k])}" for i, k in enumerate(DAMAGE))


@query(_BOOKS + f"SELECT DISTINCT pkg, CASE c_nationkey % 8 WHEN {_CASES} END AS reason FROM books")
def package_screen(spark, d):
    def spoil(batches):
        for pdf in batches:
            how = [DAMAGE[int(p[1:].split("-")[0]) % 8] for p in pdf["pkg"]]
            yield pdf.assign(content=[damaged(c, h) for c, h in zip(pdf["content"], how)])

    files = workbooks(spark, d).mapInPandas(spoil, "pkg string, format string, content binary")
    return packages.screened(files)


@query(_BOOKS + "SELECT DISTINCT pkg, unnest(['merged-cells', 'formulas', 'defined-names']) AS label FROM books")
def package_labels(spark, d):
    return packages.labels(workbooks(spark, d))


def rich_texts(spark: SparkSession, d: str) -> DataFrame:
    """A document per part of parts, with what its size names: a table, a field, a second section, a header part, an image."""

    def write(batches):
        for pdf in batches:
            made = []
            for size, name in zip(pdf["p_size"], pdf["p_name"]):
                body, more = docx.paragraph_markup(name), {}
                if size % 2 == 0:
                    body += docx.table_markup([[name, str(size)]])
                if size % 3 == 0:
                    body += "<w:p><w:r><w:instrText> PAGE </w:instrText></w:r></w:p>"
                if size % 5 == 0:
                    body += "<w:p><w:pPr><w:sectPr/></w:pPr></w:p><w:sectPr/>"
                if size % 7 == 0:
                    more["word/header1.xml"] = f'<w:hdr xmlns:w="{docx.MAIN}"/>'
                if size % 11 == 0:
                    more["word/media/image1.PNG"] = "x"
                made.append(docx.write(body, more))
            yield pd.DataFrame({"pkg": pdf["pkg"], "format": "docx", "content": made})

    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("pkg"), "p_size", F.coalesce("p_name", F.lit("")).alias("p_name"))
    return rows.mapInPandas(write, "pkg string, format string, content binary")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pkg, label FROM part, (VALUES (2, 'tables'), (3, 'fields'), (5, 'sections'), (7, 'headers'), (11, 'images')) AS v(n, label) WHERE p_size % n = 0""")
def text_labels(spark, d):
    return packages.labels(rich_texts(spark, d))


@query(_BOOKS + "SELECT pkg, 5 AS parts, 'xl/workbook.xml' AS main_part, 0 AS problems FROM books GROUP BY pkg")
def package_inventory(spark, d):
    files = workbooks(spark, d)
    parts, rels = packages.explode(files), packages.relationships(files)
    found = packages.inventory(parts, rels).join(packages.problems(parts, rels), "pkg")
    return found.select("pkg", F.col("parts").cast("int").alias("parts"), "main_part", F.size("problems").alias("problems"))


# Round trips: the identity adapter misses the edit, the patch adapter makes it, the misplacing one
# makes it in another place, and the renaming one gives the edited part another name.

_EARLY = ("opened", "saved", "package-valid", "parts-preserved")
_PASSED = {
    "identity": (*_EARLY, "semantic-preserved"),
    "patch": (*_EARLY, "edit-applied", "content-preserved"),
    "misplacing": _EARLY,
    "renaming": (*_EARLY, "edit-applied", "content-preserved"),
    "broken": ("opened",),
}
_NAMES = ["opened", "saved", "package-valid", "edit-applied", "content-preserved", "parts-preserved", "semantic-preserved"]


def _checks(names: list[str], files: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS adapter, name, CASE WHEN name IN ({', '.join(map(repr, _PASSED[a]))}) THEN n ELSE 0 END AS passed, n AS files FROM (SELECT unnest({_NAMES}) AS name), ({files}) AS f" for a in names
    )


_N_BOOKS = f"SELECT count(DISTINCT (c_nationkey, c_custkey // {BLOCK})) AS n FROM customer"
_N_TEXTS = "SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '\\S')"
_N_DECKS = "SELECT count(DISTINCT conv_id) AS n FROM conversations"


def passed(trial: roundtrip.Trial) -> DataFrame:
    rows = roundtrip.checks_of(trial).where("outcome <> 'unscored'")
    return rows.groupBy("adapter", "name").agg(F.count_if(F.col("outcome") == "success").alias("passed"), F.count("*").alias("files"))


@query(_checks(list(_PASSED), _N_BOOKS))
def roundtrip_checks(spark, d):
    return passed(roundtrip.Trial(workbooks(spark, d), list(_PASSED)))


@query(_checks(["patch", "misplacing"], _N_TEXTS))
def roundtrip_texts(spark, d):
    return passed(roundtrip.Trial(text_files(spark, d), ["patch", "misplacing"]))


@query(_checks(["patch", "misplacing"], _N_DECKS))
def roundtrip_decks(spark, d):
    return passed(roundtrip.Trial(decks(spark, d), ["patch", "misplacing"]))


@query(_BOOKS + """, n AS (SELECT count(DISTINCT pkg) AS n FROM books)
SELECT adapter, feature, CASE WHEN adapter = 'identity' AND feature = 'cells' THEN 0 ELSE n END AS preserved, n AS present, CASE WHEN adapter = 'identity' AND feature = 'cells' THEN 0.0 ELSE 1.0 END::DOUBLE AS rate
FROM n, (SELECT unnest(['identity', 'patch']) AS adapter), (SELECT unnest(['workbook', 'defined_names', 'cells', 'formulas', 'cell_styles', 'merged_cells', 'external_links']) AS feature)""")
def roundtrip_features(spark, d):
    return roundtrip.preservation(roundtrip.Trial(workbooks(spark, d), ["identity", "patch"]))


@query("""WITH n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations)
SELECT 'identity' AS adapter, feature, CASE WHEN feature = 'text' THEN 0 ELSE n END AS preserved, n AS present, CASE WHEN feature = 'text' THEN 0.0 ELSE 1.0 END::DOUBLE AS rate
FROM n, (SELECT unnest(['slide-size', 'slides', 'shapes', 'geometry', 'text', 'text-format']) AS feature)""")
def roundtrip_deck_features(spark, d):
    return roundtrip.preservation(roundtrip.Trial(decks(spark, d), ["identity"]))


@query(_BOOKS + """SELECT DISTINCT 'renaming' AS adapter, pkg, method, CASE method WHEN 'name' THEN 4 ELSE 1 END AS parts, 0 AS missing, 0 AS added
FROM books, (VALUES ('name'), ('path')) AS v(method)""")
def roundtrip_parts(spark, d):
    trial = roundtrip.Trial(workbooks(spark, d), ["renaming"])
    return trial.scores.select("adapter", "pkg", F.explode("matched").alias("method", "parts"), F.size("missing").alias("missing"), "added")


@query(_BOOKS + """SELECT DISTINCT adapter, pkg, outcome, reason FROM books, (VALUES ('patch', 'success', NULL), ('identity', 'failure', 'failed: edit-applied, content-preserved'),
('broken', 'error', 'the adapter failed to save')) AS v(adapter, outcome, reason)""")
def roundtrip_results(spark, d):
    return roundtrip.results(roundtrip.Trial(workbooks(spark, d), ["patch", "identity", "broken"])).select("adapter", "pkg", "outcome", "reason")


@query(_BOOKS + f"""SELECT 'identity' AS adapter, n AS files_total, 0 AS no_edit_target, 0 AS success, n AS failure, 0 AS error, 0 AS timeout, n AS content_files, 0 AS edit_applied,
0 AS content_preserved, 0 AS default_style_files, 0 AS unlike_parts, 5 * n AS compared_parts FROM ({_N_BOOKS}) AS f""")
def roundtrip_summary(spark, d):
    return roundtrip.summary(roundtrip.Trial(workbooks(spark, d), ["identity"])).drop("median_ms")


@query(_BOOKS + """SELECT 'identity' AS adapter, 'xlsx' AS format, 'cells' AS feature, count(DISTINCT pkg) AS diff_count, 3 AS rank FROM books
UNION ALL SELECT 'misplacing', 'xlsx', 'cells', 2 * count(DISTINCT pkg), 3 FROM books""")
def roundtrip_feature_counts(spark, d):
    return roundtrip.feature_counts(roundtrip.Trial(workbooks(spark, d), ["identity", "patch", "misplacing"]))


@query("SELECT CAST(doc_id AS VARCHAR) AS pkg, 'body' AS feature, '/body/0' AS path, 'added' AS kind FROM documents")
def inserted_paragraph(spark, d):
    """A paragraph put before all others is one difference, as lists are aligned."""

    def write(batches):
        for pdf in batches:
            marked = [[docx.paragraph_markup(x) for x in t.split("\n")] for t in pdf["text"]]
            before, after = [docx.write("".join(m)) for m in marked], [docx.write("".join([docx.paragraph_markup("put before the rest"), *m])) for m in marked]
            yield pd.DataFrame({"pkg": pdf["pkg"], "format": "docx", "before": before, "after": after})

    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pkg"), F.coalesce("text", F.lit("")).alias("text"))
    return roundtrip.model_differences(rows.mapInPandas(write, "pkg string, format string, before binary, after binary"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS pkg, 'columns' AS feature, '/columns/S/' || chr(66 + n_nationkey) || ':' || chr(66 + n_nationkey) || '/width' AS path, 'changed' AS kind
FROM nation WHERE n_nationkey < 24""")
def recut_columns(spark, d):
    """Runs of columns that are cut differently differ only where a column does: here the one that is wider."""

    def book(first: list[tuple[int, int, float]]) -> bytes:
        cols = "".join(f'<col min="{a}" max="{b}" width="{w}" customWidth="1"/>' for a, b, w in first)
        made = opc.read_package(xlsx.write({"S": [("A1", "n", 1)]}))
        parts = {made.members[k]: v.replace(b"<sheetData>", f"<cols>{cols}</cols><sheetData>".encode()) for k, v in made.parts.items()}
        return opc.write_package(parts)

    def write(batches):
        for pdf in batches:
            before = [book([(1, 30, 9.0)]) for _ in pdf["n"]]
            after = [book([(1, n + 1, 9.05), (n + 2, n + 2, 12.0), (n + 3, 30, 9.0)]) for n in pdf["n"]]
            yield pd.DataFrame({"pkg": pdf["n"].astype(str), "format": "xlsx", "before": before, "after": after})

    rows = table(spark, d, "nation").where("n_nationkey < 24").select(F.col("n_nationkey").cast("long").alias("n"))
    return roundtrip.model_differences(rows.mapInPandas(write, "pkg string, format string, before binary, after binary"))


# Files of a corpus.


@query("SELECT sha256(text) AS digest, lang AS format, source, 'd' || doc_id || '.txt' AS name FROM documents")
def holdout_rows(spark, d):
    line = F.concat(F.sha2(F.col("text").cast("binary"), 256), F.lit("  corpus/"), "lang", F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return corpus.holdout_rows(table(spark, d, "documents").select(line.alias("value")))


@query("""SELECT user_id, event_type AS event, event_id, round(value, 2) AS elapsed_ms FROM events WHERE event_id % 4 <> 1""")
def child_events(spark, d):
    line = F.when(F.col("event_id") % 4 == 1, F.lit("not a { line")).otherwise(F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("message"), F.round("value", 2).alias("elapsed_ms"))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n")
    output = table(spark, d, "events").groupBy("user_id").agg(text.alias("out"))
    return corpus.child_events(output, ["user_id"], "out").select("user_id", "event", F.col("message").cast("long").alias("event_id"), "elapsed_ms")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS archive, 'nations/' || n_name || '.txt' AS path, strlen(n_name) + 1 AS size FROM nation")
def archive_members(spark, d):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        if int(pdf["n_regionkey"].iloc[0]) % 2:
            with tarfile.open(fileobj=out, mode="w:gz") as t:
                for r in pdf.itertuples():
                    info = tarfile.TarInfo(f"top/nations/{r.n_name}.txt")
                    info.size = len(r.n_name) + 1
                    t.addfile(info, io.BytesIO(r.n_name.encode() + b"\n"))
        else:
            with zipfile.ZipFile(out, "w") as z:
                for r in pdf.itertuples():
                    z.writestr(f"top/nations/{r.n_name}.txt", r.n_name + "\n")
        return pd.DataFrame({"archive": [str(pdf["n_regionkey"].iloc[0])], "content": [out.getvalue()]})

    made = table(spark, d, "nation").groupBy("n_regionkey").applyInPandas(write, "archive string, content binary")
    return corpus.unpack(made, strip=1).select("archive", "path", "size")
