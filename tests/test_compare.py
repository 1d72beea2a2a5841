"""Differences of models, matching of packages' parts, feature rules and looks of cells."""

import random
import re
from re import _parser as grammar

import pytest

from folioscope.functions import features
from folioscope.models import compare, docx, pptx, sheet_styles, xlsx
from folioscope.models.xlsx import ET
from folioscope.operators import roundtrip
from folioscope.sources import opc, pairing


def found(kind, before, after):
    return [(d.feature, d.path, d.kind) for d in compare.differences(kind, before, after)]


def paragraphs(*texts):
    return {"body": [{"type": "paragraph", "runs": [{"text": t, "format": {"size": 10.0}}], "text": t} for t in texts]}


def test_lists_of_documents_are_aligned():
    many = [f"line {i}" for i in range(50)]
    assert found("docx", paragraphs(*many), paragraphs("first", *many)) == [("body", "/body/0", "added")]
    assert found("docx", paragraphs(*many), paragraphs(*many[:20], *many[21:])) == [("body", "/body/20", "missing")]
    changed = found("docx", paragraphs("a", "b", "c"), paragraphs("a", "x", "c"))
    assert changed == [("body", "/body/1/runs/0/text", "changed"), ("body", "/body/1/text", "changed")]


def test_values_of_two_kinds_differ():
    cell = lambda kind, value: {"cells": {"S": {"A1": {"type": kind, "value": value}}}}
    assert found("xlsx", cell("s", "true"), cell("b", True)) == [("cells", "/cells/S/A1/type", "changed"), ("cells", "/cells/S/A1/value", "changed")]
    assert found("xlsx", cell("n", float("nan")), cell("n", float("nan"))) == [("cells", "/cells/S/A1/value", "changed")]
    assert found("docx", {"body": [1]}, {"body": [True]}) == [("body", "/body/0", "changed")]


def test_columns_are_cut_alike_and_rules_pair_within_tolerance():
    before, after = {"columns": {"S": {"A:F": {"width": 9.0}}}}, {"columns": {"S": {"A:B": {"width": 9.05}, "C:C": {"width": 30.0}, "D:F": {"width": 9.0}}}}
    assert found("xlsx", before, after) == [("columns", "/columns/S/C:C/width", "changed")]
    rule = lambda tint: {"style": {"fill": {"color": f"FF0000~tint:{tint}"}}}
    named = lambda tint: {"data_validations": {"S": {xlsx.key_of(rule(tint)): rule(tint)}}}
    assert not found("xlsx", named(0.1), named(0.1005)) and len(found("xlsx", named(0.1), named(0.3))) == 2


def test_cells_of_formulas_are_cached_values():
    model = lambda v: {"formulas": {"S": {"A1": {"text": "1+1"}}}, "cells": {"S": {"A1": {"type": "n", "value": v}, "B1": {"type": "n", "value": v}}}}
    assert found("xlsx", model(2.0), model(3.0)) == [("formula_cached_values", "/cells/S/A1/value", "changed"), ("cells", "/cells/S/B1/value", "changed")]
    assert "formula_cached_values" in compare.features_present("xlsx", model(2.0))


def deck(shape=None, **slide):
    return {"slide-size": {"cx": 9144000, "cy": 6858000}, "slides": [{"hidden": False, "shapes": [shape or {}], **slide}]}


@pytest.mark.parametrize(
    "before, after, same",
    [
        ({"geometry": {"x": 100}}, {"geometry": {"x": 6450}}, True), ({"geometry": {"x": 100}}, {"geometry": {"x": 6451}}, False), ({"geometry": {"rot": 10}}, {"geometry": {"rot": 21599990}}, True),
        ({"geometry": {"rot": 0}}, {"geometry": {"rot": 2400}}, False), ({"fill": {"color": "102030~"}}, {"fill": {"color": "112030"}}, True), ({"fill": {"color": "102030"}}, {"fill": {"color": "112030"}}, False),
        ({"fill": {"color": "102030~"}}, {"fill": {"color": "122030"}}, False), ({"fill": {"color": "102030~/a50"}}, {"fill": {"color": "102030~/a50.1"}}, True),
    ],
)
def test_tolerances_of_decks(before, after, same):
    assert (not found("pptx", deck(before), deck(after))) == same


def test_features_of_decks():
    shape = lambda **k: {"kind": "sp", "name": "n", "alt_text": None, **k}
    group = lambda **k: shape(kind="grpSp", children=[shape(**k)])
    get = lambda a, b: {f for f, _, _ in found("pptx", deck(a), deck(b))}
    assert get(group(name="a"), group(name="b")) == {"shapes"}
    text = lambda **k: shape(paragraphs=[{"level": 0, "align": "l", "bullet": None, "runs": [{"text": "t"}], **k}])
    assert get(text(level=0), text(level=1)) == get(text(align="l"), text(align="r")) == get(text(bullet=None), text(bullet="x")) == {"text-format"}
    assert get(shape(fill={"kind": "none"}), shape(fill={"kind": "solid"})) == {"fill-line"} and get(shape(hidden=True), shape(hidden=False)) == {"shapes"}
    assert {f for f, _, _ in found("pptx", deck(hidden=True), deck())} == {"slide-hidden"}


@pytest.mark.parametrize("kind, content", [("xlsx", xlsx.write({"S": [("A1", "n", 1), ("B7", "s", "x")]})), ("docx", docx.write(docx.paragraph_markup("one") + docx.paragraph_markup("two"))), ("pptx", pptx.write([pptx.text_shape(2, ["one", "two"])]))])
def test_the_edit_has_to_be_at_its_place(kind, content):
    module = roundtrip.MODELS[kind]
    place = module.edit_target(content)
    score = lambda adapter: roundtrip.scored(kind, content, roundtrip.ADAPTERS[adapter](kind, content, place), roundtrip.json.dumps(place))
    patched, misplaced, renamed = score("patch"), score("misplacing"), score("renaming")
    assert patched[8] and patched[11] == [] and renamed[8] and renamed[11] == []
    assert misplaced[8] is None and misplaced[11]
    assert dict(renamed[2])["path"] == 1 and renamed[3] == [] and renamed[0] == []


def test_moved_edits_count_on_their_slide_only():
    want = deck({"paragraphs": [{"runs": [{"text": "MARK"}]}]})
    moved = deck()
    moved["slides"][0]["shapes"] = [{}, {"paragraphs": [{"runs": [{"text": "MA"}, {"text": compare.OBJECT + "RK"}]}]}]
    other = deck()
    other["slides"].append(moved["slides"][0])
    assert compare.edit_found("pptx", want, moved, {"slide": 1}, "MARK") == "/slides/0/shapes/1/paragraphs/0"
    assert compare.edit_found("pptx", want, other, {"slide": 1}, "MARK") is None


# Packages.


def package(**parts):
    made = opc.read_package(xlsx.write({"S": [("A1", "n", 1)]}))
    return pairing.Parts(made.parts | {k.replace("__", "/").replace("_DOT_", "."): v for k, v in parts.items()})


def test_relationships_follow_their_part():
    rels = b'<Relationships xmlns="x"><Relationship Id="r1" Type="t/drawing" Target="../d/a.xml"/></Relationships>'
    a = opc.read_package(xlsx.write({"S": [("A1", "n", 1)]})).parts | {"xl/worksheets/_rels/sheet1.xml.rels": rels, "xl/d/a.xml": b"<d/>"}
    b = {k.replace("sheet1", "page9"): v.replace(b"sheet1", b"page9") for k, v in a.items()}
    before, after = pairing.Parts(a), pairing.Parts(b)
    mapping = pairing.mapped(before, after)
    assert mapping["xl/worksheets/sheet1.xml"] == ("xl/worksheets/page9.xml", "path")
    assert mapping["xl/worksheets/_rels/sheet1.xml.rels"] == ("xl/worksheets/_rels/page9.xml.rels", "owner")
    assert set(mapping) == set(a) and pairing.unlike(before, after, mapping) == []
    b["xl/d/a.xml"] = b"<d x='1'/>"
    assert pairing.unlike(before, pairing.Parts(b), mapping) == ["xl/d/a.xml"]


def test_parts_with_equal_bytes_map_in_name_order():
    more = lambda *names: pairing.Parts(opc.read_package(xlsx.write({"S": []})).parts | {n: b"same" for n in names})
    mapping = pairing.mapped(more("a/1.bin", "a/2.bin", "a/3.bin"), more("b/8.bin", "b/9.bin"))
    assert mapping["a/1.bin"] == ("b/8.bin", "digest") and mapping["a/2.bin"] == ("b/9.bin", "digest") and "a/3.bin" not in mapping


def test_problems_of_packages():
    assert package().problems() == [] and package().main() == "xl/workbook.xml"
    assert package(odd="x").problems() == ["no content type: odd"]
    assert pairing.Parts({"a.xml": b"<a/>"}).problems() == ["missing content types", "no content type: a.xml", "no relationships of the package"]


def test_only_properties_have_volatile_elements():
    a, b = b"<x><modified>1</modified></x>", b"<x><modified>2</modified></x>"
    assert opc.canonical(a, part="docprops/core.xml") == opc.canonical(b, part="docprops/core.xml") and opc.canonical(a, part="xl/x.xml") != opc.canonical(b, part="xl/x.xml")


def test_prefix_lists_stand_for_namespaces():
    mc = "http://schemas.openxmlformats.org/markup-compatibility/2006"
    one = f'<a xmlns:mc="{mc}" xmlns:p="u:1" xmlns:q="u:2" mc:Ignorable="p q"/>'.encode()
    two = f'<a xmlns:m="{mc}" xmlns:x="u:2" xmlns:y="u:1" m:Ignorable="x  y"/>'.encode()
    assert opc.canonical(one) == opc.canonical(two) != opc.canonical(two.replace(b"x  y", b"x"))


# Feature rules: an example of each pattern is found, in its format only.


def example(pattern, rng):
    """A text that a regular expression matches."""

    def made(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += " "
            elif name == "IN":
                first, value = arg[0]
                out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(value[0]), "CATEGORY": lambda: "1" if "DIGIT" in str(value) else " " if "SPACE" in str(value) else "w", "NEGATE": lambda: " "}[str(first)]()
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += made(arg[2]) * max(arg[0], min(arg[1], rng.randrange(2)))
            elif name == "SUBPATTERN":
                out += made(arg[3])
            elif name == "BRANCH":
                out += made(rng.choice(arg[1]))
        return out

    return made(grammar.parse(pattern))


RULES = [(kind, *rule) for kind in features.COUNTED for rule in features.rules(kind)]


def test_numbers_of_rules():
    listed = lambda rules: sum(len(text.strip().splitlines()) for text in rules.values())
    assert (listed(features.PART_RULES), listed(features.CONTENT_RULES)) == (46, 45)


@pytest.mark.parametrize("kind, feature, name, content", RULES)
def test_each_rule_finds_its_feature(kind, feature, name, content):
    rng = random.Random(5)
    for _ in range(4):
        part = example(name.pattern, rng)
        assert name.search(part)
        tries = (example(content.pattern.decode(), rng).encode() + b" " for _ in range(50)) if content else iter([b""])
        data = next(d for d in tries if content is None or content.search(d))  # an example may miss a word's end
        assert feature in features.of_package(kind, {part: data}) and feature not in features.of_package(kind, {"other/" + part[:2]: data})


def test_counted_features():
    assert features.of_package("xlsx", {"xl/worksheets/sheet1.xml": b"", "xl/worksheets/sheet2.xml": b""}) == ["multiple-sheets"]
    assert features.of_package("docx", {"word/document.xml": b"<w:sectPr/><w:sectPr/>"}) == ["sections"] and features.of_package("docx", {"word/document.xml": b"<w:sectPr/>"}) == []
    assert "multiple-masters" in features.of_package("pptx", {"ppt/slidemasters/slidemaster1.xml": b"", "ppt/slidemasters/slidemaster2.xml": b""})


# Looks of cells.


def styles(body):
    return sheet_styles.Styles(ET.fromstring(f"<styleSheet>{body}</styleSheet>"))


@pytest.mark.parametrize(
    "markup, want",
    [
        ('<c rgb="ff112233"/>', "112233"), ('<c rgb="AABBCC"/>', "AABBCC"), ('<c theme="4" tint="-0.25"/>', "theme:4~tint:-0.25"), ('<c indexed="2"/>', "FF0000"), ('<c indexed="64"/>', None),
        ('<c indexed="65"/>', "system-background"), ('<c indexed="99"/>', "indexed:99"), ('<c auto="1" rgb="FF000000"/>', None), ("<c/>", None), ('<c indexed="1"/>', "0A0B0C"),
    ],
)
def test_colours_of_cells(markup, want):
    palette = '<colors><indexedColors><rgbColor rgb="00000000"/><rgbColor rgb="000A0B0C"/></indexedColors></colors>'
    assert styles(palette).color(ET.fromstring(markup)) == want


@pytest.mark.parametrize("code, want", [(r"0\-0", "0-0"), (r"\a0", r"\a0"), (r'"a\-b"\ 0', r'"a\-b" 0'), ("0.00", "0.00"), ("\\", "\\")])
def test_escapes_in_number_formats(code, want):
    assert sheet_styles.number_format(code) == want


def test_what_is_not_given_has_its_default():
    one = styles('<fonts><font><b/></font></fonts><fills><fill><patternFill patternType="none"/></fill></fills><borders><border/></borders><cellXfs><xf numFmtId="9" fontId="0" fillId="0" borderId="0"/><xf fontId="5"/></cellXfs>')
    two = styles('<fonts><font><b val="1"/><u val="none"/><strike val="0"/></font></fonts><fills><fill/></fills><borders><border><left style="none"/><top/></border></borders><cellXfs><xf numFmtId="9"><alignment vertical="bottom"/><protection locked="1"/></xf></cellXfs>')
    assert one.cell(0) == two.cell(0) and one.cell(0)["number_format"] == "0%" and one.cell(0)["font"]["bold"]
    assert one.cell(1)["font"] == "invalid:5" and one.cell(7) == {"invalid_xf": 7} and styles("").cell(0)["fill"] == {"pattern": "none"}


def test_looks_of_rules_have_what_is_given():
    s = styles('<dxfs><dxf><font><i/></font><fill><patternFill><bgColor rgb="FF00FF00"/></patternFill></fill><border><left/><top style="thin"/></border><numFmt numFmtId="10"/></dxf></dxfs>')
    assert s.rule_at(0) == {"font": {"italic": True}, "fill": {"pattern": "solid", "color": "00FF00"}, "border": {"top": {"style": "thin", "color": None}}, "number_format": "0.00%"}
    assert s.rule_at(1) == s.rule_at(None) == {}


def test_dumps_leave_defaults_out():
    bar = ET.fromstring('<dataBar minLength="10" showValue="false"><cfvo type="min" val="3"/><cfvo type="num" val="3" gte="true"/><color rgb="FFFF0000"/></dataBar>')
    assert styles("").dump(bar) == {"tag": "dataBar", "attrs": {"showValue": "0"}, "children": [{"tag": "cfvo", "attrs": {"type": "min"}}, {"tag": "cfvo", "attrs": {"type": "num", "val": "3"}}, {"tag": "color", "color": "FF0000"}]}


def styled_book(sheet, after="", before=""):
    made = opc.read_package(xlsx.write({"S": []}))
    parts = {made.members[k]: v.decode() for k, v in made.parts.items()}
    look = '<styleSheet><fonts><font/></fonts><fills><fill/></fills><borders><border/><border><top style="thin"/><left style="thin"/></border><border><top style="thin"/></border></borders><cellXfs><xf/><xf borderId="1"/><xf borderId="2"/></cellXfs></styleSheet>'
    parts["xl/styles.xml"] = look
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace("</Relationships>", f'<Relationship Id="rs" Type="{xlsx.REL}/styles" Target="styles.xml"/></Relationships>')
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace("<sheetData></sheetData>", f"{before}<sheetData>{sheet}</sheetData>{after}")
    return xlsx.extract(opc.write_package(parts))


def test_merged_areas_show_their_edge():
    model = styled_book('<row r="1"><c r="A1" s="1"/><c r="B1" s="2"/><c r="C1" s="2"/></row><row r="2"><c r="A2" s="1"/><c r="B2" s="1"/></row>', '<mergeCells><mergeCell ref="A1:B2"/></mergeCells>')
    own = model["cell_styles"]["S"]
    thin = {"style": "thin", "color": None}
    assert set(own) == {"A1", "C1"} and own["A1"]["border"] == {"top": thin, "left": thin, "right": {"style": "none"}, "bottom": {"style": "none"}}
    uneven = styled_book('<row r="1"><c r="A1" s="1"/></row>', '<mergeCells><mergeCell ref="A1:B1"/></mergeCells>')["cell_styles"]["S"]["A1"]["border"]
    assert uneven["top"] == [thin, {"style": "none"}] and uneven["left"] == thin


def test_rows_and_columns_have_defaults_and_looks():
    model = styled_book('<row r="3" s="1" customFormat="1"><c r="A3" s="1"/><c r="B3" s="0"/></row>', before='<sheetFormatPr customHeight="1" defaultRowHeight="30" zeroHeight="1"/><cols><col min="2" max="3" width="8" style="2" collapsed="1"/></cols>')
    assert model["rows"]["S"]["_default"] == {"height": 30.0, "hidden": True} and set(model["rows"]["S"]["3"]) == {"style"}
    assert set(model["columns"]["S"]["B:C"]) == {"width", "collapsed", "style"} and set(model["cell_styles"]["S"]) == {"B3"}


def test_extended_rules_belong_to_the_plain_ones():
    plain = '<conditionalFormatting sqref="A1"><cfRule type="dataBar" priority="2"><dataBar/><extLst><ext><id>{x}</id></ext></extLst></cfRule></conditionalFormatting>'
    rule = lambda name, n: f'<conditionalFormatting><cfRule type="dataBar" id="{name}" priority="{n}"><dataBar minLength="0"/></cfRule><sqref>B1 B2</sqref></conditionalFormatting>'
    extended = f"<extLst><ext><conditionalFormattings>{rule('{x}', 9)}{rule('{y}', 1)}</conditionalFormattings></ext></extLst>"
    rules = styled_book("", plain + extended)["conditional_formats"]["S"]
    assert [(r["refs"], r["rank"], "extended" in r) for r in rules] == [("B1:B2", 1, False), ("A1", 2, True)]
    assert re.search("minLength", str(rules[1]["extended"]))


# Lists, links, areas and numbers.


def test_areas_and_sheets():
    from folioscope.functions import sheets

    assert sheets.areas("'a,b'!$A$1,Sheet1!B2:C3 , f(x,y)") == ["'a,b'!$A$1", "Sheet1!B2:C3", "f(x,y)"] and sheets.areas("") == []
    assert [sheets.without_sheet(a) for a in ("'it''s!x'!A1", "S!B2", "C3")] == ["A1", "B2", "C3"]
    assert [sheets.canonical_number(x) for x in ("1", "1.0", "1E0", "0.1", "x", " inf ", None, "1e15")] == ["1", "1", "1", "0.1", "x", "inf", None, "1000000000000000.0"]


def numbered(paragraph, numbering, styles=""):
    parts = {"word/numbering.xml": f'<w:numbering xmlns:w="{docx.MAIN}">{numbering}</w:numbering>', "word/styles.xml": f'<w:styles xmlns:w="{docx.MAIN}">{styles}</w:styles>'}
    rels = '<Relationship Id="n" Type="x/numbering" Target="numbering.xml"/><Relationship Id="s" Type="x/styles" Target="styles.xml"/>'
    return docx.extract(docx.write(f"<w:p><w:pPr>{paragraph}</w:pPr></w:p>", parts, rels))["body"][0]["numbering"]


ABSTRACT = '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/><w:lvlText w:val="\uf0b7"/></w:lvl></w:abstractNum>'


def test_lists_by_style_override_and_link():
    own = lambda n, level=0: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>'
    plain = ABSTRACT + '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>'
    one = numbered(own(1), plain)
    assert (one["level"], one["format"], one["text"]) == (0, "decimal", "%1.") and numbered(own(1, 1), plain)["text"] == "•" and numbered(own(0), plain) is None and numbered(own(9), plain) is None
    by_style = numbered('<w:pStyle w:val="L"/>', plain, f'<w:style w:styleId="B"><w:pPr>{own(1, 1)}</w:pPr></w:style><w:style w:styleId="L"><w:basedOn w:val="B"/></w:style>')
    assert by_style == numbered(own(1, 1), plain)
    changed = plain.replace('<w:abstractNumId w:val="7"/></w:num>', '<w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num>')
    assert numbered(own(1), changed)["definition"] != one["definition"]
    linked = plain + '<w:abstractNum w:abstractNumId="8"><w:numStyleLink w:val="S"/></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num>'
    assert numbered(own(2), linked, '<w:style w:styleId="S"><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style>') == one


def test_links_of_slides():
    run = lambda text, i, more="": f'<a:r><a:rPr><a:hlinkClick r:id="{i}"{more}/></a:rPr><a:t>{text}</a:t></a:r>'
    shape = f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="x"/></p:nvSpPr><p:txBody><a:p>{run("one ", "r1")}{run("two", "r1")}<a:r><a:t>gap</a:t></a:r>{run("three", "r2")}</a:p><a:p>{run("four", "r3", " action=&quot;jump&quot;".replace("&quot;", chr(34)))}</a:p></p:txBody></p:sp>'
    made = opc.read_package(pptx.write([shape, pptx.text_shape(2, ["x"])]))
    parts = {made.members[k]: v for k, v in made.parts.items()}
    rel = lambda i, target, more: f'<Relationship Id="{i}" Type="x/hyperlink" Target="{target}"{more}/>'
    outside = ' TargetMode="External"'
    parts["ppt/slides/_rels/slide1.xml.rels"] = f'<Relationships>{rel("r1", "http://a/%C3%A9", outside)}{rel("r2", "file:///c:" + chr(92) + "x", outside)}{rel("r3", "slide2.xml", "")}</Relationships>'
    links = pptx.extract(opc.write_package(parts))["slides"][0]["hyperlinks"]
    assert links == [{"text": "one two", "target": "http://a/é"}, {"text": "three", "target": "file:///c:/x"}, {"text": "four", "target": "jump|slide:2"}]


def test_adapters_by_name():
    assert roundtrip.chosen(["patch", "identity", "patch"]) == ["patch", "identity"] and roundtrip.chosen(["all"]) == list(roundtrip.ADAPTERS)
    with pytest.raises(ValueError, match="odd"):
        roundtrip.chosen(["patch", "odd"])


def test_runs_are_written_once(spark, tmp_path):
    files = spark.createDataFrame([("b", "xlsx", bytearray(xlsx.write({"S": [("A1", "n", 1)]})))], "pkg string, format string, content binary")
    trial = roundtrip.Trial(files, ["patch"])
    roundtrip.write_run(trial, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/results.parquet")).first().outcome == "success" and roundtrip.default_style_files(trial).first().files == []
    with pytest.raises(Exception, match="already exists"):
        roundtrip.write_run(trial, str(tmp_path / "run"))


def test_tables_style_their_paragraphs_and_cells():
    style = '<w:style w:styleId="T"><w:pPr><w:jc w:val="center"/></w:pPr><w:rPr><w:b/></w:rPr><w:tblPr><w:tblBorders><w:top w:val="single" w:sz="4"/><w:insideH w:val="dotted"/><w:bottom w:val="nil"/></w:tblBorders></w:tblPr></w:style><w:style w:styleId="P"><w:pPr><w:jc w:val="right"/></w:pPr></w:style>'
    rels = '<Relationship Id="s" Type="x/styles" Target="styles.xml"/>'
    cell = lambda inside, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{inside}</w:tc>"
    plain, styled = docx.paragraph_markup("a"), '<w:p><w:pPr><w:pStyle w:val="P"/></w:pPr></w:p>'
    own = '<w:tcBorders><w:left w:val="double" w:color="FF0000"/></w:tcBorders>'
    body = f'<w:tbl><w:tblPr><w:tblStyle w:val="T"/></w:tblPr><w:tr>{cell(plain)}</w:tr><w:tr>{cell(styled, own)}</w:tr></w:tbl>{plain}'
    table, after = docx.extract(docx.write(body, {"word/styles.xml": f'<w:styles xmlns:w="{docx.MAIN}">{style}</w:styles>'}, rels))["body"]
    one, two = (r["cells"][0] for r in table["rows"])
    assert one["blocks"][0]["props"]["alignment"] == "center" and one["blocks"][0]["runs"][0]["format"]["b"] and two["blocks"][0]["props"]["alignment"] == "right"
    assert after["props"]["alignment"] == "left" and "b" not in after["runs"][0]["format"]
    assert one["borders"] == {"top": {"style": "single", "size": 4, "color": "auto"}, "bottom": {"style": "dotted", "size": 0, "color": "auto"}}
    assert two["borders"] == {"top": {"style": "dotted", "size": 0, "color": "auto"}, "left": {"style": "double", "size": 0, "color": "FF0000"}}


def test_levels_of_lists_indent_their_paragraphs():
    numbering = '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:pPr><w:ind w:left="720" w:right="9"/></w:pPr></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>'
    parts = {"word/numbering.xml": f'<w:numbering xmlns:w="{docx.MAIN}">{numbering}</w:numbering>'}
    p = '<w:p><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr><w:ind w:right="5"/></w:pPr></w:p>'
    shown = docx.extract(docx.write(p, parts, '<Relationship Id="n" Type="x/numbering" Target="numbering.xml"/>'))["body"][0]["props"]["indent"]
    assert (shown["left"], shown["right"]) == (720, 5)


def themed(shapes, layout="", master="", theme="", presentation=""):
    """A presentation's only slide, with a layout, a master and a theme."""
    made = opc.read_package(pptx.write([shapes]))
    parts = {made.members[k]: v for k, v in made.parts.items()}
    ns = f'xmlns:p="{pptx.P}" xmlns:a="{pptx.A}"'
    rels = lambda kind, target: f'<Relationships><Relationship Id="r0" Type="x/{kind}" Target="{target}"/></Relationships>'
    tree = lambda body: f"<p:cSld><p:spTree>{body}</p:spTree></p:cSld>"
    scheme = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in {"dk1": "101010", "lt1": "F0F0F0", "accent1": "336699"}.items())
    parts |= {
        "ppt/slides/_rels/slide1.xml.rels": rels("slideLayout", "../l.xml"), "ppt/l.xml": f"<p:sldLayout {ns}>{tree(layout)}</p:sldLayout>", "ppt/_rels/l.xml.rels": rels("slideMaster", "m.xml"),
        "ppt/m.xml": f'<p:sldMaster {ns}>{tree(master)}<p:clrMap bg1="dk1" tx1="lt1"/></p:sldMaster>', "ppt/_rels/m.xml.rels": rels("theme", "t.xml"),
        "ppt/t.xml": f"<a:theme {ns}><a:themeElements><a:clrScheme>{scheme}</a:clrScheme>{theme}</a:themeElements></a:theme>",
    }
    parts["ppt/presentation.xml"] = parts["ppt/presentation.xml"].replace(b"<p:sldSz", presentation.encode() + b"<p:sldSz")
    return pptx.extract(opc.write_package(parts))["slides"][0]


_OWN = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
FORMATS = (
    f'<a:fmtScheme><a:fillStyleLst>{_OWN}<a:solidFill><a:schemeClr val="phClr"><a:shade val="50000"/></a:schemeClr></a:solidFill></a:fillStyleLst>'
    f'<a:lnStyleLst><a:ln w="6350">{_OWN}<a:prstDash val="dot"/></a:ln></a:lnStyleLst><a:bgFillStyleLst>{_OWN}</a:bgFillStyleLst></a:fmtScheme>'
)


def styled_shape(style="", own=""):
    return f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="x"/></p:nvSpPr><p:spPr>{own}</p:spPr><p:style>{style}</p:style><p:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></p:txBody></p:sp>'


def test_shapes_take_the_themes_formats():
    ref = lambda kind, n, name="accent1": f'<a:{kind} idx="{n}"><a:schemeClr val="{name}"/></a:{kind}>'
    shape = lambda style, own="": themed(styled_shape(style, own), theme=FORMATS)["shapes"][0]
    assert shape(ref("fillRef", 1))["fill"] == {"kind": "solid", "color": "336699"} and shape(ref("fillRef", 0))["fill"] == {"kind": "none"}
    assert shape(ref("fillRef", 2))["fill"]["color"].endswith("~") and shape(ref("fillRef", 1, "bg1"))["fill"]["color"] == "101010"
    assert shape(ref("fillRef", 1001))["fill"] == {"kind": "solid", "color": "336699"} and shape(ref("fillRef", 1), "<a:noFill/>")["fill"] == {"kind": "none"}
    assert shape(ref("lnRef", 1))["line"] == {"fill": {"kind": "solid", "color": "336699"}, "width": 6350, "dash": "dot"}
    assert shape(ref("lnRef", 1), '<a:ln w="100"><a:tailEnd type="arrow"/></a:ln>')["line"] == {"fill": {"kind": "solid", "color": "336699"}, "width": 100, "dash": "dot", "tailEnd": "arrow"}
    assert "line" not in shape("")


def test_placeholders_inherit_lines_and_texts_the_presentations_size():
    ph = '<p:nvPr><p:ph type="body" idx="1"/></p:nvPr>'
    own = f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="x"/>{ph}</p:nvSpPr><p:spPr/><p:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></p:txBody></p:sp>'
    layout = f'<p:sp><p:nvSpPr><p:cNvPr id="3" name="y"/>{ph}</p:nvSpPr><p:spPr><a:ln w="7"><a:solidFill><a:schemeClr val="tx1"/></a:solidFill></a:ln></p:spPr></p:sp>'
    slide = themed(own, layout, presentation='<p:defaultTextStyle><a:lvl1pPr><a:defRPr sz="2400"/></a:lvl1pPr></p:defaultTextStyle>')
    assert slide["shapes"][0]["line"] == {"fill": {"kind": "solid", "color": "F0F0F0"}, "width": 7, "dash": "solid"}
    assert slide["shapes"][0]["paragraphs"][0]["runs"][0]["format"]["size"] == 2400


def test_outlines_are_in_units_of_the_shape():
    paths = '<a:path w="100" h="50"><a:moveTo><a:pt x="0" y="mid"/></a:moveTo><a:lnTo><a:pt x="100" y="50"/></a:lnTo><a:arcTo wR="10" hR="5" stAng="0" swAng="cd4"/><a:close/></a:path>'
    geometry = f'<a:xfrm><a:off x="0" y="0"/><a:ext cx="1000" cy="2000"/></a:xfrm><a:custGeom><a:gdLst><a:gd name="mid" fmla="*/ 50 1 2"/></a:gdLst><a:pathLst>{paths}</a:pathLst></a:custGeom>'
    (path,) = themed(styled_shape(own=geometry))["shapes"][0]["preset"]
    assert [s["do"] for s in path["steps"]] == ["moveTo", "lnTo", "arcTo", "close"]
    assert path["steps"][0]["points"] == [{"x": 0, "y": 1000}] and path["steps"][1]["points"] == [{"x": 1000, "y": 2000}]
    assert path["steps"][2] == {"do": "arcTo", "wR": 100, "hR": 200, "stAng": 0, "swAng": 5400000}
    preset = lambda av="": themed(styled_shape(own=f'<a:prstGeom prst="roundRect"><a:avLst>{av}</a:avLst></a:prstGeom>'))["shapes"][0]["preset"]
    assert preset() == "roundRect" and preset('<a:gd name="adj" fmla="val 9"/>') == {"name": "roundRect", "adjusted": {"adj": "9"}}
