"""Models: what looks the same has the same leaves, and what differs shows where."""

import re

import pytest

from folioscope.models import docx, leaves, model_leaves, pptx, xlsx
from folioscope.sources import opc

CELLS = {"One": [("A1", "n", 1.5), ("B1", "s", "text & <more>"), ("A2", "b", True), ("C4", "f", "a1*2")]}


def parts_of(content):
    found = opc.read_package(content)
    return {found.members[k]: v.decode() for k, v in found.parts.items()}


def changed(content, edit):
    return opc.write_package({k: edit(k, v) for k, v in parts_of(content).items()})


def test_leaves_of_values():
    assert list(leaves("f", {"a/b": [1, None, ""], "~": {}, "x": True, "y": 2.0})) == [
        ("f", "/a~1b/0", "num", "1"), ("f", "/a~1b/1", "null", None), ("f", "/a~1b/2", "str", ""), ("f", "/~0", "empty", "{}"), ("f", "/x", "bool", "true"), ("f", "/y", "num", "2.0"),
    ]


def test_shared_strings_look_like_inline_ones():
    plain = xlsx.write(CELLS)
    parts = parts_of(plain)
    sheet = re.sub(r't="inlineStr"><is><t xml:space="preserve">.*?</t></is>', 't="s"><v>0</v>', parts["xl/worksheets/sheet1.xml"])
    parts["xl/worksheets/sheet1.xml"] = sheet
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{xlsx.MAIN}"><si><r><t>text </t></r><r><t>&amp; &lt;more&gt;</t></r><rPh><t>no</t></rPh></si></sst>'
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace("</Relationships>", f'<Relationship Id="rId9" Type="{xlsx.REL}/sharedStrings" Target="/xl/sharedStrings.xml"/></Relationships>')
    assert xlsx.extract(opc.write_package(parts)) == xlsx.extract(plain)


def test_names_prefixes_and_strict_namespaces_do_not_matter():
    plain = xlsx.write(CELLS, {"One": '<mergeCells><mergeCell ref="A1:B1"/></mergeCells>'})
    renamed = {k.replace("worksheets/sheet1", "odd/Sheet%20X"): v.replace("worksheets/sheet1.xml", "odd/Sheet%20X.xml").replace("rId1", "zz") for k, v in parts_of(plain).items()}
    assert xlsx.extract(opc.write_package(renamed)) == xlsx.extract(plain)
    strict = changed(plain, lambda k, v: v.replace(xlsx.MAIN, "http://purl.oclc.org/ooxml/spreadsheetml/main").replace(xlsx.REL, "http://purl.oclc.org/ooxml/officeDocument/relationships"))
    assert xlsx.extract(strict) == xlsx.extract(plain)
    prefixed = changed(plain, lambda k, v: re.sub(r"<(/?)(\w+)", r"<\1x:\2", v).replace("<?x:xml", "<?xml").replace('xmlns="http://schemas.openxmlformats.org/spread', 'xmlns:x="http://schemas.openxmlformats.org/spread') if "sheet1.xml" == k[-10:] else v)
    assert xlsx.extract(prefixed) == xlsx.extract(plain)


def with_sheet(body, **more):
    content = xlsx.write({"S": []}, {"S": more.get("extra", "")})
    return changed(content, lambda k, v: v.replace("<sheetData></sheetData>", f"{more.get('before', '')}<sheetData>{body}</sheetData>") if k.endswith("sheet1.xml") else v)


def test_cell_kinds_and_implicit_places():
    row = '<row><c><v>1</v></c><c t="str"><f>A1</f><v>x_x0041_</v></c><c t="e"><v>#N/A</v></c></row><row r="5"><c t="d"><v>1900-03-01</v></c><c t="s"><v>7</v></c><c t="b"><v>maybe</v></c><c r="F5"><v>1e3</v></c><c/></row>'
    cells = xlsx.extract(with_sheet(row))["cells"]["S"]
    assert cells == {
        "A1": {"type": "n", "value": 1.0}, "B1": {"type": "s", "value": "xA"}, "C1": {"type": "e", "value": "#N/A"}, "A5": {"type": "n", "value": 61.0},
        "B5": {"type": "invalid", "value": "7"}, "C5": {"type": "invalid", "value": "maybe"}, "F5": {"type": "n", "value": 1000.0},
    }


def test_shared_formulas_are_shifted_from_their_anchor():
    row = '<row r="1"><c r="A1"><f t="shared" si="0" ref="A1:A3">B1+$C$1</f></c></row><row r="2"><c r="A2"><f t="shared" si="0"/></c></row><row r="3"><c r="A3"><f t="shared" si="9"/></c><c r="B3"><f t="array" ref="B3:C3">a1:a2</f></c></row>'
    assert xlsx.extract(with_sheet(row))["formulas"]["S"] == {
        "B3": {"text": "A1:A2", "array": "B3:C3"}, "A1": {"text": "B1+$C$1"}, "A2": {"text": "B2+$C$1"}, "A3": {"text": None, "shared_without_anchor": True},
    }


def test_column_runs_unite_and_rules_rank_by_priority():
    extra = '<conditionalFormatting sqref="B1 A1"><cfRule type="x" priority="5"><formula>a1&gt;1</formula></cfRule><cfRule type="y"/></conditionalFormatting><conditionalFormatting sqref="C1"><cfRule type="z" priority="1"/></conditionalFormatting>'
    model = xlsx.extract(with_sheet("", before='<cols><col min="1" max="2" width="9" customWidth="1"/><col min="3" max="3" width="9" customWidth="1"/><col min="5" max="5" hidden="1"/></cols>', extra=extra))
    assert list(model["columns"]["S"]) == ["A:C", "E:E"]
    assert [(r["type"], r["rank"], r["refs"]) for r in model["conditional_formats"]["S"]] == [("z", 1, "C1"), ("x", 2, "A1:B1"), ("y", 3, "A1:B1")]


def test_validations_with_split_ranges_are_one():
    one = '<dataValidations><dataValidation type="whole" operator="greaterThan" sqref="A1:A2"><formula1>1</formula1><formula2>9</formula2></dataValidation></dataValidations>'
    two = '<dataValidations><dataValidation type="whole" operator="greaterThan" sqref="A2"><formula1> 1</formula1></dataValidation><dataValidation type="whole" operator="greaterThan" sqref="A1"><formula1>1</formula1></dataValidation></dataValidations>'
    assert xlsx.extract(with_sheet("", extra=one))["data_validations"] == xlsx.extract(with_sheet("", extra=two))["data_validations"]


def test_edit_targets_and_edits():
    content = xlsx.write(CELLS)
    assert {k: xlsx.edit_target(content)[k] for k in ("sheet", "cell")} == {"sheet": "One", "cell": "A6"}
    assert xlsx.edit_target(with_sheet('<row r="1048575"/>')) is None
    edited = xlsx.extract(xlsx.apply_edit(content, xlsx.edit_target(content), "x < y"))
    before = xlsx.extract(content)
    assert edited["cells"]["One"].pop("A6") == {"type": "s", "value": "x < y"} and edited == before
    assert xlsx.extract(xlsx.apply_edit(with_sheet(""), {"sheet": "S", "cell": "A2", "part": "xl/worksheets/sheet1.xml"}, "m"))["cells"]["S"]["A2"]["value"] == "m"


def test_no_package_is_an_error():
    for module in (xlsx, docx, pptx):
        with pytest.raises(ValueError):
            module.extract(b"nothing")


# Text documents.


def test_split_runs_are_one():
    one = docx.write('<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>ab cd</w:t></w:r></w:p>')
    two = docx.write('<w:p><w:r><w:rPr><w:b w:val="true"/></w:rPr><w:t xml:space="preserve">ab </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>cd</w:t></w:r><w:r><w:t></w:t></w:r></w:p>')
    assert docx.extract(one) == docx.extract(two)


def test_tables_fold_vertical_merges():
    cell = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{docx.paragraph_markup(text)}</w:tc>"
    body = f'<w:tbl><w:tblGrid><w:gridCol w:w="1in"/></w:tblGrid><w:tr>{cell("a", "<w:vMerge w:val=\"restart\"/>")}{cell("b", "<w:gridSpan w:val=\"2\"/>")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("c")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    table = docx.extract(docx.write(body))["body"][0]
    assert table["grid"] == [1440] and [len(r["cells"]) for r in table["rows"]] == [2, 1, 0]
    assert table["rows"][0]["cells"][0]["rowspan"] == 3 and table["rows"][1]["cells"][0]["column"] == 1


def test_changes_fields_and_links():
    body = (
        '<w:p><w:r><w:t xml:space="preserve">keep </w:t></w:r><w:del w:author="x"><w:r><w:delText>go</w:delText></w:r></w:del><w:del w:author="x"><w:r><w:delText>ne</w:delText></w:r></w:del>'
        '<w:ins w:author="y"><w:r><w:t>new</w:t></w:r></w:ins><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> page \\* MERGEFORMAT </w:instrText></w:r>'
        '<w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>3</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:bookmarkStart w:name="b"/></w:p>'
    )
    model = docx.extract(docx.write(body))
    assert model["body"][0]["text"] == "keep new3" and model["fields"] == ["PAGE"] and model["bookmarks"] == ["b"]
    assert model["tracked_changes"] == [{"kind": "del", "author": "x", "text": "gone"}, {"kind": "ins", "author": "y", "text": "new"}]


def test_headers_are_inherited_by_later_sections():
    section = lambda refs: f'<w:p><w:pPr><w:sectPr>{refs}</w:sectPr></w:pPr></w:p>'
    body = section('<w:headerReference w:type="default" r:id="h1"/>') + section("") + '<w:sectPr><w:headerReference w:type="default" r:id="h2"/></w:sectPr>'
    header = lambda text: f'<w:hdr xmlns:w="{docx.MAIN}">{docx.paragraph_markup(text)}</w:hdr>'
    rels = "".join(f'<Relationship Id="h{i}" Type="x/header" Target="h{i}.xml"/>' for i in (1, 2))
    model = docx.extract(docx.write(body, {"word/h1.xml": header("first"), "word/h2.xml": header("second")}, rels))
    assert [h["header/default"] for h in model["headers_footers"]] == ["first", "first", "second"] and len(model["sections"]) == 3


def test_document_edit():
    content = docx.write("<w:p/>" + docx.paragraph_markup("old text") + docx.paragraph_markup("other"))
    target = docx.edit_target(content)
    assert (target["paragraph"], target["run"]) == (1, 0) and docx.edit_target(docx.write("<w:p/>")) is None
    assert [b["text"] for b in docx.extract(docx.apply_edit(content, target, "new"))["body"]] == ["", "new", "other"]


# Presentations.


def group(off, ext, ch_off, ch_ext, inner, more=""):
    box = lambda n, xy, a, b: f'<a:{n} {a}="{xy[0]}" {b}="{xy[1]}"/>'
    x = box("off", off, "x", "y") + box("ext", ext, "cx", "cy") + box("chOff", ch_off, "x", "y") + box("chExt", ch_ext, "cx", "cy")
    return f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="G"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm {more}>{x}</a:xfrm></p:grpSpPr>{inner}</p:grpSp>'


def test_groups_place_their_children_absolutely():
    shape = lambda box: pptx.text_shape(2, ["t"], box)
    a = pptx.write([group((100, 100), (200, 200), (0, 0), (20, 20), shape((0, 0, 10, 10)))])
    b = pptx.write([group((100, 100), (200, 200), (1000, 1000), (400, 400), shape((1000, 1000, 200, 200)))])
    assert pptx.extract(a) == pptx.extract(b)
    assert pptx.extract(a)["slides"][0]["shapes"][0]["children"][0]["geometry"] == {"x": 100, "y": 100, "cx": 100, "cy": 100, "rot": 0, "flipped": False}
    turned = pptx.extract(pptx.write([group((0, 0), (100, 100), (0, 0), (100, 100), shape((0, 0, 50, 50)), 'rot="5400000"')]))
    assert turned["slides"][0]["shapes"][0]["children"][0]["geometry"] == {"x": 50, "y": 0, "cx": 50, "cy": 50, "rot": 5400000, "flipped": False}


def test_slides_follow_the_list_and_edits_find_their_run():
    content = pptx.write([pptx.text_shape(2, ["", "first"]), pptx.text_shape(2, ["second"])])
    swapped = changed(content, lambda k, v: re.sub(r"(<p:sldId [^>]*/>)(<p:sldId [^>]*/>)", r"\2\1", v))
    text = lambda m: [s["shapes"][0]["paragraphs"][-1]["text"] for s in m["slides"]]
    assert text(pptx.extract(content)) == ["first", "second"] and text(pptx.extract(swapped)) == ["second", "first"]
    target = pptx.edit_target(content)
    assert (target["slide"], target["shape_id"], target["paragraph"]) == (1, 2, 1)
    assert text(pptx.extract(pptx.apply_edit(content, target, "new"))) == ["new", "second"]


def test_smart_art_cycles_end():
    from xml.etree import ElementTree as ET

    pt = lambda i, kind, text: f'<pt modelId="{i}" type="{kind}"><t>{text}</t></pt>'
    cxn = lambda a, b, n: f'<cxn srcId="{a}" destId="{b}" srcOrd="{n}"/>'
    root = ET.fromstring(f"<m><ptLst>{pt(0, 'doc', '')}{pt(1, 'node', 'a')}{pt(2, 'node', 'b')}</ptLst><cxnLst>{cxn(0, 2, 1)}{cxn(0, 1, 0)}{cxn(2, 0, 0)}{cxn(1, 1, 0)}</cxnLst></m>")
    assert pptx.smart_tree(root) == [{"text": "", "children": [{"text": "a", "children": []}, {"text": "b", "children": []}]}]


def test_extraction_gives_leaves_of_known_features():
    from folioscope.models import FEATURES

    for module, content in ((xlsx, xlsx.write(CELLS)), (docx, docx.write(docx.paragraph_markup("x"))), (pptx, pptx.write([pptx.text_shape(2, ["x"])]))):
        assert {f for f, *_ in model_leaves(module.extract(content))} <= set(FEATURES[module.__name__.rpartition(".")[2]])
