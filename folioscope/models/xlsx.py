"""The spreadsheet model: what a workbook shows, whatever its parts are called."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from xml.etree import ElementTree as ET

from folioscope.functions import sheets as S
from folioscope.models.sheet_styles import Styles, merged
from folioscope.sources import opc

_FALSE, _TRUE = {"0", "false"}, {"1", "true"}


def flag(value: str | None, default: bool = False) -> bool:
    return True if value in _TRUE else False if value in _FALSE else default


def number(value: str | None) -> float | None:
    try:
        return float(value) if value is not None else None
    except ValueError:
        return None


def kids(e: ET.Element | None, *names: str) -> list[ET.Element]:
    """Children by local name; of alternatives, the first choice, else the fallback."""
    out = []
    for child in e if e is not None else ():
        name = opc.local(child.tag)
        if name == "AlternateContent":
            choice = next((c for c in child if opc.local(c.tag) == "Choice"), None)
            out += kids(choice if choice is not None else next(iter(child), None), *names)
        elif not names or name in names:
            out.append(child)
    return out


def kid(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        found = kids(e, name)
        e = found[0] if found else None
    return e


def dump(e: ET.Element) -> dict:
    """An element as a dict of attributes, children by name, and text."""
    out: dict = {opc.local(k): v for k, v in e.attrib.items()}
    for child in kids(e):
        out.setdefault(opc.local(child.tag), []).append(dump(child))
    if e.text and e.text.strip():
        out["text"] = e.text
    return out


def key_of(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def rich_text(e: ET.Element | None, styles: Styles) -> tuple[str, list]:
    """Text of a string item and its formatted runs; phonetic runs are no text."""
    plain = "".join(t.text or "" for t in kids(e, "t"))
    runs = [["".join(t.text or "" for t in kids(r, "t")), styles.font(p) if (p := kid(r, "rPr")) is not None else None] for r in kids(e, "r")]
    merged: list = []
    for text, form in runs:
        if not text:
            continue
        if merged and merged[-1][1] == form:
            merged[-1][0] += text
        else:
            merged.append([text, form])
    text = S.unescape(plain + "".join(t for t, _ in merged))
    return text, [{"text": S.unescape(t), "format": f} for t, f in merged] if any(f for _, f in merged) else []


class Workbook:
    def __init__(self, content: bytes):
        package = opc.read_package(content, "error", decode=True)
        if package.error:
            raise ValueError(package.error)
        self.parts = package.parts
        self.rels: dict[str, dict[str, tuple[str, str, bool]]] = {}
        for source, rel_id, kind, target, external in opc.relationships(self.parts):
            self.rels.setdefault(source, {})[rel_id] = (kind, target, external)
        self.main = next((t for k, t, x in self.rels.get("", {}).values() if k == "officeDocument" and t in self.parts), None)
        if self.main is None:
            raise ValueError("no workbook")
        self.root = opc.parse(self.parts[self.main])
        self.from_1904 = flag(self.attr(kid(self.root, "workbookPr"), "date1904"))
        self.styles = Styles(self.part_of("styles"))
        self.strings = [rich_text(e, self.styles) for e in kids(self.part_of("sharedStrings"), "si")]

    @staticmethod
    def attr(e: ET.Element | None, name: str, default: str | None = None) -> str | None:
        return default if e is None else opc.attribute(e, name, default)

    def targets(self, source: str, kind: str) -> list[str]:
        return sorted(t for k, t, x in self.rels.get(source, {}).values() if k == kind and not x and t in self.parts)

    def part_of(self, kind: str, source: str | None = None) -> ET.Element | None:
        found = self.targets(self.main if source is None else source, kind)
        return opc.parse(self.parts[found[0]]) if found else None

    def sheet_list(self) -> list[tuple[str, str, str, str | None]]:
        """(name, state, kind, part) in order."""
        out = []
        for e in kids(kid(self.root, "sheets"), "sheet"):
            kind, target, _ = self.rels.get(self.main, {}).get(opc.attribute(e, "id", ""), ("", "", False))
            out.append((e.get("name", ""), e.get("state", "visible"), kind, target if target in self.parts else None))
        return out

    def style(self, index: int) -> dict:
        """What a cell format shows."""
        return self.styles.cell(index)

    # Cells.

    def value(self, c: ET.Element) -> dict | None:
        kind, v = c.get("t", "n"), kid(c, "v")
        if kind == "inlineStr":
            text, runs = rich_text(kid(c, "is"), self.styles)
            return {"type": "s", "value": text} | ({"runs": runs} if runs else {}) if kid(c, "is") is not None else None
        text = v.text if v is not None else None
        if text is None or text == "":
            return {"type": "s", "value": ""} if kind == "str" and v is not None else None
        if kind == "s":
            if text.strip().isdigit() and int(text) < len(self.strings):
                plain, runs = self.strings[int(text)]
                return {"type": "s", "value": plain} | ({"runs": runs} if runs else {})
            return {"type": "invalid", "value": text}
        if kind == "str":
            return {"type": "s", "value": S.unescape(text)}
        if kind == "b":
            return {"type": "b", "value": flag(text)} if text in _TRUE | _FALSE else {"type": "invalid", "value": text}
        if kind == "e":
            return {"type": "e", "value": text}
        if kind == "d":
            n = S.serial_day(text, self.from_1904)
            return {"type": "n", "value": n} if n is not None else {"type": "invalid", "value": text}
        n = number(text)
        return {"type": "n", "value": n} if n is not None else {"type": "invalid", "value": text}

    def grid(self, root: ET.Element):
        """(row element, number, [(cell element, column)]); a missing place follows the one before."""
        row = 0
        for r in kids(kid(root, "sheetData"), "row"):
            row = int(r.get("r", row + 1))
            column, cells = 0, []
            for c in kids(r, "c"):
                box = S.parse_range(c.get("r", "")) if c.get("r") else None
                column = box[0] if box else column + 1
                cells.append((c, column))
            yield r, row, cells


def sheet_model(book: Workbook, root: ET.Element, part: str) -> dict[str, dict]:
    out: dict[str, dict] = {k: {} for k in ("cells", "formulas", "cell_styles", "rows")}
    anchors: dict[str, tuple[str, int, int]] = {}
    users: list[tuple[str, str, int, int]] = []
    default = book.style(0)
    columns, by_column = column_runs(book, root)
    firsts = [a for a, _, _ in by_column]
    by_row: dict[int, dict] = {}

    def of_column(column: int) -> int:
        k = bisect_right(firsts, column) - 1
        return by_column[k][2] if k >= 0 and column <= by_column[k][1] else 0

    form = kid(root, "sheetFormatPr")
    usual = {"height": number(form.get("defaultRowHeight"))} if form is not None and flag(form.get("customHeight")) and form.get("defaultRowHeight") else {}
    if usual := usual | ({"hidden": True} if form is not None and flag(form.get("zeroHeight")) else {}):
        out["rows"]["_default"] = usual
    for r, row, cells in book.grid(root):
        shown: dict = {}
        if flag(r.get("customHeight")) and r.get("ht"):
            shown["height"] = number(r.get("ht"))
        shown |= {k: True for k, a in {"hidden": "hidden", "collapsed": "collapsed"}.items() if flag(r.get(a))}
        if r.get("outlineLevel", "0") != "0":
            shown["outline"] = int(r.get("outlineLevel"))
        styled = int(r.get("s", "0")) if flag(r.get("customFormat")) else None
        if styled is not None:
            by_row[row] = book.style(styled)
            shown |= {"style": by_row[row]} if by_row[row] != default else {}
        if shown:
            out["rows"][str(row)] = shown
        for c, column in cells:
            at = f"{S.column_letters(column)}{row}"
            if (value := book.value(c)) is not None:
                out["cells"][at] = value
            own = int(c.get("s", "0"))
            inherited = styled if styled is not None else of_column(column)
            if own != inherited and book.style(own) != book.style(inherited):
                out["cell_styles"][at] = book.style(own)
            f = kid(c, "f")
            if f is None:
                continue
            kind, text = f.get("t", "normal"), f.text or ""
            if kind == "shared":
                if text:
                    anchors.setdefault(f.get("si", ""), (text, row, column))
                users.append((at, f.get("si", ""), row, column))
            elif kind == "array":
                out["formulas"][at] = {"text": S.normal_formula(text), "array": S.canonical_ref(f.get("ref", at))}
            elif kind == "dataTable":
                out["formulas"][at] = {"text": "", "data_table": dump(f)}
            elif text:
                out["formulas"][at] = {"text": S.normal_formula(text)}
    for at, si, row, column in users:
        text, r0, c0 = anchors.get(si, (None, 0, 0))
        out["formulas"][at] = {"text": S.normal_formula(S.shift_formula(text, row - r0, column - c0))} if text is not None else {"text": None, "shared_without_anchor": True}
    areas = sorted(S.canonical_ref(e.get("ref", "")) for e in kids(kid(root, "mergeCells"), "mergeCell"))
    out["merged_cells"] = {m: True for m in areas}
    boxes = [box for m in areas if (box := S.parse_range(m))]
    look = lambda x, y: out["cell_styles"].get(f"{S.column_letters(x)}{y}") or by_row.get(y) or book.style(of_column(x))
    shown_by = merged(boxes, look)
    for at in inside(boxes, list(out["cell_styles"])):
        del out["cell_styles"][at]
    out["cell_styles"] |= {f"{S.column_letters(x)}{y}": style for (x, y), style in shown_by.items()}
    out["columns"] = columns
    views = {}
    for i, v in enumerate(kids(kid(root, "sheetViews"), "sheetView")):
        pane = kid(v, "pane")
        views[str(i)] = {"grid_lines": flag(v.get("showGridLines"), True), "zoom": int(number(v.get("zoomScale")) or 100), "right_to_left": flag(v.get("rightToLeft"))}
        if pane is not None:
            views[str(i)]["pane"] = {k: pane.get(k) for k in ("xSplit", "ySplit", "topLeftCell", "state") if pane.get(k)}
    out["views"] = views
    if (f := kid(root, "autoFilter")) is not None:
        out["auto_filters"] = {"ref": S.canonical_ref(f.get("ref", "")), "columns": [book.styles.dump(c) for c in kids(f, "filterColumn")]}
    out["data_validations"] = validations(root)
    out["conditional_formats"] = conditional_formats(book, root)
    links = {}
    for e in kids(kid(root, "hyperlinks"), "hyperlink"):
        _, target, _ = book.rels.get(part, {}).get(opc.attribute(e, "id", ""), ("", None, True))
        links[S.canonical_ref(e.get("ref", ""))] = {"target": target, "location": e.get("location"), "tooltip": e.get("tooltip")}
    out["hyperlinks"] = links
    out["comments"] = comments(book, part)
    if (p := kid(root, "sheetProtection")) is not None and flag(p.get("sheet"), flag(p.get("content"))):
        out["protection"] = {k: flag(v) for k, v in p.attrib.items() if v in _TRUE | _FALSE}
    setup: dict = {}
    for name in ("pageMargins", "pageSetup", "printOptions"):
        if (e := kid(root, name)) is not None:
            setup[name] = {opc.local(k): number(v) if number(v) is not None else v for k, v in e.attrib.items() if opc.local(k) != "id"}
    if (e := kid(root, "headerFooter")) is not None:
        setup["headerFooter"] = {opc.local(x.tag): S.header_sections(x.text or "") for x in kids(e)}
    for name in ("rowBreaks", "colBreaks"):
        if found := [b.get("id") for b in kids(kid(root, name), "brk")]:
            setup[name] = found
    out["page_setup"] = setup
    out["images"], out["charts"] = drawings(book, part)
    out["tables"] = {t.get("displayName", t.get("name", "")): {"ref": S.canonical_ref(t.get("ref", "")), "columns": [c.get("name") for c in kids(kid(t, "tableColumns"), "tableColumn")]} for x in book.targets(part, "table") if (t := opc.parse(book.parts[x])) is not None}
    out["pivot_tables"] = {p.get("name", ""): {"ref": S.canonical_ref(attr(kid(p, "location"), "ref"))} for x in book.targets(part, "pivotTable") if (p := opc.parse(book.parts[x])) is not None}
    return out


def attr(e: ET.Element | None, name: str, default: str = "") -> str:
    return default if e is None else opc.attribute(e, name, default)


def inside(boxes: list[tuple[int, int, int, int]], cells: list[str]) -> list[str]:
    """Those of ``cells`` that lie in a box, by the rows and then the columns that have cells."""
    rows: dict[int, list[tuple[int, str]]] = {}
    for at in cells:
        x, y, _, _ = S.parse_range(at)
        rows.setdefault(y, []).append((x, at))
    order, found = sorted(rows), set()
    for a, b, c, d in boxes:
        for y in order[bisect_left(order, b) : bisect_right(order, d)]:
            found.update(at for x, at in rows[y] if a <= x <= c)
    return sorted(found)


def column_runs(book: Workbook, root: ET.Element) -> tuple[dict[str, dict], list[tuple[int, int, int]]]:
    """Maximal runs of columns with equal properties, and (first, last, format) of those with a look of their own."""
    runs: list[list] = []
    styled: list[tuple[int, int, int]] = []
    for e in sorted(kids(kid(root, "cols"), "col"), key=lambda e: int(e.get("min", "1"))):
        index, first, last = int(e.get("style", "0")), int(e.get("min", "1")), int(e.get("max", "1"))
        shown: dict = {"width": number(e.get("width"))} if number(e.get("width")) is not None else {}
        shown |= {k: True for k in ("hidden", "collapsed") if flag(e.get(k))}
        if e.get("outlineLevel", "0") != "0":
            shown["outline"] = int(e.get("outlineLevel"))
        if book.style(index) != book.style(0):
            shown["style"] = book.style(index)
            styled.append((first, last, index))
        if shown and runs and runs[-1][1] == first - 1 and runs[-1][2] == shown:
            runs[-1][1] = last
        elif shown:
            runs.append([first, last, shown])
    return {f"{S.column_letters(a)}:{S.column_letters(b)}": shown for a, b, shown in runs}, styled


#: Validation types whose operator counts, and operators that take a second formula.
_COMPARED = {"whole", "decimal", "date", "time", "textLength"}
_TWO = {"between", "notBetween"}


def validations(root: ET.Element) -> dict[str, dict]:
    """Validations by the content of their rule, split lists of ranges united."""
    found: dict[str, dict] = {}
    extended = [d for x in kids(kid(root, "extLst"), "ext") for d in kids(kid(x, "dataValidations"), "dataValidation")]
    for e in kids(kid(root, "dataValidations"), "dataValidation") + extended:
        kind, operator = e.get("type", "none"), e.get("operator", "between")
        text = lambda n: S.normal_formula("".join((kid(e, n)).itertext())) if kid(e, n) is not None else None  # noqa: B023, E731
        rule = {"type": kind, "formula1": text("formula1"), "show_dropdown": not flag(e.get("showDropDown")), "blank": flag(e.get("allowBlank")), "error": e.get("error"), "prompt": e.get("prompt"), "style": e.get("errorStyle", "stop")}
        if kind in _COMPARED:
            rule["operator"] = operator
            if operator in _TWO:
                rule["formula2"] = text("formula2")
        refs = e.get("sqref") or "".join(x.text or "" for x in kids(e, "sqref"))
        slot = found.setdefault(key_of(rule), rule | {"refs": ""})
        slot["refs"] += " " + refs
    return {k: v | {"refs": S.canonical_refs(v["refs"])} for k, v in found.items()}


#: Attributes that each kind of rule reads, with the value that stands for nothing, and kinds without a condition of their own.
_READ = {
    **dict.fromkeys(("containsText", "notContainsText", "beginsWith", "endsWith"), {"text": None}), "timePeriod": {"timePeriod": None}, "top10": {"rank": None, "percent": False, "bottom": False},
    "aboveAverage": {"aboveAverage": True, "equalAverage": False, "stdDev": None},
}
_COMPARES = {"cellIs", "containsText", "notContainsText", "beginsWith", "endsWith"}
_NO_FORMULA = {"aboveAverage", "top10", "duplicateValues", "uniqueValues", "colorScale", "dataBar", "iconSet"}
_GRAPHIC = ("colorScale", "dataBar", "iconSet")


def conditional_rule(book: Workbook, e: ET.Element, refs: str) -> dict:
    kind = e.get("type")
    out: dict = {"type": kind, "refs": S.canonical_refs(refs)}
    if e.get("operator") and kind in _COMPARES:
        out["operator"] = e.get("operator")
    formulas = [S.normal_formula(f.text or "") for f in kids(e, "formula", "f") if f.text]
    if formulas and kind not in _NO_FORMULA:
        out["formulas"] = formulas
    if flag(e.get("stopIfTrue")):
        out["stop"] = True
    for name, usual in _READ.get(kind or "", {}).items():
        value = e.get(name) if usual is None else flag(e.get(name), usual)
        if value != usual:
            out[name] = value
    style = book.styles.rule(kid(e, "dxf")) if kid(e, "dxf") is not None else book.styles.rule_at(int(e.get("dxfId")) if (e.get("dxfId") or "").isdigit() else None)
    return out | ({"style": style} if style else {}) | ({"shown": shown} if (shown := [book.styles.dump(c) for c in kids(e, *_GRAPHIC)]) else {})


def conditional_formats(book: Workbook, root: ET.Element) -> list[dict]:
    """Rules by priority, a missing one last, then by place; the rank is what counts.

    An extended rule that a plain one refers to belongs to it; others are rules of their own.
    """
    extended = [(rule, "".join(kid(block, "sqref").itertext()) if kid(block, "sqref") is not None else "")
                for x in kids(kid(root, "extLst"), "ext") for block in kids(kid(x, "conditionalFormattings"), "conditionalFormatting") for rule in kids(block, "cfRule")]
    by_id = {rule.get("id"): rule for rule, _ in extended if rule.get("id")}
    rows, linked = [], set()
    for block in kids(root, "conditionalFormatting"):
        for rule in kids(block, "cfRule"):
            body = conditional_rule(book, rule, block.get("sqref", ""))
            for x in kids(kid(rule, "extLst"), "ext"):
                name = "".join(kid(x, "id").itertext()).strip() if kid(x, "id") is not None else ""
                if name in by_id:
                    linked.add(name)
                    body["extended"] = [book.styles.dump(c) for c in kids(by_id[name]) if opc.local(c.tag) != "dxf"]
            rows.append((rule, body))
    rows += [(rule, conditional_rule(book, rule, refs)) for rule, refs in extended if rule.get("id") not in linked]
    place = lambda row: int(row[0].get("priority")) if (row[0].get("priority") or "").lstrip("-").isdigit() else 1 << 30
    return [body | {"rank": i} for i, (_, body) in enumerate(sorted(rows, key=place), 1)]


def comments(book: Workbook, part: str) -> dict[str, dict]:
    out: dict[str, dict] = {}
    people = {p.get("id"): p.get("displayName") for p in kids(book.part_of("person"), "person")}
    for target in book.targets(part, "threadedComment"):
        for e in kids(opc.parse(book.parts[target]), "threadedComment"):
            entry = {"author": people.get(e.get("personId")), "text": "".join((kid(e, "text")).itertext()) if kid(e, "text") is not None else ""}
            out.setdefault(S.canonical_ref(e.get("ref", "")), {"thread": []})["thread"].append(entry)
    for target in book.targets(part, "comments"):
        root = opc.parse(book.parts[target])
        authors = ["".join(a.itertext()) for a in kids(kid(root, "authors"), "author")]
        for e in kids(kid(root, "commentList"), "comment"):
            at, author = S.canonical_ref(e.get("ref", "")), int(e.get("authorId", "0"))
            if at not in out:
                out[at] = {"author": authors[author] if author < len(authors) else None, "text": rich_text(kid(e, "text"), book.styles)[0]}
    return out


def drawings(book: Workbook, part: str) -> tuple[dict, dict]:
    """Images by anchor and digest with a count; charts by anchor."""
    images: dict[str, dict] = {}
    charts: dict[str, dict] = {}
    for target in book.targets(part, "drawing"):
        rels = book.rels.get(target, {})
        for anchor in kids(opc.parse(book.parts[target])):
            place = kid(anchor, "from")
            at = f"{S.column_letters(int((kid(place, 'col')).text or 0) + 1)}{int((kid(place, 'row')).text or 0) + 1}" if place is not None else "absolute"
            for e in anchor.iter():
                if opc.local(e.tag) == "blip" and (ref := rels.get(opc.attribute(e, "embed", ""))) and ref[1] in book.parts:
                    digest = hashlib.sha256(book.parts[ref[1]]).hexdigest()
                    slot = images.setdefault(at, {})
                    slot[digest] = slot.get(digest, 0) + 1
                elif opc.local(e.tag) == "chart" and (ref := rels.get(opc.attribute(e, "id", ""))) and ref[1] in book.parts:
                    key, n = at, 1
                    while key in charts:
                        n += 1
                        key = f"{at}#{n}"
                    charts[key] = chart(opc.parse(book.parts[ref[1]]))
    return images, charts


def chart(root: ET.Element) -> dict:
    """Kinds of plot, and series in their order with what they are drawn from."""
    plots = []
    for plot in kids(kid(root, "chart", "plotArea")):
        series = []
        for i, s in enumerate(kids(plot, "ser")):
            refs: dict = {opc.local(x.tag): S.normal_formula(f.text or "") for x in kids(s) for f in x.iter() if opc.local(f.tag) == "f"}
            told = {opc.local(x.tag): [S.canonical_number(v.text) for v in x.iter() if opc.local(v.tag) == "v"] for x in kids(s) if opc.local(x.tag) not in refs}
            refs |= {k: v for k, v in told.items() if v}
            series.append((int(number(attr(kid(s, "order"), "val", "0")) or 0), i, refs))
        if series:
            plots.append({"kind": opc.local(plot.tag), "series": [r for _, _, r in sorted(series, key=lambda x: x[:2])]})
    title = kid(root, "chart", "title")
    return {"plots": plots, "title": "".join(t.text or "" for t in title.iter() if opc.local(t.tag) == "t") if title is not None else None}


#: Names of cells and ranges that other features show.
_HIDDEN_NAMES = {"_xlnm.Print_Area": "print_area", "_xlnm.Print_Titles": "print_titles", "_xlnm._FilterDatabase": None}


def extract(content: bytes) -> dict[str, object]:
    """Feature -> value of a workbook; raises ValueError for what is none."""
    book = Workbook(content)
    listed = book.sheet_list()
    model: dict[str, object] = {"workbook": {"sheets": [{"name": n, "state": s, "kind": k} for n, s, k, _ in listed], "date1904": book.from_1904}}
    per = {name: {} for name in ("cells", "formulas", "cell_styles", "merged_cells", "columns", "rows", "views", "auto_filters", "data_validations", "conditional_formats", "hyperlinks", "comments", "protection", "page_setup", "images", "charts", "tables", "pivot_tables")}
    for name, _, kind, part in listed:
        if part is None:
            continue
        found = sheet_model(book, opc.parse(book.parts[part]), part)
        for feature, value in found.items():
            if value:
                per[feature][name] = value
    names = {}
    for e in kids(kid(book.root, "definedNames"), "definedName"):
        index, name = e.get("localSheetId"), e.get("name", "")
        sheet = (listed[int(index)][0] if int(index) < len(listed) else f"#{index}") if index else None
        if name in _HIDDEN_NAMES:
            if _HIDDEN_NAMES[name] and sheet is not None:
                per["page_setup"].setdefault(sheet, {})[_HIDDEN_NAMES[name]] = [S.canonical_ref(S.without_sheet(a)) for a in S.areas(S.normal_formula(e.text or "") or "")]
        else:
            names[f"{sheet}!{name}" if sheet is not None else name] = {"formula": S.normal_formula(e.text or ""), "hidden": flag(e.get("hidden"))}
    model["defined_names"] = names
    if (p := kid(book.root, "workbookProtection")) is not None:
        per["protection"][""] = {k: flag(v) for k, v in p.attrib.items() if v in _TRUE | _FALSE}
    per["cell_styles"][""] = book.style(0)  # the look of cells that have none of their own
    model |= per
    model["external_links"] = {"count": len(book.targets(book.main, "externalLink"))}
    model["vba"] = any(p.rpartition("/")[2] == "vbaproject.bin" for p in book.parts)
    scheme = kid(book.part_of("theme"), "themeElements", "clrScheme")
    model["theme"] = {opc.local(c.tag): next((attr(x, "lastClr") or attr(x, "val") for x in c), None) for c in kids(scheme)}
    return model


def edit_target(content: bytes) -> dict | None:
    """The first worksheet and the first free cell two rows below all it holds; none if that leaves the grid."""
    book = Workbook(content)
    for name, _, kind, part in book.sheet_list():
        if part is not None and kind == "worksheet":
            last = max((row for _, row, _ in book.grid(opc.parse(book.parts[part]))), default=0)
            return {"sheet": name, "cell": f"A{last + 2}", "part": part} if last + 2 <= S.MAX_ROW else None
    return None


def apply_edit(content: bytes, target: dict, text: str) -> bytes:
    """The package with an inline string in the target cell, all other members as they were."""
    import re
    from xml.sax.saxutils import escape

    package = opc.read_package(content, decode=True)
    data = package.parts[target["part"]].decode("utf-8")
    prefix = m[1] if (m := re.search(r"<((?:\w+:)?)sheetData", data)) else ""
    row = S.parse_range(target["cell"])[1]
    p = prefix
    added = f'<{p}row r="{row}"><{p}c r="{target["cell"]}" t="inlineStr"><{p}is><{p}t xml:space="preserve">{escape(text)}</{p}t></{p}is></{p}c></{p}row>'
    if f"</{p}sheetData>" in data:
        data = data.replace(f"</{p}sheetData>", f"{added}</{p}sheetData>", 1)
    else:
        data = re.sub(rf"<{p}sheetData\s*/>", lambda _: f"<{p}sheetData>{added}</{p}sheetData>", data, count=1)
    return opc.replace_member(content, package.members[target["part"]], data.encode())


# A small writer, for fixtures and for queries that write and read back.

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def write(sheets: dict[str, list[tuple[str, str, object]]], extra: dict[str, str] | None = None, names: dict[str, str] | None = None) -> bytes:
    """A workbook of (cell, kind, value) lists in row order; kind: n, s, b, or f for a formula.  ``extra``: markup after the cells, by sheet."""
    from xml.sax.saxutils import escape, quoteattr

    parts: dict[str, bytes | str] = {}
    entries, rels, types = [], [], []
    for i, (name, cells) in enumerate(sheets.items(), 1):
        rows: dict[int, list[str]] = {}
        for at, kind, value in cells:
            row = S.parse_range(at)[1]
            if kind == "n":
                body = f'<c r="{at}"><v>{value!r}</v></c>'
            elif kind == "b":
                body = f'<c r="{at}" t="b"><v>{int(bool(value))}</v></c>'
            elif kind == "f":
                body = f'<c r="{at}"><f>{escape(str(value))}</f></c>'
            else:
                body = f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
            rows.setdefault(row, []).append(body)
        data = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items())
        parts[f"xl/worksheets/sheet{i}.xml"] = f'{_HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{REL}"><sheetData>{data}</sheetData>{(extra or {}).get(name, "")}</worksheet>'
        entries.append(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>')
        rels.append(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>')
        types.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>')
    defined = "".join(f'<definedName name="{k}">{escape(v)}</definedName>' for k, v in (names or {}).items())
    book = f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{"".join(entries)}</sheets>{f"<definedNames>{defined}</definedNames>" if defined else ""}</workbook>'
    top = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{"".join(types)}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{PKG}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": book,
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{PKG}/relationships">{"".join(rels)}</Relationships>',
    }
    return opc.write_package(top | parts)
