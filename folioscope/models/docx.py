"""The text document model: blocks in reading order, and what hangs on them."""

from __future__ import annotations

import hashlib
import re
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from folioscope.models.xlsx import attr, key_of, kid, kids, number
from folioscope.sources import opc

#: Twips per unit.
_TWIPS = {"": 1, "pt": 20, "pc": 240, "pi": 240, "in": 1440, "cm": 1440 / 2.54, "mm": 144 / 2.54}

#: Characters that stand for elements of a run.
_MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "‑", "softHyphen": "­"}
OBJECT = "￼"


def twips(value: str | None) -> int | None:
    m = re.fullmatch(r"\s*(-?[0-9]*\.?[0-9]+)\s*([a-z]*)\s*", value or "")
    return round(float(m[1]) * _TWIPS[m[2]]) if m and m[2] in _TWIPS else None


def on(e: ET.Element | None) -> bool | None:
    """A switch: there without a value means on."""
    return None if e is None else attr(e, "val", "1") in ("1", "true", "on")


class Document:
    def __init__(self, content: bytes):
        package = opc.read_package(content, "last")
        if package.error:
            raise ValueError(package.error)
        self.parts, self.rels = package.parts, {}
        for source, rel_id, kind, target, external in opc.relationships(self.parts):
            self.rels.setdefault(source, {})[rel_id] = (kind, target, external)
        mains = sorted(t for k, t, x in self.rels.get("", {}).values() if k == "officeDocument" and t in self.parts)
        if not mains:
            raise ValueError("no document")
        self.main = mains[0]
        self.root = opc.parse(self.parts[self.main])
        self.styles = {attr(s, "styleId"): s for s in kids(self.part_of("styles"), "style")}
        self.defaults = kid(self.part_of("styles"), "docDefaults")
        self.numbering = self.part_of("numbering")
        self.lists: dict[str, dict[int, tuple] | None] = {}
        self.list_props: dict[tuple[str, int], ET.Element | None] = {}
        self.styled: dict[tuple[str, str | None, str | None], dict[str, dict]] = {}

    def targets(self, kind: str, source: str | None = None) -> list[str]:
        return sorted(t for k, t, x in self.rels.get(self.main if source is None else source, {}).values() if k == kind and not x and t in self.parts)

    def part_of(self, kind: str, source: str | None = None) -> ET.Element | None:
        found = self.targets(kind, source)
        return opc.parse(self.parts[found[0]]) if found else None

    def chain(self, style: str | None) -> list[ET.Element]:
        """A style and what it is based on, furthest first; cycles end."""
        out, seen = [], set()
        while style and style in self.styles and style not in seen:
            seen.add(style)
            out.append(self.styles[style])
            style = attr(kid(self.styles[style], "basedOn"), "val") or None
        return out[::-1]

    def cascade(self, name: str, style: str | None, table: str | None = None) -> dict[str, dict]:
        """Properties of one kind: defaults, then the table's style, then the style chain; per property the last wins."""
        if (name, style, table) not in self.styled:
            layers = [kid(self.defaults, f"{name}Default", name), *(kid(s, name) for s in self.chain(table)), *(kid(s, name) for s in self.chain(style))]
            self.styled[name, style, table] = self.over({}, layers)
        return self.styled[name, style, table]

    @staticmethod
    def over(props: dict[str, dict], layers: list[ET.Element | None]) -> dict[str, dict]:
        """``props`` with the properties of further layers laid over them."""
        out = dict(props)
        for layer in layers:
            for e in kids(layer):
                name = opc.local(e.tag)
                out[name] = out.get(name, {}) | ({opc.local(k): v for k, v in e.attrib.items()} or {"val": "1"})
        return out


    def list_levels(self, number: str) -> dict[int, tuple] | None:
        """(format, text, start) of each level of a list: its abstract definition's, or those of the list of the style that this one links to, and what the list overrides."""
        if number not in self.lists:
            num = next((n for n in kids(self.numbering, "num") if attr(n, "numId") == number), None)
            self.lists[number] = None  # a list that links to itself has none
            abstract = next((a for a in kids(self.numbering, "abstractNum") if num is not None and attr(a, "abstractNumId") == attr(kid(num, "abstractNumId"), "val")), None)
            link = attr(kid(self.styles.get(attr(kid(abstract, "numStyleLink"), "val")), "pPr", "numPr", "numId"), "val")
            found = self.list_levels(link) if link and link != number else None
            if found is None and abstract is not None:
                found = {}
                for x in kids(abstract, "lvl"):
                    found[int(attr(x, "ilvl", "0"))] = self.level_row(x)
                    self.list_props[number, int(attr(x, "ilvl", "0"))] = kid(x, "pPr")
            elif found is not None:
                self.list_props |= {(number, i): self.list_props.get((link, i)) for i in found}
            if found is not None:
                found = dict(found)
                for o in kids(num, "lvlOverride"):
                    i, start = int(attr(o, "ilvl", "0")), attr(kid(o, "startOverride"), "val")
                    if kid(o, "lvl") is not None:
                        found[i] = self.level_row(kid(o, "lvl"))
                        self.list_props[number, i] = kid(o, "lvl", "pPr")
                    if i in found and start.lstrip("-").isdigit():
                        found[i] = (*found[i][:2], int(start))
            self.lists[number] = found
        return self.lists[number]

    @staticmethod
    def level_row(e: ET.Element) -> tuple:
        start, text = attr(kid(e, "start"), "val"), kid(e, "lvlText")
        return (attr(kid(e, "numFmt"), "val") or "decimal", attr(text, "val").replace("\uf0b7", "•") if text is not None else None, int(start) if start.lstrip("-").isdigit() else 0)


#: Run properties that are switches.
_SWITCHES = ("b", "i", "strike", "dstrike", "caps", "smallCaps", "vanish", "outline", "shadow", "emboss")


class Story:
    """One flow of blocks: the body, a header, a note, a cell."""

    def __init__(self, doc: Document, part: str):
        self.doc, self.part, self.in_table = doc, part, None
        self.out: dict[str, list] = {k: [] for k in ("tracked_changes", "fields", "bookmarks", "hyperlinks", "content_controls", "images", "shapes", "text_boxes", "embedded_objects", "references", "breaks")}

    def format(self, run: ET.Element, style: str | None) -> dict:
        own = kid(run, "rPr")
        named = [kid(s, "rPr") for s in self.doc.chain(attr(kid(own, "rStyle"), "val") or None)] if own is not None else []
        props = self.doc.over(self.doc.cascade("rPr", style, self.in_table), [*named, own])
        value = lambda n: props.get(n, {}).get("val")
        out: dict = {k: True for k in _SWITCHES if k in props and value(k) not in ("0", "false", "off")}
        out["size"] = float(number(value("sz")) or 20) / 2
        for key, name in {"underline": "u", "color": "color", "highlight": "highlight", "vertical": "vertAlign"}.items():
            if value(name) not in (None, "none", "auto", "baseline"):
                out[key] = value(name)
        if font := props.get("rFonts", {}).get("ascii"):
            out["font"] = font
        return out

    def run_text(self, run: ET.Element) -> str:
        text = ""
        for e in kids(run):
            name = opc.local(e.tag)
            if name == "t":
                raw = e.text or ""
                text += raw if opc.attribute(e, "space") == "preserve" else raw.strip()
            elif name == "br" and attr(e, "type") in ("page", "column"):
                text += "\f"
            elif name in _MARKS:
                text += _MARKS[name]
            elif name == "sym":
                code = int(attr(e, "char", "0"), 16)
                text += "•" if code == 0xF0B7 else chr(code)
            elif name in ("drawing", "pict", "object"):
                text += OBJECT
                self.thing(e)
            elif name in ("footnoteReference", "endnoteReference", "commentReference"):
                self.out["references"].append((name.removesuffix("Reference"), attr(e, "id")))
        return text

    def thing(self, e: ET.Element) -> None:
        rels, blips, boxes = self.doc.rels.get(self.part, {}), [], []
        for x in e.iter():
            name = opc.local(x.tag)
            ref = rels.get(opc.attribute(x, "embed", "") or opc.attribute(x, "id", ""))
            if name in ("blip", "imagedata") and ref and ref[1] in self.doc.parts:
                blips.append(hashlib.sha256(self.doc.parts[ref[1]]).hexdigest())
            elif name == "txbxContent":
                boxes.append(x)
            elif name in ("OLEObject", "control", "chart") and ref and ref[1] in self.doc.parts:
                self.out["embedded_objects"].append({"kind": name, "digest": opc.payload_digest(self.doc.parts[ref[1]])})
        self.out["images"] += [{"digest": d} for d in blips]
        if not blips and opc.local(e.tag) == "drawing":
            geometry = next((attr(x, "prst") for x in e.iter() if opc.local(x.tag) == "prstGeom"), None)
            self.out["shapes"].append({"geometry": geometry})
        for box in boxes[:1]:
            self.out["text_boxes"].append([b.get("text") for b in self.blocks(box) if b["type"] == "paragraph"])

    def paragraph(self, p: ET.Element) -> dict:
        own = kid(p, "pPr")
        style = attr(kid(own, "pStyle"), "val") or None
        number, level = self.list_place(kid(own, "numPr"), style)
        listed = self.doc.list_props.get((number, level)) if number and self.doc.list_levels(number) else None
        props = self.doc.over(self.doc.cascade("pPr", style, self.in_table), [listed, own])
        runs: list[list] = []
        state = {"depth": 0, "code": "", "hidden": False, "link": None}

        def emit(text: str, form: dict | None) -> None:
            if not text:
                return
            form = None if not text.strip("\f\n" + OBJECT) else form
            if runs and runs[-1][1] == form:
                runs[-1][0] += text
            else:
                runs.append([text, form])

        def walk(e: ET.Element, change: tuple | None = None) -> None:
            for x in kids(e):
                name = opc.local(x.tag)
                if name == "r":
                    for f in kids(x, "fldChar"):
                        kind = attr(f, "fldCharType")
                        if kind == "begin":
                            state.update(depth=state["depth"] + 1, code="", hidden=True)
                        elif kind == "separate":
                            state["hidden"] = False
                        elif kind == "end":
                            self.field(state["code"])
                            state.update(depth=max(0, state["depth"] - 1), hidden=False)
                    state["code"] += "".join(i.text or "" for i in kids(x, "instrText"))
                    text = "" if state["hidden"] else self.run_text(x)
                    if change and change[0] in ("del", "moveFrom"):
                        self.change(*change, "".join(t.text or "" for t in kids(x, "delText", "t")), len(runs))
                        continue
                    if change:
                        self.change(*change, text, len(runs))
                    emit(text, self.format(x, style))
                elif name in ("ins", "del", "moveTo", "moveFrom"):
                    walk(x, (name, attr(x, "author")))
                elif name == "hyperlink":
                    _, target, _ = self.doc.rels.get(self.part, {}).get(opc.attribute(x, "id", ""), ("", None, True))
                    text = "".join(t.text or "" for t in x.iter() if opc.local(t.tag) == "t")
                    self.out["hyperlinks"].append({"target": target, "anchor": attr(x, "anchor") or None, "text": text})
                    walk(x, change)
                elif name == "fldSimple":
                    self.field(attr(x, "instr"))
                    walk(x, change)
                elif name == "sdt":
                    self.control(x)
                    walk(kid(x, "sdtContent") if kid(x, "sdtContent") is not None else ET.Element("x"), change)
                elif name == "bookmarkStart":
                    self.out["bookmarks"].append(attr(x, "name"))
                elif name in ("smartTag", "customXml", "dir", "bdo"):
                    walk(x, change)

        walk(p)
        indent, spacing = props.get("ind", {}), props.get("spacing", {})
        hanging = twips(indent.get("hanging"))
        shown = {
            "alignment": props.get("jc", {}).get("val", "left"),
            "indent": {"left": twips(indent.get("left") or indent.get("start")) or 0, "right": twips(indent.get("right") or indent.get("end")) or 0, "first_line": -hanging if hanging else twips(indent.get("firstLine")) or 0},
            "spacing": {"before": twips(spacing.get("before")) or 0, "after": twips(spacing.get("after")) or 0, "line": twips(spacing.get("line")) or 240, "line_rule": spacing.get("lineRule", "auto")},
            "keep_next": "keepNext" in props, "keep_lines": "keepLines" in props, "page_break_before": "pageBreakBefore" in props, "widow_control": props.get("widowControl", {}).get("val", "1") not in ("0", "false", "off"),
        }
        return {"type": "paragraph", "style": style, "props": shown, "numbering": self.list_level(number, level), "text": "".join(t for t, _ in runs), "runs": [{"text": t, "format": f} for t, f in runs]}

    def list_place(self, e: ET.Element | None, style: str | None) -> tuple[str | None, int]:
        """The list and the level of a paragraph, by its own properties or else its style's."""
        given = [e, *(kid(x, "pPr", "numPr") for x in reversed(self.doc.chain(style)))]
        own = lambda name: next((attr(k, "val") for x in given if (k := kid(x, name)) is not None), None)
        number = own("numId")
        return (None if number == "0" else number), int(own("ilvl") or 0)

    def list_level(self, number: str | None, level: int) -> dict | None:
        """What a list shows at a level; ``definition`` names all its levels."""
        levels = self.doc.list_levels(number) if number else None
        if levels is None:
            return None
        shown = levels.get(level, (None, None, None))
        return {"definition": key_of(sorted(levels.items())), "level": level, "format": shown[0], "text": shown[1]}

    def field(self, code: str) -> None:
        words = re.sub(r"\\\* MERGEFORMAT", "", code, flags=re.I).split()
        if words:
            self.out["fields"].append(" ".join([words[0].upper(), *words[1:]]))
            if words[0].upper() == "HYPERLINK" and (m := re.search(r'"([^"]*)"', code)):
                self.out["hyperlinks"].append({"target": None if "\\l" in code else m[1], "anchor": m[1] if "\\l" in code else None, "text": None})

    def change(self, kind: str, author: str, text: str, at: int) -> None:
        found = self.out["tracked_changes"]
        if found and (found[-1]["kind"], found[-1]["author"], found[-1]["_at"]) == (kind, author, at) and kind in ("del", "moveFrom"):
            found[-1]["text"] += text
        elif found and (found[-1]["kind"], found[-1]["author"]) == (kind, author) and kind in ("ins", "moveTo") and found[-1]["_at"] >= at - 1:
            found[-1]["text"] += text
            found[-1]["_at"] = at
        else:
            found.append({"kind": kind, "author": author, "text": text, "_at": at})

    def control(self, e: ET.Element) -> None:
        p = kid(e, "sdtPr")
        kinds = [opc.local(x.tag) for x in kids(p) if opc.local(x.tag) in ("text", "richText", "comboBox", "dropDownList", "date", "checkbox", "picture")]
        self.out["content_controls"].append({"tag": attr(kid(p, "tag"), "val") or None, "alias": attr(kid(p, "alias"), "val") or None, "kind": kinds[0] if kinds else "richText"})

    def table(self, t: ET.Element) -> dict:
        """Rows of cells with their spans; a cell that continues one above counts towards its origin."""
        rows, origins, outer = [], {}, self.in_table
        style = self.in_table = attr(kid(t, "tblPr", "tblStyle"), "val") or None
        for r in kids(t, "tr"):
            column, cells = int(attr(kid(r, "trPr", "gridBefore"), "val", "0")), []
            for c in kids(r, "tc"):
                p = kid(c, "tcPr")
                span, merge = int(attr(kid(p, "gridSpan"), "val", "1")), kid(p, "vMerge")
                origin = origins.get(column)
                if merge is not None and attr(merge, "val", "continue") != "restart" and origin is not None and origin["colspan"] == span:
                    origin["rowspan"] += 1
                else:
                    cell = {"column": column, "colspan": span, "rowspan": 1, "shading": attr(kid(p, "shd"), "fill") or None, "blocks": self.blocks(c), "_own": kid(p, "tcBorders")}
                    cells.append(cell)
                    origins[column] = cell if merge is not None else None
                column += span
            rows.append({"repeat_header": bool(on(kid(r, "trPr", "tblHeader"))), "cells": cells})
        self.in_table = outer
        self.draw(rows, [*(kid(x, "tblPr", "tblBorders") for x in self.doc.chain(style)), kid(t, "tblPr", "tblBorders")])
        grid = [twips(attr(g, "w")) for g in kids(kid(t, "tblGrid"), "gridCol")]
        return {"type": "table", "style": style, "grid": grid, "rows": rows}

    @staticmethod
    def draw(rows: list[dict], layers: list[ET.Element | None]) -> None:
        """Gives each cell the lines on its sides: its own, else those of the table's edge or of its inside."""
        line = lambda e: {"style": attr(e, "val"), "size": int(attr(e, "sz") or 0), "color": attr(e, "color") or "auto"}
        named = lambda e: {"start": "left", "end": "right"}.get(opc.local(e.tag), opc.local(e.tag))
        table = {named(e): line(e) for layer in layers for e in kids(layer)}
        width = max((c["column"] + c["colspan"] for r in rows for c in r["cells"]), default=0)
        for i, r in enumerate(rows):
            for c in r["cells"]:
                edge = {"top": i == 0, "bottom": i + c["rowspan"] >= len(rows), "left": c["column"] == 0, "right": c["column"] + c["colspan"] == width}
                own = {named(e): line(e) for e in kids(c.pop("_own"))}
                drawn = {side: own.get(side) or table.get(side if at else "insideH" if side in ("top", "bottom") else "insideV") for side, at in edge.items()}
                c["borders"] = {side: x for side, x in drawn.items() if x and x["style"] not in ("nil", "none", "")}

    def blocks(self, e: ET.Element) -> list[dict]:
        out = []
        for x in kids(e):
            name = opc.local(x.tag)
            if name == "p":
                out.append(self.paragraph(x))
                if (s := kid(x, "pPr", "sectPr")) is not None:
                    out.append({"type": "section_break"})
                    self.out["breaks"].append(s)
            elif name == "tbl":
                out.append(self.table(x))
            elif name == "sdt":
                self.control(x)
                out += self.blocks(kid(x, "sdtContent") if kid(x, "sdtContent") is not None else ET.Element("x"))
            elif name in ("ins", "moveTo", "customXml"):
                out += self.blocks(x)
            elif name == "bookmarkStart":
                self.out["bookmarks"].append(attr(x, "name"))
            elif name == "altChunk":
                ref = self.doc.rels.get(self.part, {}).get(opc.attribute(x, "id", ""))
                if ref and ref[1] in self.doc.parts:
                    self.out["embedded_objects"].append({"kind": "altChunk", "digest": opc.payload_digest(self.doc.parts[ref[1]])})
        return out


def texts(doc: Document, part: str, e: ET.Element) -> str:
    return "\n".join(b["text"] for b in Story(doc, part).blocks(e) if b["type"] == "paragraph")


def extract(content: bytes) -> dict[str, object]:
    """Feature -> value of a document; raises ValueError for what is none."""
    doc = Document(content)
    body, story = kid(doc.root, "body"), Story(doc, doc.main)
    model: dict[str, object] = {"body": story.blocks(body) if body is not None else []}
    breaks = [*story.out.pop("breaks"), *([s] if (s := kid(body, "sectPr")) is not None else [])]
    sections, heads, carried = [], [], {}
    for i, s in enumerate(breaks):
        size, margins = kid(s, "pgSz"), kid(s, "pgMar")
        sections.append({
            "break": (attr(kid(s, "type"), "val") or "nextPage") if i else None, "width": twips(attr(size, "w")), "height": twips(attr(size, "h")), "orientation": attr(size, "orient", "portrait"),
            "margins": {opc.local(k): twips(v) for k, v in (margins.attrib if margins is not None else {}).items()}, "columns": int(attr(kid(s, "cols"), "num", "1")), "title_page": bool(on(kid(s, "titlePg"))),
        })
        for ref in kids(s, "headerReference", "footerReference"):
            kind = (opc.local(ref.tag).removesuffix("Reference"), attr(ref, "type", "default"))
            target = doc.rels.get(doc.main, {}).get(opc.attribute(ref, "id", ""), ("", "", False))[1]
            carried[kind] = texts(doc, target, opc.parse(doc.parts[target])) if target in doc.parts else None
        heads.append({f"{a}/{b}": t for (a, b), t in sorted(carried.items())})
    model["sections"], model["headers_footers"] = sections, heads
    references = story.out.pop("references")
    for kind in ("footnote", "endnote"):
        target = (doc.targets(f"{kind}s") or [""])[0]
        notes = {attr(n, "id"): n for n in kids(opc.parse(doc.parts[target]) if target else None, kind)}
        model[f"{kind}s"] = [texts(doc, target, notes[i]) if i in notes else None for k, i in references if k == kind]
    target = (doc.targets("comments") or [""])[0]
    noted = {attr(n, "id"): n for n in kids(opc.parse(doc.parts[target]) if target else None, "comment")}
    model["comments"] = [{"author": attr(noted[i], "author"), "text": texts(doc, target, noted[i])} if i in noted else None for k, i in references if k == "comment"]
    story.out["tracked_changes"] = [{k: v for k, v in c.items() if k != "_at"} for c in story.out["tracked_changes"]]
    model |= story.out
    model["bookmarks"] = sorted(set(story.out["bookmarks"]) - {"_GoBack"})
    model["styles"] = sorted({attr(kid(s, "name"), "val") for s in doc.styles.values()})
    core = doc.part_of("core-properties", "")
    model["core_properties"] = {opc.local(e.tag): e.text for e in kids(core) if e.text and opc.local(e.tag) not in opc.VOLATILE}
    model["custom_properties"] = {attr(e, "name"): typed(next(iter(e), None)) for e in kids(doc.part_of("custom-properties", ""))}
    model["custom_xml"] = sorted(opc.canonical(doc.parts[t]) for t in doc.targets("customXml"))
    model["glossary"] = sorted("".join(t.text or "" for t in d.iter() if opc.local(t.tag) == "t") for d in kids(kid(doc.part_of("glossaryDocument"), "docParts"), "docPart"))
    return model


def typed(e: ET.Element | None) -> dict | None:
    if e is None:
        return None
    kind, text = opc.local(e.tag), e.text or ""
    if kind in ("i1", "i2", "i4", "i8", "int", "r4", "r8", "decimal"):
        n = number(text)
        return {"type": "number", "value": int(n) if n is not None and n == int(n) else n}
    if kind == "bool":
        return {"type": "boolean", "value": text in ("1", "true")}
    return {"type": {"lpwstr": "string", "lpstr": "string", "bstr": "string", "filetime": "date"}.get(kind, "other"), "value": text}


def edit_target(content: bytes) -> dict | None:
    """The first paragraph of the body with a run of its own that has text: (paragraph, run)."""
    doc = Document(content)
    for i, p in enumerate(kids(kid(doc.root, "body"), "p")):
        for j, r in enumerate(kids(p, "r")):
            if any((t.text or "") for t in kids(r, "t")):
                return {"paragraph": i, "run": j, "part": doc.main}
    return None


def set_run_text(root: ET.Element, target: dict, text: str) -> None:
    run = kids(kids(kid(root, "body"), "p")[target["paragraph"]], "r")[target["run"]]
    _replace_text(run, text)


def _replace_text(run: ET.Element, text: str) -> None:
    found = kids(run, "t")
    for extra in found[1:]:
        run.remove(extra)
    found[0].text = text
    found[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def apply_edit(content: bytes, target: dict, text: str) -> bytes:
    package = opc.read_package(content, "last")
    root = opc.parse(package.parts[target["part"]])
    set_run_text(root, target, text)
    return opc.replace_member(content, package.members[target["part"]], ET.tostring(root, "utf-8", xml_declaration=True))


MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def paragraph_markup(text: str) -> str:
    return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def table_markup(rows: list[list[str]]) -> str:
    cells = lambda r: "".join(f"<w:tc><w:tcPr/>{paragraph_markup(x)}</w:tc>" for x in r)
    return f"<w:tbl><w:tblPr/><w:tblGrid/>{''.join(f'<w:tr>{cells(r)}</w:tr>' for r in rows)}</w:tbl>"


def write(body: str, more: dict[str, str] | None = None, rels: str = "") -> bytes:
    """A document of body markup, and further parts."""
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{MAIN}" xmlns:r="{_REL}"><w:body>{body}</w:body></w:document>',
    }
    if rels:
        parts["word/_rels/document.xml.rels"] = f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{rels}</Relationships>'
    return opc.write_package(parts | (more or {}))
