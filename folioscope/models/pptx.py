"""The presentation model: slides in order, shapes with what they inherit, and what hangs on them."""

from __future__ import annotations

import hashlib
import math
import re
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from folioscope.functions.drawing import guides, modified, scaled
from folioscope.models.docx import _replace_text
from folioscope.models.xlsx import attr, chart, dump, kid, kids
from folioscope.sources import opc


class Deck:
    def __init__(self, content: bytes):
        package = opc.read_package(content, "first")
        if package.error or opc.CONTENT_TYPES not in package.parts:
            raise ValueError(package.error or "missing content types")
        self.parts, self.rels = package.parts, {}
        for source, rel_id, kind, target, external in opc.relationships(self.parts):
            self.rels.setdefault(source, {})[rel_id] = (kind, target, external)
        mains = [t for k, t, x in self.rels.get("", {}).values() if k == "officeDocument" and t in self.parts]
        if not mains:
            raise ValueError("no presentation")
        self.main = mains[-1]
        self.root = opc.parse(self.parts[self.main])
        ids = [_rel_id(e) for e in kids(kid(self.root, "sldIdLst"), "sldId")]
        self.slides = [t for i in ids if (t := self.rels.get(self.main, {}).get(i, ("", "", False))[1]) in self.parts]

    def target(self, source: str, kind: str) -> str | None:
        return next(iter(sorted(t for k, t, x in self.rels.get(source, {}).values() if k == kind and not x and t in self.parts)), None)

    def targets(self, source: str, kind: str) -> list[str]:
        return sorted(t for k, t, x in self.rels.get(source, {}).values() if k == kind and not x and t in self.parts)

    def xml(self, part: str | None) -> ET.Element | None:
        return opc.parse(self.parts[part]) if part else None


def _rel_id(e: ET.Element) -> str:
    """The relationship id, which shares its local name with the slide's own id."""
    return next((v for k, v in e.attrib.items() if "}" in k and opc.local(k) == "id"), "")


_SHAPES = ("sp", "cxnSp", "pic", "grpSp", "graphicFrame", "contentPart")


def placeholder(e: ET.Element) -> ET.Element | None:
    for child in kids(e):
        if opc.local(child.tag).startswith("nv"):
            return kid(child, "nvPr", "ph")
    return None


def inherited(deck: Deck, shape: ET.Element, layers: list[ET.Element | None]) -> list[ET.Element]:
    """The shapes of the layout and the master that a placeholder takes after: by index, then by type, titles alike."""
    ph = placeholder(shape)
    if ph is None:
        return []
    kind = ph.get("type", "obj")
    fold = lambda k: "title" if k in ("title", "ctrTitle") else "body" if k in ("obj", "subTitle", "body") else k
    out = []
    for depth, layer in enumerate(layers):
        rows = [(s, p) for s in kids(kid(layer, "cSld", "spTree"), "sp", "pic") if (p := placeholder(s)) is not None]
        by_index = [s for s, p in rows if not depth and ph.get("idx") is not None and p.get("idx") == ph.get("idx")]
        by_type = [s for s, p in rows if p.get("type", "obj") == kind]
        by_fold = [s for s, p in rows if fold(p.get("type", "obj")) == fold(kind)]
        if found := by_index or by_type or by_fold:
            out.append(found[0])
    return out


def number(e: ET.Element | None, name: str) -> float:
    return float(attr(e, name, "0"))


#: A map of group space to slide space: x' = a x + c y + e, y' = b x + d y + f; and the rotation and mirroring so far.
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def compose(m, n):
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n
    return (a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f)


def group_map(x: ET.Element | None):
    """From a group's child space to the space the group stands in."""
    off, ext, ch_off, ch_ext = (kid(x, n) for n in ("off", "ext", "chOff", "chExt"))
    if off is None or ch_off is None:
        return IDENTITY
    sx = number(ext, "cx") / number(ch_ext, "cx") if number(ch_ext, "cx") else 1.0
    sy = number(ext, "cy") / number(ch_ext, "cy") if number(ch_ext, "cy") else 1.0
    scale = (sx, 0, 0, sy, number(off, "x") - sx * number(ch_off, "x"), number(off, "y") - sy * number(ch_off, "y"))
    cx, cy = number(off, "x") + number(ext, "cx") / 2, number(off, "y") + number(ext, "cy") / 2
    t = math.radians(number(x, "rot") / 60000)
    flip = (-1 if attr(x, "flipH") in ("1", "true") else 1, -1 if attr(x, "flipV") in ("1", "true") else 1)
    turn = (math.cos(t) * flip[0], math.sin(t) * flip[0], -math.sin(t) * flip[1], math.cos(t) * flip[1], 0.0, 0.0)
    return compose(compose(compose((1, 0, 0, 1, cx, cy), turn), (1, 0, 0, 1, -cx, -cy)), scale)


def geometry(x: ET.Element | None, space) -> dict | None:
    """Centre, size and rotation in slide space, in whole units."""
    off, ext = kid(x, "off"), kid(x, "ext")
    if off is None or ext is None:
        return None
    a, b, c, d, e, f = space
    mx, my = number(off, "x") + number(ext, "cx") / 2, number(off, "y") + number(ext, "cy") / 2
    mirrored = a * d - b * c < 0
    turn = math.degrees(math.atan2(b, a)) * 60000 if not mirrored else math.degrees(math.atan2(-b, -a)) * 60000
    own = number(x, "rot")
    w, h = number(ext, "cx") * math.hypot(a, b), number(ext, "cy") * math.hypot(c, d)
    cx, cy = a * mx + c * my + e, b * mx + d * my + f
    flipped = mirrored != ((attr(x, "flipH") in ("1", "true")) != (attr(x, "flipV") in ("1", "true")))
    return {"x": round(cx - w / 2), "y": round(cy - h / 2), "cx": round(w), "cy": round(h), "rot": round((turn + (-own if mirrored else own)) % 21_600_000), "flipped": flipped}


#: Names of the colour map's default.
_MAPPED = {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"}


def theme_colors(deck: Deck, master: str | None, *overrides: ET.Element | None) -> dict[str, str]:
    """The theme's colours by their own names, and by the names that the master's map, or that of a layout or slide, gives them."""
    scheme = kid(deck.xml(deck.target(master, "theme") if master else None), "themeElements", "clrScheme")
    named = {opc.local(c.tag): next((attr(v, "lastClr") or attr(v, "val") for v in c), "") for c in kids(scheme)}
    names = dict(_MAPPED)
    for e in (kid(deck.xml(master), "clrMap"), *(kid(x, "clrMapOvr", "overrideClrMapping") for x in overrides)):
        names |= e.attrib if e is not None else {}
    return named | {k: named[v] for k, v in names.items() if v in named}


def color(e: ET.Element | None, colors: dict[str, str], own: str | None = None) -> str | None:
    """A colour as RGB, its modifiers applied in order; a name that no theme resolves stays a name.

    ``own`` is what stands for the colour of the shape in a theme's format.
    """
    for x in kids(e):
        name = opc.local(x.tag)
        if not name.endswith("Clr"):
            continue
        value, steps = attr(x, "val"), [(opc.local(m.tag), int(attr(m, "val", "0"))) for m in kids(x)]
        if value == "phClr" and own is not None:
            if not steps:
                return own
            base = own[:6]
        else:
            base = {"srgbClr": value.upper(), "schemeClr": colors.get(value, value), "sysClr": attr(x, "lastClr") or value}.get(name, value)
        if re.fullmatch("[0-9A-Fa-f]{6}", base):
            return modified(base.upper(), steps)
        return base + "".join(f"|{n}={v}" for n, v in steps)
    return None


def fill_of(x: ET.Element, colors: dict[str, str], own: str | None = None) -> dict | None:
    """What a fill element paints; null for other elements."""
    name = opc.local(x.tag)
    if name == "noFill":
        return {"kind": "none"}
    if name == "solidFill":
        return {"kind": "solid", "color": color(x, colors, own)}
    if name == "gradFill":
        turn = kid(x, "lin")
        stops = [{"at": attr(g, "pos"), "color": color(g, colors, own)} for g in kids(kid(x, "gsLst"), "gs")]
        return {"kind": "gradient", "stops": stops} | ({"linear": int(attr(turn, "ang", "0"))} if turn is not None else {}) | ({"path": attr(kid(x, "path"), "path")} if kid(x, "path") is not None else {})
    if name == "pattFill":
        return {"kind": name, "pattern": attr(x, "prst") or None, "fg": color(kid(x, "fgClr"), colors, own), "bg": color(kid(x, "bgClr"), colors, own)}
    if name == "blipFill":
        return {"kind": name, "mode": "tile" if kid(x, "tile") is not None else "stretch", "crop": [int(attr(kid(x, "srcRect"), k, "0")) for k in "ltrb"]}
    return {"kind": name} if name == "grpFill" else None


def fill(e: ET.Element | None, colors: dict[str, str]) -> dict | None:
    return next((f for x in kids(e) if (f := fill_of(x, colors)) is not None), None)


def outline(e: ET.Element | None, box: dict | None) -> list[dict] | None:
    """The paths of a geometry of its own, in units of the shape: commands with their points, arcs with radii and angles."""
    if e is None or box is None:
        return None
    known = guides([(attr(g, "name"), attr(g, "fmla")) for n in ("avLst", "gdLst") for g in kids(kid(e, n), "gd")], box["cx"], box["cy"])
    out = []
    for path in kids(kid(e, "pathLst"), "path"):
        own = [int(attr(path, k, "0")) for k in ("w", "h")]
        sx, sy = (size / n if n else 1.0 for size, n in zip((box["cx"], box["cy"]), own))
        steps = []
        for x in kids(path):
            step: dict = {"do": opc.local(x.tag)}
            if points := [{"x": scaled(attr(p, "x"), known, sx), "y": scaled(attr(p, "y"), known, sy)} for p in kids(x, "pt")]:
                step["points"] = points
            step |= {k: scaled(attr(x, k), known, {"wR": sx, "hR": sy}.get(k, 1.0)) for k in ("wR", "hR", "stAng", "swAng") if attr(x, k)}
            steps.append(step)
        out.append({"steps": steps} | {k: attr(path, k) for k in ("fill", "stroke") if attr(path, k)})
    return out


class Theme:
    """The formats of a theme that shapes refer to by number, one for each weight: 0 is none, and backgrounds follow 1000."""

    def __init__(self, root: ET.Element | None, colors: dict[str, str]):
        lists = kid(root, "themeElements", "fmtScheme")
        self.colors = colors
        self.fills, self.lines, self.backs = (kids(kid(lists, n)) for n in ("fillStyleLst", "lnStyleLst", "bgFillStyleLst"))

    def _at(self, rows: list[ET.Element], ref: ET.Element | None, base: int = 0) -> ET.Element | None:
        n = int(attr(ref, "idx", "0")) - base if attr(ref, "idx", "0").isdigit() else 0
        return rows[n - 1] if 0 < n <= len(rows) else None

    def fill(self, ref: ET.Element | None) -> dict | None:
        if ref is None:
            return None
        back = attr(ref, "idx", "0").isdigit() and int(attr(ref, "idx", "0")) > 1000
        found = self._at(self.backs, ref, 1000) if back else self._at(self.fills, ref)
        return {"kind": "none"} if found is None else fill_of(found, self.colors, color(ref, self.colors))

    def line(self, ref: ET.Element | None) -> tuple[ET.Element | None, str | None]:
        """The line element that a reference names, and the colour that it is drawn in."""
        return self._at(self.lines, ref), color(ref, self.colors)


def line_of(layers: list[tuple[ET.Element | None, str | None]], colors: dict[str, str]) -> dict | None:
    """Each property of a line from the first of its layers (element, own colour) that has it; without a layer there is no line."""
    some = [(e, own) for e, own in layers if e is not None]
    if not some:
        return None
    drawn = next((f for e, own in some for x in kids(e) if (f := fill_of(x, colors, own)) is not None), None)
    if not drawn or drawn["kind"] == "none":
        return {"fill": drawn}
    first = lambda get: next((v for e, _ in some if (v := get(e))), None)
    ends = {k: t for k in ("headEnd", "tailEnd") if (t := first(lambda e: attr(kid(e, k), "type"))) and t != "none"}  # noqa: B023
    return {"fill": drawn, "width": int(first(lambda e: attr(e, "w")) or "9525"), "dash": first(lambda e: attr(kid(e, "prstDash"), "val")) or "solid"} | ends


def run_format(deck: Deck, run: ET.Element, level: int, sources: list[ET.Element | None], colors: dict[str, str]) -> dict:
    """Each property from the first of: the run, the paragraph's level in the shape, its layout, its master, the master's text styles, and the presentation's."""
    layers = [kid(run, "rPr")]
    for s in sources:
        for owner in (kid(s, "txBody", "lstStyle"), s if s is not None and opc.local(s.tag).endswith("Style") else None):
            layers.append(kid(owner, f"lvl{level + 1}pPr", "defRPr"))
    layers.append(kid(deck.root, "defaultTextStyle", f"lvl{level + 1}pPr", "defRPr"))
    first = lambda name: next((x.get(name) for x in layers if x is not None and x.get(name) is not None), None)
    on = lambda name: first(name) in ("1", "true")
    face = next((attr(f, "typeface") for x in layers if (f := kid(x, "latin")) is not None), None)
    shade = next((c for x in layers if (c := fill(x, colors)) is not None), None)
    return {"size": int(first("sz") or 1800), "bold": on("b"), "italic": on("i"), "underline": (first("u") or "none") != "none", "font": face, "color": shade}


#: Fixed value: code points of symbol fonts, which stand for those 0xF000 below.
_SYMBOLS = {c: c - 0xF000 for c in range(0xF020, 0xF100)}


def link_target(deck: Deck, part: str, click: ET.Element | None) -> str | None:
    """Where a click leads: an action and a target, a slide by its number, a part by its digest, a file with plain slashes."""
    if click is None:
        return None
    action, rel = attr(click, "action"), deck.rels.get(part, {}).get(_rel_id(click))
    target = ""
    if rel is not None:
        kind, found, external = rel
        if external:
            target = unquote(found.strip())
            target = target.replace("\\", "/") if target[:5].lower() == "file:" else target
        elif found in deck.slides:
            target = f"slide:{deck.slides.index(found) + 1}"
        else:
            target = f"{kind}:{hashlib.sha256(deck.parts[found]).hexdigest() if found in deck.parts else 'missing'}"
    return "|".join(x for x in (action, target) if x) if action else target or None


def paragraphs(deck: Deck, part: str, shape: ET.Element, sources: list[ET.Element | None], colors: dict[str, str], links: list) -> list[dict]:
    out = []
    for p in kids(kid(shape, "txBody"), "p"):
        own = kid(p, "pPr")
        level, runs, linked = int(attr(own, "lvl", "0")), [], False
        for r in kids(p, "r", "br", "fld"):
            name = opc.local(r.tag)
            text = "\v" if name == "br" else "".join(t.text or "" for t in kids(r, "t"))
            text = text.translate(_SYMBOLS) if kid(r, "rPr", "sym") is not None else text
            form = run_format(deck, r, level, [shape, *sources], colors)
            click = kid(r, "rPr", "hlinkClick")
            target = link_target(deck, part, click)
            if target is not None and links and linked and links[-1]["target"] == target:
                links[-1]["text"] += text  # a link over neighbouring runs is one
            elif target is not None:
                links.append({"text": text, "target": target})
            linked = target is not None
            key = [form, target, attr(r, "type") if name == "fld" else None]
            if not text:
                continue
            if runs and runs[-1][1] == key and name != "fld":
                runs[-1][0] += text
            else:
                runs.append([text, key])
        bullet = None
        if runs and own is not None:
            bullet = next((opc.local(b.tag) + (":" + attr(b, "char").translate(_SYMBOLS) if attr(b, "char") else "") for b in kids(own, "buChar", "buAutoNum", "buNone", "buBlip")), None)
        out.append({"level": level, "align": attr(own, "algn", "l"), "bullet": bullet, "text": "".join(t for t, _ in runs), "runs": [{"text": t, "format": k[0], "link": k[1], "field": k[2]} for t, k in runs]})
    return out


class Slide:
    def __init__(self, deck: Deck, part: str):
        self.deck, self.part = deck, part
        self.layout = deck.target(part, "slideLayout")
        self.master = deck.target(self.layout, "slideMaster") if self.layout else None
        self.layers = [deck.xml(self.layout), deck.xml(self.master)]
        self.colors = theme_colors(deck, self.master, self.layers[0], deck.xml(part))
        self.theme = Theme(deck.xml(deck.target(self.master, "theme") if self.master else None), self.colors)
        self.links: list[dict] = []
        self.media: dict[str, str] = {}

    def shape(self, e: ET.Element, space=IDENTITY) -> dict:
        kind = opc.local(e.tag)
        info = next((kid(c, "cNvPr") for c in kids(e) if opc.local(c.tag).startswith("nv")), None)
        above = inherited(self.deck, e, self.layers)
        props = kid(e, "grpSpPr") if kind == "grpSp" else kid(e, "spPr")
        x = kid(e, "xfrm") if kind == "graphicFrame" else kid(props, "xfrm")
        if x is None:
            x = next((y for s in above if (y := kid(s, "spPr", "xfrm")) is not None), None)
        ph = placeholder(e)
        out: dict = {
            "kind": kind, "name": attr(info, "name"), "hidden": attr(info, "hidden") in ("1", "true"), "alt_text": attr(info, "descr") or None,
            "placeholder": {"type": ph.get("type", "obj"), "idx": ph.get("idx")} if ph is not None else None,
            "geometry": None if kind == "grpSp" else geometry(x, space), "preset": None,
            "fill": fill(props, self.colors) or next((f for s in above if (f := fill(kid(s, "spPr"), self.colors))), None) or self.theme.fill(kid(e, "style", "fillRef")),
        }
        shaped = kid(props, "prstGeom")
        if shaped is not None:
            moved = {attr(g, "name"): attr(g, "fmla").removeprefix("val ") for g in kids(kid(shaped, "avLst"), "gd")}
            out["preset"] = {"name": attr(shaped, "prst"), "adjusted": moved} if moved else attr(shaped, "prst")
        else:
            out["preset"] = outline(kid(props, "custGeom"), out["geometry"])
        line = line_of([(kid(props, "ln"), None), *((kid(s, "spPr", "ln"), None) for s in above), self.theme.line(kid(e, "style", "lnRef"))], self.colors)
        if line is not None:
            out["line"] = line
        if kid(e, "txBody") is not None:
            role = (ph.get("type", "obj") if ph is not None else "other").lower()
            style = kid(self.layers[1], "txStyles", "titleStyle" if "title" in role and role != "subtitle" else "bodyStyle" if ph is not None else "otherStyle")
            out["paragraphs"] = paragraphs(self.deck, self.part, e, [*above, style], self.colors, self.links)
        rels = self.deck.rels.get(self.part, {})
        for x in e.iter() if kind != "grpSp" else ():
            name = opc.local(x.tag)
            ref = rels.get(opc.attribute(x, "embed", "") or opc.attribute(x, "link", "") or _rel_id(x))
            if not ref:
                continue
            inside = ref[1] in self.deck.parts
            if name == "blip" and inside:
                out["picture"] = hashlib.sha256(self.deck.parts[ref[1]]).hexdigest()
            elif name in ("videoFile", "audioFile", "media", "wavAudioFile"):
                digest = hashlib.sha256(self.deck.parts[ref[1]]).hexdigest() if inside else ref[1]
                self.media[digest] = name if name != "media" else self.media.get(digest, name)
            elif name == "chart" and inside:
                out["chart"] = chart(self.deck.xml(ref[1]))
            elif name == "oleObj" and inside:
                out["object"] = opc.payload_digest(self.deck.parts[ref[1]])
        data = next((rels[i][1] for x in e.iter() if opc.local(x.tag) == "relIds" for k, i in x.attrib.items() if opc.local(k) == "dm" and i in rels), None)
        if data in self.deck.parts and kind == "graphicFrame":
            out["smartart"] = smart_tree(self.deck.xml(data))
        table = kid(e, "graphic", "graphicData", "tbl")
        if table is not None:
            out["table"] = [[{"text": "\n".join(p["text"] for p in paragraphs(self.deck, self.part, c, [], self.colors, self.links)), "colspan": int(c.get("gridSpan", "1")), "rowspan": int(c.get("rowSpan", "1"))} for c in kids(r, "tc") if c.get("hMerge") not in ("1", "true") and c.get("vMerge") not in ("1", "true")] for r in kids(table, "tr")]
        if kind == "grpSp":
            inner = compose(space, group_map(kid(props, "xfrm")))
            out["children"] = [self.shape(c, inner) for c in kids(e, *_SHAPES)]
        return out

    def model(self) -> dict:
        root, deck = self.deck.xml(self.part), self.deck
        tree = kid(root, "cSld", "spTree")
        shapes = [self.shape(e) for e in kids(tree, *_SHAPES)]
        notes = deck.xml(deck.target(self.part, "notesSlide"))
        body = [s for s in kids(kid(notes, "cSld", "spTree"), "sp") if (p := placeholder(s)) is not None and p.get("type") == "body"]
        text = "\n".join("".join(t.text or "" for t in p.iter() if opc.local(t.tag) == "t") for s in body for p in kids(kid(s, "txBody"), "p")).strip()
        transition = kid(root, "transition")
        effect = next(iter(kids(transition)), None)
        timing = kid(root, "timing")
        moves = [attr(x, "presetID") or opc.local(x.tag) for x in (timing.iter() if timing is not None else ()) if attr(x, "presetID") or opc.local(x.tag) in ("anim", "animEffect", "animMotion", "animScale", "animRot", "set")]
        layout, master = self.layers
        return {
            "hidden": attr(root, "show", "1") in ("0", "false"), "layout": attr(kid(layout, "cSld"), "name") or None, "master": self.deck.rels.get(self.master or "", {}) and attr(kid(master, "cSld"), "name") or None,
            "background": next((f for x in (root, *self.layers) if (f := fill(kid(x, "cSld", "bg", "bgPr"), self.colors) or self.theme.fill(kid(x, "cSld", "bg", "bgRef")))), None), "shapes": shapes, "hyperlinks": self.links, "notes": text or None,
            "comments": [{"text": "".join(t.text or "" for t in c.iter() if opc.local(t.tag) in ("text", "t"))} for t in deck.targets(self.part, "comments") for c in kids(deck.xml(t), "cm")],
            "transition": {"effect": opc.local(effect.tag), "speed": attr(transition, "spd", "fast")} if effect is not None else None, "animation": moves or None, "media": sorted(self.media.items()),
        }


def smart_tree(root: ET.Element) -> list:
    """Points as a tree of texts along parent links, in source order; a point met before ends its branch."""
    points = {attr(p, "modelId"): p for p in kids(kid(root, "ptLst"), "pt")}
    links: dict[str, list] = {}
    for c in kids(kid(root, "cxnLst"), "cxn"):
        if attr(c, "type", "parOf") == "parOf":
            links.setdefault(attr(c, "srcId"), []).append((int(attr(c, "srcOrd", "0")), attr(c, "destId")))
    seen: set[str] = set()

    def node(i: str) -> dict | None:
        if i in seen or i not in points or attr(points[i], "type", "node") not in ("node", "asst", "doc"):
            return None
        seen.add(i)
        text = "".join(t.text or "" for t in points[i].iter() if opc.local(t.tag) == "t")
        return {"text": text, "children": [n for _, j in sorted(links.get(i, [])) if (n := node(j))]}

    return [n for i, p in points.items() if attr(p, "type", "node") == "doc" and (n := node(i))]


def extract(content: bytes) -> dict[str, object]:
    """Feature -> value of a presentation; raises ValueError for what is none."""
    deck = Deck(content)
    size = kid(deck.root, "sldSz")
    masters = [deck.rels[deck.main][i][1] for i in map(_rel_id, kids(kid(deck.root, "sldMasterIdLst"), "sldMasterId")) if i in deck.rels.get(deck.main, {})]
    named = lambda part: {"name": attr(kid(deck.xml(part), "cSld"), "name") or None, "shapes": [attr(s, "name") for s in deck.xml(part).iter() if opc.local(s.tag) == "cNvPr"]}
    sections = [{"name": attr(s, "name"), "slides": len(kids(kid(s, "sldIdLst"), "sldId"))} for s in deck.root.iter() if opc.local(s.tag) == "section"]
    return {
        "slide-size": {"cx": int(attr(size, "cx", "9144000")), "cy": int(attr(size, "cy", "6858000"))},
        "slides": [Slide(deck, s).model() for s in deck.slides],
        "theme": [theme_colors(deck, m) for m in masters if m in deck.parts],
        "masters-layouts": [named(m) | {"layouts": sorted((named(x) for x in deck.targets(m, "slideLayout")), key=str)} for m in masters if m in deck.parts],
        "custom-xml": sorted(opc.canonical(deck.parts[t]) for t in deck.targets(deck.main, "customXml")),
        "sections": sections,
    }


def edit_target(content: bytes) -> dict | None:
    """The first run with text of a shape of its own on a slide, whose id is a number."""
    deck = Deck(content)
    for n, part in enumerate(deck.slides, 1):
        for e in deck.xml(part).iter():
            if opc.local(e.tag) != "spTree":
                continue
            for s in (c for c in e if opc.local(c.tag) == "sp"):
                number_ = attr(kid(s, "nvSpPr", "cNvPr"), "id")
                for i, p in enumerate(kids(kid(s, "txBody"), "p")):
                    for j, r in enumerate(kids(p, "r")):
                        if number_.isdigit() and any(t.text for t in kids(r, "t")):
                            return {"slide": n, "shape_id": int(number_), "paragraph": i, "run": j, "part": part}
    return None


def apply_edit(content: bytes, target: dict, text: str) -> bytes:
    package = opc.read_package(content, "first")
    root = opc.parse(package.parts[target["part"]])
    shape = next(s for s in root.iter() if opc.local(s.tag) == "sp" and attr(kid(s, "nvSpPr", "cNvPr"), "id") == str(target["shape_id"]))
    run = kids(kids(kid(shape, "txBody"), "p")[target["paragraph"]], "r")[target["run"]]
    _replace_text(run, text)
    for t in kids(run, "t"):
        t.attrib.pop("{http://www.w3.org/XML/1998/namespace}space", None)
    return opc.replace_member(content, package.members[target["part"]], ET.tostring(root, "utf-8", xml_declaration=True))


A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def text_shape(n: int, lines: list[str], box: tuple[int, int, int, int] = (0, 0, 914400, 914400)) -> str:
    x, y, cx, cy = box
    body = "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" if t else "<a:p/>" for t in lines)
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="Shape {n}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm></p:spPr><p:txBody><a:bodyPr/>{body}</p:txBody></p:sp>'


def write(slides: list[str]) -> bytes:
    """A presentation of slides, each the markup of its shapes."""
    kind = "application/vnd.openxmlformats-officedocument.presentationml"
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(slides) + 1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/slide" Target="slides/slide{i}.xml"/>' for i in range(1, len(slides) + 1))
    types = "".join(f'<Override PartName="/ppt/slides/slide{i}.xml" ContentType="{kind}.slide+xml"/>' for i in range(1, len(slides) + 1))
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/ppt/presentation.xml" ContentType="{kind}.presentation.main+xml"/>{types}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="ppt/presentation.xml"/></Relationships>',
        "ppt/presentation.xml": f'{_HEAD}<p:presentation xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{_REL}"><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{rels}</Relationships>',
    }
    for i, shapes in enumerate(slides, 1):
        parts[f"ppt/slides/slide{i}.xml"] = f'{_HEAD}<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{_REL}"><p:cSld><p:spTree><p:nvGrpSpPr/><p:grpSpPr/>{shapes}</p:spTree></p:cSld></p:sld>'
    return opc.write_package(parts)
