"""Open packages: reading and writing one package's bytes.

Pure functions on bytes, used inside Arrow batches.  Nothing is extracted to disk, XML is
parsed without external entities, and every problem comes back as a value.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
import zlib
from dataclasses import dataclass, field
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.parsers import expat

CONTENT_TYPES = "[content_types].xml"
OLE_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")

#: Elements of the document properties that every save may change, and the parts that have them.
VOLATILE = {"modified", "lastModifiedBy", "revision", "Application", "AppVersion", "TotalTime"}
VOLATILE_PARTS = ("docprops/core.xml", "docprops/app.xml")
#: Attributes of markup compatibility that list namespace prefixes.
PREFIX_LISTS = {"{http://schemas.openxmlformats.org/markup-compatibility/2006}" + name for name in ("Ignorable", "ProcessContent", "MustUnderstand", "PreserveElements", "PreserveAttributes")}


@dataclass
class Package:
    parts: dict[str, bytes] = field(default_factory=dict)
    members: dict[str, str] = field(default_factory=dict)
    error: str | None = None


def read_package(content: bytes, duplicates: str = "error", decode: bool = False) -> Package:
    """Parts by lower-case name.  ``duplicates`` of a name: error, first or last.  ``decode``: names are percent-encoded."""
    out = Package()
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                key = (unquote(info.filename) if decode else info.filename).lstrip("/").lower()
                if key in out.parts:
                    if duplicates == "error":
                        out.error = f"duplicate part: {key}"
                        return out
                    if duplicates == "first":
                        continue
                out.parts[key], out.members[key] = z.read(info), info.filename
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError) as e:
        out.error = f"unreadable: {type(e).__name__}"
    return out


def write_package(parts: dict[str, bytes | str]) -> bytes:
    """A package with the parts in the given order; equal input gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, data.encode() if isinstance(data, str) else data)
    return out.getvalue()


def replace_member(content: bytes, member: str, data: bytes) -> bytes:
    """The package with one member's bytes replaced, all else in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [i.filename for i in z.infolist()]
        return write_package({n: data if n == member else z.read(n) for n in names})


class Unfit(ValueError):
    """XML that isn't well-formed, or has a document type."""


def parse(data: bytes, expand: bool = False) -> ET.Element:
    """The root of an XML part.  Document types are refused, so no entity expands.

    ``expand``: lists of namespace prefixes come as sorted lists of what the prefixes stand for.
    """
    builder, known = ET.TreeBuilder(), {}

    def named(token: str) -> str:
        prefix, _, rest = token.partition(":")
        uri = (known.get(prefix) or [f"unbound:{prefix}"])[-1]
        return "{" + uri + "}" + rest if rest else uri

    def start(tag, attributes):
        fix = lambda n: "{" + n.replace("}", "}", 1) if "}" in n else n
        found = {fix(k): v for k, v in attributes.items()}
        for k in PREFIX_LISTS.intersection(found) if expand else ():
            found[k] = " ".join(sorted(map(named, found[k].split())))
        builder.start(fix(tag), found)

    def refuse(*_):
        raise Unfit("document type")

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler = start, builder.data
    parser.EndElementHandler = lambda tag: builder.end("{" + tag if "}" in tag else tag)
    parser.StartDoctypeDeclHandler = refuse
    if expand:
        parser.StartNamespaceDeclHandler = lambda prefix, uri: known.setdefault(prefix or "", []).append(uri)
        parser.EndNamespaceDeclHandler = lambda prefix: known[prefix or ""].pop()
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise Unfit(str(e)) from None
    return builder.close()


def well_formed(data: bytes) -> bool:
    try:
        parse(data)
    except Unfit:
        return False
    return True


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(element: ET.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by local name, whatever its namespace."""
    if name in element.attrib:
        return element.attrib[name]
    return next((v for k, v in element.attrib.items() if local(k) == name), default)


def is_rels(part: str) -> bool:
    return part.endswith(".rels") and "_rels/" in part


def rels_owner(part: str) -> str:
    """The part that a relationships part belongs to: '' for the package's own."""
    folder, _, name = part.rpartition("/")
    owner = posixpath.join(posixpath.dirname(folder), name.removesuffix(".rels"))
    return owner.lstrip("/")


def rels_part(owner: str) -> str:
    folder, name = posixpath.split(owner)
    return posixpath.join(folder, "_rels", f"{name}.rels")


def resolve(source: str, target: str) -> str:
    """The part that a relationship's target names, seen from its source."""
    path = unquote(target.partition("#")[0]).replace("\\", "/")
    base = "/" if path.startswith("/") else "/" + posixpath.dirname(source)
    return posixpath.normpath(posixpath.join(base, path)).lstrip("/").lower()


def relationships(parts: dict[str, bytes]) -> list[tuple[str, str, str, str, bool]]:
    """(source, id, kind, target, external) of every well-formed relationships part; kind is the type's last segment."""
    out = []
    for part, data in sorted(parts.items()):
        if not is_rels(part):
            continue
        owner = rels_owner(part)
        try:
            root = parse(data)
        except Unfit:
            continue
        for e in root:
            if local(e.tag) == "Relationship":
                external = e.get("TargetMode") == "External"
                target = e.get("Target", "")
                out.append((owner, e.get("Id", ""), e.get("Type", "").rpartition("/")[2], target if external else resolve(owner, target), external))
    return out


def content_types(parts: dict[str, bytes]) -> tuple[dict[str, str], dict[str, str], str | None]:
    """Types by extension, types by part, and what is wrong with the list."""
    if CONTENT_TYPES not in parts:
        return {}, {}, "missing content types"
    try:
        root = parse(parts[CONTENT_TYPES])
    except Unfit:
        return {}, {}, "malformed content types"
    defaults = {e.get("Extension", "").lower(): e.get("ContentType", "") for e in root if local(e.tag) == "Default"}
    overrides = {e.get("PartName", "").lstrip("/").lower(): e.get("ContentType", "") for e in root if local(e.tag) == "Override"}
    return defaults, overrides, None


def type_of(part: str, defaults: dict[str, str], overrides: dict[str, str]) -> str | None:
    return overrides.get(part, defaults.get(part.rpartition(".")[2] if "." in part.rpartition("/")[2] else ""))


def is_xml(part: str, kind: str | None) -> bool:
    return part == CONTENT_TYPES or part.endswith((".rels", ".xml", ".vml")) or bool(kind and kind.endswith("xml"))


def main_part(rels: list[tuple[str, str, str, str, bool]]) -> str | None:
    return next((target for source, _, kind, target, external in rels if source == "" and kind == "officeDocument" and not external), None)


def screen(content: bytes) -> str | None:
    """Why a file is no package to work with; the first reason, null if there is none."""
    if content.startswith(OLE_MAGIC):
        return "encrypted-or-legacy"
    package = read_package(content)
    if package.error:
        return "corrupt"
    if any(p.rpartition("/")[2] in ("encryptioninfo", "encryptedpackage") for p in package.parts):
        return "encrypted"
    defaults, overrides, problem = content_types(package.parts)
    if any(p.rpartition("/")[2].startswith("vbaproject") for p in package.parts) or any("macroenabled" in t.lower() for t in (*defaults.values(), *overrides.values())):
        return "macro-enabled"
    main = main_part(relationships(package.parts))
    if problem or main is None or main not in package.parts or not well_formed(package.parts[main]):
        return "corrupt"
    return None


def payload_digest(data: bytes) -> str:
    """Digest of an embedded payload; a package counts by its members, not by how they were compressed."""
    found = read_package(data, "last")
    if found.error or not found.parts:
        return hashlib.sha256(data).hexdigest()
    rows = sorted(f"{k}:{hashlib.sha256(v).hexdigest()}" for k, v in found.parts.items())
    return "zip:" + hashlib.sha256("\n".join(rows).encode()).hexdigest()


def canonical(data: bytes, tokens: dict[str, str] | None = None, part: str = "") -> str:
    """Digest of an XML part that doesn't depend on prefixes, attribute order, comments, blank text or relationship ids.

    ``tokens`` gives what a relationship id stands for.  Of the document's properties, what any
    save changes is left out.  Malformed parts are digested as bytes.
    """
    try:
        root = parse(data, expand=True)
    except Unfit:
        return hashlib.sha256(data).hexdigest()
    digest, volatile = hashlib.sha256(), VOLATILE if part in VOLATILE_PARTS else frozenset()

    def text(s: str | None) -> None:
        if s and s.strip():
            digest.update(b"t" + s.encode() + b"\0")

    def walk(e: ET.Element) -> None:
        digest.update(b"<" + e.tag.encode() + b"\0")
        for k, v in sorted(e.attrib.items()):
            if "relationships" in k and tokens:
                v = tokens.get(v, v)
            digest.update(k.encode() + b"=" + v.encode() + b"\0")
        text(e.text)
        for child in e:
            if local(child.tag) not in volatile:
                walk(child)
                text(child.tail)
        digest.update(b">")

    walk(root)
    return digest.hexdigest()
