"""Two packages beside each other: which part became which, and what of each is still the same.

Pure functions on the parts of one pair of packages; ``operators.graph`` has the same matching
as joins of tables of parts.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from dataclasses import dataclass, field

from folioscope.sources import opc


def _natural(text: str) -> list[tuple[int, int, str]]:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", text)]


@dataclass
class Parts:
    """One package's parts with their types and relationships."""

    parts: dict[str, bytes]
    rels: dict[str, list[tuple[str, str, str, bool]]] = field(init=False)

    def __post_init__(self):
        self.rels = {}
        for source, rel_id, kind, target, external in opc.relationships(self.parts):
            self.rels.setdefault(source, []).append((rel_id, kind, target, external))
        self.defaults, self.overrides, self.broken = opc.content_types(self.parts)

    def type_of(self, part: str) -> str | None:
        return opc.type_of(part, self.defaults, self.overrides)

    def digest(self, part: str) -> str:
        return hashlib.sha256(self.parts[part]).hexdigest()

    def paths(self) -> dict[str, str]:
        """Each part that can be reached, with the chain of relationships that first reaches it, breadth first."""
        found: dict[str, str] = {}
        queue, met = deque([("", "")]), {""}
        while queue:
            source, path = queue.popleft()
            nth: dict[str, int] = {}
            for _, kind, target, external in sorted(self.rels.get(source, []), key=lambda r: (r[1], _natural(r[2]))):
                if external:
                    continue
                nth[kind] = nth.get(kind, 0) + 1
                found.setdefault(target, f"{path}/{kind}#{nth[kind]}")
                if target not in met and target in self.parts:
                    met.add(target)
                    queue.append((target, found[target]))
        return found

    def problems(self) -> list[str]:
        """Everything wrong with the package's structure: content types, then relationships, each by part."""
        out = [self.broken] if self.broken else []
        own = sorted(self.parts)
        out += [f"no content type: {p}" for p in own if not opc.is_rels(p) and p != opc.CONTENT_TYPES and self.type_of(p) is None]
        out += [f"malformed: {p}" for p in own if opc.is_rels(p) and not opc.well_formed(self.parts[p])]
        roots = self.rels.get("", [])
        if "_rels/.rels" not in self.parts:
            out.append("no relationships of the package")
        elif not any(kind == "officeDocument" and not external for _, kind, _, external in roots):
            out.append("no main part")
        sources = sorted(self.rels, key=opc.rels_part)
        return out + [f"dangling: {s} -> {target}" for s in sources for _, _, target, external in self.rels[s] if not external and target not in self.parts]

    def main(self) -> str | None:
        return next((target for _, kind, target, external in self.rels.get("", []) if kind == "officeDocument" and not external), None)


#: How a part was matched, in the order in which it is tried.
METHODS = ("name", "path", "digest", "owner")


def mapped(before: Parts, after: Parts) -> dict[str, tuple[str, str]]:
    """Part of ``before`` -> (part of ``after``, method).

    By name; then by the path of relationships, with an equal content type; then by equal
    bytes, in name order.  A relationships part follows the part that it belongs to, unless
    it has kept its name.
    """
    out: dict[str, tuple[str, str]] = {}
    used: set[str] = set()

    def match(part: str, other: str | None, method: str) -> bool:
        fits = part not in out and other is not None and other in after.parts and other not in used
        if fits:
            out[part] = (other, method)
            used.add(other)
        return fits

    own = [p for p in sorted(before.parts) if not opc.is_rels(p)]
    for part in own:
        match(part, part, "name")
    by_path: dict[str, str] = {}
    for part, path in after.paths().items():
        by_path.setdefault(path, part)
    paths = before.paths()
    for part in own:
        other = by_path.get(paths.get(part, ""))
        if other is not None and before.type_of(part) == after.type_of(other):
            match(part, other, "path")
    by_digest: dict[str, deque[str]] = {}
    for part in sorted(after.parts):
        if part not in used and not opc.is_rels(part):
            by_digest.setdefault(after.digest(part), deque()).append(part)
    for part in own:
        pool = by_digest.get(before.digest(part)) if part not in out else None
        if pool:
            match(part, pool.popleft(), "digest")
    for part in sorted(p for p in before.parts if opc.is_rels(p)):
        owner = opc.rels_owner(part)
        if not match(part, part, "name") and owner in out:
            match(part, opc.rels_part(out[owner][0]), "owner")
    return out


def canonical(package: Parts, part: str, names: dict[str, str] | None) -> object:
    """What of a part is compared; ``names`` gives parts the names that they have in the other package."""

    def token(kind: str, target: str, external: bool) -> str:
        if external:
            return f"{kind}|external|{target}"
        return f"{kind}|internal|{target if names is None else names.get(target, 'unmapped:' + target)}"

    if opc.is_rels(part):
        return sorted(token(*r[1:]) for r in package.rels.get(opc.rels_owner(part), []))
    if part == opc.CONTENT_TYPES:
        return None  # the types of the mapped parts are compared instead
    data = package.parts[part]
    if not opc.is_xml(part, package.type_of(part)):
        return hashlib.sha256(data).hexdigest()
    return opc.canonical(data, {r[0]: f"rel({token(*r[1:])})" for r in package.rels.get(part, [])}, part)


def unlike(before: Parts, after: Parts, mapping: dict[str, tuple[str, str]]) -> list[str]:
    """The mapped parts whose content type or canonical content differs, sorted."""
    names = {part: other for part, (other, _) in mapping.items()}
    out = []
    for part, other in sorted(names.items()):
        typed = not opc.is_rels(part) and part != opc.CONTENT_TYPES
        if typed and before.type_of(part) != after.type_of(other):
            out.append(f"{part} (content type)")
        elif canonical(before, part, names) != canonical(after, other, None):
            out.append(part)
    return out
