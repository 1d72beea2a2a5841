"""What a reader of a document can observe, as leaf tables.

A leaf is (feature, path, vtype, value): one scalar of a format's model at a JSON pointer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

Leaf = tuple[str, str, str, str | None]

#: The features of each format's model, in their order.
FEATURES = {
    "xlsx": (
        "workbook", "defined_names", "cells", "formulas", "formula_cached_values", "cell_styles", "merged_cells", "columns", "rows", "views", "auto_filters", "data_validations",
        "conditional_formats", "hyperlinks", "comments", "protection", "page_setup", "images", "charts", "tables", "pivot_tables", "external_links", "vba", "theme",
    ),
    "docx": (
        "body", "sections", "headers_footers", "footnotes", "endnotes", "comments", "tracked_changes", "fields", "bookmarks", "hyperlinks", "content_controls", "images", "shapes",
        "text_boxes", "embedded_objects", "styles", "custom_properties", "core_properties", "custom_xml", "glossary",
    ),
    "pptx": (
        "package", "slide-size", "slides", "slide-hidden", "slide-layout", "background", "shapes", "geometry", "fill-line", "placeholders", "text", "text-format", "tables", "pictures",
        "groups", "charts", "smartart", "embedded-objects", "hyperlinks", "notes", "comments", "transitions", "animations", "media", "theme", "masters-layouts", "custom-xml", "sections",
    ),
}


def leaves(feature: str, value: object, path: str = "") -> Iterator[Leaf]:
    """The scalars below a value of dicts, lists and scalars; empty containers are leaves."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(feature, v, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(feature, v, f"{path}/{i}")
    elif value is None:
        yield feature, path, "null", None
    elif isinstance(value, bool):
        yield feature, path, "bool", "true" if value else "false"
    elif isinstance(value, (int, float)):
        yield feature, path, "num", json.dumps(value)
    elif isinstance(value, str):
        yield feature, path, "str", value
    else:
        yield feature, path, "empty", json.dumps(value)


def model_leaves(model: dict[str, object]) -> list[Leaf]:
    return [leaf for feature, value in model.items() for leaf in leaves(feature, value, f"/{feature}")]
