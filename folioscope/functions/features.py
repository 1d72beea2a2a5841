"""What kinds of content a package has, told from its parts' names and bytes."""

from __future__ import annotations

import re
from functools import lru_cache

#: Feature and pattern of a part's lower-case name, for any format and for each.
PART_RULES = {
    "any": """
        charts                  (^|/)charts/chart[^/]*\\.xml$
        chart-styles            (^|/)charts/(style|colors)[^/]*\\.xml$
        smartart                (^|/)diagrams/data[^/]*\\.xml$
        embedded-objects        (^|/)embeddings/
        images                  (^|/)media/[^/]+\\.(png|jpe?g|gif|bmp|tiff?|emf|wmf|svg)$
        audio-video             (^|/)media/[^/]+\\.(mp3|wav|m4a|mp4|m4v|wmv|avi|mov)$
        custom-xml              ^customxml/
        theme                   (^|/)theme/theme[^/]*\\.xml$
        thumbnail               ^docprops/thumbnail
        custom-properties       ^docprops/custom\\.xml$
        ink                     (^|/)ink/
        activex                 (^|/)activex/
        digital-signature       ^_xmlsignatures/
        vml-drawings            \\.vml$
    """,
    "xlsx": """
        chartsheets             ^xl/chartsheets/
        pivots                  ^xl/pivottables/
        pivot-caches            ^xl/pivotcache/
        comments                ^xl/comments[^/]*\\.xml$
        threaded-comments       ^xl/threadedcomments/
        tables                  ^xl/tables/
        drawings                ^xl/drawings/drawing[^/]*\\.xml$
        external-links          ^xl/externallinks/
        shared-strings          ^xl/sharedstrings\\.xml$
        calc-chain              ^xl/calcchain\\.xml$
        query-tables            ^xl/querytables/
        connections             ^xl/connections\\.xml$
        slicers                 ^xl/slicers?(caches)?/
        timelines               ^xl/timeline
        rich-data               ^xl/richdata/
        printer-settings        ^xl/printersettings/
        persons                 ^xl/persons/
    """,
    "pptx": """
        comments                ^ppt/comments/
        notes                   ^ppt/notesslides/
        handout-master          ^ppt/handoutmasters/
        tags                    ^ppt/tags/
        printer-settings        ^ppt/printersettings/
    """,
    "docx": """
        comments                ^word/comments\\.xml$
        comments-extended       ^word/comments(extended|ids|extensible)\\.xml$
        footnotes               ^word/footnotes\\.xml$
        endnotes                ^word/endnotes\\.xml$
        headers                 ^word/header[^/]*\\.xml$
        footers                 ^word/footer[^/]*\\.xml$
        numbering               ^word/numbering\\.xml$
        glossary                ^word/glossary/
        embedded-fonts          ^word/fonts/
        people                  ^word/people\\.xml$
    """,
}

#: Feature, pattern of the part's name, and pattern of its bytes.
CONTENT_RULES = {
    "xlsx": """
        conditional-formatting  ^xl/worksheets/            <(\\w+:)?conditionalFormatting\\b
        data-validation         ^xl/worksheets/            <(\\w+:)?dataValidations?\\b
        formulas                ^xl/worksheets/            <(\\w+:)?f[\\s>/]
        merged-cells            ^xl/worksheets/            <(\\w+:)?mergeCell\\b
        hyperlinks              ^xl/worksheets/            <(\\w+:)?hyperlink\\b
        sparklines              ^xl/worksheets/            sparklineGroup\\b
        autofilter              ^xl/worksheets/            <(\\w+:)?autoFilter\\b
        frozen-panes            ^xl/worksheets/            <(\\w+:)?pane\\b
        sheet-protection        ^xl/worksheets/            <(\\w+:)?sheetProtection\\b
        outline-grouping        ^xl/worksheets/            outlineLevel=
        rich-text               ^xl/sharedstrings\\.xml$    <(\\w+:)?rPr\\b
        defined-names           ^xl/workbook\\.xml$         <(\\w+:)?definedName\\b
        array-formulas          ^xl/worksheets/            t="array"
        shared-formulas         ^xl/worksheets/            t="shared"
        number-formats          ^xl/styles\\.xml$           <(\\w+:)?numFmt\\b
        differential-styles     ^xl/styles\\.xml$           <(\\w+:)?dxf\\b
        shapes                  ^xl/drawings/drawing       <(\\w+:)?sp\\b
        print-setup             ^xl/worksheets/            <(\\w+:)?pageSetup\\b
    """,
    "pptx": """
        tables                  ^ppt/slides/               <a:tbl\\b
        animations              ^ppt/slides/               <p:timing\\b
        transitions             ^ppt/slides/               <p:transition\\b
        group-shapes            ^ppt/slides/               <p:grpSp\\b
        hyperlinks              ^ppt/slides/               <a:hlinkClick\\b
        ole-objects             ^ppt/slides/               <p:oleObj\\b
        connectors              ^ppt/slides/               <p:cxnSp\\b
        custom-geometry         ^ppt/slides/               <a:custGeom\\b
        gradient-fills          ^ppt/(slides|slidelayouts|slidemasters)/  <a:gradFill\\b
        sections                ^ppt/presentation\\.xml$    sectionLst\\b
        alternate-content       ^ppt/slides/               <mc:AlternateContent\\b
        placeholders            ^ppt/slides/               <p:ph\\b
    """,
    "docx": """
        tracked-changes         ^word/document\\.xml$       <w:(ins|del|moveFrom|moveTo|rPrChange|pPrChange)\\b
        tables                  ^word/document\\.xml$       <w:tbl\\b
        fields                  ^word/(document|header\\d*|footer\\d*)\\.xml$  <w:(fldSimple|instrText|fldChar)\\b
        content-controls        ^word/document\\.xml$       <w:sdt\\b
        math                    ^word/document\\.xml$       <m:oMath
        text-boxes              ^word/document\\.xml$       <w:txbxContent\\b|<wps:txbx\\b
        bookmarks               ^word/document\\.xml$       <w:bookmarkStart\\b
        hyperlinks              ^word/document\\.xml$       <w:hyperlink\\b
        columns                 ^word/document\\.xml$       <w:cols\\b[^>]*w:num="[2-9]
        drawings                ^word/document\\.xml$       <w:drawing\\b
        legacy-vml              ^word/document\\.xml$       <w:pict\\b
        comments-anchored       ^word/document\\.xml$       <w:commentRangeStart\\b
        alternate-content       ^word/document\\.xml$       <mc:AlternateContent\\b
        styles                  ^word/styles\\.xml$         <w:style\\b
        lists                   ^word/document\\.xml$       <w:numPr\\b
    """,
}

#: Features of a package with more than one of something: parts of that name, or occurrences in the part.
COUNTED = {
    "pptx": ("multiple-masters", r"^ppt/slidemasters/slidemaster[^/]*\.xml$", None),
    "xlsx": ("multiple-sheets", r"^xl/worksheets/sheet[^/]*\.xml$", None),
    "docx": ("sections", r"^word/document\.xml$", b"<w:sectPr"),
}


@lru_cache
def rules(kind: str) -> tuple[tuple[str, re.Pattern[str], re.Pattern[bytes] | None], ...]:
    """(feature, pattern of names, pattern of bytes or null) of a format, in order."""
    rows = [line.split(None, 2) for text in (PART_RULES["any"], PART_RULES[kind], CONTENT_RULES[kind]) for line in text.strip().splitlines()]
    return tuple((r[0], re.compile(r[1]), re.compile(r[2].encode()) if len(r) > 2 else None) for r in rows)


def of_package(kind: str, parts: dict[str, bytes]) -> list[str]:
    """The features of a package (parts by lower-case name), sorted."""
    found: set[str] = set()
    for feature, name, content in rules(kind):
        if feature not in found and any(name.search(p) and (content is None or content.search(parts[p])) for p in parts):
            found.add(feature)
    feature, name, occurrence = COUNTED[kind]
    own = [p for p in parts if re.search(name, p)]
    if (len(own) if occurrence is None else sum(parts[p].count(occurrence) for p in own)) > 1:
        found.add(feature)
    return sorted(found)
