"""Scalar functions over package content, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Twips per unit of a length in word-processing markup; a bare number is twips.
TWIPS = {"": 1.0, "pt": 20.0, "pc": 240.0, "pi": 240.0, "in": 1440.0, "cm": 1440 / 2.54, "mm": 144 / 2.54, "px": 15.0}

CLIP_CHARS = 200


def pointer_escape(key: Column) -> Column:
    """A key as a segment of a JSON pointer: the tilde first, then the slash."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def column_number(letters: Column) -> Column:
    """A = 1, Z = 26, AA = 27."""
    each = F.transform(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.ascii)
    return F.aggregate(each, F.lit(0).cast("long"), lambda n, c: n * 26 + c - 64)


def column_letters(number: Column) -> Column:
    """The inverse of ``column_number`` up to three letters (18,278 columns)."""
    one = lambda n: F.char(65 + n.cast("long"))
    n = number.cast("long")
    second, third = n - 27, n - 703
    return (
        F.when(n <= 26, one(n - 1))
        .when(n <= 702, F.concat(one(F.floor(second / 26)), one(second % 26)))
        .otherwise(F.concat(one(F.floor(third / 676)), one(F.floor(third / 26) % 26), one(third % 26)))
    )


def twips(length: Column) -> Column:
    """A length with or without a unit in twips, halves to even; null for anything else."""
    shape = r"^\s*(-?[0-9]*\.?[0-9]+)\s*(pt|pc|pi|in|cm|mm|px)?\s*$"
    number = F.regexp_extract(length, shape, 1)
    unit = F.regexp_extract(length, shape, 2)
    factor = F.lit(None).cast("double")
    for name, n in TWIPS.items():
        factor = F.when(unit == name, F.lit(n)).otherwise(factor)
    return F.when(number != "", F.rint(number.try_cast("double") * factor).cast("long"))


def blend(channel: Column, share: Column, dark: bool) -> Column:
    """A colour channel moved towards black (shade) or white (tint); ``share``: 0 to 255, what stays."""
    kept = channel * share / 255
    return F.rint(kept if dark else kept + 255 - share).cast("long")


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case; the empty path of a web address is a slash."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rest = F.substr(url, F.length(scheme) + 4 + F.length(host))
    web = F.lower(scheme).isin("http", "https") & ~F.startswith(rest, F.lit("/"))
    return F.when(scheme == "", url).otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(web, F.lit("/")).otherwise(""), rest))


def comparable_text(text: Column) -> Column:
    """Paragraph text with one kind of line break and without object marks and page breaks."""
    return F.translate(text, "\v\r \f\ufffc", "\n\n\n")


def clip(text: Column, chars: int = CLIP_CHARS) -> Column:
    """A longer text ends in an ellipsis at its last allowed character."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars - 1), F.lit("…"))).otherwise(text)


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    runs = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), width, "0")).otherwise(r)), "\x01")


def serial_day(moment: Column, from_1904: bool = False) -> Column:
    """A local date and time as a spreadsheet's day number; 1900 has the day that never was."""
    epoch = "1904-01-01" if from_1904 else "1899-12-30"
    days = F.datediff(moment.cast("date"), F.lit(epoch).cast("date"))
    seconds = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    serial = days + seconds / 86400
    return serial if from_1904 else F.when(moment.cast("date") < F.lit("1900-03-01").cast("date"), serial - 1).otherwise(serial)


def differing_share(a: Column, b: Column, delta: float) -> Column:
    """The share of positions of two arrays whose values differ by more than ``delta``."""
    far = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > delta)
    return F.size(far) / F.greatest(F.size(a), F.lit(1))


def wheel_tags(filename: Column) -> Column:
    """All (python, abi, platform) tags of a wheel's file name, dotted parts multiplied out."""
    parts = F.split(F.regexp_replace(filename, r"[.]whl$", ""), "-")
    part = lambda n: F.split(F.get(parts, F.size(parts) - n), "[.]")
    return F.flatten(F.transform(part(3), lambda py: F.flatten(F.transform(part(2), lambda abi: F.transform(part(1), lambda at: F.concat_ws("-", py, abi, at))))))
