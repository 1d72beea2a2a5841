"""Spreadsheet references, ranges, formulas and dates."""

from __future__ import annotations

import datetime as dt
import re

MAX_ROW, MAX_COLUMN = 1_048_576, 16_384

_CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?([0-9]+)")
_TOKEN = re.compile(
    r'"(?:[^"]|"")*"'  # text
    r"|'(?:[^']|'')*'!?"  # quoted sheet
    r"|\[[^\]]*\]"  # workbook or table column
    r"|[A-Za-z_\\][\w.\\]*!"  # bare sheet
    r"|#[A-Za-z0-9/]+[!?]?"  # error
    r"|(?P<cell>\$?[A-Za-z]{1,3}\$?[0-9]+(?![\w.(]))"
    r"|(?P<columns>\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w.(]))"
    r"|(?P<rows>\$?[0-9]+:\$?[0-9]+)"
    r"|[A-Za-z_\\][\w.\\]*"  # name or function
    r"|[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?"
    r"|\s+|."
)


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(number: int) -> str:
    out = ""
    while number:
        number, r = divmod(number - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_range(ref: str) -> tuple[int, int, int, int] | None:
    """(first column, first row, last column, last row) of a cell, a range, whole columns or whole rows."""
    ends = [e for e in ref.replace("$", "").split(":")]
    if len(ends) > 2:
        return None
    corners = []
    for end, last in zip((ends[0], ends[-1]), (False, True)):
        if m := re.fullmatch(r"([A-Za-z]{1,3})([0-9]+)", end):
            corners.append((column_number(m[1]), int(m[2])))
        elif len(ends) == 2 and re.fullmatch(r"[A-Za-z]{1,3}", end):
            corners.append((column_number(end), MAX_ROW if last else 1))
        elif len(ends) == 2 and re.fullmatch(r"[0-9]+", end):
            corners.append((MAX_COLUMN if last else 1, int(end)))
        else:
            return None
    (a, b), (c, d) = corners
    return min(a, c), min(b, d), max(a, c), max(b, d)


def render_range(box: tuple[int, int, int, int]) -> str:
    a, b, c, d = box
    if (b, d) == (1, MAX_ROW) and (a, c) != (1, MAX_COLUMN):
        return f"{column_letters(a)}:{column_letters(c)}"
    if (a, c) == (1, MAX_COLUMN):
        return f"{b}:{d}"
    first, last = f"{column_letters(a)}{b}", f"{column_letters(c)}{d}"
    return first if first == last else f"{first}:{last}"


def canonical_ref(ref: str) -> str:
    box = parse_range(ref)
    return render_range(box) if box else ref.upper()


def canonical_refs(refs: str) -> str:
    """A list of ranges as the set of their cells: maximal bands of rows that have equal columns, each run of columns a range."""
    boxes = [parse_range(r) for r in refs.split()]
    if not boxes or None in boxes:
        return " ".join(sorted(refs.upper().split()))
    cuts = sorted({y for _, b, _, d in boxes for y in (b, d + 1)})
    bands: list[list] = []
    for low, high in zip(cuts, cuts[1:]):
        spans: list[list[int]] = []
        for a, c in sorted((a, c) for a, b, c, d in boxes if b <= low and d >= high - 1):
            if spans and a <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], c)
            else:
                spans.append([a, c])
        if bands and bands[-1][2] == spans and bands[-1][1] == low - 1:
            bands[-1][1] = high - 1
        else:
            bands.append([low, high - 1, spans])
    return " ".join(render_range((a, low, c, high)) for low, high, spans in bands for a, c in spans)


def normal_formula(text: str) -> str:
    """One spelling for formulas that differ in case, blanks and needless signs only."""
    out: list[str] = []
    tokens = [m[0] for m in _TOKEN.finditer(text[1:] if text.startswith("=") else text)]
    operand = lambda t: bool(re.match(r"[\w$'\"#\[\]).]", t[-1:] or " ")) or t[-1:] in ")}"
    for i, t in enumerate(tokens):
        if t.isspace():
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            if out and after and operand(out[-1]) and re.match(r"[\w$'\"#\[(.]", after):
                out.append(" ")
        elif t.startswith('"'):
            out.append(t)
        elif t.startswith("'"):
            inner = t.rstrip("!")[1:-1]
            out.append(f"'{inner.upper()}'" + "!" * t.endswith("!"))
        elif t.endswith("!") and t[0] != "#":
            out.append(f"'{t[:-1].upper()}'!")
        else:
            out.append(t.upper())
    return "".join(out)


def shift_formula(text: str, rows: int, columns: int) -> str:
    """The formula as it reads that many rows down and columns right; what leaves the grid is a broken reference."""

    def cell(t: str) -> str:
        m = re.fullmatch(r"(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)", t)
        c = column_number(m[2]) + (0 if m[1] else columns)
        r = int(m[4]) + (0 if m[3] else rows)
        return f"{m[1]}{column_letters(c)}{m[3]}{r}" if 1 <= c <= MAX_COLUMN and 1 <= r <= MAX_ROW else "#REF!"

    def span(t: str, is_row: bool) -> str:
        ends = []
        for e in t.split(":"):
            fixed, body = ("$", e[1:]) if e.startswith("$") else ("", e)
            n = (int(body) if is_row else column_number(body)) + (0 if fixed else rows if is_row else columns)
            if not 1 <= n <= (MAX_ROW if is_row else MAX_COLUMN):
                return "#REF!"
            ends.append(fixed + (str(n) if is_row else column_letters(n)))
        return ":".join(ends)

    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if m.lastgroup == "cell" and column_number(t.replace("$", "").rstrip("0123456789")) <= MAX_COLUMN:
            t = cell(t)
        elif m.lastgroup in ("columns", "rows"):
            t = span(t, m.lastgroup == "rows")
        out.append(t)
    return "".join(out)


def unescape(text: str) -> str:
    """``_x000D_`` and its like as characters."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def header_sections(text: str) -> dict[str, str]:
    """A header or footer by its left, centre and right sections; text before any mark is centred."""
    out, now = {"L": "", "C": "", "R": ""}, "C"
    for piece in re.findall(r"&[^&]|[^&]+|&", text):
        if len(piece) == 2 and piece[0] == "&" and piece[1].upper() in out:
            now = piece[1].upper()
        else:
            out[now] += piece
    return {k: v for k, v in out.items() if v}


def serial_day(text: str, from_1904: bool = False) -> float | None:
    """An ISO date, date and time, or time as a day number."""
    try:
        if "-" not in text:
            t = dt.time.fromisoformat(text)
            return (t.hour * 3600 + t.minute * 60 + t.second + t.microsecond / 1e6) / 86400
        moment = dt.datetime.fromisoformat(text.replace("Z", ""))
    except ValueError:
        return None
    days = (moment - (dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30))) / dt.timedelta(days=1)
    return days - 1 if not from_1904 and moment < dt.datetime(1900, 3, 1) else days


def areas(text: str) -> list[str]:
    """The areas of a reference list: what stands between commas outside quotes, brackets and parentheses."""
    out, depth, held = [], 0, ""
    for m in _TOKEN.finditer(text):
        token = m[0]
        depth += {"(": 1, ")": -1}.get(token, 0)
        if token == "," and depth <= 0:
            out.append(held)
            held = ""
        else:
            held += token
    return [a for a in map(str.strip, [*out, held]) if a]


def without_sheet(area: str) -> str:
    """An area without the sheet before its last ``!`` outside quotes."""
    quoted, cut = False, 0
    for i, c in enumerate(area):
        quoted ^= c == "'"
        cut = i + 1 if c == "!" and not quoted else cut
    return area[cut:]


def canonical_number(text: str | None) -> str | None:
    """A number as text, the same for 1, 1.0 and 1E0; other texts stay, those of no finite number without blanks around."""
    try:
        n = float(text) if text is not None else None
    except ValueError:
        return text
    if n is None:
        return None
    if n != n or n in (float("inf"), float("-inf")):
        return text.strip()
    return str(int(n)) if n.is_integer() and abs(n) < 1e15 else repr(n)
