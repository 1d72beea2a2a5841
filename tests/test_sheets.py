import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioscope.functions import sheets as S


@given(st.integers(1, 18_278))
def test_columns_round_trip(n):
    assert S.column_number(S.column_letters(n)) == n


@pytest.mark.parametrize(
    "ref, want",
    [("$B$2:A1", "A1:B2"), ("a1", "A1"), ("C3:C3", "C3"), ("C:A", "A:C"), ("5:3", "3:5"), ("A1:A1048576", "A:A"), ("table[x]", "TABLE[X]")],
)
def test_canonical_ref(ref, want):
    assert S.canonical_ref(ref) == want


def cells(refs):
    return {(x, y) for r in refs.split() for a, b, c, d in [S.parse_range(r)] for x in range(a, c + 1) for y in range(b, d + 1)}


def test_unions_of_ranges_do_not_depend_on_how_they_are_split():
    rng = random.Random(1)
    for _ in range(200):
        boxes = [(rng.randint(1, 8), rng.randint(1, 8)) for _ in range(rng.randint(1, 5))]
        refs = [S.render_range((x, y, x + rng.randint(0, 3), y + rng.randint(0, 3))) for x, y in boxes]
        whole = S.canonical_refs(" ".join(refs))
        single = [S.render_range((x, y, x, y)) for x, y in cells(" ".join(refs))]
        rng.shuffle(single)
        assert cells(whole) == cells(" ".join(refs)) and S.canonical_refs(" ".join(single)) == whole


@pytest.mark.parametrize(
    "text, want",
    [
        ("=sum( a1 , b2 )", "SUM(A1,B2)"),
        ('if(a1="x y","n  o",1)', 'IF(A1="x y","n  o",1)'),
        ("a1:b2 b2:c3", "A1:B2 B2:C3"),
        ("sheet1!a1+'My Sheet'!b2", "'SHEET1'!A1+'MY SHEET'!B2"),
        ("#ref!+1", "#REF!+1"),
        ('"say ""hi"" "&a1', '"say ""hi"" "&A1'),
    ],
)
def test_normal_formula(text, want):
    assert S.normal_formula(text) == want
    assert S.normal_formula(want) == want


@pytest.mark.parametrize(
    "text, move, want",
    [
        ("A1+$A1+A$1+$A$1", (2, 1), "B3+$A3+B$1+$A$1"),
        ("A1", (0, -1), "#REF!"),
        ("SUM(B:C)", (5, 1), "SUM(C:D)"),
        ("SUM(2:$3)", (1, 0), "SUM(3:$3)"),
        ('"A1"&LOG10(A1)', (1, 0), '"A1"&LOG10(A2)'),
        ("'A1 B2'!A1+Name1x+x.A1", (1, 1), "'A1 B2'!B2+Name1x+x.A1"),
        ("A1048576", (1, 0), "#REF!"),
        ("[1]Sheet!A1", (1, 0), "[1]Sheet!A2"),
    ],
)
def test_shift_formula(text, move, want):
    assert S.shift_formula(text, *move) == want


def test_dates_and_text():
    assert S.serial_day("1900-03-01") == 61 and S.serial_day("1900-02-28") == 59 and S.serial_day("1904-01-02", True) == 1
    assert S.serial_day("2024-01-01T12:00:00") == 45292.5 and S.serial_day("06:00:00") == 0.25 and S.serial_day("nonsense") is None
    assert S.unescape("a_x000D_b_x00zz_") == "a\rb_x00zz_"
    assert S.header_sections("top&Lleft&P&Rright") == {"L": "left&P", "C": "top", "R": "right"}
