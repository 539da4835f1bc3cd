"""Scalar functions on literal vectors."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import scalars as S
from foliospark.functions import text as X


@pytest.fixture(scope="module")
def one(spark):
    def run(kind, values, f):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]

    return run


def test_amounts(one, spark):
    v = lambda r: None if r["value"] is None else float(r["value"])
    assert [v(r) for r in one("string", ["1,00,000", "100,000", "(500)", "-3", "abc", None], S.amount)] == [100000, 100000, -500, -3, None, None]
    df = spark.createDataFrame([("2", "lakh"), ("1.5", "Crore"), ("(3)", "k")], "a string, m string")
    got = [r[0] for r in df.select(S.amount(F.col("a"), F.col("m"))).collect()]
    assert [(float(g["value"]), g["rule"]) for g in got] == [(200000, "NUM_MULT_LAKH"), (15000000, "NUM_MULT_CRORE"), (-3000, "NUM_MULT_K")]


def test_cell_numbers(one):
    got = one("string", ["1,234.50", "(500)", "12%", "abc", "$5", "(7%)"], S.cell_number)
    assert [None if g is None else (float(g["value"]), g["rule"]) for g in got][:5] == [(1234.5, "strip_thousands_separator"), (-500, "parentheses_negative"), (12, "percent_strip"), None, None]


def test_number_tokens(one):
    assert one("string", ["1,00,000", "(500)", "0.50", "007", "abc", "0"], S.number_token) == ["100000", "-500", "0.5", "7", None, "0"]
    assert one("string", ["paid 1,00,000 and (500) of x7"], S.numbers_in) == [["-500", "100000", "500"]]


def test_dates(one):
    assert one("string", ["2025-03-04", "04/03/2025", "31/02/2025", "4.3.2025", "x"], S.to_iso) == [dt.date(2025, 3, 4)] * 2 + [None, dt.date(2025, 3, 4), None]
    assert one("string", ["from 2025-01-01 to 31/12/2025 or 99/99/2025"], S.dates_in) == [[dt.date(2025, 1, 1), dt.date(2025, 12, 31)]]


def test_checksums_and_masks(one):
    assert one("string", ["GB82WEST12345698765432", "GB82WEST12345698765433"], S.iban_ok) == [True, False]
    assert one("string", ["mail r.smith@ex.org, call 9876543210 or 12345"], S.mask_text) == ["mail r***@ex.org, call ••••••••10 or 12345"]
    assert one("string", ["at 10.2.3.44 now"], S.mask_ip) == ["at 10.2.3.x now"]
    assert one("string", ["password=hunter2 kept"], S.scrub) == ["password=[redacted] kept"]


def test_display_names_durations(one):
    assert one("double", [0.5, 0.125], lambda v: S.display(v, 0, percent=True))[0] == "50%"
    assert one("double", [1234567.0, -5.0, None], lambda v: S.display(v, 0, thousands=True)) == ["1,234,567", "-5", None]
    assert one("int", [0, 25, 26, 701, 702, 1377, 16383], lambda v: S.a1(F.lit(0), v)) == ["A1", "Z1", "AA1", "ZZ1", "AAA1", "AZZ1", "XFD1"]
    assert one("string", ["A1", "AA7", "ZZ1", "XFD9"], S.a1_col) == [0, 26, 701, 16383]
    assert one("string", ["a/b\\rep?ort.pdf", "", None, "x" * 130 + ".txt"], S.file_name) == ["rep_ort.pdf", "file", "file", "x" * 100 + ".txt"]
    assert one("string", ["3d", "24 h", "2w", "soon", "12"], S.duration_hours) == [72, 24, 336, None, 12]


def test_bands_and_severity(one):
    assert one("double", [0.6, 0.61, 0.85, 0.9, None], S.band) == ["low", "medium", "medium", "high", None]
    assert one("double", [4.9, 5.0, 20.0], S.severity) == ["low", "medium", "high"]


def test_python_text(one):
    assert one("string", ["Ａｂｃ   x"], X.nfkc) == ["Abc x"]
    assert X.ratio("abcd", "abxd") == 75.0 and X.ratio("", "") == 100.0
    assert X.token_set_ratio("acme corp", "corp acme ltd") == 100.0
    assert X.lcs("nematode", "empty") == 3
    assert X.partial_ratio("corp", "acme corporation") == 100.0 and X.partial_ratio("", "x") == 0.0
    for a, b in (("abcdef", "xxabdefyy"), ("kitten", "sitting"), ("aaaa", "b"), ("night", "nacht")):
        s, l = sorted((a, b), key=len)
        assert X.partial_ratio(a, b) == max(X.ratio(s, l[max(0, k) : k + len(s)]) for k in range(1 - len(s), len(l)))


def test_partial_ratio_of_a_long_line_keeps_one_stretch():
    """All stretches of a line of 5000 letters hold 25 million letters; one at a time they take no more than a few lines."""
    import tracemalloc

    line = "".join(chr(97 + k * k % 23) for k in range(5000))
    tracemalloc.start()
    got = X.partial_ratio(line, "X" + line[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == pytest.approx(200 * 4999 / 9999) and peak < 2_000_000


@given(st.text(st.sampled_from("abcdefz uvvvvé日"), max_size=30), st.text(st.sampled_from("abcdefz uvvvvé日"), max_size=30))
def test_letters_counted_by_bits_are_no_more_than_edits(a, b):
    """Two rests whose bags differ by more bits than edits are allowed are turned away unread; no alike rest may be."""
    from foliospark.functions.text import bag_of, lcs

    assert 0 <= bag_of(a) < 1 << 63 and (bag_of(a) ^ bag_of(b)).bit_count() <= len(a) + len(b) - 2 * lcs(a, b)


def test_a_rest_is_written_once_with_its_keys(spark):
    from foliospark.functions.text import bag_of, places, places_of, stretches, stretches_of

    names = [["Ada", "Lovelace"], ["x"], [], ["Grace", "Hopper", "Murray"]]
    df = spark.createDataFrame([(w,) for w in names], "ws array<string>")
    for column, plain in ((stretches, stretches_of), (places, places_of)):
        for r in df.select("ws", column(90.0)("ws").alias("k")).collect():
            assert len({x.rest for x in r.k}) == len(r.k) == max(0, 2 ** len(r.ws) - 1) and all(x.bag == bag_of(x.rest) for x in r.k)
            assert sorted((k, x.rest) for x in r.k for k in x["keys"]) == sorted(plain(r.ws, 90.0))
