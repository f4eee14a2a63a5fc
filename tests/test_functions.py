from pyspark.sql import functions as F

from tieout.functions import amounts as A
from tieout.functions import text as X
from tieout.functions import tolerance as T


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_amount_parse(rows):
    cases = [
        ("(123)", -123.0), ("1 234", 1234.0), ("–", None), ("—", None), ("", None), ("1,234", 1234.0), ("123,45", 123.45),
        ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1.234.567", 1234567.0), ("1,234,567", 1234567.0), ("49.5%", 49.5),
        ("1,000 -", -1000.0), ("−500", -500.0), ("VND 1,000", 1000.0), ("abc", None), ("-100,000", -100000.0), ("1.234.567,8", 1234567.8),
        ("​42", 42.0), ("12 345", 12345.0),
    ]
    df = rows("i int, s string", *[(i, s) for i, (s, _) in enumerate(cases)]).orderBy("i")
    assert values(df, A.parse_amount(F.col("s"))) == [v for _, v in cases]


def test_other_parsers(rows):
    df = rows("i int, s string", (0, "(1,234)"), (1, "-5"), (2, "junk"), (3, "12d"), (4, "nan"), (5, None), (6, "1 000")).orderBy("i")
    assert values(df, A.parse_rule_amount(F.col("s"))) == [-1234.0, -5.0, 0.0, 0.0, 0.0, 0.0, 1000.0]
    assert values(df, A.parse_simple(F.col("s")))[:5] == [-1234.0, -5.0, None, None, None]
    long = rows("s string", ("1" * 1001,))
    assert values(long, A.parse_bounded(F.col("s"))) == [0.0]


def test_inline_formulas(rows):
    df = rows("s string", ("Profit (30 = 20 + (21 - 22) - 25 - 26)",), ("(50 = 30 - (40 - 41))",), ("no formula",))
    terms = [r[0] for r in df.select(X.formula_terms(F.col("s"))).collect()]
    assert terms == [["20", "21", "-22", "-25", "-26"], ["30", "-40", "41"], []]


def test_text_functions(rows):
    df = rows("s string", ("=1+1",), ("-5",), ("-x",), ("plain",))
    assert values(df, X.spreadsheet_safe(F.col("s"))) == ["'=1+1", "-5", "'-x", "plain"]
    notes = rows("s string", ("Note 04: cash",), ("TM.9",), ("Thuyết minh số 12",), ("none",))
    assert values(notes, X.note_number_from_heading(F.col("s"))) == ["4", "9", "12", ""]
    p = rows("s string", ("At 31-12-18",), ("CY2024",), ("x",))
    assert values(p, X.period_key(F.col("s"))) == ["31/12/2018", "2024", None]


def test_materiality(rows):
    df = rows("v double, t string", (100.0, "X"), (1000000.0, "TAX_NOTE"), (1e12, "X"), (1000000.0, "FS_BALANCE_SHEET"))
    m = T.Materiality()
    assert values(df, m.tolerance(F.col("v"), F.col("t"))) == [1.0, 5000.0, 1000000.0, 8000.0]
    assert values(df, m.statement_profile().tolerance(F.col("v"), F.col("t")))[3] == 1000.0


def test_compare_amounts(rows):
    df = rows("e double, a double", (100.0, 100.5), (100.0, 102.0), (None, 1.0), (0.5, 0.505))
    got = [r[0] for r in df.select(T.compare_amounts(F.col("e"), F.col("a"))).collect()]
    assert [g.ok for g in got] == [True, False, False, True]
    assert [g.bound for g in got] == ["rel", "rel", "none", "abs"]
