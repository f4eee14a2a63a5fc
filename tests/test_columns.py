"""Row classes against the statement of the query, on letters whose upper or lower case has several characters."""

from datetime import date

import duckdb
from pyspark.sql import functions as F

from tieout.functions.amounts import _parse_messy, parse_amount
from tieout.operators import columns as L
from tieout.plans import views as V
from tieout.queries import load_all


def test_row_classes_follow_single_letter_case(spark, tmp_path):
    lines = [
        "Straße", "STRASSE", "ﬁne words", "Iſſued", "ABC ", "ABC\u0085", "ABC\u000bDEF", "ABC\tDEF\r", "DESCRİPTION 2024", "Trading assets 1", "",
        "ASSETS ß", "total", "see note", "ǰ", "ghi chú 2024",
    ]
    spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    queries, statements = load_all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, queries["row_classes"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(statements["row_classes"]).fetchall())
    one = spark.createDataFrame([("Straße",), ("STRASSE",)], "t string").select(L.row_class(F.col("t"), F.lit(0)).alias("c"))
    assert [r["c"] for r in one.collect()] == ["DATA", "SECTION_TITLE"]


def test_filter_on_cell_text_derives_it_once(spark, tmp_path):
    spark.createDataFrame(
        [(1, 8, 3, 1, 10.0, 99.5, "A", date(1996, 1, 1)), (1, 9, 3, 2, 7.0, 1234.5, "A", date(1996, 1, 1))],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate date",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = V.cell_rows(spark, str(tmp_path)).where("trim(text) <> ''")
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "format_number" in line]
    assert sorted(r.text for r in cells.where("row_idx > 0 and col_idx >= 3").collect()) == ["1,227.50", "1,234.50", "89.50", "99.50"]


def test_profile_means_the_first_twenty_filled_cells(rows):
    texts = ["" if r in (3, 21) else "x" * (r % 9 + 1) for r in range(30)]
    body = rows("doc_id int, table_idx int, row_idx int, col_idx int, text string", *[(1, 1, r, 0, t) for r, t in enumerate(texts)], *[(1, 1, r, 1, "ab") for r in (0, 40)])
    heads = rows("doc_id int, table_idx int, col_idx int, header string", *[(1, 1, c, "h") for c in (0, 1, 2)])
    got = {r.col_idx: r for r in L.column_profile(body, heads).collect()}
    filled = [t for t in texts if t]
    assert got[0].avg_len == sum(map(len, filled[:20])) / 20 and got[0].uniqueness == len(set(filled)) / len(filled)
    assert got[1].avg_len == 2.0 and got[2].avg_len == 0.0
    assert "_r" not in got[0].asDict()


def test_usual_notations_are_parsed_as_by_the_full_chain(rows):
    numbers = ["1", "0", "007", "123", "1234", "1,234", "12,345,678", "1,23", "1234,567", "1,234.5", "12.", ".5", "1.234,5", "1.234.567,89", "1.234", "1 234 567", "1\u00a0234", "1 234,5", "12 -", "1.5e3"]
    texts = [a + n + b for n in numbers for a in ("", "(", "-", "VND ", "VND", "A b ", "E ", "\u2212") for b in ("", ")", " -", "-", " %", " VND", "\n", " -\n", "d")]
    df = rows("text string", *[(t,) for t in [*texts, "", "\u2014", "Item", None]])
    both = df.select("text", parse_amount(F.col("text")).alias("a"), _parse_messy(F.col("text")).alias("b"))
    assert both.where("NOT (a <=> b)").collect() == []


def test_note_columns_read_the_cells_once(rows):
    cells = [("Cash", "5", "2024", ""), ("Debt", "6", "2023", "x"), ("", "", "2022", "7")]
    body = rows("doc_id int, table_idx int, row_idx int, col_idx int, text string", *[(1, t, r, c, x) for t in (1, 2) for r, line in enumerate(cells) for c, x in enumerate(line[t - 1:])])
    heads = rows("doc_id int, table_idx int, col_idx int, header string", *[(1, t, c, h) for t in (1, 2) for c, h in enumerate(["Item", "Amount", "Other", "Quantity"])])
    got = L.note_amount_columns(body, heads)
    want = L.note_amount_columns(body, heads, L.note_label_column(body))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_column_types_join_tables_only(rows):
    heads = rows("doc_id int, table_idx int, col_idx int, header string", *[(1, 1, c, h) for c, h in enumerate(["Item", "Code", "Note", "2024", "2023", "2022", None])], (1, 2, 0, "x"))
    periods = rows("doc_id int, table_idx int, cy_col int, py_col int", (1, 1, 3, 4), (1, 2, -1, -1))
    got = L.column_types(heads, periods)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    assert {(r.table_idx, r.col_idx): r.column_type for r in got.collect()} == {
        (1, 0): "TEXT", (1, 1): "CODE", (1, 2): "TEXT", (1, 3): "NUMERIC_CY", (1, 4): "NUMERIC_PY", (1, 5): "OTHER", (1, 6): "TEXT", (2, 0): "TEXT"}
