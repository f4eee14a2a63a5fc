"""The normalisation chain: small tables are stored by table and moved no more, with the same results as large ones."""

from pyspark.sql import functions as F

from tieout.operators import ingest as I
from tieout.plans import normalize as N
from tieout.plans import views as V

KEY = ["doc_id", "table_idx"]
SCHEMA = "doc_id long, table_idx long, row_idx int, col_idx int, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cells(rows):
    grids = {
        1: [["Item", "Code", "Note", "2024", "2023"], ["", "", "", "VND", "VND"], ["Cash", "110", "4", "1,000", "(900)"], ["Debt", "310", None, "-", "7"]],
        2: [["0", "1", "2"], ["Code", "Note", "2024"], ["01", "x", "5"]],  # the first row only numbers its columns
        3: [["Name"], ["Code", "", "31/12/2023", "31/12/2023"], ["11", "2", "3", "4"], ["12", "b"]],  # rows of other widths
        4: [["no header", "at all"], ["a", "b"]],
        5: [["0", "1"], ["Code", "Note 2024", "Year 2023"], ["7", "1", "2"]],  # narrower than the table: no index row
    }
    data = [(t % 2, t, r, c, x) for t, g in grids.items() for r, line in enumerate(g) for c, x in enumerate(line)]
    return rows(SCHEMA, *data, (1, 3, 2, 7, "far"), (1, 3, 2, 0, "twice"), (None, 9, 0, 0, "Code"))


def got(out):
    return {name: sorted(map(str, df.select(sorted(df.columns)).collect())) for name, df in out.items()}


def test_stored_tables_give_the_same_and_are_not_moved(rows, monkeypatch):
    small = N.normalize_tables(cells(rows))
    assert "Exchange hashpartitioning" not in plan(small["metadata"]) and "Exchange hashpartitioning" not in plan(small["body"])
    have = got(small)
    monkeypatch.setattr(N, "_small", lambda c: False)
    assert have == got(N.normalize_tables(cells(rows))) and len(have["metadata"]) == 4


def test_squared_rows_equal_padded_cells(rows):
    nested = cells(rows).groupBy(*KEY, "row_idx").agg(F.collect_list(F.struct("col_idx", "text")).alias("cells"))
    have = I.squared_rows(nested).select(*KEY, "row_idx", F.inline("cells"))
    assert sorted(map(str, have.collect())) == sorted(map(str, I.drop_index_rows(I.rectangular(cells(rows))).collect()))


def test_cells_by_line_equal_cells_by_position(spark, tmp_path):
    lines = [(k, 40 + 7 * i + k, i % 3, i // 2 + 1, float(i), 1000.0 * k + i, f"199{i}-01-01") for k in (3, 4, 5, 1005) for i in range(k % 4 + 1)]
    li = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string")
    li.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows, size = V.dealt_cell_rows(spark, str(tmp_path))
    assert size == 2 * len(lines)
    have = rows.select(*KEY, "row_idx", F.inline("cells"))
    assert sorted(map(str, have.collect())) == sorted(map(str, V.cell_rows(spark, str(tmp_path)).collect()))
