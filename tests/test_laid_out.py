"""Notes laid out beside their lines where none is large: the same rows and facts as by positions and joins, moved once."""

import os

import pytest
from pyspark.sql import functions as F

from tieout.operators import notes as N
from tieout.operators import tie_outs as T
from tieout.plans import note_audit as A
from tieout.plans import views as V
from tieout.queries import report_queries as R
from tieout.queries import tie_out_queries as Q

SF = "/root/testdata/sf0.001"
KEY = ["doc_id", "table_idx"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    cols = sorted(b.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


@pytest.fixture
def tables(rows, tmp_path):
    lines = [(k, 40 + k + i, 7, i // 2 + 1, float(5 + i % 4), 10.25 * k + i, f, k + i) for k in (1, 2, 3, 4, 5, 12, 13) for i, f in enumerate("ANRNRA"[: k % 5 + 1])]
    lines += [(20, 1, 1, 1, 5.0, 3.5, None, 0), (20, 1, 1, 1, 5.0, 3.5, None, 0), (None, 1, 1, 1, 5.0, 3.5, "A", 0), (99, 1, 1, 1, 7.0, 3.5, "A", 0)]
    rows("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_x int", *lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows("o_orderkey long, o_custkey long, o_totalprice double", *[(k, k % 3, 100.0 * k) for k in (1, 2, 3, 4, 5, 12, 13, 20, 50)]).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_amounts_by_line_equal_amounts_by_position(spark, tables, monkeypatch):
    got = V.note_amounts(spark, tables)
    assert plan(got).count("Exchange hashpartitioning") <= 2  # lines and orders, each once
    monkeypatch.setattr(V, "groups_fit", lambda *_: False)
    assert same(got, V.note_amounts(spark, tables))


def test_segments_of_small_tables_join_nothing(rows):
    labels = ["a", "Opening balance", "b", "c", "Closing balance", "Cost", "Opening balance", "Additions", "Closing balance", "Cost", "x", "Total"]
    data = rows("doc_id string, table_idx long, row_idx int, label string, value double", *[("d", t, r, x, None if x == "Cost" else 1.0) for t in (1, 2) for r, x in enumerate(labels[t - 1:])])
    structured = A.structured(data)
    got = N.segments(structured, True, totals=True)
    assert "Join" not in plan(got)
    assert same(got.drop("explicit", "dense", "numeric"), N.segments(structured))
    assert same(N.scopes(structured, got), N.scopes(structured, N.segments(structured)))
    assert {r.n_moves for r in got.collect()} == {0, 1, 2}


def test_audit_takes_structured_rows_as_they_are(rows):
    data = rows("doc_id string, table_idx long, row_idx int, label string, value double", *[("d", 1, r, x, v) for r, (x, v) in enumerate([("a", 1.0), ("b", 2.0), ("Total", 9000.0)])])
    heads = rows("doc_id string, table_idx long, heading string", ("d", 1, "Inventories"))
    assert same(A.audit_notes(A.structured(data), heads), A.audit_notes(data, heads))


def test_blocks_by_line_equal_blocks_by_position(rows, tables, spark):
    li = spark.read.parquet(f"{tables}/lineitem.parquet").drop("l_x")
    laid = V.lay_blocks(li.where("l_orderkey is not null").withColumns({"doc_id": F.col("l_orderkey") % 1000, "table_idx": F.col("l_orderkey")}))
    numbered = V._numbered_blocks(li).select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("table_idx"), "row_idx", "label", "value")
    assert same(laid, numbered)


def test_walks_over_stored_blocks_move_nothing(spark, tables):
    blocks = V.block_rows(spark, tables)
    got = N.grand_total(N.block_walk(blocks, short=N.short_walks(blocks)), blocks)
    assert "Exchange hashpartitioning" not in plan(got)
    assert same(got, N.grand_total(N.block_walk(blocks), blocks))
    assert all("Exchange hashpartitioning" not in plan(df) for df in (N.block_sums(blocks), N.two_block_total(blocks)))


def test_total_rows_of_small_notes_are_not_stored(spark, tables, monkeypatch):
    cells, headings, dealt = V.note_tables(spark, tables)
    want = T.total_rows(T.stored_rows(cells, dealt), headings)
    monkeypatch.setattr(T, "stored_rows", lambda *_: pytest.fail("stored"))
    assert same(Q.note_total_rows(spark, tables), want) and want.count() == 8


def test_band_lines_are_dealt_before_they_are_laid_out(spark, tables, monkeypatch):
    got, headings, totals = Q._band_cells(spark, tables)
    monkeypatch.setattr(V, "groups_fit", lambda *_: False)
    rows, heads, ends = Q._band_cells(spark, tables)
    assert same(got, rows) and same(headings, heads) and same(totals, ends)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rules_of_the_model_read_stored_notes(spark):
    notes = R._model(spark, SF).notes
    assert "Window" not in plan(notes) and "Exchange" not in plan(N.segments(notes, True))
    fields = ["doc_id", "table_idx", "row_idx", "label", "value"]
    assert same(notes.select(fields), V.note_amounts(spark, SF).select(fields))
