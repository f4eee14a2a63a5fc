"""Rows stored by group: later steps move none of them, and notes built per line equal those built by positions."""

import re

from pyspark.sql import functions as F

from tieout.operators import tie_outs as T
from tieout.operators.scans import Scan, scan, stored
from tieout.plans import views as V
from tieout.session import deal

KEY = ["doc_id", "table_idx"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_over_stored_rows_move_none(rows):
    df = rows("doc_id int, table_idx int, row_idx int, v double", *[(t % 3, t, r, float(r)) for t in range(20) for r in range(4)])
    kept = stored(df, KEY)
    r = scan(kept, KEY, "row_idx", [Scan("run", "sum", F.col("v"))], small=True)
    sums = r.groupBy(*KEY).agg(F.max("run").alias("top"))
    assert "Exchange" not in plan(sums)
    assert sorted(sums.collect()) == sorted((t % 3, t, 6.0) for t in range(20))


def test_large_group_is_stored_plainly(rows):
    df = rows("doc_id int, table_idx int, row_idx int", *[(1, 1, r) for r in range(6)])
    kept = stored(df, KEY, chunk_rows=4)
    assert "Exchange" in plan(kept.groupBy(*KEY).count())
    assert kept.count() == 6


def test_nested_cells_give_the_same_rows(rows):
    cells = rows("doc_id int, table_idx int, row_idx int, col_idx int, text string, value double",
                 (1, 1, 0, 1, " Cost ", None), (1, 1, 0, 0, None, None), (1, 1, 1, 0, "A", None), (1, 1, 1, 1, "5", 5.0))
    nested = cells.groupBy(*KEY, "row_idx").agg(F.collect_list(F.struct("col_idx", "text", "value")).alias("cells"))
    assert sorted(map(str, T.note_rows(nested).collect())) == sorted(map(str, T.note_rows(cells).collect()))


def test_notes_by_line_equal_notes_by_position(rows):
    lines = [(k, 40 + k + i, 7, i // 2 + 1, float(5 + i % 4), 10.0 * k + i, "ANR"[(k + i) % 3]) for k in (1, 2, 4, 5, 12, 13, 15, 26) for i in range(k % 5 + 1)]
    li = rows("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string", *lines)
    owner = li.select("l_orderkey", (F.col("l_orderkey") % 3).alias("doc_id")).distinct()
    cols = ["doc_id", "l_orderkey", "part", "label", "amounts", "row_idx"]
    want = V._numbered_notes(li).join(owner, "l_orderkey").select(*cols)
    got = V._small_notes(deal(li.join(owner, "l_orderkey"), ["doc_id", "l_orderkey"], 1)).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def notes(rows):
    """(stored rows, headings, totals, blocks) of notes with several blocks, one of them under a heading of its own sums."""
    lines = [("", "", ""), ("a", "1", "2"), ("b", "3", "-"), ("", "", ""), ("", "4", "2"), ("", "", ""), ("short-term c", "5", "5"), ("d", "1", "1"), ("", "", ""), ("", "6", "6"), ("", "", ""), ("Total", "10", "8")]
    value = lambda x: float(x) if x.isdigit() else None
    cells = rows("doc_id int, table_idx long, row_idx int, col_idx int, text string, value double",
                 *[(t % 2, t, r, c, x, value(x)) for t in range(4) for r, line in enumerate(lines[t % 2:]) for c, x in enumerate(line)])
    heads = rows("doc_id int, table_idx long, heading string", (0, 0, "Recognised deferred tax assets and liabilities"), (1, 1, "Long-term provisions"), (0, 2, "Inventories"), (1, 3, "Changes in owners’ equity"))
    kept = T.stored_rows(cells)
    totals = T.total_rows(kept, heads)
    return kept, heads, totals, T.note_blocks(kept, heads, totals)


def moved(df):
    return re.findall(r"Exchange hashpartitioning\([^)]*?(row_idx|block|col_idx|_row|_col|_b)#", plan(df))


def test_blocks_are_looked_up_where_rows_are_stored(rows, monkeypatch):
    kept, heads, _, blocks = notes(rows)
    got = T.block_columns(kept, blocks, heads)
    assert moved(got) == []
    have = sorted(map(str, got.collect()))
    monkeypatch.setattr(T, "FEW_BLOCKS", 0)
    plain = T.block_columns(kept, blocks, heads)
    assert moved(plain) and have == sorted(map(str, plain.collect())) and len(have) > 12


def test_identities_of_stored_notes_equal_those_of_plain_joins(rows, monkeypatch):
    kept, heads, _, _ = notes(rows)
    got = T.note_identities(kept, heads)
    assert moved(got) in ([], ["row_idx"])  # the places that are asked for, not the rows
    have = sorted(map(str, got.collect()))
    monkeypatch.setattr(T, "one_chunk", lambda *_: False)
    assert have == sorted(map(str, T.note_identities(kept, heads).collect())) and have


def test_places_are_read_where_rows_are_stored(rows):
    kept, _, _, _ = notes(rows)
    places = rows("doc_id int, table_idx long, choice int, cy_row int, cy_col int, py_row int, py_col int, sign int", (0, 0, 1, 11, 1, 4, 2, -1), (0, 0, 2, 99, 1, 4, 9, 1), (1, 1, 1, 0, 1, 0, 2, 1))
    got = T.read_places(places, kept, True)
    assert "row_idx" not in moved(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, T.read_places(places, kept).collect()))


def test_words_of_notes_come_from_one_aggregation(rows):
    kept, heads, totals, blocks = notes(rows)
    said = plan(T.said_rows(kept))
    assert "Join" not in said and "Exchange" not in said
    got = {r.table_idx: (r.total_row, r.short, r.n_rows, r.figures) for r in T.note_slots(kept, heads, totals, blocks).collect()}
    assert got == {t: (11 - t % 2, 6 - t % 2, 12 - t % 2, True) for t in range(4)}
