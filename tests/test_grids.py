from tieout.operators import grids as G

CELL = "doc_id string, table_idx int, row_idx int, col_idx int, text string, row_span int, col_span int"


def test_grid_invariants(rows):
    grid = lambda t, *cells: [("d", t, *c) for c in cells]
    square = [(0, 0, "a", 1, 1), (0, 1, "b", None, None), (1, 0, "x", 1, 1), (1, 1, "y", 1, 1)]
    data = (
        grid(0, *square)
        + grid(1, *square[:3])  # a row too short
        + grid(2, (0, 0, "a", 1, 1), (0, 1, "b", 1, 1), (1, 0, "x", 1, 2))  # a cell over two columns fills its row
        + grid(3, (0, 0, "a", 2, 1), *square[1:])  # a vertical merge onto another cell
        + grid(4, *square[:3], (1, 1, "y", 2, 1))  # a vertical merge out of the table
        + grid(5, *square[:2], (1, 0, "x", 1, 2), (1, 1, "y", 1, 1))  # two cells side by side cover one place
        + grid(6, (0, 0, "a", 1, 1), (0, 1, "a", 1, 1), (1, 0, "", 1, 1), (1, 1, None, 1, 1))
        + grid(8, (0, 0, "a", 1, 1), (2, 0, "b", 1, 1))  # no row 1
        + grid(9, (0, 0, "a", 2, 1), (0, 1, "b", 1, 1), (1, 1, "y", 1, 1))  # a good vertical merge
    )
    tables = rows("doc_id string, table_idx int, expected_cols int", *[("d", t, 3 if t == 0 else None) for t in range(10) if t != 7], ("d", 7, 2))
    got = {r.table_idx: (r.quality_score, r.violations, r.usable) for r in G.grid_invariants(rows(CELL, *data), tables).collect()}
    assert got == {
        0: (0.8, ["grid_col_mismatch"], True), 1: (0.5, ["row_col_count"], False), 2: (1.0, [], True), 3: (0.8, ["vmerge_misalign"], True), 4: (0.8, ["vmerge_misalign"], True),
        5: (0.9, ["soft_anomaly"], True), 6: (0.5, ["duplicate_periods"], False), 7: (0.0, ["empty_grid"], False), 8: (0.5, ["row_col_count"], False), 9: (1.0, [], True),
    }
