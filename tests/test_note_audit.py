import pytest

from tieout.plans import note_audit as A

NOTE = "doc_id string, table_idx int, row_idx int, label string, value double"
HEAD = "doc_id string, table_idx int, heading string"
COLS = "doc_id string, table_idx int, row_idx int, col_idx int, header string, value double"

TABLES = [
    ("Fixed assets", [("Cost", None), ("Opening balance", 5), ("Additions", 2), ("Closing balance", 8)]),
    ("Inventories", [("a", 1), ("b", 2), ("Total", 3)]),
    ("Inventories", [("a", 1), ("b", 2), ("Total", 9000)]),
    ("Number of shares", [("a", 1), ("b", 2), ("Total", 3)]),
    ("Detailed by related parties", [("a", 1), ("b", 2), ("Total", 4)]),
    ("Sales", [("Gross total", 10), ("Less: allowances", -3), ("Net amount", 7)]),
    ("Odd", [("Opening balance", 1), ("a", 2)]),
    ("Empty", [("a", None), ("b", None)]),
    ("Movement table", [("Opening balance", 1), ("a", 2)]),
]


@pytest.fixture
def audited(rows):
    data = [("d", t, r, label, None if v is None else float(v)) for t, (_, lines) in enumerate(TABLES) for r, (label, v) in enumerate(lines)]
    columns = [("d", 8, r, c, h, float(v)) for r, vs in enumerate([(1, 2, 3), (1, 2000, 3)]) for c, (h, v) in enumerate(zip(("Opening balance", "Additions", "Closing balance"), vs))]
    return rows(NOTE, *data), rows(HEAD, *[("d", t, h) for t, (h, _) in enumerate(TABLES)]), rows(COLS, *columns)


def test_modes_come_from_rows(audited):
    notes, headings, columns = audited
    got = {r.table_idx: (r.mode, r.status) for r in A.note_plans(A.structured(notes), headings, columns).collect()}
    assert got == {
        0: ("MOVEMENT_BY_ROWS", "OK"), 1: ("GENERIC_NUMERIC_NOTE", "OK"), 2: ("GENERIC_NUMERIC_NOTE", "OK"), 3: ("LISTING_NO_TOTAL", "NO_TOTAL"), 4: ("LISTING_TOTALS", "OK"),
        5: ("HIERARCHICAL_NETTING", "OK"), 6: ("UNDETERMINED", "UNDETERMINED"), 7: ("UNDETERMINED", "UNDETERMINED"), 8: ("MOVEMENT_BY_COLUMNS", "UNDETERMINED"),
    }


def test_rules_follow_the_mode(audited):
    got = {}
    for r in A.audit_notes(*audited).collect():
        got.setdefault(r.table_idx, set()).add((r.rule_id, r.is_material))
    assert ("MOVEMENT_ROLLFORWARD", False) in got[0]
    assert got[1] == {("VERTICAL_SUM_SCOPED", False), ("NOTE_BREAKDOWN_TOTALS", False)} and got[2] == {("VERTICAL_SUM_SCOPED", True), ("NOTE_BREAKDOWN_TOTALS", True)}
    assert got[3] == {("UNVERIFIED_NUMERIC_TABLE", False)}  # no totals expected, no rule runs
    assert got[4] == {("VERTICAL_SUM_SCOPED", False)} and got[5] == {("NETTING_BLOCKS", False)}
    assert got[6] == {("NOTE_STRUCTURE_UNDETERMINED", False), ("BASIC_NUMERIC_CHECKS", False)}
    assert got[7] == {("NOTE_STRUCTURE_UNDETERMINED", False)}
    assert ("MOVEMENT_BY_COLUMNS", True) in got[8]
