from tieout.operators import statements as S

ITEMS = "doc_id string, statement_type string, table_idx int, row_idx int, code string, label string, cy double, py double"


def items(rows, *lines, kind="FS_INCOME_STATEMENT"):
    return rows(ITEMS, *[("d", kind, t, i, c, l, float(a), float(b)) for i, (t, c, l, a, b) in enumerate(lines)])


def test_balance_children_and_missing(rows):
    df = items(rows, (0, "110", "", 100, 90), (0, "111", "", 60, 50), (0, "112", "", 40, 40), (0, "140", "", 10, 10), (0, "141", "", 9, 10))
    got = {(r.formula, r.period_ord): r for r in S.balance_check(df).collect()}
    assert got[("110", 0)].ok and got[("110", 1)].ok
    assert not got[("140", 0)].ok and got[("140", 0)].diff == -1.0 and got[("140", 0)].missing == "142"
    assert ("100", 0) not in got


def test_zero_row_never_replaces(rows):
    df = items(rows, (0, "110", "", 5, 6), (0, "110", "", 0, 0), (0, "120", "", 0, 0), (0, "120", "", 7, 0))
    got = {r.code: (r.cy, r.py) for r in S.dedup_keep_nonzero(df, ["code"]).collect()}
    assert got == {"110": (5.0, 6.0), "120": (7.0, 0.0)}


def test_derived_income_tax(rows):
    df = S.long_items(items(rows, (0, "51", "", 100, 90), (0, "52", "", 50, 45)))
    got = {r.period_ord: r.value for r in S.derived_facts(df).where("account_key = 'income tax'").collect()}
    assert got == {0: 150.0, 1: 135.0}


def test_cash_flow_13_subtotal_by_position(rows):
    df = items(rows, (0, "08", "", 10, 0), (0, "12", "", 5, 0), (0, "13", "", 15, 0), (0, "14", "", 1, 0), (0, "20", "", 16, 0), kind="FS_CASH_FLOW")
    got = [r for r in S.cash_flow_rules(S.long_items(df)).collect() if r.assertion == "Formula code 20" and r.period_ord == 0]
    assert got[0].actual == 16.0 and not got[0].is_material


def test_uncoded_row_before_block_acts_as_18(rows):
    df = items(rows, (0, "08", "", 10, 1), (0, "09", "", 5, 1), (0, "", "", 15, 2), (0, "14", "", 1, 0), kind="FS_CASH_FLOW")
    got = {(r.formula, r.period_ord): r for r in S.cash_flow_check_baseline(df).collect()}
    assert got[("18", 0)].ok and got[("18", 0)].reported == 15.0


def test_explicit_formula_overrides_template(rows):
    df = items(rows, (0, "10", "", 100, 0), (0, "20", "Gross (20 = 10 - 12)", 70, 0), (0, "11", "", 50, 0), (0, "12", "", 30, 0))
    got = {(r.formula, r.period_ord): r for r in S.income_check_templates(df).collect()}
    assert got[("20", 0)].ok and got[("20", 0)].computed == 70.0


def test_registry_sums_over_tables(rows):
    df = items(rows, (0, "01", "", 10, 5), (1, "01", "", 0, 0), (0, "02", "", 20, 10), (0, "08", "", 30, 15), (1, "08", "", 0, 0), kind="FS_CASH_FLOW")
    got = {(r.formula, r.period_ord): r for r in S.cash_flow_registry_check(df).collect()}
    assert got[("08", 0)].ok and got[("08", 0)].reported == 30.0 and got[("08", 1)].computed == 15.0


def test_note_column_code_rescue(rows):
    a = rows("code string, note string", ("", "9"), ("20", "x"), ("", "abc"))
    assert sorted(r.code for r in S.union_parts(a).collect()) == ["", "09", "20"]
