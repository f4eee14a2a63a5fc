import itertools
from collections import defaultdict

from pyspark.sql import functions as F

from tieout.operators import notes as N
from tieout.operators.sums import details_against_total

NOTE = "doc_id string, table_idx int, row_idx int, label string, value double"


def note(rows, *lines, table=0):
    return rows(NOTE, *[("d", table, i, l, None if v is None else float(v)) for i, (l, v) in enumerate(lines)])


def typed(df):
    df = df.withColumn("has_numeric", F.col("value").isNotNull())
    return N.with_segments(df.withColumn("kind", N.row_kind(F.col("label"), F.col("has_numeric"))))


def test_sum_of_details(rows):
    got = details_against_total(note(rows, ("a", 100), ("b", 200), ("Total", 300)), "GENERIC_NOTE").collect()[0]
    assert (got.expected, got.actual, got.severity) == (300.0, 300.0, "INFO")


def test_row_kinds(rows):
    df = rows("l string, n boolean", ("Số dư đầu năm", True), ("Closing balance", True), ("Tổng", True), ("Accumulated depreciation", False),
              ("Disposals", True), ("Disposals", False), ("", False), ("", True), ("1.", True), ("Cash", True))
    kinds = [r[0] for r in df.select(N.row_kind(F.col("l"), F.col("n"))).collect()]
    assert kinds == ["OPENING", "CLOSING", "TOTAL_LIKE", "SECTION_HEADER", "MOVEMENT", "SECTION_HEADER", "BLANK", "OTHER", "SECTION_HEADER", "OTHER"]


def test_segments_and_roll_forward(rows):
    df = typed(note(rows, ("Cost", None), ("Opening balance", 10), ("Additions", 5), ("Closing balance", 15),
                    ("Net book value", None), ("Opening balance", 1), ("Closing balance", 2)))
    segs = {r.seg: r for r in N.segments(df).collect()}
    assert (segs[0].ob_row, segs[0].cb_row, segs[0].n_moves, segs[0].confidence) == (1, 3, 1, 1.0)
    ev = {r.seg: r for r in N.roll_forward(df).collect()}
    assert ev[0].expected == 15.0 and not ev[0].is_material
    assert ev[1].reason_code == "DERIVED_SEGMENT"


def test_fallback_movements(rows):
    df = typed(note(rows, ("Opening balance", 10), ("Something", 5), ("Closing balance", 15)))
    assert N.segments(df).collect()[0].confidence == 0.6
    assert N.roll_forward(df).collect()[0].expected == 15.0


def test_lone_total_is_a_warning(rows):
    for value, n in ((1000, 1), (0, 0)):
        df = typed(note(rows, ("Total", value)))
        got = N.scoped_sums(df, N.scopes(df, N.segments(df))).collect()
        assert len(got) == n
        if n:
            assert got[0].reason_code == "NO_DETAIL_ROWS" and not got[0].is_material


def test_total_row_after_blank(rows):
    hit = note(rows, ("A", 10), ("B", 20), ("", None), ("Total", 30))
    assert N.total_row_after_blank(hit).collect()[0].total_row == 3
    miss = note(rows, ("", None), ("A", 10), ("B", 20), ("Total", 30))
    assert N.total_row_after_blank(miss).collect()[0].total_row == 1
    none = note(rows, ("x", None), ("A", 10), ("Total", 30))
    assert N.total_row_after_blank(none).count() == 0
    assert N.total_row_after_blank(none, strict=False).collect()[0].total_row == 2


def test_netting(rows):
    for net, bad in ((800, False), (600, True)):
        plan = N.netting_plan(note(rows, ("Gross total", 1000), ("Less returns", 200), ("Net sales", net)))
        assert N.netting_check(plan).collect()[0].is_material is bad


def brute_walk(lines):
    """Walk the rows as a reader would: (sum, rows counted, row of the sub-total or None) of every block."""
    out, start, n = [], -1, len(lines)
    total = n - 1
    while start + 1 < total:
        i, count, s = start + 1, 0, 0.0
        while i < n - 1:
            label, v = lines[i]
            if label == "" and v is None and i - (start + 1) > 0:
                break
            s += v or 0.0
            count += 1
            i += 1
        if count == 0:
            break
        out.append((round(s, 4), count, i + 1 if count > 1 and i < n - 1 else None))
        new = i - 1 if count == 1 else i + 1
        if new >= total:
            break
        start = new
    return out


def test_block_walk_matches_a_row_walk_over_all_short_layouts(rows):
    layouts = [bits for n in range(1, 10) for bits in itertools.product((0, 1), repeat=n)]
    tables = [[("x", 2.0**k) if bit else ("", None) for k, bit in enumerate(bits)] for bits in layouts]
    long = [("x", float(k)) if k % 7 in (1, 2, 4) or k > 2000 else ("", None) for k in range(2100)]  # over several chunks
    tables += [long, [("x", 1.0), ("", None)] * 1200 + [("x", 1.0)]]
    data = [("d", t, i, label, v) for t, lines in enumerate(tables) for i, (label, v) in enumerate(lines)]
    got = defaultdict(list)
    for r in N.block_walk(rows(NOTE, *data)).collect():
        at = r.subtotal_row if r.compared and r.subtotal is not None else None
        got[r.table_idx].append((r.block, r.sum_details, r.n_counted, at))
    for t, lines in enumerate(tables):
        # a sub-total row that is blank compares with nothing
        want = [(s, c, at if at is not None and lines[at][1] is not None else None) for s, c, at in brute_walk(lines)]
        assert [g[1:] for g in sorted(got[t])] == want, lines[:30]


def test_signed_and_partial_grand_totals(rows):
    lines = [("a", 1), ("b", 2), ("", None), ("s", 3), ("c", 4), ("d", 5), ("", None), ("s", 9), ("e", 7), ("f", 1), ("", None), ("s", 8), ("", None), ("Total", 20)]
    headings = ["Inventories", "Revenue from sales", "Recognised deferred tax assets", "Convertible bonds"]
    data = [("d", t, i, label, None if v is None else float(v)) for t in range(4) for i, (label, v) in enumerate(lines)]
    df = rows(NOTE, *data)
    got = {r.table_idx: (r.expected, r.actual, r.ok) for r in N.signed_grand_total(N.block_walk(df), df, rows("doc_id string, table_idx int, heading string", *[("d", t, h) for t, h in enumerate(headings)])).collect()}
    # the walk ends with a block of one blank row, so leaving the last block out changes nothing here
    assert got == {0: (20.0, 20.0, True), 1: (2.0, 20.0, False), 2: (-6.0, 7.0, False), 3: (20.0, 20.0, True)}


def test_text_formulas(rows):
    got = N.text_formula_percent(note(rows, ("Base", 1234567.89), ("x 20% tax", 246913.58))).collect()[0]
    assert got.ok
    df = rows(NOTE + ", code string", ("d", 0, 0, "a", 5.0, "20"), ("d", 0, 1, "b", 6.0, "21"), ("d", 0, 2, "30 = 20 + 21", 11.0, "30"))
    assert N.text_formula_equation(df).collect()[0].ok


def test_anchor_tolerance(rows):
    for end, ok in ((150, True), (140, False)):
        df = note(rows, ("Balance at 1 Jan", 100), ("Profit", 50), ("Balance at 31 Dec", end)).withColumn("is_anchor", F.col("label").contains("Balance at"))
        assert N.anchor_roll_forward(df).collect()[0].ok is ok


def test_infer_total_column(rows):
    data = [("d", 0, r, c, float(v)) for r, vals in enumerate([(1, 2, 3), (4, 5, 9), (7, 8, 15)]) for c, v in enumerate(vals)]
    df = rows("doc_id string, table_idx int, row_idx int, col_idx int, value double", *data)
    assert N.infer_total_column(df).collect()[0].col_idx == 2
