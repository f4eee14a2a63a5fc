"""Note structure, totals, scopes, roll-forwards, netting, blocks and anchors."""

from pyspark.sql import functions as F

from tieout.operators import notes as N
from tieout.operators.scans import Scan, scan
from tieout.plans import views as V
from tieout.queries import oracle_views as O
from tieout.queries.registry import query

EVK = ["expected", "actual", "diff", "tolerance", "is_material", "severity", "reason_code"]


def _tol(base):
    return f"greatest(1.0, least(0.008 * abs({base}), 1000000.0))"


def _roll(spark, sf):
    rows = V.roll_rows(spark, sf).drop("kind", "event_type", "ts", "event_id")
    # section headers ("Cost") carry no amount
    rows = rows.withColumn("value", F.when(F.col("label") != "Cost", F.col("value")))
    return rows.withColumn("kind", N.row_kind(F.col("label"), F.col("value").isNotNull()))


_ROLL = (
    O.ROLL
    + """, rk AS (SELECT doc_id, table_idx, row_idx, label, CASE WHEN label = 'Cost' THEN NULL ELSE value END AS value,
   CASE event_type WHEN 'signup' THEN 'OPENING' WHEN 'purchase' THEN 'CLOSING' WHEN 'click' THEN 'MOVEMENT' WHEN 'view' THEN 'OTHER' ELSE 'SECTION_HEADER' END AS kind FROM roll),
 rs AS (SELECT *, CAST(sum(CASE WHEN kind = 'SECTION_HEADER' AND row_idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, table_idx ORDER BY row_idx) AS BIGINT) AS seg FROM rk),
 sg0 AS (SELECT doc_id, table_idx, seg, min(row_idx) AS start_row, CAST(max(row_idx) + 1 AS INTEGER) AS end_row,
   max(row_idx) FILTER (kind = 'OPENING') AS ob_row, max(row_idx) FILTER (kind = 'CLOSING') AS cb_row,
   count(*) FILTER (kind = 'MOVEMENT') AS n_keyword, lower(arg_min(label, row_idx)) AS name FROM rs GROUP BY 1, 2, 3),
 sg AS (SELECT *, CASE WHEN n_keyword > 0 THEN n_keyword ELSE n_fb END AS n_moves,
    CASE WHEN ob_row IS NOT NULL AND cb_row IS NOT NULL AND n_keyword > 0 THEN 1.0 WHEN ob_row IS NOT NULL AND cb_row IS NOT NULL AND n_fb > 0 THEN 0.6
     WHEN ob_row IS NOT NULL AND cb_row IS NOT NULL THEN 0.7 WHEN ob_row IS NOT NULL OR cb_row IS NOT NULL THEN 0.4 ELSE 0.0 END AS confidence
   FROM (SELECT sg0.*, (SELECT count(*) FROM rs WHERE rs.doc_id = sg0.doc_id AND rs.table_idx = sg0.table_idx AND rs.seg = sg0.seg AND kind = 'OTHER'
      AND n_keyword = 0 AND rs.row_idx > ob_row AND rs.row_idx < cb_row) AS n_fb FROM sg0))"""
)


@query("row_kinds", f"WITH {_ROLL} SELECT kind, label, count(*) AS n FROM rk GROUP BY 1, 2")
def row_kinds(spark, sf):
    return _roll(spark, sf).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "note_segments",
    f"""WITH {_ROLL} SELECT doc_id, table_idx, seg, start_row, end_row, coalesce(ob_row, -1) AS ob_row, coalesce(cb_row, -1) AS cb_row,
        n_moves, CAST(confidence AS DOUBLE) AS confidence, name FROM sg""",
)
def note_segments(spark, sf):
    s = N.segments(N.with_segments(_roll(spark, sf)))
    return s.select("doc_id", "table_idx", "seg", "start_row", "end_row", F.coalesce("ob_row", F.lit(-1)).alias("ob_row"),
                    F.coalesce("cb_row", F.lit(-1)).alias("cb_row"), "n_moves", "confidence", "name")


@query(
    "roll_forward_by_segment",
    f"""WITH {_ROLL}, s AS (SELECT sg.doc_id, sg.table_idx, sg.seg, any_value(confidence) AS conf,
        max(value) FILTER (row_idx = ob_row) AS ob, max(value) FILTER (row_idx = cb_row) AS cb,
        coalesce(round(CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (CASE WHEN n_keyword > 0 THEN kind = 'MOVEMENT' ELSE kind = 'OTHER' AND row_idx > ob_row AND row_idx < cb_row END) AS DOUBLE), 4), 0) AS mv
        FROM sg JOIN rs USING (doc_id, table_idx, seg) GROUP BY 1, 2, 3),
      e AS (SELECT doc_id, table_idx, seg, conf < 0.5 AS w, CASE WHEN conf < 0.5 THEN 0 ELSE round(ob + mv, 4) END AS expected, CASE WHEN conf < 0.5 THEN 0 ELSE cb END AS actual,
        CASE WHEN conf < 0.5 THEN 0 ELSE {_tol('greatest(abs(ob), abs(cb))')} END AS tolerance FROM s)
      SELECT doc_id, table_idx, seg, expected, actual, round(actual - expected, 4) AS diff, tolerance, NOT w AND abs(round(actual - expected, 4)) > tolerance AS is_material,
        CASE WHEN NOT w AND abs(round(actual - expected, 4)) > tolerance THEN 'MAJOR' ELSE 'INFO' END AS severity, CASE WHEN w THEN 'STRUCTURE_INCOMPLETE' END AS reason_code FROM e""",
)
def roll_forward_by_segment(spark, sf):
    return N.roll_forward(N.with_segments(_roll(spark, sf))).select("doc_id", "table_idx", "seg", *EVK)


@query(
    "roll_forward_by_terms",
    f"""WITH {_ROLL}, s AS (SELECT doc_id, table_idx, max(row_idx) FILTER (kind = 'OPENING') AS ob_row, max(row_idx) FILTER (kind = 'CLOSING') AS cb_row, count(*) FILTER (kind = 'MOVEMENT') AS n_moves,
        arg_max(value, row_idx) FILTER (kind = 'OPENING') AS ob, arg_max(value, row_idx) FILTER (kind = 'CLOSING') AS cb,
        coalesce(round(CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (kind = 'MOVEMENT') AS DOUBLE), 4), 0) AS mv FROM rk GROUP BY 1, 2)
      SELECT doc_id, table_idx, ob_row, cb_row, n_moves, round(ob + mv, 4) AS expected, cb AS actual,
        abs(round(ob + mv, 4) - cb) <= greatest(0.01, 0.008 * greatest(abs(round(ob + mv, 4)), abs(cb), 1)) AS ok FROM s WHERE ob_row IS NOT NULL AND cb_row IS NOT NULL""",
)
def roll_forward_by_terms(spark, sf):
    return N.roll_forward_by_terms(_roll(spark, sf))


def _note(spark, sf):
    n = V.note_amounts(spark, sf)
    n = n.withColumn("has_numeric", F.col("value").isNotNull())
    return n.withColumn("kind", N.row_kind(F.col("label"), F.col("has_numeric"))).withColumn("seg", F.lit(0))


_NT = f"""{O.NOTE}, nt AS (SELECT doc_id, table_idx, max(row_idx) FILTER (label = 'Total') AS total_row, max(value) FILTER (label = 'Total') AS t,
   round(CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (label <> 'Total') AS DOUBLE), 4) AS s, count(*) FILTER (label LIKE 'Item%') AS n FROM note GROUP BY 1, 2)"""


def _evidence(select, expected, actual, tol, material, severity):
    return f"""SELECT {select}, {expected} AS expected, {actual} AS actual, round({actual} - {expected}, 4) AS diff, {tol} AS tolerance,
      {material} AS is_material, CASE WHEN {material} THEN '{severity}' ELSE 'INFO' END AS severity, CAST(NULL AS VARCHAR) AS reason_code"""


@query(
    "scoped_vertical_sums",
    f"WITH {_NT} " + _evidence("doc_id, table_idx, total_row, n AS n_details", "t", "s", _tol("t"), f"abs(round(s - t, 4)) > {_tol('t')}", "MAJOR") + " FROM nt",
)
def scoped_vertical_sums(spark, sf):
    rows = _note(spark, sf)
    sc = N.scopes(rows, N.segments(rows))
    return N.scoped_sums(rows, sc).select("doc_id", "table_idx", "total_row", "n_details", *EVK)


@query("scope_detection", f"WITH {_NT} SELECT doc_id, table_idx, total_row, 0 AS start_row, CAST(total_row + 1 AS INTEGER) AS end_row FROM nt")
def scope_detection(spark, sf):
    rows = _note(spark, sf)
    return N.scopes(rows, N.segments(rows)).drop("seg")


@query("generic_scope_until_total", f"WITH {_NT} SELECT doc_id, table_idx, total_row FROM nt WHERE total_row > 0")
def generic_scope_until_total(spark, sf):
    return N.generic_scopes(_note(spark, sf))


@query(
    "fallback_vertical_sums",
    f"""WITH {_NT} SELECT doc_id, table_idx, total_row, 'label_regex' AS strategy, t AS expected, s AS actual, round(s - t, 4) AS diff,
      abs(round(s - t, 4)) > 1 AS is_material, CASE WHEN abs(round(s - t, 4)) > 1 THEN 'MINOR' ELSE 'INFO' END AS severity FROM nt""",
)
def fallback_vertical_sums(spark, sf):
    return N.fallback_sums(V.note_amounts(spark, sf))


@query(
    "implicit_listing_totals",
    f"""WITH {O.BLOCKS}, f AS (SELECT table_idx, b, count(*) FILTER (part = 0) AS n FROM blocks GROUP BY 1, 2),
      r AS (SELECT b1.doc_id, b1.table_idx, b1.row_idx AS total_row, n AS n_details FROM blocks b1 JOIN f USING (table_idx, b) WHERE b1.part = 2 AND n >= 2 AND table_idx % 4 <> 0)
      SELECT doc_id, table_idx, total_row, n_details FROM r""",
)
def implicit_listing_totals(spark, sf):
    # drop the blank between details and sub-total so that each listing block ends with its total
    rows = V.block_rows(spark, sf)
    prev = scan(rows, ["doc_id", "table_idx"], "row_idx", [Scan("nxt", "lag", F.col("label"))], descending=True)
    rows = prev.where(~((F.col("label") == "") & (F.coalesce("nxt", F.lit("")) == "Subtotal")))
    rows = rows.withColumn("kind", N.row_kind(F.col("label"), F.col("value").isNotNull()))
    return N.implicit_totals(rows).select("doc_id", "table_idx", "total_row", "n_details")


@query(
    "total_row_after_blank",
    f"WITH {_NT} SELECT doc_id, table_idx, total_row, total_row AS last_numeric FROM nt",
)
def total_row_after_blank(spark, sf):
    return N.total_row_after_blank(V.note_amounts(spark, sf))


@query("total_row_ranked", f"WITH {_NT} SELECT doc_id, table_idx, total_row, 'keyword' AS source FROM nt")
def total_row_ranked(spark, sf):
    return N.total_row_ranked(V.note_amounts(spark, sf))


@query(
    "total_scope_priority",
    f"""WITH {_NT} SELECT doc_id, table_idx, CASE table_idx % 4 WHEN 3 THEN -1 ELSE total_row END AS total_row,
      CASE table_idx % 4 WHEN 0 THEN 'note_structure_scope_0' WHEN 1 THEN 'legacy_blank_row_before_total' WHEN 2 THEN 'legacy_tax_reconciliation_fallback' ELSE 'legacy_no_total_detected' END AS source FROM nt""",
)
def total_scope_priority(spark, sf):
    rows = _note(spark, sf)
    pick = F.col("table_idx") % 4
    structure = N.scopes(rows, N.segments(rows)).where(pick == 0)
    by_blank = N.total_row_after_blank(V.note_amounts(spark, sf)).where(pick <= 1)
    tables = rows.groupBy("doc_id", "table_idx").agg((F.max("row_idx") + 1).alias("n_rows")).select(
        "doc_id", "table_idx", "n_rows",
        F.when(pick == 2, "TAX_NOTE").otherwise("GENERIC_NOTE").alias("table_type"),
        F.when(pick == 2, "reconciliation of effective tax rate").otherwise("other").alias("heading"),
    ).withColumn("n_rows", F.when(pick == 2, F.greatest("n_rows", F.lit(3))).otherwise(F.col("n_rows")))
    return N.total_scope_priority(structure, by_blank, tables).withColumn("total_row", F.coalesce("total_row", F.lit(-1)))


_NP = f"""{O.NETTING}, tri AS (SELECT a.doc_id, a.table_idx, a.row_idx AS t, b.row_idx AS l, c.row_idx AS n, a.value AS tv, b.value AS lv, c.value AS nv,
    greatest(a.row_idx, b.row_idx, c.row_idx) - least(a.row_idx, b.row_idx, c.row_idx) AS span
   FROM netting a JOIN netting b USING (table_idx) JOIN netting c USING (table_idx) WHERE a.label = 'Gross total' AND b.label LIKE 'Less%' AND c.label = 'Net amount'),
  np AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_idx ORDER BY span > 5, t, l, n) AS rn FROM tri WHERE span <= 25) WHERE rn = 1)"""


@query(
    "netting_plan",
    f"WITH {_NP} SELECT doc_id, table_idx, t AS total_row, l AS less_row, n AS net_row, CAST(CASE WHEN span > 5 THEN 25 ELSE 5 END AS INTEGER) AS max_dist FROM np",
)
def netting_plan(spark, sf):
    return N.netting_plan(V.netting_rows(spark, sf)).drop("total_value", "less_value", "net_value")


@query(
    "netting_check",
    f"WITH {_NP}, e AS (SELECT *, round(CASE WHEN lv < 0 THEN tv + lv ELSE tv - lv END, 4) AS e FROM np) "
    + _evidence("doc_id, table_idx", "e", "nv", _tol("e"), f"abs(round(nv - e, 4)) > {_tol('e')}", "MAJOR") + " FROM e",
)
def netting_check(spark, sf):
    return N.netting_check(N.netting_plan(V.netting_rows(spark, sf))).select("doc_id", "table_idx", *EVK)


@query(
    "netting_acceptance",
    f"""WITH {_NP} SELECT doc_id, table_idx, CAST(1 AS BIGINT) AS n_cols, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS n_ok, ok AS accepted
      FROM (SELECT *, abs(e - nv) <= greatest(0.01, 0.008 * greatest(abs(e), abs(nv), 1)) AS ok FROM (SELECT *, CASE WHEN lv < 0 THEN tv + lv ELSE tv - lv END AS e,
      FROM (SELECT * REPLACE (CASE WHEN table_idx % 2 = 0 THEN CASE WHEN lv < 0 THEN tv + lv ELSE tv - lv END ELSE nv END AS nv) FROM np)))""",
)
def netting_acceptance(spark, sf):
    p = N.netting_plan(V.netting_rows(spark, sf)).withColumn("anchored", F.lit(True))
    exact = F.when(F.col("less_value") < 0, F.col("total_value") + F.col("less_value")).otherwise(F.col("total_value") - F.col("less_value"))
    p = p.withColumn("net_value", F.when(F.col("table_idx") % 2 == 0, exact).otherwise(F.col("net_value")))
    return N.netting_acceptance(p)


# the walk, row by row: i moves through a block that began behind row start; a closed block leaves (k, d, e, f): rows, sum, end, blanks in front
_BW = f"""WITH RECURSIVE {O.BLOCKS}, rw AS (SELECT *, label = '' AND value IS NULL AS blank, count(*) OVER (PARTITION BY table_idx) AS n FROM blocks),
  w AS (SELECT doc_id, table_idx, n, -1::BIGINT AS start, 0::BIGINT AS i, 0::BIGINT AS k0, 0::DECIMAL(20,2) AS s0, 0::BIGINT AS f0,
      NULL::BIGINT AS k, NULL::DECIMAL(20,2) AS d, NULL::BIGINT AS e, NULL::BIGINT AS f FROM rw WHERE row_idx = 0 AND n > 1
    UNION ALL
    SELECT doc_id, table_idx, n, CASE WHEN shut THEN nxt ELSE start END, CASE WHEN shut THEN nxt + 1 ELSE i + 1 END,
      CASE WHEN shut THEN 0 ELSE k0 + 1 END, CASE WHEN shut THEN 0 ELSE s0 + coalesce(value::DECIMAL(20,2), 0) END, CASE WHEN shut OR NOT blank THEN CASE WHEN shut THEN 0 ELSE f0 END ELSE f0 + 1 END,
      CASE WHEN shut THEN k0 END, CASE WHEN shut THEN s0 END, CASE WHEN shut THEN i END, CASE WHEN shut THEN f0 END
    FROM (SELECT w.doc_id, w.table_idx, w.n, w.start, w.i, w.k0, w.s0, w.f0, r.value, r.blank, w.i >= w.n - 1 OR (r.blank AND w.i > w.start + 1) AS shut,
        CASE WHEN w.k0 = 1 THEN w.i - 1 ELSE w.i + 1 END AS nxt
      FROM w JOIN rw r ON r.table_idx = w.table_idx AND r.row_idx = w.i WHERE w.start + 1 < w.n - 1)),
  st AS (SELECT doc_id, table_idx, n, k, round(d::DOUBLE, 4) AS sum_details, e, k - f AS n_details, k > 1 AND e < n - 1 AS compared, row_number() OVER (PARTITION BY table_idx ORDER BY e, k) AS r FROM w WHERE k >= 1),
  sb AS (SELECT st.*, CASE WHEN compared THEN e + 1 END AS subtotal_row, rw.value AS subtotal FROM st LEFT JOIN rw ON st.compared AND rw.table_idx = st.table_idx AND rw.row_idx = st.e + 1)"""


@query(
    "block_subtotals",
    f"""{_BW} SELECT doc_id, table_idx, n_details, sum_details, subtotal_row::INTEGER AS subtotal_row, subtotal, abs(round(sum_details - subtotal, 4)) <= 0.5 AS ok
      FROM sb WHERE compared AND subtotal IS NOT NULL""",
)
def block_subtotals(spark, sf):
    b = N.block_sums(V.block_rows(spark, sf))
    return b.select("doc_id", "table_idx", "n_details", "sum_details", "subtotal_row", "subtotal", "ok")


@query(
    "block_grand_totals",
    f"""{_BW}, g AS (SELECT doc_id, table_idx, round(CAST(sum(sum_details::DECIMAL(20,2)) AS DOUBLE), 4) AS expected, count(*) AS n_blocks FROM sb GROUP BY 1, 2)
      SELECT g.doc_id, g.table_idx, expected, n_blocks, value AS actual, abs(round(expected - value, 4)) <= 0.5 AS ok FROM g JOIN rw ON rw.table_idx = g.table_idx AND rw.row_idx = rw.n - 1 WHERE n_blocks > 1""",
)
def block_grand_totals(spark, sf):
    rows = V.block_rows(spark, sf)
    return N.grand_total(N.block_walk(rows, short=N.short_walks(rows)), rows)


@query(
    "movement_columns_plan",
    f"WITH {O.DAILY} SELECT DISTINCT doc_id, table_idx, 0 AS ob_col, 3 AS cb_col, '1' AS move_cols FROM daily",
)
def movement_columns_plan(spark, sf):
    d = V.daily_columns(spark, sf)
    cols = d.groupBy("doc_id", "table_idx", "col_idx").agg(F.first("header").alias("header"))
    # here the third column is a plain disclosure, so only one column moves
    cols = cols.withColumn("header", F.when(F.col("col_idx") == 2, "Memo").otherwise(F.col("header")))
    return N.movement_columns_plan(cols).withColumn("move_cols", F.array_join("move_cols", ","))


@query(
    "movement_by_columns",
    f"""WITH {O.DAILY}, r AS (SELECT *, round(ob + m1 + m2, 4) AS e FROM daily WHERE m1 IS NOT NULL AND m2 IS NOT NULL),
      f AS (SELECT *, {_tol('greatest(abs(ob), abs(cb))')} AS tolerance FROM r)
      SELECT doc_id, table_idx, row_idx, e AS expected, cb AS actual, tolerance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY row_idx) AS k FROM f WHERE abs(round(e - cb, 4)) > tolerance) WHERE k = 1""",
)
def movement_by_columns(spark, sf):
    d = V.daily_columns(spark, sf)
    cols = d.groupBy("doc_id", "table_idx", "col_idx").agg(F.first("header").alias("header"))
    return N.movement_by_columns(d, N.movement_columns_plan(cols))


@query(
    "anchor_roll_forward",
    f"""WITH {O.ROLL}, r AS (SELECT *, CAST(sum(CASE WHEN kind = 'OPENING' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, table_idx ORDER BY row_idx) AS BIGINT) AS block FROM roll),
      b AS (SELECT doc_id, table_idx, block, max(row_idx) FILTER (kind = 'OPENING') AS ar, max(value) FILTER (kind = 'OPENING') AS av,
        coalesce(round(CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (label NOT IN ('Opening balance', 'Closing balance')) AS DOUBLE), 4), 0) AS mv FROM r WHERE block > 0 GROUP BY 1, 2, 3),
      n AS (SELECT *, lead(ar) OVER w AS er, lead(av) OVER w AS ev FROM b WINDOW w AS (PARTITION BY doc_id, table_idx ORDER BY block))
      SELECT doc_id, table_idx, block, er AS row_idx, round(av + mv, 4) AS expected, ev AS actual,
        abs(round(av + mv, 4) - ev) <= greatest(0.01, 0.012 * greatest(abs(round(av + mv, 4)), abs(ev), 1)) AS ok FROM n WHERE er IS NOT NULL""",
)
def anchor_roll_forward(spark, sf):
    rows = V.roll_rows(spark, sf).withColumn("is_anchor", F.col("kind") == "OPENING")
    return N.anchor_roll_forward(rows)


_PIVOT = """pv AS (SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 2) AS a,
   round(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 2) AS n, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS r FROM lineitem GROUP BY 1, 2),
  pt AS (SELECT *, coalesce(a, 0) + coalesce(n, 0) + coalesce(r, 0) + CASE WHEN l_linenumber % 4 = 3 THEN 100000 ELSE 0 END AS t FROM pv),
  long AS (SELECT l_orderkey % 1000 AS doc_id, l_orderkey AS table_idx, l_linenumber AS row_idx, c AS col_idx, round(CASE c WHEN 0 THEN a WHEN 1 THEN n WHEN 2 THEN r ELSE t END, 2) AS value
   FROM pt, (VALUES (0), (1), (2), (3)) v(c))"""


def _flag_columns(spark, sf):
    """Return-flag columns with a total column that is wrong on every fourth line number."""
    flag = F.col("l_returnflag")
    p = V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.round(F.sum(F.when(flag == k, F.col("l_extendedprice"))), 2).alias(k) for k in ("A", "N", "R")]
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    off = F.when(F.col("l_linenumber") % 4 == 3, 100000.0).otherwise(0.0)
    p = p.withColumn("T", F.round(z("A") + z("N") + z("R") + off, 2))
    return p.select(
        (F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("table_idx"), F.col("l_linenumber").alias("row_idx"),
        F.expr("stack(4, 0, A, 1, N, 2, R, 3, T) as (col_idx, value)"),
    )


@query(
    "total_column_check",
    f"""WITH {_PIVOT} SELECT doc_id, table_idx, row_idx, round(coalesce(sum(value) FILTER (col_idx < 3), 0), 4) AS expected, max(value) FILTER (col_idx = 3) AS actual,
       abs(round(round(coalesce(sum(value) FILTER (col_idx < 3), 0), 4) - max(value) FILTER (col_idx = 3), 4)) <= 0.5 AS ok FROM long GROUP BY 1, 2, 3 HAVING count(value) FILTER (col_idx < 3) >= 2""",
)
def total_column_check(spark, sf):
    return N.total_column(_flag_columns(spark, sf))


@query(
    "total_column_inferred",
    f"""WITH {_PIVOT}, s AS (SELECT table_idx, row_idx, sum(value) AS s, count(value) AS n FROM long GROUP BY 1, 2),
      m AS (SELECT l.doc_id, l.table_idx, col_idx, CAST(sum(CASE WHEN n >= 3 AND abs(s - value - value) <= greatest(0.01, 0.008 * greatest(abs(s - value), abs(value), 1)) THEN 1 ELSE 0 END) AS BIGINT) AS matches
        FROM long l JOIN s USING (table_idx, row_idx) WHERE value IS NOT NULL GROUP BY 1, 2, 3)
      SELECT doc_id, table_idx, col_idx, matches FROM (SELECT *, row_number() OVER (PARTITION BY table_idx ORDER BY matches DESC, col_idx) AS k FROM m) WHERE k = 1 AND matches >= 2""",
)
def total_column_inferred(spark, sf):
    return N.infer_total_column(_flag_columns(spark, sf))


@query(
    "text_formula_percent",
    f"""WITH {O.LINES}, r AS (SELECT *, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY row_idx) AS p FROM lines),
      e AS (SELECT l_orderkey % 1000 AS doc_id, l_orderkey AS table_idx, row_idx, round(p * 20 / 100, 6) AS expected, CASE WHEN l_orderkey % 2 = 0 THEN round(p * 0.2, 2) ELSE l_extendedprice END AS actual
        FROM r WHERE row_idx % 2 = 1 AND NOT (p BETWEEN 1900 AND 2100 AND floor(p) = p))
      SELECT *, abs(expected - actual) <= greatest(0.01, 0.008 * greatest(abs(expected), abs(actual), 1)) AS ok FROM e
      WHERE NOT (actual BETWEEN 1900 AND 2100 AND floor(actual) = actual)""",
)
def text_formula_percent(spark, sf):
    lines = V.order_lines(spark, sf)
    prev = scan(lines, ["l_orderkey"], "row_idx", [Scan("p", "lag", F.col("l_extendedprice"))])
    odd = F.col("row_idx") % 2 == 1
    rows = prev.select(
        (F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("table_idx"), "row_idx",
        F.when(odd, "Tax x 20%").otherwise("Base").alias("label"),
        F.when(odd & (F.col("l_orderkey") % 2 == 0), F.round(F.col("p") * 0.2, 2)).otherwise(F.col("l_extendedprice")).alias("value"),
    )
    return N.text_formula_percent(rows)


@query(
    "text_formula_equation",
    f"""WITH {O.FS}, c AS (SELECT doc_id, table_idx, code, arg_max(cy, row_idx) AS v, max(row_idx) AS r FROM fs WHERE code <> '00' GROUP BY 1, 2, 3),
      e AS (SELECT f.doc_id, f.table_idx, f.row_idx AS label_row, a.r AS row_idx, round(b.v - d.v, 4) AS expected, a.v AS actual FROM fs f
        JOIN c a ON a.doc_id = f.doc_id AND a.table_idx = f.table_idx AND a.code = '40' JOIN c b ON b.doc_id = f.doc_id AND b.table_idx = f.table_idx AND b.code = '31'
        JOIN c d ON d.doc_id = f.doc_id AND d.table_idx = f.table_idx AND d.code = '32' WHERE f.code = '40')
      SELECT *, abs(expected - actual) <= greatest(0.01, 0.008 * greatest(abs(expected), abs(actual), 1)) AS ok FROM e""",
)
def text_formula_equation(spark, sf):
    rows = V.statement_rows(spark, sf).select("doc_id", "table_idx", "row_idx", "code", "label", F.col("cy").alias("value"))
    return N.text_formula_equation(
        rows.withColumn("label", F.when(F.col("code") == "40", "Other profit (40) = (31) - (32)").otherwise(F.col("label")))
    )


@query(
    "tax_reconciliation_steps",
    """WITH s AS (SELECT l_orderkey AS k, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE), 2) AS p, round(CAST(sum(CAST(round(l_quantity, 2) AS DECIMAL(20,2))) AS DOUBLE), 2) AS q FROM lineitem GROUP BY 1),
      d AS (SELECT k, p, q, CASE WHEN k % 3 = 0 THEN round(p * 2, 2) ELSE round(p * 0.2, 2) END AS t FROM s),
      e AS (SELECT k, 1 AS step, CASE WHEN k % 3 = 0 THEN round(p * 0.25, 4) ELSE round(p * abs(t / p), 4) END AS expected, t AS actual FROM d
        UNION ALL SELECT k, 2, round(t + q, 4), CASE WHEN k % 4 = 0 THEN t ELSE round(t + q, 2) END FROM d
        UNION ALL SELECT k, 3, round(t + q + 7, 4), round(t + q + 7, 2) FROM d)
      SELECT k % 1000 AS doc_id, k AS table_idx, step, expected, actual, abs(round(expected - actual, 4)) <= 0.5 AS ok FROM e""",
)
def tax_reconciliation_steps(spark, sf):
    s = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("p"), F.round(F.sum("l_quantity"), 2).alias("q")
    )
    t = F.when(F.col("k") % 3 == 0, F.round(F.col("p") * 2, 2)).otherwise(F.round(F.col("p") * 0.2, 2))
    s = s.withColumn("t", t)
    total1 = F.when(F.col("k") % 4 == 0, F.col("t")).otherwise(F.round(F.col("t") + F.col("q"), 2))
    kinds = ["Accounting profit before tax", "Tax at the Company’s tax rate", "Non-deductible expenses", "", "Subtotal", "Under provision", "Total"]
    rows = s.withColumn("row_idx", F.explode(F.array(*[F.lit(i) for i in range(7)]))).select(
        (F.col("k") % 1000).alias("doc_id"), F.col("k").alias("table_idx"), "row_idx",
        F.element_at(F.array(*[F.lit(x) for x in kinds]), F.col("row_idx") + 1).alias("label"),
        F.when(F.col("row_idx") == 0, F.col("p")).when(F.col("row_idx") == 1, F.col("t")).when(F.col("row_idx") == 2, F.col("q"))
        .when(F.col("row_idx") == 4, total1).when(F.col("row_idx") == 5, 7.0)
        .when(F.col("row_idx") == 6, F.round(F.col("t") + F.col("q") + 7, 2)).alias("value"),
    )
    return N.tax_reconciliation(rows)


@query(
    "running_windows",
    f"""WITH {O.LINES} SELECT l_orderkey, row_idx, round(sum(l_extendedprice) OVER w, 2) AS running, round(coalesce(sum(l_extendedprice) OVER b, 0), 2) AS before,
      coalesce(lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY row_idx), -1) AS prev, count(*) OVER w AS seen,
      coalesce(last_value(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END IGNORE NULLS) OVER w, -1) AS last_r FROM lines
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY row_idx ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY l_orderkey ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def running_windows(spark, sf):
    lines = V.order_lines(spark, sf, "l_returnflag")
    v = F.col("l_extendedprice")
    # three-row chunks here, so that the cross-chunk carry is exercised by small orders
    out = scan(
        lines, ["l_orderkey"], "row_idx",
        [Scan("running", "sum", v), Scan("before", "sum", v, inclusive=False), Scan("prev", "lag", v), Scan("seen", "count", v),
         Scan("last_r", "last", F.when(F.col("l_returnflag") == "R", v))],
        chunk_rows=3,
    )
    return out.select(
        "l_orderkey", "row_idx", F.round("running", 2).alias("running"), F.round(F.coalesce("before", F.lit(0.0)), 2).alias("before"),
        F.coalesce("prev", F.lit(-1.0)).alias("prev"), "seen", F.coalesce("last_r", F.lit(-1.0)).alias("last_r"),
    )


@query(
    "block_grand_totals_signed",
    f"""{_BW}, s AS (SELECT *, max(r) OVER (PARTITION BY table_idx) AS n_blocks FROM sb),
      g AS (SELECT doc_id, table_idx, n, max(n_blocks) AS n_blocks, max(CASE WHEN r = 2 AND table_idx % 4 = 1 THEN subtotal_row + 1 END) AS stop,
          round(CAST(sum(CASE WHEN table_idx % 4 = 1 AND r > 2 THEN 0 WHEN table_idx % 4 = 3 AND r = n_blocks THEN 0
            WHEN r = 2 AND table_idx % 4 IN (0, 1) AND compared AND coalesce(subtotal > 0, TRUE) THEN -sum_details::DECIMAL(20,2) ELSE sum_details::DECIMAL(20,2) END) AS DOUBLE), 4) AS expected FROM s GROUP BY 1, 2, 3)
      SELECT g.doc_id, g.table_idx, expected, n_blocks, coalesce(value, 0) AS actual, abs(round(expected - coalesce(value, 0), 4)) <= 0.5 AS ok FROM g JOIN rw ON rw.table_idx = g.table_idx AND rw.row_idx = coalesce(stop, g.n - 1) WHERE n_blocks > 1""",
)
def block_grand_totals_signed(spark, sf):
    rows = V.block_rows(spark, sf)
    k = F.col("o_orderkey")
    kinds = F.when(k % 4 == 0, "Revenue from sales of goods").when(k % 4 == 1, "Recognised deferred tax assets").when(k % 4 == 3, "Long-term provisions").otherwise("Inventories")
    headings = V.table(spark, sf, "orders").select((k % 1000).alias("doc_id"), k.alias("table_idx"), kinds.alias("heading"))
    return N.signed_grand_total(N.block_walk(rows, short=N.short_walks(rows)), rows, headings)
