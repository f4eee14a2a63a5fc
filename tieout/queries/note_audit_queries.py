"""Audit of notes from rows alone: modes derived from structure, gated rules, fallback and unverified tables."""

from pyspark.sql import functions as F

from tieout.operators.scans import groups_fit, stored
from tieout.plans import note_audit as A
from tieout.plans import views as V
from tieout.queries import oracle_views as O
from tieout.queries.note_queries import _ROLL, _tol
from tieout.queries.registry import query
from tieout.session import deal

_ROLL_HEADS = ["Tangible movements", "Interest rate risk", "Borrowings –"]
_ORDER_HEADS = ["Inventories", "Number of shares", "Transactions with related companies", "Business costs by element"]


def _notes(spark, sf):
    """Events by user and day, and orders, as notes under several headings; every ninth order shows no amount at all.

    Structured rows, stored once: where no note is large each line is dealt to its note before the rows are laid out.
    """
    events, lines = V.event_tables(spark, sf), V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    at = F.col("table_idx").cast("bigint")
    if groups_fit(events, ["user_id", "table_idx"]) and groups_fit(lines, ["l_orderkey"]):
        size = 2 * lines.count() + events.count()
        events = deal(events.withColumns({"user_id": F.concat(F.lit("u"), "user_id"), "table_idx": at}), ["user_id", "table_idx"], size)
        notes = V.lay_amounts(deal(V.amount_lines(spark, sf, lines).withColumn("doc_id", F.concat(F.lit("c"), "doc_id")), A.TABLE_KEY, size))
    else:
        size = None
        events = events.withColumns({"user_id": F.concat(F.lit("u"), "user_id"), "table_idx": at})
        notes = V.note_amounts(spark, sf).withColumn("doc_id", F.concat(F.lit("c"), "doc_id"))
    roll = V.roll_rows(spark, sf, events).select("doc_id", "table_idx", "row_idx", "label", F.when(F.col("label") != "Cost", F.col("value")).alias("value"))
    notes = notes.select("doc_id", "table_idx", "row_idx", "label", F.when(F.col("table_idx") % 9 != 4, F.col("value")).alias("value"))
    small = True if size is not None else None
    rows = stored(A.structured(roll, small).unionByName(A.structured(notes, small)), A.TABLE_KEY, dealt=size)
    heads = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("table_idx") % len(xs) + 1).cast("int"))
    headings = rows.select("doc_id", "table_idx").distinct().withColumn("heading", F.when(F.col("doc_id").startswith("u"), heads(_ROLL_HEADS)).otherwise(heads(_ORDER_HEADS)))
    return rows, headings


def _columns(spark, sf):
    d = V.daily_columns(spark, sf)
    return d.where("table_idx % 2 = 0").select(F.concat(F.lit("u"), "doc_id").alias("doc_id"), F.col("table_idx").cast("bigint").alias("table_idx"), "row_idx", "col_idx", "header", "value")


def _pick(xs, e):
    return "[" + ", ".join(f"'{x}'" for x in xs) + f"][CAST({e} % {len(xs)} + 1 AS INTEGER)]"


#: Per table t: mv, sc, cp, no_total, listing, numeric; the two families in one frame md with mode and status.
_PLANS = f"""{_ROLL}, {O.NOTE.replace('lines AS', 'lines AS MATERIALIZED')}, {O.DAILY},
  cols AS (SELECT DISTINCT doc_id, table_idx FROM daily WHERE table_idx % 2 = 0),
  sp AS (SELECT sg.doc_id, sg.table_idx, sg.seg, start_row, ob_row, cb_row, end_row, max(row_idx) FILTER (value IS NOT NULL AND kind IN ('MOVEMENT', 'OTHER')) AS dense FROM sg JOIN rs USING (doc_id, table_idx, seg) GROUP BY ALL),
  sc AS MATERIALIZED (SELECT doc_id, table_idx, seg, dense AS total_row FROM sp WHERE ob_row IS NULL AND cb_row IS NULL AND table_idx % 3 = 0 AND end_row - start_row >= 3 AND dense > start_row),
  ta AS (SELECT 'u' || doc_id AS doc_id, table_idx, {_pick(_ROLL_HEADS, 'table_idx')} AS heading, bool_or(ob_row IS NOT NULL AND cb_row IS NOT NULL AND n_moves >= 1) AS mv FROM sg GROUP BY 1, 2),
  fa AS (SELECT ta.*, table_idx % 3 <> 1 AND EXISTS (SELECT 1 FROM sc WHERE 'u' || sc.doc_id = ta.doc_id AND sc.table_idx = ta.table_idx) AS sc, EXISTS (SELECT 1 FROM cols WHERE 'u' || cols.doc_id = ta.doc_id AND cols.table_idx = ta.table_idx) AS cp,
      table_idx % 3 = 1 AS no_total, table_idx % 3 = 2 AS listing, EXISTS (SELECT 1 FROM rs WHERE 'u' || rs.doc_id = ta.doc_id AND rs.table_idx = ta.table_idx AND value IS NOT NULL) AS num FROM ta),
  nb AS MATERIALIZED (SELECT 'c' || doc_id AS doc_id, table_idx, max(CASE WHEN table_idx % 9 <> 4 THEN value END) FILTER (label = 'Total') AS t,
      coalesce(round(CAST(sum(CAST(CASE WHEN table_idx % 9 <> 4 THEN value END AS DECIMAL(20,4))) FILTER (label <> 'Total') AS DOUBLE), 4), 0) AS s FROM note GROUP BY 1, 2),
  fb AS (SELECT doc_id, table_idx, {_pick(_ORDER_HEADS, 'table_idx')} AS heading, false AS mv, table_idx % 4 IN (0, 2) AS sc, false AS cp, table_idx % 4 IN (1, 3) AS no_total, table_idx % 4 IN (1, 2) AS listing, table_idx % 9 <> 4 AS num FROM nb),
  md AS MATERIALIZED (SELECT *, CASE WHEN mv THEN 'MOVEMENT_BY_ROWS' WHEN cp THEN 'MOVEMENT_BY_COLUMNS' WHEN no_total THEN 'LISTING_NO_TOTAL' WHEN listing AND sc THEN 'LISTING_TOTALS' WHEN listing THEN 'LISTING_NO_TOTAL' WHEN sc THEN 'GENERIC_NUMERIC_NOTE' ELSE 'UNDETERMINED' END AS mode,
      CASE WHEN no_total THEN 'NO_TOTAL' WHEN mv OR sc THEN 'OK' ELSE 'UNDETERMINED' END AS status FROM (SELECT * FROM fa UNION ALL SELECT * FROM fb))"""


@query("note_plans_from_rows", f"WITH {_PLANS} SELECT doc_id, CAST(table_idx AS BIGINT) AS table_idx, heading, mv AS is_movement, num AS numeric, sc AS has_scopes, cp AS has_column_plan, false AS has_netting_plan, mode, status FROM md")
def note_plans_from_rows(spark, sf):
    rows, headings = _notes(spark, sf)
    return A.note_plans(rows, headings, _columns(spark, sf))


_MAT = lambda e, a, tol: f"abs(round({a} - {e}, 4)) > {tol}"

#: Evidence ev(doc_id, table_idx, rule_id, expected, actual, material) before the gates.
_EVIDENCE = f"""rf AS (SELECT 'u' || sg.doc_id AS doc_id, sg.table_idx, sg.seg, any_value(confidence) AS conf, max(value) FILTER (row_idx = ob_row) AS ob, max(value) FILTER (row_idx = cb_row) AS cb,
      coalesce(round(CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (CASE WHEN n_keyword > 0 THEN kind = 'MOVEMENT' ELSE kind = 'OTHER' AND row_idx > ob_row AND row_idx < cb_row END) AS DOUBLE), 4), 0) AS mv FROM sg JOIN rs USING (doc_id, table_idx, seg) GROUP BY 1, 2, 3),
  vs AS (SELECT 'u' || sc.doc_id AS doc_id, sc.table_idx, seg, max(value) FILTER (row_idx = total_row) AS t, coalesce(round(CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (row_idx < total_row) AS DOUBLE), 4), 0) AS s, count(*) FILTER (row_idx < total_row) AS n
      FROM sc JOIN rs USING (doc_id, table_idx, seg) GROUP BY 1, 2, 3),
  dr AS (SELECT d.*, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY row_idx) AS n FROM daily d WHERE table_idx % 2 = 0 AND m1 IS NOT NULL AND m2 IS NOT NULL AND abs(round(ob + m1 + m2 - cb, 4)) > {_tol('greatest(abs(ob), abs(cb))')}),
  bs AS (SELECT doc_id, table_idx, max(row_idx) AS last, max(row_idx) FILTER (coalesce(value, 0) <> 0 AND row_idx > 0) AS dense FROM rs GROUP BY 1, 2),
  bf AS (SELECT 'u' || bs.doc_id AS doc_id, bs.table_idx, coalesce(max(value) FILTER (row_idx = coalesce(dense, last)), 0) AS e, coalesce(round(CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (row_idx < coalesce(dense, last)) AS DOUBLE), 4), 0) AS a
      FROM bs JOIN rs USING (doc_id, table_idx) WHERE last >= 1 GROUP BY 1, 2),
  ev AS (SELECT doc_id, table_idx, 'MOVEMENT_ROLLFORWARD' AS rule_id, CASE WHEN conf < 0.5 THEN 0 ELSE round(ob + mv, 4) END AS expected, CASE WHEN conf < 0.5 THEN 0 ELSE cb END AS actual, conf >= 0.5 AND coalesce({_MAT('round(ob + mv, 4)', 'cb', _tol('greatest(abs(ob), abs(cb))'))}, false) AS material FROM rf
    UNION ALL SELECT doc_id, table_idx, 'VERTICAL_SUM_SCOPED', CASE WHEN n = 0 THEN 0 ELSE t END, CASE WHEN n = 0 THEN 0 ELSE s END, n > 0 AND {_MAT('t', 's', _tol('t'))} FROM vs WHERE t IS NOT NULL AND NOT (n = 0 AND t = 0)
    UNION ALL SELECT doc_id, table_idx, 'VERTICAL_SUM_SCOPED', t, s, {_MAT('t', 's', _tol('t'))} FROM nb WHERE t IS NOT NULL
    UNION ALL SELECT doc_id, table_idx, 'NOTE_BREAKDOWN_TOTALS', t, s, {_MAT('t', 's', _tol('t'))} FROM nb WHERE t IS NOT NULL
    UNION ALL SELECT 'u' || doc_id, table_idx, 'MOVEMENT_BY_COLUMNS', round(ob + m1 + m2, 4), cb, true FROM dr WHERE n = 1),
  ga(mode, rule_id) AS (VALUES {", ".join(f"('{m}', '{r}')" for m, rules in A.ALLOWED.items() for r in rules)}),
  kp AS (SELECT ev.*, mode FROM ev JOIN md USING (doc_id, table_idx) WHERE EXISTS (SELECT 1 FROM ga WHERE ga.mode = md.mode AND ga.rule_id = ev.rule_id)
    UNION ALL SELECT bf.doc_id, bf.table_idx, 'BASIC_NUMERIC_CHECKS', e, a, false, mode FROM bf JOIN md USING (doc_id, table_idx) WHERE status = 'UNDETERMINED' AND num AND mode <> 'LISTING_NO_TOTAL')"""


@query(
    "note_audit_from_rows",
    f"""WITH {_PLANS}, {_EVIDENCE} SELECT doc_id, CAST(table_idx AS BIGINT) AS table_idx, mode, rule_id, round(expected, 2) AS expected, round(actual, 2) AS actual, material AS is_material FROM kp
      UNION ALL SELECT doc_id, table_idx, mode, 'NOTE_STRUCTURE_UNDETERMINED', NULL, NULL, false FROM md WHERE status = 'UNDETERMINED'
      UNION ALL SELECT doc_id, table_idx, mode, 'UNVERIFIED_NUMERIC_TABLE', NULL, NULL, false FROM md WHERE num AND NOT EXISTS (SELECT 1 FROM kp WHERE kp.doc_id = md.doc_id AND kp.table_idx = md.table_idx)""",
)
def note_audit_from_rows(spark, sf):
    rows, headings = _notes(spark, sf)
    e = A.audit_notes(rows, headings, _columns(spark, sf))
    return e.select("doc_id", "table_idx", "mode", "rule_id", F.round("expected", 2).alias("expected"), F.round("actual", 2).alias("actual"), "is_material")
