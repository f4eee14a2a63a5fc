"""Column roles, period and code columns, row classes, table classification."""

from pyspark.sql import functions as F

from tieout import catalogue as C
from tieout.operators import classify as Y
from tieout.operators import columns as L
from tieout.operators import notes as N
from tieout.operators.scans import dense_positions
from tieout.plans import views as V
from tieout.queries import oracle_views as O
from tieout.queries.registry import query
from tieout.session import checkpoint

_BODY = f"""{O.CELLS}, body AS (SELECT doc_id, table_idx, row_idx - 1 AS row_idx, col_idx, text, trim(text) <> '' AS filled,
    trim(text) <> '' AND text <> '—' AS num, regexp_matches(text, '[0-9]') AS dig FROM cells WHERE row_idx > 0),
  hd AS (SELECT doc_id, table_idx, col_idx, text AS header FROM cells WHERE row_idx = 0),
  prof AS (SELECT table_idx, col_idx, count(*) FILTER (filled) AS n, count(*) FILTER (num) AS p, count(DISTINCT text) FILTER (filled) AS u FROM body GROUP BY 1, 2),
  lens AS (SELECT table_idx, col_idx, avg(length(text)) AS avg_len FROM (SELECT *, row_number() OVER (PARTITION BY table_idx, col_idx ORDER BY row_idx) AS r FROM body WHERE filled) WHERE r <= 20 GROUP BY 1, 2),
  pf AS (SELECT hd.doc_id, hd.table_idx, hd.col_idx, header, CASE WHEN n > 0 THEN p / n ELSE 0 END AS numeric_density, CASE WHEN n > 0 THEN u / n ELSE 0 END AS uniqueness, coalesce(avg_len, 0) AS avg_len
    FROM hd LEFT JOIN prof USING (table_idx, col_idx) LEFT JOIN lens USING (table_idx, col_idx))"""


def _split(spark, sf):
    body, heads = V.cell_parts(spark, sf)
    return body.withColumn("row_idx", F.col("row_idx") - 1), heads.select("doc_id", "table_idx", "col_idx", F.col("text").alias("header"))


@query(
    "numeric_evidence_scores",
    f"""WITH {_BODY}, s AS (SELECT doc_id, table_idx, col_idx, count(*) FILTER (filled) AS n, count(*) FILTER (num) AS p, count(*) FILTER (dig) AS d FROM body WHERE row_idx < 20 GROUP BY 1, 2, 3)
      SELECT doc_id, table_idx, col_idx, round(CASE WHEN n > 0 THEN p / n ELSE 0 END, 6) AS parseable_ratio, round(CASE WHEN n > 0 THEN d / n ELSE 0 END, 6) AS digit_ratio FROM s""",
)
def numeric_evidence_scores(spark, sf):
    e = L.numeric_evidence(_split(spark, sf)[0])
    return e.select("doc_id", "table_idx", "col_idx", F.round("parseable_ratio", 6).alias("parseable_ratio"), F.round("digit_ratio", 6).alias("digit_ratio"))


@query(
    "table_evidence_scores",
    f"""WITH {_BODY}, s AS (SELECT doc_id, table_idx, col_idx, count(*) FILTER (filled) AS n, count(*) FILTER (num) AS p, count(*) FILTER (dig) AS d FROM body WHERE row_idx < 20 GROUP BY 1, 2, 3)
      SELECT doc_id, table_idx, max(CASE WHEN n > 0 THEN greatest(p, d) / n ELSE 0 END) AS numeric_evidence_score FROM s GROUP BY 1, 2""",
)
def table_evidence_scores(spark, sf):
    return L.table_evidence(L.numeric_evidence(_split(spark, sf)[0])).drop("numeric_cell_ratio")


@query(
    "column_profiles",
    f"WITH {_BODY} SELECT doc_id, table_idx, col_idx, header, round(numeric_density, 6) AS numeric_density, round(uniqueness, 6) AS uniqueness, round(avg_len, 6) AS avg_len FROM pf",
)
def column_profiles(spark, sf):
    p = L.column_profile(*_split(spark, sf))
    return p.select("doc_id", "table_idx", "col_idx", "header", *[F.round(c, 6).alias(c) for c in ("numeric_density", "uniqueness", "avg_len")])


_ROLE = """CASE WHEN header IN ('Description', 'Code') THEN 'CODE' WHEN header = 'Note' THEN 'LABEL' WHEN col_idx >= 3 THEN 'NUMERIC'
  WHEN numeric_density >= 0.5 THEN 'NUMERIC' WHEN numeric_density < 0.2 AND (avg_len < 15 OR uniqueness > 0.9) AND uniqueness > 0.2 THEN 'CODE' ELSE 'OTHER' END"""


@query(
    "column_roles",
    f"""WITH {_BODY} SELECT doc_id, table_idx, col_idx, {_ROLE} AS role, CASE WHEN header IN ('Description', 'Code') THEN 0.9 WHEN header = 'Note' THEN 0.85 WHEN col_idx >= 3 THEN 0.6
      WHEN numeric_density >= 0.5 THEN least(0.95, 0.5 + numeric_density * 0.5) ELSE 0.75 END::DOUBLE AS confidence FROM pf""",
)
def column_roles(spark, sf):
    r = L.column_roles(L.column_profile(*_split(spark, sf)))
    return r.select("doc_id", "table_idx", "col_idx", "role", "confidence")


@query("columns_kept_out_of_sums", f"WITH {_BODY} SELECT doc_id, table_idx, col_idx FROM pf WHERE {_ROLE} IN ('CODE', 'LABEL')")
def columns_kept_out_of_sums(spark, sf):
    return L.excluded_from_sums(L.column_roles(L.column_profile(*_split(spark, sf)))).select("doc_id", "table_idx", "col_idx")


def _varied(headers):
    """Headers in four styles: years, wording, bare amounts, one year."""
    k = F.col("table_idx") % 4
    c = F.col("col_idx")
    return headers.withColumn(
        "header",
        F.when((k == 1) & (c == 3), "Current year").when((k == 1) & (c == 4), "Prior year").when((k == 2) & (c == 3), "VND million")
        .when((k == 2) & (c == 4), "USD").when((k == 3) & (c == 4), "Remarks").otherwise(F.col("header")),
    )


@query(
    "period_columns",
    f"""WITH {_BODY} SELECT DISTINCT doc_id, table_idx, 3 AS cy_col, CASE table_idx % 4 WHEN 3 THEN -1 ELSE 4 END AS py_col, CASE table_idx % 4 WHEN 0 THEN 'years' WHEN 1 THEN 'terms' WHEN 2 THEN 'scored pair' ELSE 'years' END AS strategy FROM hd""",
)
def period_columns(spark, sf):
    body, headers = _split(spark, sf)
    return L.period_columns(_varied(headers), L.numeric_evidence(body))


@query("period_columns_baseline", f"WITH {_BODY} SELECT DISTINCT doc_id, table_idx, 3 AS cy_col, 4 AS py_col FROM hd")
def period_columns_baseline(spark, sf):
    return L.period_columns_baseline(_varied(_split(spark, sf)[1]))


@query("code_and_note_columns", f"WITH {_BODY} SELECT DISTINCT doc_id, table_idx, 1 AS code_col, 2 AS note_col FROM hd")
def code_and_note_columns(spark, sf):
    h = _split(spark, sf)[1]
    return L.code_columns(h).withColumnRenamed("col_idx", "code_col").join(L.note_columns(h).withColumnRenamed("col_idx", "note_col"), ["doc_id", "table_idx"])


@query(
    "effective_code_column",
    f"""WITH {_BODY}, r AS (SELECT table_idx, coalesce(avg(CASE WHEN regexp_matches(text, '^[0-9]{{1,4}}[A-Za-z]?$') THEN 1.0 ELSE 0 END) FILTER (col_idx = 1 AND filled), 0) AS code_r,
        coalesce(avg(CASE WHEN regexp_matches(text, '^[0-9]{{1,4}}[A-Za-z]?$') THEN 1.0 ELSE 0 END) FILTER (col_idx = 3 AND filled), 0) AS cy_r, count(*) FILTER (col_idx = 2 AND filled) AS notes FROM body GROUP BY 1)
      SELECT doc_id, hd.table_idx, CASE WHEN hd.table_idx % 2 = 0 THEN 1 WHEN header = 'Code' THEN 1 WHEN notes > 0 THEN 1 ELSE 1 END AS col_idx FROM hd JOIN r USING (table_idx) WHERE col_idx = 1""",
)
def effective_code_column(spark, sf):
    body, headers = _split(spark, sf)
    declared = headers.where("col_idx = 1 and table_idx % 2 = 0")
    return L.effective_code_column(body, headers, declared)


@query(
    "column_types",
    f"WITH {_BODY} SELECT doc_id, table_idx, col_idx, CASE col_idx WHEN 1 THEN 'CODE' WHEN 3 THEN 'NUMERIC_CY' WHEN 4 THEN CASE WHEN table_idx % 4 = 3 THEN 'TEXT' ELSE 'NUMERIC_PY' END ELSE 'TEXT' END AS column_type FROM hd",
)
def column_types(spark, sf):
    body, headers = _split(spark, sf)
    h = checkpoint(_varied(headers))  # read for periods, marks and types
    return L.column_types(h, checkpoint(L.period_columns(h, L.numeric_evidence(body))))


@query(
    "amount_columns",
    f"WITH {_BODY} SELECT doc_id, table_idx, col_idx FROM hd WHERE col_idx = 3 OR (col_idx = 4 AND table_idx % 4 <> 3)",
)
def amount_columns(spark, sf):
    body, headers = _split(spark, sf)
    h = checkpoint(_varied(headers))  # read for periods, blocks and columns
    return L.amount_columns(h, checkpoint(L.period_columns(h, L.numeric_evidence(body))))


@query(
    "note_columns_by_density",
    f"""WITH {_BODY}, b AS (SELECT *, CASE WHEN col_idx = 0 THEN false ELSE num END AS v FROM body),
      d AS (SELECT doc_id, table_idx, col_idx, avg(CASE WHEN filled THEN 1.0 ELSE 0 END) AS td, avg(CASE WHEN v THEN 1.0 ELSE 0 END) AS nd FROM b GROUP BY 1, 2, 3),
      l AS (SELECT table_idx, arg_max(col_idx, {{'s': round(td * (1 - nd), 9), 'c': -col_idx}}) AS label_col FROM d WHERE td >= 0.3 AND nd < 0.5 GROUP BY 1)
      SELECT d.doc_id, d.table_idx, d.col_idx FROM d LEFT JOIN l USING (table_idx) WHERE d.nd >= 0.15 AND coalesce(d.col_idx <> label_col, true) AND d.col_idx <> 4
        AND NOT EXISTS (SELECT 1 FROM y WHERE y.table_idx = d.table_idx AND y.col_idx = d.col_idx)""".replace(
        "d AS (SELECT doc_id, table_idx, col_idx, avg(CASE WHEN filled",
        "y AS (SELECT table_idx, col_idx FROM (SELECT l_orderkey AS table_idx, c AS col_idx, CASE l_partkey % 8 WHEN 3 THEN -x WHEN 4 THEN -x WHEN 6 THEN floor(x) WHEN 7 THEN NULL ELSE x END AS x FROM (SELECT l_orderkey, l_partkey, 3 AS c, l_extendedprice AS x FROM lineitem)) GROUP BY 1, 2 HAVING avg(CASE WHEN x IS NULL THEN NULL WHEN x BETWEEN 2000 AND 2099 THEN 1.0 ELSE 0 END) > 0.5),\n      d AS (SELECT doc_id, table_idx, col_idx, avg(CASE WHEN filled",
    ),
)
def note_columns_by_density(spark, sf):
    body, headers = _split(spark, sf)
    # descriptions without digits, as in a real label column; the last header names a year
    body = body.withColumn("text", F.when(F.col("col_idx") == 0, F.lit("Receivables")).otherwise(F.col("text")))
    return L.note_amount_columns(body, headers)


@query(
    "row_classes",
    """WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(line, ' ') AS t, lower(trim(line, ' ')) AS l FROM d)
      SELECT cls, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN 'EMPTY'
         WHEN (contains(l,'code') OR contains(l,'note') OR contains(l,'description') OR contains(l,'account') OR contains(l,'mã') OR contains(l,'ghi chú')) AND regexp_matches(t, '[0-9]{4}') THEN 'HEADER'
         WHEN regexp_matches(upper(t), '^([A-Z\\s]+$|CASH FLOWS FROM|CASH AND CASH EQUIVALENTS|OPERATING ACTIVITIES|INVESTING ACTIVITIES|FINANCING ACTIVITIES|ASSETS|LIABILITIES|EQUITY)') AND len(regexp_extract_all(t, '[0-9]+')) <= 1 THEN 'SECTION_TITLE'
         WHEN contains(l,'note') OR contains(l,'ghi chú') OR contains(l,'(*)') OR contains(l,'(**)') THEN 'FOOTER' ELSE 'DATA' END AS cls FROM t) GROUP BY 1""",
)
def row_classes(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    # document lines are one text cell each, so no line has a numeric cell beside its words
    return d.select(L.row_class(F.col("line"), F.lit(0)).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


_HEADS = ["Balance sheet", "Statement of income", "Deferred tax note", "Statement of cash flows", "Trading securities", "Changes in equity", "Significant accounting policies", "Cash"]


def _tables(spark, sf):
    """Statement tables by supplier and year, with dense row positions and a heading."""
    rows = V.statement_rows(spark, sf)
    first = dense_positions(rows, ["doc_id", "table_idx"], ["row_idx"], [F.expr("row_idx div 65536")], "pos")
    return first.withColumn("row_text", F.lower("label"))


def _heading(df):
    pick = ((F.col("doc_id") + F.col("table_idx")) % len(_HEADS) + 1).cast("int")
    return df.withColumn("heading", F.element_at(F.array(*[F.lit(h) for h in _HEADS]), pick)).withColumn(
        "heading_confidence", F.when(F.col("doc_id") % 3 == 0, 0.4).otherwise(0.9)
    )


def _in(codes):
    return "[" + ",".join(f"'{c}'" for c in codes) + "]"


_FP = f"""{O.FS}, fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY row_idx) - 1 AS pos FROM fs),
  fp AS (SELECT doc_id, table_idx, count(*) AS scan_rows, list(DISTINCT code) AS found, bool_or(lower(label) LIKE '%profit%') AS kw_profit, bool_or(lower(label) LIKE '%cash%') AS kw_cash, bool_or(lower(label) LIKE '%revenue%') AS kw_revenue
    FROM fr WHERE pos < 60 GROUP BY 1, 2),
  fm AS (SELECT *, CAST(len(list_intersect(found, {_in(Y.BS_CODES)})) AS INTEGER) AS bs, CAST(len(list_intersect(found, {_in(Y.IS_CODES)})) AS INTEGER) AS is_, CAST(len(list_intersect(found, {_in(Y.CF_CODES)})) AS INTEGER) AS cf,
    CAST(len(list_intersect(found, {_in(Y.IS_ONLY)})) AS INTEGER) AS is_only, CAST(len(list_intersect(found, {_in(Y.CF_ONLY)})) AS INTEGER) AS cf_only, {O._pick(_HEADS, f'(doc_id + table_idx) % {len(_HEADS)}')} AS heading,
    CASE WHEN doc_id % 3 = 0 THEN 0.15 ELSE 0.3 END AS w FROM fp)"""


@query("structural_fingerprint", f"WITH {_FP} SELECT doc_id, table_idx, scan_rows, bs, is_ AS \"is\", cf, is_only, cf_only, kw_profit, kw_cash, false AS has_movement FROM fm")
def structural_fingerprint(spark, sf):
    return Y.fingerprint(_tables(spark, sf)).select("doc_id", "table_idx", "scan_rows", "bs", "is", "cf", "is_only", "cf_only", "kw_profit", "kw_cash", "has_movement")


@query(
    "classification_by_votes",
    f"""WITH {_FP}, s AS (SELECT doc_id, table_idx, heading, 0.7 * CASE WHEN is_ >= 3 AND (is_only >= 1 OR kw_revenue OR kw_profit) THEN least(1.0, 0.3 + is_ * 0.08) * CASE WHEN cf_only >= 1 THEN 0.5 ELSE 1 END
         WHEN is_ >= 2 AND cf_only = 0 THEN CASE WHEN cf >= is_ THEN 0.34 ELSE 0.85 END ELSE 0 END AS i,
        0.7 * CASE WHEN cf >= 3 AND (kw_cash OR cf_only >= 1) THEN least(1.0, 0.3 + cf * 0.06) * CASE WHEN is_only >= 1 THEN 0.5 ELSE 1 END WHEN cf >= 2 AND is_only = 0 THEN CASE WHEN is_ >= cf THEN 0.34 ELSE 0.85 END ELSE 0 END AS c, w FROM fm),
      v AS (SELECT *, round(i + CASE heading WHEN 'Statement of income' THEN 0.95 * w ELSE 0 END, 9) AS vi, round(c + CASE heading WHEN 'Statement of cash flows' THEN 0.95 * w ELSE 0 END, 9) AS vc,
        round(CASE heading WHEN 'Balance sheet' THEN 0.95 * w ELSE 0 END, 9) AS vb, round(CASE heading WHEN 'Changes in equity' THEN 0.95 * w ELSE 0 END, 9) AS ve, round(CASE heading WHEN 'Deferred tax note' THEN 0.8 * w ELSE 0 END, 9) AS vt FROM s),
      k AS (SELECT *, greatest(vi, vc, vb, ve, vt) AS m FROM v)
      SELECT doc_id, table_idx, CASE WHEN heading = 'Significant accounting policies' AND (m = 0 OR i + c < 0.6) THEN 'GENERIC_NOTE' WHEN m = 0 THEN 'UNKNOWN' WHEN m = vt AND vt > 0 THEN 'TAX_NOTE' WHEN m = vb AND vb > 0 THEN 'FS_BALANCE_SHEET' WHEN m = ve AND ve > 0 THEN 'FS_EQUITY'
        WHEN heading = 'Statement of cash flows' AND m = vc THEN 'FS_CASH_FLOW' WHEN m = vi THEN 'FS_INCOME_STATEMENT' ELSE 'FS_CASH_FLOW' END AS table_type,
        round(CASE WHEN heading = 'Significant accounting policies' AND (m = 0 OR i + c < 0.6) THEN 0.75 ELSE least(1.0, m) END, 3)::DOUBLE AS confidence FROM k""",
)
def classification_by_votes(spark, sf):
    return Y.classify_by_votes(_heading(Y.fingerprint(_tables(spark, sf))))


@query(
    "classification_by_heading",
    f"""SELECT o_custkey AS doc_id, o_orderkey AS table_idx, CASE o_orderkey % 8 WHEN 0 THEN 'FS_BALANCE_SHEET' WHEN 1 THEN 'FS_INCOME_STATEMENT' WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'GENERIC_NOTE' ELSE 'TAX_NOTE' END WHEN 3 THEN 'FS_CASH_FLOW'
       WHEN 5 THEN 'FS_EQUITY' ELSE 'GENERIC_NOTE' END AS table_type, CASE o_orderkey % 8 WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 WHEN 3 THEN 0.95 WHEN 5 THEN 0.9 WHEN 6 THEN 0.5 ELSE 0.5 END::DOUBLE AS confidence FROM orders""",
)
def classification_by_heading(spark, sf):
    pick = (F.col("o_orderkey") % 8 + 1).cast("int")
    t = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_idx"),
        F.element_at(F.array(*[F.lit(h) for h in [*_HEADS[:6], "Significant events", "Cash"]]), pick).alias("heading"),
        F.lit(True).alias("has_tax_content"), (F.col("o_orderkey") % 3 == 0).alias("has_vat_exclusion"),
    )
    return Y.classify_by_heading(t)


@query(
    "baseline_routing",
    f"""WITH {_FP} SELECT doc_id, table_idx, CASE heading WHEN 'Balance sheet' THEN 'balance_sheet' WHEN 'Statement of income' THEN 'income_statement' WHEN 'Deferred tax note' THEN 'tax_note' WHEN 'Statement of cash flows' THEN 'cash_flow' ELSE 'generic_note' END AS family,
      CASE heading WHEN 'Balance sheet' THEN 'heading_alias:balance_sheet' WHEN 'Statement of income' THEN 'heading_alias:income_statement' WHEN 'Deferred tax note' THEN 'note_disambiguation:tax_note' WHEN 'Statement of cash flows' THEN 'heading_alias:cash_flow'
        WHEN 'Trading securities' THEN 'legacy_catalog:cross_check_table' WHEN 'Cash' THEN 'legacy_catalog:cross_check_table' ELSE 'fallback:generic_note' END AS reason FROM fm""",
)
def baseline_routing(spark, sf):
    return Y.route(_heading(Y.fingerprint(_tables(spark, sf)))).drop("confidence")


def _mode_input(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    heads = ["Inventories", "Interest rate risk", "Borrowings –", "Number of shares", "Fees paid and payable to the auditors"]
    return o.select(
        F.col("o_custkey").alias("doc_id"), k.alias("table_idx"), F.element_at(F.array(*[F.lit(h) for h in heads]), (k % 5 + 1).cast("int")).alias("heading"),
        (k % 7 == 0).alias("is_movement"), (k % 2 == 0).alias("has_scopes"), (k % 11 == 0).alias("has_column_plan"), (k % 13 == 0).alias("has_netting_plan"),
    )


_MODE = """md AS (SELECT o_custkey AS doc_id, o_orderkey AS table_idx, CASE WHEN o_orderkey % 7 = 0 THEN 'MOVEMENT_BY_ROWS' WHEN o_orderkey % 11 = 0 THEN 'MOVEMENT_BY_COLUMNS' WHEN o_orderkey % 13 = 0 THEN 'HIERARCHICAL_NETTING'
   WHEN o_orderkey % 5 IN (1, 3, 4) THEN 'LISTING_NO_TOTAL' WHEN o_orderkey % 5 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'LISTING_TOTALS' ELSE 'LISTING_NO_TOTAL' END WHEN o_orderkey % 2 = 0 THEN 'GENERIC_NUMERIC_NOTE' ELSE 'UNDETERMINED' END AS mode FROM orders)"""


@query("note_modes", f"WITH {_MODE} SELECT doc_id, table_idx, mode FROM md")
def note_modes(spark, sf):
    return Y.note_mode(_mode_input(spark, sf)).select("doc_id", "table_idx", "mode")


@query(
    "rules_gated_by_mode",
    f"""WITH {_MODE}, {O.NOTE}, a(mode, rule_id) AS (VALUES {','.join(str(m) for m in Y.MODE_RULES)}), t AS (SELECT DISTINCT table_idx FROM note)
      SELECT md.doc_id, md.table_idx, md.mode, coalesce(a.rule_id, 'none') AS rule_id, CASE WHEN a.rule_id = 'VERTICAL_SUM_SCOPED' THEN '' ELSE 'UNVERIFIED_NUMERIC_TABLE' END AS reason_code FROM md JOIN t USING (table_idx) LEFT JOIN a USING (mode)
      WHERE coalesce(a.rule_id, '') = 'VERTICAL_SUM_SCOPED' OR true""".replace("coalesce(a.rule_id, 'none') AS rule_id", "CASE WHEN a.rule_id = 'VERTICAL_SUM_SCOPED' THEN a.rule_id ELSE 'none' END AS rule_id"),
)
def rules_gated_by_mode(spark, sf):
    rows = V.note_amounts(spark, sf).withColumn("has_numeric", F.col("value").isNotNull()).withColumn("seg", F.lit(0))
    rows = rows.withColumn("kind", N.row_kind(F.col("label"), F.col("has_numeric")))
    evidence = N.scoped_sums(rows, N.scopes(rows, N.segments(rows)))
    modes = Y.note_mode(_mode_input(spark, sf))
    kept = Y.gate_rules(evidence, modes).select("doc_id", "table_idx", "mode", "rule_id", F.lit("").alias("reason_code"))
    numeric = rows.where("has_numeric").select("doc_id", "table_idx").distinct().join(modes.select("doc_id", "table_idx", "mode"), ["doc_id", "table_idx"])
    rest = Y.unverified(numeric, kept).select("doc_id", "table_idx", "mode", F.lit("none").alias("rule_id"), "reason_code")
    return kept.unionByName(rest)


@query(
    "generic_table_gates",
    """SELECT o_orderkey AS table_idx, CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN 'SKIP_NO_TOTAL_HEADING' WHEN o_orderkey % 3 = 0 THEN 'SKIP_FOOTER' WHEN o_orderkey % 7 = 0 THEN 'TEXT_FORMULA' WHEN o_orderkey % 4 = 0 THEN 'NO_NUMERIC_COLUMNS'
       WHEN o_orderkey % 9 <= 1 THEN 'SINGLE_ROW' WHEN o_orderkey % 2 = 0 THEN 'NO_TOTAL_ROW' ELSE 'VALIDATE' END AS gate FROM orders""",
)
def generic_table_gates(spark, sf):
    k = F.col("table_idx")
    t = _mode_input(spark, sf).select(
        "table_idx", "heading", (k % 7 == 0).alias("has_formula_text"), (k % 4).alias("n_numeric_cols"), (k % 9).alias("n_rows"),
        (k % 2 != 0).alias("has_total_row"), (k % 3 == 0).alias("all_text"),
    )
    return Y.generic_table_gate(t).select("table_idx", "gate")
