"""Statuses, severities, gates, marks, reports, fleet aggregates and run diffs."""

from pyspark.sql import functions as F

from tieout.functions import tolerance as T
from tieout.operators import results as R
from tieout.plans import views as V
from tieout.queries import oracle_views as O
from tieout.queries.registry import query


def _results(spark, sf):
    r = V.result_rows(spark, sf).withColumn("status_enum", R.status_enum(F.col("status")))
    no = F.lit(False)
    return r.withColumn("severity", R.severity_by_taxonomy(F.col("rule_id"), F.col("max_diff"), no)).withColumn(
        "confidence",
        R.confidence_level(F.col("rule_id"), no, F.col("table_idx") % 4 == 1, F.col("table_idx") % 4 == 2),
    )


_R = O.RESULTS + f", rr AS (SELECT *, {O.SEVERITY} AS severity, {O.CONFIDENCE} AS confidence FROM res)"


@query(
    "materiality_and_severity",
    """WITH t AS (SELECT o_orderkey, o_totalprice AS v, (o_orderkey % 40) * 0.001 * o_totalprice AS d, CASE o_orderkey % 3 WHEN 0 THEN 0.005 ELSE 0.008 END AS rel FROM orders),
      u AS (SELECT *, greatest(1.0, least(rel * abs(v), 1000000.0)) AS tol FROM t)
      SELECT o_orderkey, round(tol, 6) AS tolerance, CASE WHEN abs(d) <= tol THEN 'INFO' WHEN abs(d) / tol > 10 THEN 'CRITICAL' WHEN abs(d) / tol > 3 THEN 'MAJOR' ELSE 'MINOR' END AS severity FROM u""",
)
def materiality_and_severity(spark, sf):
    m = T.Materiality()
    kind = F.when(F.col("o_orderkey") % 3 == 0, "TAX_NOTE").when(F.col("o_orderkey") % 3 == 1, "FS_BALANCE_SHEET").otherwise("OTHER")
    tol = m.tolerance(F.col("o_totalprice"), kind)
    d = (F.col("o_orderkey") % 40) * F.lit(0.001) * F.col("o_totalprice")
    return V.table(spark, sf, "orders").select(
        "o_orderkey", F.round(tol, 6).alias("tolerance"), T.severity_by_ratio(d, tol).alias("severity")
    )


@query(
    "amount_comparison",
    """WITH t AS (SELECT o_orderkey, o_totalprice AS e, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice * (1 + (o_orderkey % 20) * 0.001) END AS a FROM orders)
      SELECT o_orderkey, coalesce(abs(e - a) <= greatest(0.01, 0.008 * greatest(abs(e), abs(a), 1.0)), false) AS ok, coalesce(round(abs(e - a), 4), -1) AS abs_delta,
        coalesce(round(abs(e - a) / greatest(abs(e), abs(a), 1.0) * 100, 6), -1) AS rel_delta,
        CASE WHEN a IS NULL THEN 'none' WHEN 0.01 >= 0.008 * greatest(abs(e), abs(a), 1.0) THEN 'abs' ELSE 'rel' END AS bound, coalesce(abs(e - a) <= 0.5, false) AS rounds_to_zero FROM t""",
)
def amount_comparison(spark, sf):
    from tieout.functions.amounts import rounds_to_zero

    a = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 20) * 0.001))
    e = F.col("o_totalprice")
    c = T.compare_amounts(e, F.col("a"))
    return V.table(spark, sf, "orders").withColumn("a", a).withColumn("c", c).select(
        "o_orderkey", "c.ok", F.coalesce(F.round("c.abs_delta", 4), F.lit(-1.0)).alias("abs_delta"),
        F.coalesce(F.round("c.rel_delta", 6), F.lit(-1.0)).alias("rel_delta"), "c.bound",
        F.coalesce(rounds_to_zero(e - F.col("a")), F.lit(False)).alias("rounds_to_zero"),
    )


@query(
    "status_enums",
    f"""WITH {_R} SELECT table_idx, enum AS status_enum, CASE WHEN enum = 'PASS' THEN 'PASS' WHEN enum = 'INFO_SKIPPED' THEN 'INFO_SKIPPED' WHEN enum = 'FAIL_TOOL_EXTRACT' THEN enum
        WHEN rule_id = 'FAIL_TOOL_LOGIC_VALIDATOR_CRASH' OR enum = 'FAIL_TOOL_LOGIC' THEN 'FAIL_TOOL_LOGIC' WHEN enum = 'WARN' THEN 'WARN' ELSE 'FAIL_DATA' END AS category,
        CASE table_idx % 9 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'WARN' WHEN 3 THEN 'FAIL' WHEN 4 THEN 'INFO' WHEN 5 THEN 'UNKNOWN' WHEN 6 THEN 'ERROR' WHEN 7 THEN 'PASS' ELSE 'FAIL' END AS icon_enum,
        CASE WHEN rule_id = 'SKIPPED_FOOTER_SIGNATURE' THEN 'Skipped' ELSE 'Validated' END AS validation FROM rr""",
)
def status_enums(spark, sf):
    return _results(spark, sf).select(
        "table_idx", "status_enum", R.status_category(F.col("status_enum"), F.col("rule_id")).alias("category"),
        R.status_enum_from_icon(F.col("status")).alias("icon_enum"), R.validated_flag(F.col("rule_id")).alias("validation"),
    )


@query(
    "severity_confidence_cause",
    f"""WITH {_R} SELECT table_idx, severity, confidence, CASE rule_id WHEN 'MATH_EQ' THEN 'calculation' WHEN 'CROSS_CHECK_MISMATCH' THEN 'cross_ref' WHEN 'BALANCE_SHEET_VALIDATION' THEN 'structure'
       WHEN 'TABLE_NO_TOTAL_ROW' THEN 'structure' WHEN 'ROW_TOTAL_GRAND_TOTAL' THEN 'subtotal' WHEN 'SKIPPED_FOOTER_SIGNATURE' THEN 'general' ELSE 'logic' END AS cause,
       CASE WHEN table_idx % 3 = 0 THEN 'movement' ELSE 'structure' END AS unlisted_cause FROM rr""",
)
def severity_confidence_cause(spark, sf):
    no = F.lit(False)
    return _results(spark, sf).select(
        "table_idx", "severity", "confidence", R.root_cause(F.col("rule_id"), no, no, no).alias("cause"),
        R.root_cause(F.lit("MY_HEADER_RULE"), no, F.col("table_idx") % 3 == 0, no).alias("unlisted_cause"),
    )


@query(
    "quality_gates",
    f"""WITH {_R} SELECT table_idx, CASE WHEN flag = 0 THEN 'FAIL_TOOL_EXTRACT' WHEN enum <> 'PASS' THEN enum WHEN assertions = 0 THEN 'INFO_SKIPPED' WHEN ev < 0.25 THEN 'FAIL_TOOL_EXTRACT'
       WHEN flag = 1 OR engine = 'ooxml_fallback' OR (q >= 0.6 AND q < 0.85) THEN 'WARN' ELSE 'PASS' END AS status_enum,
       CASE WHEN flag = 0 AND q < 0.6 THEN 'FAIL_TOOL_EXTRACT_LOW_QUALITY' WHEN flag = 0 THEN 'FAIL_TOOL_EXTRACT_GRID_CORRUPTION' WHEN enum <> 'PASS' THEN '' WHEN assertions = 0 THEN 'NO_ASSERTIONS'
       WHEN ev < 0.25 THEN 'NO_NUMERIC_EVIDENCE' WHEN flag = 1 OR engine = 'ooxml_fallback' OR (q >= 0.6 AND q < 0.85) THEN 'BORDERLINE_EXTRACTION_CONFIDENCE' ELSE '' END AS gate_reason FROM rr""",
)
def quality_gates(spark, sf):
    return R.apply_gates(_results(spark, sf)).select("table_idx", "status_enum", "gate_reason")


def _marks(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("table_idx"), F.col("l_linenumber").alias("row_idx"),
        (F.col("l_partkey") % 2).alias("col_idx"), F.when(F.col("l_returnflag") == "A", "cross_ref").otherwise("validation").alias("kind"),
        (F.col("l_quantity") >= 15).alias("ok"), F.concat(F.lit("q"), F.col("l_quantity").cast("int")).alias("comment"),
        F.col("l_linestatus").alias("rule_id"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("seq"),
    )


_MARKS = """m AS (SELECT l_orderkey % 1000 AS doc_id, l_orderkey AS table_idx, l_linenumber AS row_idx, l_partkey % 2 AS col_idx, CASE WHEN l_returnflag = 'A' THEN 'cross_ref' ELSE 'validation' END AS kind,
   l_quantity >= 15 AS ok, 'q' || CAST(l_quantity AS INTEGER) AS comment, l_linestatus AS rule_id, l_partkey * 100000 + l_suppkey AS seq FROM lineitem),
   b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_idx, row_idx, col_idx, kind ORDER BY ok, seq) AS rn FROM m) WHERE rn = 1),
   f AS (SELECT *, table_idx % 5 = 0 AS failed FROM b WHERE NOT (table_idx % 5 = 0 AND ok)),
   k AS (SELECT f.* FROM f LEFT JOIN f o ON o.table_idx = f.table_idx AND o.row_idx = f.row_idx AND o.col_idx = f.col_idx AND o.kind <> f.kind WHERE NOT (f.ok AND coalesce(NOT o.ok, false)))"""


@query("resolved_marks", f"WITH {_MARKS} SELECT doc_id, table_idx, row_idx, col_idx, kind, ok, comment, rule_id FROM k")
def resolved_marks(spark, sf):
    failed = V.table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(
        (F.col("o_orderkey") % 1000).alias("doc_id"), F.col("o_orderkey").alias("table_idx")
    )
    return R.resolve_marks(_marks(spark, sf), failed).drop("seq")


_DIFF = """d AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice - 20000, 2) AS diff FROM lineitem)"""


@query(
    "top_differences",
    f"""WITH {_DIFF} SELECT l_orderkey, rank, diff FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(diff) DESC, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank FROM d WHERE abs(diff) > 0.01) WHERE rank <= 5""",
)
def top_differences(spark, sf):
    d = V.table(spark, sf, "lineitem").withColumn("diff", F.round(F.col("l_extendedprice") - 20000, 2))
    return R.top_differences(d, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "rank", "diff")


@query(
    "top_findings",
    f"""WITH {_R} SELECT doc_id, table_idx, enum AS status_enum, severity, max_diff FROM rr WHERE enum IN ('FAIL','WARN','FAIL_TOOL_EXTRACT','FAIL_TOOL_LOGIC','FAIL_DATA')
       ORDER BY CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, max_diff DESC, doc_id, table_idx LIMIT 10""",
)
def top_findings(spark, sf):
    return R.top_findings(_results(spark, sf)).select("doc_id", "table_idx", "status_enum", "severity", "max_diff")


@query(
    "focus_list",
    f"WITH {_R} SELECT doc_id, table_idx, enum AS status_enum, severity, confidence, max_diff FROM rr WHERE enum IN ('FAIL','WARN','FAIL_TOOL_EXTRACT','FAIL_TOOL_LOGIC','FAIL_DATA') AND severity <> 'LOW' AND confidence <> 'LOW'",
)
def focus_list(spark, sf):
    return R.focus_list(_results(spark, sf)).select("doc_id", "table_idx", "status_enum", "severity", "confidence", "max_diff")


@query(
    "report_order",
    f"""WITH {_R} SELECT doc_id, table_idx, rule_id, CAST(CASE enum WHEN 'ERROR' THEN 0 WHEN 'FAIL_TOOL_EXTRACT' THEN 1 WHEN 'FAIL_TOOL_LOGIC' THEN 2 WHEN 'FAIL_DATA' THEN 3 WHEN 'FAIL' THEN 4 WHEN 'WARN' THEN 5 WHEN 'INFO' THEN 6 WHEN 'PASS' THEN 7 ELSE 4 END AS INTEGER) AS report_rank
       FROM rr WHERE rule_id <> 'SKIPPED_FOOTER_SIGNATURE'""",
)
def report_order(spark, sf):
    return R.report_rows(_results(spark, sf)).select("doc_id", "table_idx", "rule_id", "report_rank")


@query(
    "issue_previews",
    """WITH i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
      SELECT user_id, n AS n_issues, string_agg('E' || event_id, '; ' ORDER BY r) || CASE WHEN n > 10 THEN ' ... (+' || (n - 10) || ' more)' ELSE '' END AS preview FROM i WHERE r <= 10 GROUP BY 1, 2""",
)
def issue_previews(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_id", F.concat(F.lit("E"), "event_id").alias("issue"))
    return R.issue_preview(e, ["user_id"], "event_id")


@query(
    "audit_scores",
    """SELECT l_suppkey AS doc_id, greatest(0.0, 100.0 - sum(CASE WHEN l_linenumber = 1 THEN 0 WHEN l_quantity < 2 THEN 20 WHEN l_quantity < 4 THEN 5 WHEN l_quantity < 6 THEN 1 ELSE 0 END))::DOUBLE AS score FROM lineitem GROUP BY 1""",
)
def audit_scores(spark, sf):
    q = F.col("l_quantity")
    ev = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), (F.col("l_linenumber") != 1).alias("is_material"),
        F.when(q < 2, "CRITICAL").when(q < 4, "MAJOR").when(q < 6, "MINOR").otherwise("INFO").alias("severity"),
    )
    return R.score(ev)


_AGG = """{p} AS (SELECT validator_type, failure_reason_code, rule_id, engine AS extractor_engine, '' AS total_row_method, count(*) AS count, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources
   FROM rr WHERE enum IN ('FAIL','ERROR','WARN','FAIL_TOOL_EXTRACT','FAIL_TOOL_LOGIC','FAIL_DATA') AND ({w}) GROUP BY 1, 2, 3, 4)"""


def _agg_input(spark, sf, where):
    return _results(spark, sf).where(where).withColumn("total_row_method", F.lit(None).cast("string"))


@query(
    "failure_aggregation",
    f"WITH {_R}, {_AGG.format(p='a', w='true')} SELECT validator_type, failure_reason_code, rule_id, extractor_engine, total_row_method, count, len(string_split(sources, ',')) AS n_sources FROM a",
)
def failure_aggregation(spark, sf):
    return R.aggregate_failures(_agg_input(spark, sf, "true")).drop("sources_digest")


@query(
    "failure_sources",
    f"WITH {_R} SELECT validator_type, failure_reason_code, rule_id, engine AS extractor_engine, '' AS total_row_method, source, count(*) AS n FROM rr WHERE enum IN ('FAIL','ERROR','WARN','FAIL_TOOL_EXTRACT','FAIL_TOOL_LOGIC','FAIL_DATA') GROUP BY ALL",
)
def failure_sources(spark, sf):
    return R.failure_sources(_agg_input(spark, sf, "true"))


def _cmp_sql(extra):
    return f"""WITH {_R}, {_AGG.format(p='a', w='table_idx % 30 <> 1')}, {_AGG.format(p='c', w='table_idx % 37 <> 2')},
      j AS (SELECT validator_type, failure_reason_code, rule_id, extractor_engine, total_row_method, a.count AS ac, c.count AS cc, a.sources AS s1, c.sources AS s2 FROM a FULL JOIN c USING (validator_type, failure_reason_code, rule_id, extractor_engine, total_row_method)),
      x AS (SELECT *, 'missing_in_current' AS problem FROM j WHERE cc IS NULL UNION ALL SELECT *, 'missing_in_baseline' FROM j WHERE ac IS NULL AND {extra}
        UNION ALL SELECT *, 'count_mismatch' FROM j WHERE ac <> cc UNION ALL SELECT *, 'sources_mismatch' FROM j WHERE s1 <> s2)
      SELECT validator_type, failure_reason_code, rule_id, extractor_engine, coalesce(ac, -1) AS baseline_count, coalesce(cc, -1) AS current_count, problem FROM x"""


def _compare(spark, sf, strict):
    b = R.aggregate_failures(_agg_input(spark, sf, "table_idx % 30 <> 1"))
    c = R.aggregate_failures(_agg_input(spark, sf, "table_idx % 37 <> 2"))
    out = R.compare_aggregates(b, c, strict=strict).drop("total_row_method")
    return out.withColumn("baseline_count", F.coalesce("baseline_count", F.lit(-1))).withColumn("current_count", F.coalesce("current_count", F.lit(-1)))


@query("baseline_compare_strict", _cmp_sql("true"))
def baseline_compare_strict(spark, sf):
    return _compare(spark, sf, True)


@query("baseline_compare_keys", _cmp_sql("false"))
def baseline_compare_keys(spark, sf):
    return _compare(spark, sf, False)


@query(
    "run_diff",
    f"""WITH {_R}, a AS (SELECT rule_id, heading, arg_max({{'s': severity, 'c': confidence}}, table_idx) AS v FROM rr WHERE enum IN ('FAIL','ERROR','WARN','FAIL_TOOL_EXTRACT','FAIL_TOOL_LOGIC','FAIL_DATA') AND table_idx % 2 = 0 GROUP BY 1, 2),
      b AS (SELECT rule_id, heading, arg_max({{'s': severity, 'c': confidence}}, table_idx) AS v FROM rr WHERE enum IN ('FAIL','ERROR','WARN','FAIL_TOOL_EXTRACT','FAIL_TOOL_LOGIC','FAIL_DATA') AND table_idx % 3 = 0 GROUP BY 1, 2)
      SELECT rule_id, heading, CASE WHEN b.v IS NULL THEN 'NEW' WHEN a.v IS NULL THEN 'RESOLVED' WHEN a.v = b.v THEN 'UNCHANGED' ELSE 'CHANGED' END AS diff_status,
        coalesce(a.v, b.v).s AS severity, coalesce(a.v, b.v).c AS confidence, CASE WHEN a.v <> b.v THEN b.v.s END AS previous_severity, CASE WHEN a.v <> b.v THEN b.v.c END AS previous_confidence
      FROM a FULL JOIN b USING (rule_id, heading)""",
)
def run_diff(spark, sf):
    r = _results(spark, sf).withColumn("seq", F.col("table_idx"))
    return R.run_diff(r.where("table_idx % 2 = 0"), r.where("table_idx % 3 = 0"))


@query(
    "triage_carry_forward",
    f"""WITH {_R}, p AS (SELECT heading AS table_id, rule_id, arg_max(source, table_idx) AS owner, arg_max(CASE WHEN table_idx % 4 = 0 THEN '' ELSE engine END, table_idx) AS st FROM rr WHERE table_idx % 3 = 0 GROUP BY 1, 2)
      SELECT r.table_idx, coalesce(owner, '') AS owner, coalesce(nullif(st, ''), 'New') AS review_status, '' AS comment FROM rr r LEFT JOIN p ON p.table_id = r.heading AND p.rule_id = r.rule_id WHERE r.table_idx % 2 = 0""",
)
def triage_carry_forward(spark, sf):
    r = _results(spark, sf).withColumn("table_id", F.col("heading"))
    prev = r.where("table_idx % 3 = 0").select(
        "table_id", "rule_id", F.col("source").alias("owner"), F.when(F.col("table_idx") % 4 == 0, "").otherwise(F.col("extractor_engine")).alias("review_status"),
        F.lit("").alias("comment"), F.col("table_idx").alias("seq"),
    )
    return R.carry_triage(r.where("table_idx % 2 = 0").select("table_id", "rule_id", "table_idx"), prev).drop("table_id", "rule_id")


@query(
    "key_set_differences",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 30)
      SELECT user_id, CASE WHEN b.u IS NULL THEN 'only_left' WHEN a.user_id IS NULL THEN 'only_right' ELSE 'both' END AS side FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.user_id AS au, b.user_id AS bu FROM a FULL JOIN b ON a.user_id = b.user_id) x
      LEFT JOIN (SELECT user_id AS u FROM b) b ON b.u = x.user_id LEFT JOIN a USING (user_id)""".replace("a.user_id IS NULL THEN 'only_right'", "au IS NULL THEN 'only_right'").replace("b.u IS NULL", "bu IS NULL"),
)
def key_set_differences(spark, sf):
    e = V.table(spark, sf, "events")
    a = e.where("event_type = 'signup'").select("user_id").distinct()
    b = e.where("event_type = 'purchase' and value > 30").select("user_id").distinct()
    tag = lambda df, t: df.withColumn("side", F.lit(t))
    return tag(a.exceptAll(b), "only_left").unionByName(tag(b.exceptAll(a), "only_right")).unionByName(tag(a.intersect(b), "both"))


@query(
    "status_count_contract",
    f"WITH {_R} SELECT coalesce(enum, 'TOTAL') AS status_enum, count(*) AS n, true AS integrity_ok FROM rr GROUP BY ROLLUP (enum)",
)
def status_count_contract(spark, sf):
    return R.status_counts(_results(spark, sf))


@query(
    "executive_summary",
    f"WITH {_R} SELECT count(*) AS total, count(*) FILTER (enum = 'PASS') AS passed, count(*) FILTER (enum = 'FAIL') AS failed, count(*) FILTER (enum = 'WARN') AS warnings, 'RED' AS overall FROM rr",
)
def executive_summary(spark, sf):
    return R.executive_summary(_results(spark, sf))


@query(
    "run_telemetry_summary",
    f"""WITH {_R} SELECT 'total_tables' AS metric, count(*)::DOUBLE AS value FROM rr UNION ALL SELECT 'total_assertions', sum(assertions)::DOUBLE FROM rr UNION ALL SELECT 'average_assertions', round(sum(assertions) / count(*), 6)::DOUBLE FROM rr
      UNION ALL SELECT 'status:' || enum, count(*)::DOUBLE FROM rr GROUP BY 1 UNION ALL SELECT 'validator:' || validator_type, count(*)::DOUBLE FROM rr GROUP BY 1""",
)
def run_telemetry_summary(spark, sf):
    return R.run_summary(_results(spark, sf))


@query(
    "batch_summary",
    """SELECT count(*) AS total_files, count(*) FILTER (o_orderstatus <> 'P') AS successful, count(*) FILTER (o_orderstatus = 'P') AS failed, sum(o_orderkey % 7)::BIGINT AS tables,
       round(count(*) FILTER (o_orderstatus <> 'P') / count(*) * 100, 6) AS success_rate FROM orders""",
)
def batch_summary(spark, sf):
    o = V.table(spark, sf, "orders").select((F.col("o_orderstatus") != "P").alias("ok"), (F.col("o_orderkey") % 7).alias("tables"))
    return R.batch_summary(o)
