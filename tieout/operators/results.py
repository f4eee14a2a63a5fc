"""From evidence and marks to statuses, severities, scores, reports and run diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.literals import literal_map

TABLE_KEY = ["doc_id", "table_idx"]

# Rule taxonomy as (rule, family, criticality, root cause).
RULE_TAXONOMY = [
    ("MATH_EQ", "FS Casting", "HIGH", "calculation"),
    ("TAX_RATE_CALCULATION_STEP2", "FS Casting", "HIGH", "calculation"),
    ("TAX_RATE_CALCULATION_STEP3", "FS Casting", "HIGH", "calculation"),
    ("TAX_REMAINING_TABLE_GRAND_TOTAL", "FS Casting", "MEDIUM", "calculation"),
    ("CROSS_CHECK_MISMATCH", "Cross-Check", "HIGH", "cross_ref"),
    ("BALANCE_SHEET_VALIDATION", "Structure", "MEDIUM", "structure"),
    ("INCOME_STATEMENT_VALIDATION", "Structure", "MEDIUM", "structure"),
    ("CASH_FLOW_VALIDATION", "Structure", "MEDIUM", "structure"),
    ("EQUITY_VALIDATION", "Structure", "MEDIUM", "structure"),
    ("TAX_VALIDATION", "FS Casting", "HIGH", "calculation"),
    ("FIXED_ASSET_VALIDATION", "Structure", "MEDIUM", "structure"),
    ("COLUMN_TOTAL_VALIDATION", "FS Casting", "MEDIUM", "calculation"),
    ("ROW_TOTAL_GRAND_TOTAL", "FS Casting", "MEDIUM", "subtotal"),
    ("VALIDATION_INDEX_ERROR", "Error", "HIGH", "general"),
    ("VALIDATION_KEY_ERROR", "Error", "HIGH", "general"),
    ("VALIDATION_UNICODE_ERROR", "Error", "MEDIUM", "general"),
    ("VALIDATION_VALUE_ERROR", "Error", "MEDIUM", "general"),
    ("VALIDATION_UNEXPECTED_ERROR", "Error", "HIGH", "general"),
    ("VALIDATOR_FACTORY_ERROR", "Error", "HIGH", "general"),
    ("SKIPPED_FOOTER_SIGNATURE", "Info", "LOW", "general"),
    ("TABLE_EMPTY", "Info", "LOW", "structure"),
    ("TAX_NO_PROFIT_ROW", "Info", "LOW", "structure"),
    ("TABLE_NO_TOTAL_ROW", "Info", "LOW", "structure"),
    ("NOTE_STRUCTURE_UNDETERMINED", "Info", "LOW", "structure"),
    ("UNVERIFIED_NUMERIC_TABLE", "Info", "LOW", "structure"),
    ("FAIL_TOOL_EXTRACT_GRID_CORRUPTION", "Tool", "HIGH", "extraction"),
    ("FAIL_TOOL_EXTRACT_HEADER_COLLAPSE", "Tool", "HIGH", "extraction"),
    ("FAIL_TOOL_EXTRACT_DUPLICATE_PERIODS", "Tool", "HIGH", "extraction"),
    ("FAIL_TOOL_EXTRACT_LOW_QUALITY", "Tool", "HIGH", "extraction"),
    ("FAIL_TOOL_LOGIC_VALIDATOR_CRASH", "Tool", "HIGH", "logic"),
    ("FAIL_TOOL_EXTRACT_NO_TOTALS", "Tool", "HIGH", "extraction"),
    ("FAIL_TOOL_EXTRACT_NO_NUMERIC", "Tool", "HIGH", "extraction"),
    ("FAIL_TOOL_EXTRACT_MISSING_PERIOD_COLUMN", "Tool", "HIGH", "extraction"),
    ("TABLE_NO_NUMERIC_STRUCTURE", "Info", "LOW", "structure"),
    ("EXTRACTION_FALLBACK_OOXML", "Tool", "MEDIUM", "extraction"),
    ("NO_TOTAL_AND_NO_COLUMN_CHECK", "Info", "LOW", "structure"),
]
ACTIONABLE = ["FAIL", "ERROR", "WARN", "FAIL_TOOL_EXTRACT", "FAIL_TOOL_LOGIC", "FAIL_DATA"]
FINDING = ["FAIL", "WARN", "FAIL_TOOL_EXTRACT", "FAIL_TOOL_LOGIC", "FAIL_DATA"]
REPORT_ORDER = ["ERROR", "FAIL_TOOL_EXTRACT", "FAIL_TOOL_LOGIC", "FAIL_DATA", "FAIL", "WARN", "INFO", "PASS"]
DIFF_HIGH, DIFF_MEDIUM = 100_000.0, 10_000.0
GROUP_KEYS = ["validator_type", "failure_reason_code", "rule_id", "extractor_engine", "total_row_method"]


def _lookup(rule_id: Column, field: int, default: str) -> Column:
    pairs = literal_map((row[0], row[field]) for row in RULE_TAXONOMY)
    return F.coalesce(F.try_element_at(pairs, rule_id), F.lit(default))


def severity_by_taxonomy(rule_id: Column, diff_abs: Column, is_skipped: Column) -> Column:
    """Casting and cross-check rules grade by size of the gap, others by their criticality."""
    family = _lookup(rule_id, 1, "Unknown")
    return (
        F.when(is_skipped, "LOW")
        .when(
            family.isin("FS Casting", "Cross-Check"),
            F.when(diff_abs >= DIFF_HIGH, "HIGH").when(diff_abs >= DIFF_MEDIUM, "MEDIUM").otherwise("LOW"),
        )
        .otherwise(_lookup(rule_id, 2, "MEDIUM"))
    )


def confidence_level(rule_id: Column, is_skipped: Column, is_heuristic: Column, ambiguous: Column) -> Column:
    return (
        F.when(is_skipped | is_heuristic, "MEDIUM")
        .when(rule_id.isin("MATH_EQ", "CROSS_CHECK_MISMATCH"), "HIGH")
        .when(ambiguous, "LOW")
        .otherwise("HIGH")
    )


def root_cause(rule_id: Column, has_subtotals: Column, is_movement: Column, has_missing: Column) -> Column:
    known = _lookup(rule_id, 3, "")
    return (
        F.when(known != "", known)
        .when(has_subtotals, "subtotal").when(is_movement, "movement").when(has_missing, "mapping")
        .when(rule_id.contains("MATH"), "calculation").when(rule_id.contains("CROSS"), "cross_ref")
        .when(rule_id.contains("STRUCT") | rule_id.contains("HEADER"), "structure")
        .otherwise("general")
    )


def status_enum(status: Column) -> Column:
    """First matching wording wins: a text with both 'fail' and 'pass' is a PASS."""
    s = F.lower(status)

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | s.contains(w)
        return out

    return (
        F.when(has("pass", "khớp", "success"), "PASS")
        .when(
            has("fail_tool_extract", "grid corruption", "header collapse", "duplicate period")
            | (has("extraction") & has("failed", "low quality")),
            "FAIL_TOOL_EXTRACT",
        )
        .when(has("fail_tool_logic", "validator crash", "validator exception"), "FAIL_TOOL_LOGIC")
        .when(has("info_skipped", "non-financial", "footer", "signature", "narrative", "skipped"), "INFO_SKIPPED")
        .when(has("fail", "sai lệch"), "FAIL")
        .when(has("warn", "không tìm thấy", "info"), "WARN")
        .when(has("error"), "ERROR")
        .otherwise("UNKNOWN")
    )


def status_enum_from_icon(status: Column) -> Column:
    raw = F.trim(F.coalesce(status, F.lit("")))
    up = F.upper(raw)
    compact = F.replace(up, F.lit(" "), F.lit(""))
    return (
        F.when(raw == "", "UNKNOWN")
        .when(raw.contains("⚠") | up.contains("WARN"), "WARN")
        .when(up.contains("ERROR"), "ERROR")
        .when(up.contains("PASS"), "PASS")
        .when(up.contains("FAIL") | raw.contains("❌") | compact.startswith("X:") | compact.startswith("X-"), "FAIL")
        .when(up.contains("INFO"), "INFO")
        .otherwise("UNKNOWN")
    )


def status_category(enum: Column, rule_id: Column) -> Column:
    return (
        F.when(enum == "PASS", "PASS")
        .when(enum == "INFO_SKIPPED", "INFO_SKIPPED")
        .when(rule_id.startswith("FAIL_TOOL_EXTRACT") | (enum == "FAIL_TOOL_EXTRACT"), "FAIL_TOOL_EXTRACT")
        .when(rule_id.startswith("FAIL_TOOL_LOGIC") | (enum == "FAIL_TOOL_LOGIC"), "FAIL_TOOL_LOGIC")
        .when(enum == "WARN", "WARN")
        .when(enum.isin("FAIL", "ERROR"), "FAIL_DATA")
        .when(enum == "INFO", "INFO_SKIPPED")
        .otherwise("FAIL_DATA")
    )


def rule_from_status(status: Column) -> Column:
    s = F.lower(status)
    return (
        F.when(s.contains("balance sheet"), "BALANCE_SHEET_VALIDATION")
        .when(s.contains("income"), "INCOME_STATEMENT_VALIDATION")
        .when(s.contains("cash flow"), "CASH_FLOW_VALIDATION")
        .when(s.contains("equity"), "EQUITY_VALIDATION")
        .when(s.contains("tax") | s.contains("reconciliation"), "TAX_VALIDATION")
        .when(s.contains("fixed asset"), "FIXED_ASSET_VALIDATION")
        .when(s.contains("cột") | s.contains("column"), "COLUMN_TOTAL_VALIDATION")
        .when(s.contains("kiểm tra công thức") | s.contains("sai lệch"), "ROW_TOTAL_GRAND_TOTAL")
        .otherwise("UNKNOWN")
    )


def apply_gates(results: DataFrame) -> DataFrame:
    """Extraction gate, pass gate, warn cap — in that order — on status_enum.

    Needs status_enum, quality_score, quality_flags, extractor_engine, assertions and
    numeric_evidence.
    """
    bad = F.arrays_overlap("quality_flags", F.array(F.lit("GRID_CORRUPTION"), F.lit("DUPLICATE_PERIODS")))
    low = F.coalesce(F.col("quality_score") < 0.6, F.lit(False))
    passing = F.col("status_enum") == "PASS"
    borderline = (
        F.array_contains("quality_flags", "BORDERLINE_CONFIDENCE")
        | (F.col("extractor_engine") == "ooxml_fallback")
        | F.coalesce((F.col("quality_score") >= 0.6) & (F.col("quality_score") < 0.85), F.lit(False))
    )
    gated = (
        F.when(bad, "FAIL_TOOL_EXTRACT")
        .when(passing & (F.col("assertions") == 0), "INFO_SKIPPED")
        .when(passing & (F.col("numeric_evidence") < 0.25), "FAIL_TOOL_EXTRACT")
        .when(passing & borderline, "WARN")
        .otherwise(F.col("status_enum"))
    )
    reason = (
        F.when(bad & low, "FAIL_TOOL_EXTRACT_LOW_QUALITY").when(bad, "FAIL_TOOL_EXTRACT_GRID_CORRUPTION")
        .when(passing & (F.col("assertions") == 0), "NO_ASSERTIONS")
        .when(passing & (F.col("numeric_evidence") < 0.25), "NO_NUMERIC_EVIDENCE")
        .when(passing & borderline, "BORDERLINE_EXTRACTION_CONFIDENCE")
    )
    return results.withColumn("gate_reason", F.coalesce(reason, F.lit(""))).withColumn("status_enum", gated)


def validated_flag(rule_id: Column) -> Column:
    skipped = ["SKIPPED_FOOTER_SIGNATURE", "SKIPPED_NO_NUMERIC_EVIDENCE"]
    return F.when(F.coalesce(rule_id, F.lit("")).isin(skipped), "Skipped").otherwise("Validated")


def resolve_marks(marks: DataFrame, failed: DataFrame) -> DataFrame:
    """One mark per cell and kind (FAIL beats PASS, else first); failed tables drop PASS marks; a
    validation FAIL beats a cross-reference PASS at the same cell and the other way round.

    ``failed`` lists the keys of failed tables. A single aggregation per cell does it all.
    """
    cell = [*TABLE_KEY, "row_idx", "col_idx"]
    pick = lambda kind: F.min_by(
        F.when(F.col("kind") == kind, F.struct("ok", "comment", "rule_id", "seq")),
        F.when(F.col("kind") == kind, F.struct("ok", "seq")),
    )
    per = marks.groupBy(*cell).agg(pick("validation").alias("v"), pick("cross_ref").alias("c"))
    per = per.join(failed.select(*TABLE_KEY).distinct().withColumn("_f", F.lit(True)), TABLE_KEY, "left")
    table_failed = F.coalesce("_f", F.lit(False))
    v = F.when(~(table_failed & F.col("v.ok")), F.col("v"))
    c = F.when(~(table_failed & F.col("c.ok")), F.col("c"))
    per = per.withColumn("v", v).withColumn("c", c)
    drop_c = (F.col("v.ok") == F.lit(False)) & F.col("c.ok")
    drop_v = F.col("v.ok") & (F.col("c.ok") == F.lit(False))
    both = F.array_compact(
        F.array(
            F.when(F.col("v").isNotNull() & ~F.coalesce(drop_v, F.lit(False)), F.struct(F.lit("validation").alias("kind"), F.col("v").alias("m"))),
            F.when(F.col("c").isNotNull() & ~F.coalesce(drop_c, F.lit(False)), F.struct(F.lit("cross_ref").alias("kind"), F.col("c").alias("m"))),
        )
    )
    return per.select(*cell, F.explode(both).alias("x")).select(*cell, "x.kind", "x.m.ok", "x.m.comment", "x.m.rule_id", "x.m.seq")


def top_differences(evidence: DataFrame, keys: list[str], order: list, n: int = 5) -> DataFrame:
    """The n largest absolute gaps per key; ties by ``order``.

    Spark prunes ranks before the shuffle, so a hot key ships at most n rows per task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.abs("diff").desc(), *order)
    return evidence.where(F.abs("diff") > 0.01).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def severity_rank(c: Column) -> Column:
    return F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0)


def max_diff(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy(*TABLE_KEY).agg(F.max(F.abs("diff")).alias("max_diff"))


def top_findings(results: DataFrame, n: int = 10, evidence: DataFrame | None = None) -> DataFrame:
    """The ``n`` gravest findings; a result without its own largest difference takes that of its ``evidence``."""
    found = results.where(F.col("status_enum").isin(FINDING))
    if evidence is not None:
        known = max_diff(evidence).withColumnRenamed("max_diff", "_shown")
        found = found.join(known, TABLE_KEY, "left").withColumn("max_diff", F.coalesce("max_diff", "_shown")).drop("_shown")
    return found.orderBy(
        severity_rank(F.col("severity")).desc(), F.coalesce("max_diff", F.lit(0.0)).desc(), "doc_id", "table_idx"
    ).limit(n)


def focus_list(results: DataFrame) -> DataFrame:
    keep = (
        F.col("status_enum").isin(FINDING)
        & (F.coalesce("confidence", F.lit("MEDIUM")) != "LOW") & (F.coalesce("severity", F.lit("MEDIUM")) != "LOW")
    )
    return results.where(keep).withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        F.desc("severity_rank"), F.desc("max_diff"), "doc_id", "table_idx"
    )


def report_rank(enum: Column) -> Column:
    out = F.lit(4)
    for i, s in reversed(list(enumerate(REPORT_ORDER))):
        out = F.when(enum == s, i).otherwise(out)
    return out


def report_rows(results: DataFrame) -> DataFrame:
    """Report order: status rank, then table; footer artifacts are left out."""
    return results.where("rule_id <> 'SKIPPED_FOOTER_SIGNATURE'").withColumn(
        "report_rank", report_rank(F.col("status_enum"))
    ).orderBy("report_rank", "doc_id", "table_idx")


def issue_preview(issues: DataFrame, keys: list[str], order: str, n: int = 10) -> DataFrame:
    """First n issues joined by '; ' plus a count of the rest, with bounded lists."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    head = issues.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    text = head.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "issue"))), lambda s: s["issue"]), "; ").alias("t")
    )
    count = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_issues"))
    more = F.when(F.col("n_issues") > n, F.concat(F.lit(" ... (+"), F.col("n_issues") - n, F.lit(" more)"))).otherwise("")
    return text.join(count, keys).select(*keys, "n_issues", F.concat("t", more).alias("preview"))


def score(evidence: DataFrame) -> DataFrame:
    """100 minus 20 / 5 / 1 per material CRITICAL / MAJOR / MINOR finding, at least 0."""
    s = F.col("severity")
    points = F.when(~F.col("is_material"), 0).when(s == "CRITICAL", 20).when(s == "MAJOR", 5).when(s == "MINOR", 1).otherwise(0)
    return evidence.groupBy("doc_id").agg(F.greatest(F.lit(0.0), F.lit(100.0) - F.sum(points)).alias("score"))


# --- fleet aggregates and summaries -------------------------------------------------


def failure_sources(results: DataFrame) -> DataFrame:
    """FAIL/WARN rows by five keys and source with their count; one INFO wording is noise."""
    noise = (F.col("failure_reason_code") == "GenericTableValidator_VALIDATION") & F.col("status").contains(
        "Bảng không bao gồm số/số tổng"
    )
    rows = results.where(F.col("status_enum").isin(ACTIONABLE) & ~F.coalesce(noise, F.lit(False)))
    keys = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in GROUP_KEYS]
    return rows.select(*keys, "source").groupBy(*GROUP_KEYS, "source").agg(F.count(F.lit(1)).alias("n"))


def aggregate_failures(results: DataFrame) -> DataFrame:
    """Failure groups: rows, distinct sources and a digest of the source set.

    The set itself stays in :func:`failure_sources` as rows: a group may span millions of files,
    and a digest compares two sets without gathering either.
    """
    return failure_sources(results).groupBy(*GROUP_KEYS).agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("n_sources"), F.bit_xor(F.xxhash64("source")).alias("sources_digest")
    )


def compare_aggregates(baseline: DataFrame, current: DataFrame, strict: bool = True, allow_extra: bool | None = None) -> DataFrame:
    """Differences between two failure aggregates: missing, extra, count and source-set mismatches."""
    allow_extra = (not strict) if allow_extra is None else allow_extra
    sources = F.struct("n_sources", "sources_digest")
    b = baseline.select(*GROUP_KEYS, F.col("count").alias("baseline_count"), sources.alias("_bs"))
    c = current.select(*GROUP_KEYS, F.col("count").alias("current_count"), sources.alias("_cs"))
    j = b.join(c, GROUP_KEYS, "full_outer")
    missing, extra = F.col("current_count").isNull(), F.col("baseline_count").isNull()
    kinds = F.array_compact(
        F.array(
            F.when(missing, "missing_in_current"),
            F.when(extra & F.lit(not allow_extra), "missing_in_baseline"),
            F.when(~missing & ~extra & (F.col("baseline_count") != F.col("current_count")), "count_mismatch"),
            F.when(~missing & ~extra & (F.col("_bs") != F.col("_cs")), "sources_mismatch"),
        )
    )
    return j.select(*GROUP_KEYS, "baseline_count", "current_count", F.explode(kinds).alias("problem"))


def run_diff(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """NEW / RESOLVED / CHANGED / UNCHANGED by (rule_id, heading); the last duplicate wins.

    Needs rule_id, heading, status_enum, severity, confidence and an order column seq.
    """
    def last(df: DataFrame, p: str) -> DataFrame:
        v = F.max_by(F.struct("status_enum", "severity", "confidence"), "seq")
        return df.where(F.col("status_enum").isin(ACTIONABLE)).groupBy("rule_id", "heading").agg(v.alias(p))

    cur = last(current, "c")
    if previous is None:
        return cur.select(
            "rule_id", "heading", F.lit("NEW").alias("diff_status"), "c.severity", "c.confidence",
            F.lit(None).cast("string").alias("previous_severity"), F.lit(None).cast("string").alias("previous_confidence"),
        )
    j = cur.join(last(previous, "p"), ["rule_id", "heading"], "full_outer")
    same = F.col("c.severity").eqNullSafe(F.col("p.severity")) & F.col("c.confidence").eqNullSafe(F.col("p.confidence"))
    kind = F.when(F.col("p").isNull(), "NEW").when(F.col("c").isNull(), "RESOLVED").when(same, "UNCHANGED").otherwise("CHANGED")
    return j.select(
        "rule_id", "heading", kind.alias("diff_status"),
        F.coalesce("c.severity", "p.severity").alias("severity"), F.coalesce("c.confidence", "p.confidence").alias("confidence"),
        F.when(kind == "CHANGED", F.col("p.severity")).alias("previous_severity"),
        F.when(kind == "CHANGED", F.col("p.confidence")).alias("previous_confidence"),
    )


def carry_triage(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Owner, review status and comment of the previous run by (table_id, rule_id); default 'New'."""
    prev = previous.groupBy("table_id", "rule_id").agg(F.max_by(F.struct("owner", "review_status", "comment"), "seq").alias("p"))
    return current.join(prev, ["table_id", "rule_id"], "left").select(
        *current.columns, F.coalesce("p.owner", F.lit("")).alias("owner"),
        F.coalesce(F.nullif(F.col("p.review_status"), F.lit("")), F.lit("New")).alias("review_status"),
        F.coalesce("p.comment", F.lit("")).alias("comment"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    """Rows per status plus a total row, with the integrity check Σ = total.

    The rollup leaves a handful of rows; the check is a window over those.
    """
    from pyspark.sql import Window

    c = results.rollup("status_enum").agg(F.count(F.lit(1)).alias("n"), F.grouping("status_enum").alias("_g"))
    every = Window.partitionBy(F.lit(0))
    parts = F.sum(F.when((F.col("_g") == 0) & F.col("status_enum").isNotNull(), F.col("n"))).over(every)
    total = F.max(F.when(F.col("_g") == 1, F.col("n"))).over(every)
    return c.select(
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.coalesce("status_enum", F.lit("UNKNOWN"))).alias("status_enum"),
        "n", (parts == total).alias("integrity_ok"),
    )


def executive_summary(results: DataFrame) -> DataFrame:
    s = F.upper(F.trim(F.coalesce("status_enum", F.lit(""))))
    c = lambda v: F.count_if(s == v)
    return results.agg(
        F.count(F.lit(1)).alias("total"), c("PASS").alias("passed"), c("FAIL").alias("failed"), c("WARN").alias("warnings")
    ).withColumn("overall", F.when(F.col("failed") > 0, "RED").when(F.col("warnings") > 0, "YELLOW").otherwise("GREEN"))


def run_summary(telemetry: DataFrame) -> DataFrame:
    """Totals, averages and counts by status and validator as one long metric table."""
    base = telemetry.groupBy("status_enum", "validator_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("assertions").alias("a")
    )
    total = base.agg(F.sum("n").alias("tables"), F.sum("a").alias("assertions"))
    metrics = [
        total.select(F.lit("total_tables").alias("metric"), F.col("tables").cast("double").alias("value")),
        total.select(F.lit("total_assertions").alias("metric"), F.col("assertions").cast("double").alias("value")),
        total.select(F.lit("average_assertions").alias("metric"), F.round(F.col("assertions") / F.col("tables"), 6).alias("value")),
        base.groupBy(F.concat(F.lit("status:"), "status_enum").alias("metric")).agg(F.sum("n").cast("double").alias("value")),
        base.groupBy(F.concat(F.lit("validator:"), "validator_type").alias("metric")).agg(F.sum("n").cast("double").alias("value")),
    ]
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m)
    return out


def batch_summary(files: DataFrame) -> DataFrame:
    """Files total / ok / failed, tables processed, success rate in percent."""
    return files.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"),
    ).withColumn(
        "success_rate",
        F.when(F.col("total_files") > 0, F.round(F.col("successful") / F.col("total_files") * 100, 6)).otherwise(0.0),
    )
