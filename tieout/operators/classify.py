"""Table classification: structural fingerprint, two classifiers, a router and mode gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.literals import contains_any as any_of
from tieout.functions.literals import literal_array
from tieout.operators.notes import CLOSING, LISTING_HEADING, MOVEMENT, OPENING
from tieout import catalogue as C

TABLE_KEY = ["doc_id", "table_idx"]

# Code sets and wording per statement family.
BS_CODES = [
    "100", "110", "120", "130", "140", "150", "200", "210", "220", "230", "240", "250", "260", "261", "262", "270", "300", "310", "311", "312",
    "313", "314", "315", "320", "330", "400", "410", "411", "412", "420", "421", "430", "440",
]
IS_CODES = [
    "01", "02", "10", "11", "20", "21", "22", "23", "24", "25", "26", "30", "31", "32", "40", "50", "51", "52", "60", "61",
    "62",
]
CF_CODES = [
    "01", "02", "03", "04", "05", "06", "07", "08", "09", "10", "11", "12", "13", "14", "15", "16", "17", "20", "21", "22",
    "23", "24", "25", "26", "27", "30", "31", "32", "33", "34", "35", "36", "40", "50", "60", "61", "70",
]
IS_ONLY = ["51", "52", "62", "71"]
CF_ONLY = ["03", "04", "05", "06", "07", "08", "09", "12", "13", "14", "15", "16", "17", "18", "27", "33", "34", "35", "36"]
KEYWORDS = {
    "assets": ["assets", "tài sản"],
    "liabilities": ["liabilities", "nợ phải trả"],
    "equity": ["equity", "vốn chủ sở hữu"],
    "cash": ["cash", "tiền"],
    "flows": ["flows", "lưu chuyển"],
    "revenue": ["revenue", "doanh thu", "sales", "thu nhập"],
    "profit": ["profit", "lợi nhuận", "lãi"],
    "operating": ["operating", "hoạt động kinh doanh"],
    "investing": ["investing", "hoạt động đầu tư"],
    "financing": ["financing", "hoạt động tài chính"],
}
HEADING_PATTERNS = {
    "FS_BALANCE_SHEET": ["balance sheet", "cân đối kế toán", "statement of financial position", "báo cáo tình hình tài chính", "financial position", "assets", "tài sản", "liabilities and equity", "nguồn vốn", "resources", "total assets", "tổng tài sản"],
    "FS_INCOME_STATEMENT": ["statement of income", "income statement", "kết quả kinh doanh", "profit and loss", "p&l", "statement of comprehensive income", "báo cáo kết quả hoạt động kinh doanh", "revenue", "doanh thu", "gross profit", "lợi nhuận gộp"],
    "FS_CASH_FLOW": ["cash flow", "cash flows", "lưu chuyển tiền tệ", "lưu chuyển tiền", "statement of cash flows", "net cash", "tiền thuần", "operating activities", "hoạt động kinh doanh"],
    "FS_EQUITY": ["changes in equity", "changes in owner", "changes in owners", "changes in owners' equity", "changes in owner's equity", "changes in owners’ equity", "changes in owner’s equity", "biến động vốn chủ sở hữu", "statement of changes in equity", "báo cáo biến động vốn chủ sở hữu"],
    "TAX_NOTE": ["tax", "thuế"],
}
NOTE_WORDS = ["recognised in", "ghi nhận tại", "off balance sheet", "ngoài bảng", "approved but not provided", "policy", "policies", "accounting policy", "chính sách", "is recognised", "được ghi nhận"]
NOTE_WORDS_HEADING = ["recognised in", "ghi nhận tại", "off balance sheet", "ngoài bảng", "approved but not provided", "policy", "accounting policy", "chính sách", "is recognised", "được ghi nhận", "details of", "chi tiết", "schedule of"]
ROUTER_NOTE_WORDS = ["note", "thuyết minh", "disclosure", "recognised in", "is recognised", "details of", "chi tiết", "schedule of", "policy", "accounting policy"]
ROUTER_ALIASES = [
    ("balance_sheet", ["consolidated statement of financial position", "statement of financial position", "financial position", "balance sheet", "bảng cân đối kế toán"]),
    ("income_statement", ["consolidated statement of income", "statement of income", "income statement", "báo cáo kết quả hoạt động kinh doanh"]),
    ("cash_flow", ["consolidated statement of cash flows", "statement of cash flows", "cash flows", "báo cáo lưu chuyển tiền tệ"]),
    ("equity", ["consolidated statement of changes in equity", "statement of changes in equity", "changes in owners' equity", "báo cáo thay đổi vốn chủ sở hữu"]),
    ("notes", ["notes to the consolidated financial statements", "notes to financial statements", "thuyết minh báo cáo tài chính"]),
]
ROUTER_BS_CODES = ["100", "110", "270", "300", "440"]
TYPE_ORDER = ["heading", "FS_BALANCE_SHEET", "FS_INCOME_STATEMENT", "FS_CASH_FLOW", "FS_EQUITY", "GENERIC_NOTE"]
SCAN_ROWS, EARLY_ROWS = 60, 20


def fingerprint(rows: DataFrame) -> DataFrame:
    """Evidence from a table's first 60 rows: code matches, keywords, movement structure.

    ``rows``: doc_id, table_idx, pos (0-based row position), row_text (lower case), code (or ''). The
    60-row window is part of the measure; found codes are bounded by it.
    """
    r = rows.where(F.col("pos") < SCAN_ROWS)
    t = F.col("row_text")
    digits = F.regexp_extract("code", r"^(\d{2,3})[a-zA-Z]?$", 1)
    has_code = (digits != "") | F.col("code").rlike("^[IVX]+$")
    fp = r.groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("scan_rows"),
        F.avg(has_code.cast("double")).alias("code_density"),
        F.collect_set(F.when(digits != "", digits)).alias("found"),
        F.bool_or(t.rlike(OPENING)).alias("has_opening"), F.bool_or(t.rlike(CLOSING)).alias("has_closing"),
        F.count_if(t.rlike(MOVEMENT)).alias("movement_rows"),
        F.bool_or(any_of(t, KEYWORDS["assets"]) & (F.col("pos") < EARLY_ROWS)).alias("assets_early"),
        *[F.bool_or(any_of(t, words)).alias(f"kw_{k}") for k, words in KEYWORDS.items()],
    )
    hits = lambda codes: F.size(F.array_intersect("found", literal_array(codes)))
    return (
        fp.withColumn("bs", hits(BS_CODES)).withColumn("is", hits(IS_CODES)).withColumn("cf", hits(CF_CODES))
        .withColumn("is_only", hits(IS_ONLY)).withColumn("cf_only", hits(CF_ONLY))
        .withColumn("has_movement", F.col("has_opening") & F.col("has_closing") & (F.col("movement_rows") >= 1))
    )


def _heading_signal(h: Column) -> Column:
    """Best heading match as struct(score, rank, type); the earlier family wins ties."""
    options = []
    for i, (kind, words) in enumerate(HEADING_PATTERNS.items()):
        score = F.when(h.isin(words), 0.95).when(any_of(h, words), 0.8).otherwise(0.0)
        options.append(F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(kind).alias("type")))
    return F.array_max(F.array(*options))


def classify_by_votes(tables: DataFrame) -> DataFrame:
    """Weighted vote of heading (0.3, halved below 0.5 confidence) and structure (0.7).

    ``tables``: fingerprint columns plus heading and heading_confidence. Scores are columns, the
    winner is the largest struct, so no shuffle is added to the fingerprint's.
    """
    h = F.lower(F.trim(F.coalesce("heading", F.lit(""))))
    c = F.col
    note = any_of(h, NOTE_WORDS)
    weight = F.when(c("heading_confidence") < 0.5, 0.15).otherwise(0.3)
    is_n, cf_n, bs_n = c("is").cast("double"), c("cf").cast("double"), c("bs").cast("double")
    bs = (
        F.when(c("bs") >= 3, F.least(F.lit(1.0), 0.3 + bs_n * 0.1)).when(c("bs") >= 2, 0.85)
        .when(c("kw_assets") & c("kw_liabilities") & (c("code_density") > 0.15), 0.6)
        .when(c("assets_early") & (c("code_density") > 0.2), 0.5).otherwise(0.0)
    )
    inc = (
        F.when(
            (c("is") >= 3) & ((c("is_only") >= 1) | c("kw_revenue") | c("kw_profit")),
            F.least(F.lit(1.0), 0.3 + is_n * 0.08) * F.when(c("cf_only") >= 1, 0.5).otherwise(1.0),
        )
        .when((c("is") >= 2) & (c("cf_only") == 0), F.when(c("cf") >= c("is"), 0.85 * 0.4).otherwise(0.85))
        .otherwise(0.0)
    )
    cf = (
        F.when(
            (c("cf") >= 3) & (c("kw_cash") | (c("cf_only") >= 1) | (c("kw_operating") & c("kw_investing"))),
            F.least(F.lit(1.0), 0.3 + cf_n * 0.06) * F.when(c("is_only") >= 1, 0.5).otherwise(1.0),
        )
        .when((c("cf") >= 2) & (c("is_only") == 0), F.when(c("is") >= c("cf"), 0.85 * 0.4).otherwise(0.85))
        .otherwise(0.0)
    )
    eq = F.when(c("kw_equity") & c("has_movement"), 0.5).otherwise(0.0)
    mv = F.when(c("has_movement"), 0.8).otherwise(0.0)
    staged = tables.withColumn("_h", _heading_signal(h)).withColumn("_note", note)
    for name, e in [("_bs", bs), ("_is", inc), ("_cf", cf), ("_eq", eq), ("_mv", mv)]:
        staged = staged.withColumn(name, e * 0.7)
    heading_vote = F.when(~c("_note") & (h != ""), c("_h.score") * weight).otherwise(0.0)
    staged = staged.withColumn("_hv", heading_vote)
    votes = []
    families = [("FS_BALANCE_SHEET", "_bs"), ("FS_INCOME_STATEMENT", "_is"), ("FS_CASH_FLOW", "_cf"), ("FS_EQUITY", "_eq"), ("GENERIC_NOTE", "_mv"), ("TAX_NOTE", None)]
    for i, (kind, own) in enumerate(families):
        from_heading = F.when((c("_h.type") == kind) & (c("_hv") > 0), c("_hv")).otherwise(0.0)
        total = from_heading + (c(own) if own else F.lit(0.0))
        # ties go to the first vote cast: the heading's family, then the structure order
        votes.append(F.struct(F.round(total, 9).alias("score"), F.when(from_heading > 0, 1).otherwise(-i).alias("rank"), F.lit(kind).alias("type")))
    staged = staged.withColumn("_w", F.array_max(F.array(*votes)))
    none = c("_w.score") == 0
    vat = (c("_w.type") == "TAX_NOTE") & h.rlike(r"exclusive\s+of\s+vat")
    structure = c("_bs") + c("_is") + c("_cf") + c("_eq")
    overrule = c("_note") & ~none & ~c("_w.type").isin("GENERIC_NOTE", "TAX_NOTE") & (structure < 0.6)
    skipped = h.contains("skipped_")
    kind = (
        F.when(skipped, "UNKNOWN").when(none & c("_note"), "GENERIC_NOTE").when(none, "UNKNOWN").when(vat | overrule, "GENERIC_NOTE").otherwise(c("_w.type"))
    )
    conf = (
        F.when(skipped, 1.0).when(none & c("_note"), 0.75).when(none, 0.0).when(vat, 0.8).when(overrule, 0.75)
        .otherwise(F.least(F.lit(1.0), c("_w.score")))
    )
    return staged.select(*TABLE_KEY, kind.alias("table_type"), F.round(conf, 3).alias("confidence"))


def classify_by_heading(tables: DataFrame, tax_needs_content: bool = False) -> DataFrame:
    """Heading rules with tax guards; needs heading, has_tax_content, has_vat_exclusion."""
    h = F.lower(F.trim(F.coalesce("heading", F.lit(""))))
    tax = h.contains("tax") | h.contains("thuế")
    note = any_of(h, NOTE_WORDS_HEADING)
    vat = F.col("has_vat_exclusion") | h.rlike(r"exclusive\s+of\s+vat")
    starved = ~F.col("has_tax_content") & F.lit(tax_needs_content)
    result = (
        F.when(h.contains("skipped_"), F.struct(F.lit("UNKNOWN").alias("t"), F.lit(1.0).alias("c")))
        .when(note & tax & vat, F.struct(F.lit("GENERIC_NOTE").alias("t"), F.lit(0.8).alias("c")))
        .when(note & tax & starved, F.struct(F.lit("GENERIC_NOTE").alias("t"), F.lit(0.7).alias("c")))
        .when(note & tax, F.struct(F.lit("TAX_NOTE").alias("t"), F.lit(0.9).alias("c")))
        .when(note, F.struct(F.lit("GENERIC_NOTE").alias("t"), F.lit(0.8).alias("c")))
        .when((h == "balance sheet") | h.contains("cân đối kế toán"), F.struct(F.lit("FS_BALANCE_SHEET").alias("t"), F.lit(0.95).alias("c")))
        .when((h == "statement of income") | h.contains("kết quả kinh doanh"), F.struct(F.lit("FS_INCOME_STATEMENT").alias("t"), F.lit(0.95).alias("c")))
        .when((h == "statement of cash flows") | h.contains("lưu chuyển tiền"), F.struct(F.lit("FS_CASH_FLOW").alias("t"), F.lit(0.95).alias("c")))
        .when((h.contains("equity") | h.contains("vốn chủ sở hữu")) & (h.contains("change") | h.contains("biến động")), F.struct(F.lit("FS_EQUITY").alias("t"), F.lit(0.9).alias("c")))
        .when(tax & vat, F.struct(F.lit("GENERIC_NOTE").alias("t"), F.lit(0.8).alias("c")))
        .when(tax & starved, F.struct(F.lit("GENERIC_NOTE").alias("t"), F.lit(0.7).alias("c")))
        .when(tax, F.struct(F.lit("TAX_NOTE").alias("t"), F.lit(0.8).alias("c")))
        .otherwise(F.struct(F.lit("GENERIC_NOTE").alias("t"), F.lit(0.5).alias("c")))
    )
    return tables.withColumn("_r", result).select(*TABLE_KEY, F.col("_r.t").alias("table_type"), F.col("_r.c").alias("confidence"))


def route(tables: DataFrame) -> DataFrame:
    """Baseline family: note words, aliases, tax, note catalogues, balance-sheet codes, generic.

    Needs heading and ``found`` (codes of the first 60 rows).
    """
    h = F.lower(F.trim(F.regexp_replace(F.coalesce("heading", F.lit("")), r"\s+", " ")))
    tax = h.contains("tax") | h.contains("thuế")
    say = lambda family, why, conf: F.struct(F.lit(family).alias("f"), F.lit(why).alias("w"), F.lit(conf).alias("c"))
    notes = any_of(h, ROUTER_NOTE_WORDS)
    out = F.when(notes & tax, say("tax_note", "note_disambiguation:tax_note", 0.9)).when(
        notes, say("generic_note", "note_disambiguation:generic_note", 0.9)
    )
    for family, words in ROUTER_ALIASES:
        if family == "notes":
            out = out.when(any_of(h, words), say("generic_note", "heading_alias:notes", 0.9))
        else:
            out = out.when(any_of(h, words), say(family, f"heading_alias:{family}", 0.95))
    catalogue = sorted({name for _, names in C.FORMS for name in names})
    codes = F.size(F.array_intersect("found", literal_array(ROUTER_BS_CODES))) >= 3
    out = (
        out.when(tax, say("tax_note", "heading_keyword:tax", 0.8))
        .when(h.isin(catalogue), say("generic_note", "legacy_catalog:cross_check_table", 0.75))
        .when(codes, say("balance_sheet", "code_pattern_fallback_balance_only", 0.6))
        .otherwise(say("generic_note", "fallback:generic_note", 0.4))
    )
    return tables.withColumn("_r", out).select(*TABLE_KEY, F.col("_r.f").alias("family"), F.col("_r.w").alias("reason"), F.col("_r.c").alias("confidence"))


def note_mode(tables: DataFrame) -> DataFrame:
    """Validation mode of a note from its structure flags.

    Needs heading, is_movement, has_scopes, has_column_plan, has_netting_plan.
    """
    h = F.lower(F.trim(F.coalesce("heading", F.lit(""))))
    mode = (
        F.when(F.col("is_movement"), "MOVEMENT_BY_ROWS").when(F.col("has_column_plan"), "MOVEMENT_BY_COLUMNS")
        .when(F.col("has_netting_plan"), "HIERARCHICAL_NETTING").when(h.isin(C.TABLES_WITHOUT_TOTAL), "LISTING_NO_TOTAL")
        .when(h.rlike(LISTING_HEADING) & F.col("has_scopes"), "LISTING_TOTALS").when(h.rlike(LISTING_HEADING), "LISTING_NO_TOTAL")
        .when(F.col("has_scopes"), "GENERIC_NUMERIC_NOTE").otherwise("UNDETERMINED")
    )
    return tables.withColumn("mode", mode)


# Which rule may run in which note mode.
MODE_RULES = [
    ("MOVEMENT_BY_ROWS", "MOVEMENT_ROLLFORWARD"),
    ("MOVEMENT_BY_COLUMNS", "MOVEMENT_BY_COLUMNS"),
    ("HIERARCHICAL_NETTING", "NETTING_BLOCKS"),
    ("GENERIC_NUMERIC_NOTE", "VERTICAL_SUM_SCOPED"),
    ("LISTING_TOTALS", "VERTICAL_SUM_SCOPED"),
    ("UNDETERMINED", "BASIC_NUMERIC_CHECKS"),
]


def gate_rules(evidence: DataFrame, modes: DataFrame) -> DataFrame:
    """Keep evidence whose rule is allowed in the table's mode."""
    from tieout.session import fixed_table

    allow = fixed_table(evidence.sparkSession, MODE_RULES, "mode string, rule_id string")
    return evidence.join(modes.select(*TABLE_KEY, "mode"), TABLE_KEY).join(allow, ["mode", "rule_id"], "left_semi")


def unverified(numeric_tables: DataFrame, evidence: DataFrame) -> DataFrame:
    """Numeric tables that no rule looked at."""
    return numeric_tables.join(evidence.select(*TABLE_KEY).distinct(), TABLE_KEY, "left_anti").withColumn(
        "reason_code", F.lit("UNVERIFIED_NUMERIC_TABLE")
    )


def generic_table_gate(tables: DataFrame) -> DataFrame:
    """First applicable outcome for a generic table.

    Needs heading, has_formula_text, n_numeric_cols, n_rows, has_total_row, all_text.
    """
    h = F.lower(F.trim(F.coalesce("heading", F.lit(""))))
    out = (
        F.when(h.isin(C.TABLES_WITHOUT_TOTAL), "SKIP_NO_TOTAL_HEADING").when(F.col("all_text"), "SKIP_FOOTER")
        .when(F.col("has_formula_text"), "TEXT_FORMULA").when(F.col("n_numeric_cols") == 0, "NO_NUMERIC_COLUMNS")
        .when(F.col("n_rows") <= 1, "SINGLE_ROW").when(~F.col("has_total_row"), "NO_TOTAL_ROW").otherwise("VALIDATE")
    )
    return tables.withColumn("gate", out)
