"""Shaping raw blocks and cells: headings, header rows, merges, quality, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.amounts import parse_amount
from tieout.functions.text import box_score, centre_inside, period_key
from tieout.functions.literals import contains_any as any_of
from tieout.operators.scans import Scan, groups_fit, join_tables, scan
from tieout.session import checkpoint

TABLE_KEY = ["doc_id", "table_idx"]
#: The same for sorts, which compare the first key alone as long as it differs.
SORT_KEY = ["table_idx", "doc_id"]
NEAREST = 15
#: Boxes of a page that every token of the page is tried against.
FEW_BOXES = 256

# Wording and patterns of headings, headers and footers.
STRONG_HEADING_WORDS = [
    "balance sheet", "bảng cân đối kế toán", "statement of financial position", "statement of income", "income statement",
    "profit and loss", "kết quả kinh doanh", "báo cáo kết quả", "cash flow", "lưu chuyển tiền tệ", "lưu chuyển tiền",
    "changes in equity", "changes in owners' equity", "vốn chủ sở hữu", "thay đổi vốn", "notes to", "thuyết minh", "ghi chú",
    "tax", "thuế",
]
YEAR_CONTEXT = ["for the year", "năm kết thúc", "ended", "period", "kỳ kế toán", "niên độ", "statement", "báo cáo"]
SCHEMA_TOKENS = [
    "code", "note", "notes", "unit", "mã số", "mã", "ms", "đơn vị", "đơn vị tính", "đvt", "stt", "tt", "số", "thuyết minh", "ghi chú",
]
VALID_HEADING = (
    r"balance sheet|cân đối kế toán|income statement|kết quả kinh doanh|cash flow|lưu chuyển tiền|equity|vốn chủ sở hữu|note \d+:"
)
STATEMENT_WORDS = [
    "kết quả kinh doanh", "thu nhập", "lưu chuyển tiền tệ", "cash flow", "income statement", "changes in equity", "changes in owner",
    "biến động vốn chủ sở hữu", "balance sheet", "bảng cân đối kế toán", "tình hình tài chính", "financial position",
]
FOOTER_WORDS = [
    "prepared by", "approved by", "authorised", "authorized", "chief accountant", "cfo", "chief financial officer",
    "chief executive officer", "ceo", "signature", "reviewed by", "managing director", "general director", "board of directors",
    "auditor", "date:", "ký tên", "chữ ký", "người lập", "được ủy quyền", "đã phê duyệt", "người xem xét", "kế toán trưởng",
    "giám đốc tài chính", "tổng giám đốc", "giám đốc điều hành",
]
FINANCIAL_LABELS = [
    "share capital", "number of shares", "par value", "contributed capital", "equity", "vốn", "cổ phần", "vốn cổ phần", "vốn điều lệ",
    "capital", "issued", "ordinary shares", "preference shares", "treasury shares", "legal reserve", "other reserves",
    "retained earnings", "undistributed", "assets", "tài sản", "liabilities", "nợ", "borrowings", "vay", "revenue", "doanh thu",
    "expenses", "chi phí", "profit", "lợi nhuận", "cash", "tiền", "receivables", "phải thu", "payables", "phải trả", "inventory",
    "hàng tồn kho",
]
CURRENCY_WORDS = ["vnd", "usd", "%", "percent", "million", "thousand", "triệu", "nghìn"]
RESTART_CODES = ["01", "1", "1.", "01.", "I"]
YEAR_OR_DATE = r"\b20\d{2}\b|\d{1,2}/\d{1,2}/\d{4}"
PERIOD_HEADER = (
    r"(?i)^((19|20)\d{2}|FY\s*(19|20)?\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|Q[1-4]\s*(19|20)?\d{2}|"
    r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s*\d{2,4})$"
)
# Acceptance thresholds (coverage, mean confidence, p10 confidence, empty share).
ACCEPT = (0.9, 0.85, 0.7, 0.3)
BORDERLINE = (0.7, 0.7, 0.5, 0.5)


def attach_last_heading(blocks: DataFrame) -> DataFrame:
    """Each table gets the last heading-styled paragraph before it; section text overrides a missing
    or bare statement heading. Carry-forward runs as a chunked scan over the document."""
    heading = F.when(F.col("style").startswith("Heading") & (F.col("kind") != "table"), F.col("text"))
    out = scan(blocks, ["doc_id"], "block_idx", [Scan("heading", "last", heading, inclusive=False)]).where("kind = 'table'")
    if "section_text" in blocks.columns:
        h = F.lower("heading")
        weak = F.col("heading").isNull() | h.contains("financial position") | h.contains("statement of income")
        out = out.withColumn("heading", F.when(weak, F.coalesce("section_text", "heading")).otherwise(F.col("heading")))
    return out


def heading_junk(text: Column) -> Column:
    """Text that looks like data, units or dates rather than a section heading."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    words = F.split(low, r"\s+")
    few = F.size(words) <= 4
    n = F.length(t)
    digits = F.length(F.regexp_replace(t, r"[^\d]", ""))
    marks = F.length(F.regexp_replace(t, "[^$.,()\u00a0]", ""))
    date = F.regexp_extract(t, r"\d{1,2}/\d{1,2}/\d{2,4}", 0)
    unit = F.exists(words, lambda w: w.isin("vnd", "usd", "eur", "đồng") | w.contains("vnd'") | w.contains("usd'"))
    year = F.exists(words, lambda w: w.rlike(r"^(19|20)\d{2}$"))
    dated = F.exists(words, lambda w: w.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}"))
    return (
        F.when(n < 3, True)
        .when(low.isin(SCHEMA_TOKENS) | low.rlike(r"^(vnd|usd|eur|đồng|vnd'\d+|usd'\d+)$"), True)
        .when(low.rlike(VALID_HEADING), False)
        .when(low.rlike(r"^(unit|đơn\s*vị\s*(tính)?|đvt|currency|tỷ\s*giá)\s*:?\s*.{0,20}$"), True)
        .when(few & (year | unit | dated), True)
        .when((digits + marks) / n > 0.5, True)
        .when(F.length(date) / n > 0.5, True)
        .when(t.rlike(r"20\d{2}\s*$") & (digits / n > 0.2), True)
        .when(t.contains(":"), False)
        .otherwise((F.size(F.split(t, r"\s+")) <= 2) & low.rlike(r"^(note|table|appendix)\s+\d+$"))
    )


def attach_scored_heading(blocks: DataFrame, first_rows: DataFrame | None = None) -> DataFrame:
    """Best-scored paragraph among the 15 nearest since the previous table.

    The scan numbers the table islands and the paragraphs; paragraphs then meet their one table
    by (doc, island), so nothing fans out. Without a winner the table's first row may serve.
    """
    is_table = F.col("kind") == "table"
    numbered = scan(
        blocks, ["doc_id"], "block_idx",
        [Scan("island", "sum", F.when(is_table, 1).otherwise(0), inclusive=False), Scan("n_par", "sum", F.when(is_table, 0).otherwise(1))],
    ).withColumn("island", F.coalesce("island", F.lit(0)))
    # tables and paragraphs both read the numbered blocks
    numbered = checkpoint(numbered)
    tables = numbered.where(is_table).select("doc_id", "island", "table_idx", F.col("n_par").alias("_at"))
    paragraphs = numbered.where(~is_table)
    j = paragraphs.join(tables.select("doc_id", "island", "_at"), ["doc_id", "island"]).withColumn("distance", F.col("_at") - F.col("n_par"))
    low = F.lower("text")
    score = (
        F.when(any_of(low, STRONG_HEADING_WORDS), 10.0).otherwise(0.0) + F.when(F.col("style").contains("Heading"), 5.0).otherwise(0.0)
        + F.when(F.col("is_bold"), 3.0).otherwise(0.0) + F.when(F.col("is_upper"), 2.0).otherwise(0.0)
        + F.when(F.col("text").rlike(r"20\d{2}") & any_of(low, YEAR_CONTEXT), 10.0).otherwise(0.0) - F.col("distance") * 0.5
    )
    cand = j.where((F.col("distance") < NEAREST) & (F.col("text") != "") & ~heading_junk(F.col("text"))).withColumn("score", score).where("score >= 5")
    best = cand.groupBy("doc_id", "island").agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col("distance"))).alias("b"))
    out = tables.join(best, ["doc_id", "island"], "left")
    if first_rows is not None:
        out = out.join(first_rows.select(*TABLE_KEY, F.col("heading").alias("_first")), TABLE_KEY, "left")
    else:
        out = out.withColumn("_first", F.lit(None).cast("string"))
    found = F.col("b").isNotNull()
    return out.select(
        *TABLE_KEY, F.coalesce("b.text", "_first").alias("heading"),
        F.when(found, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("b.score") / 10))).when(F.col("_first").isNotNull(), 0.6).otherwise(0.0).alias("heading_confidence"),
        F.when(found, "paragraph").when(F.col("_first").isNotNull(), "table_first_row").otherwise("none").alias("heading_source"),
    )


def heading_from_first_row(cells: DataFrame) -> DataFrame:
    """Longest cell of the first two rows that is neither a number, a code nor junk; first one wins ties."""
    t = F.trim("text")
    number = F.regexp_replace(t, "[,. ()]", "").rlike(r"^-*\d+$")
    keep = (t != "") & ~number & ~t.rlike(r"^[0-9]{2,}[A-Z]?$") & ~heading_junk(t)
    return cells.where(F.col("row_idx") < 2).where(keep).groupBy(*TABLE_KEY).agg(
        F.max_by(F.trim("text"), F.struct(F.length(F.trim("text")), -F.col("row_idx"), -F.col("col_idx"))).alias("heading")
    )


def header_range(cells: DataFrame, code_words: list[str], note_words: list[str], scan_rows: int = 15) -> DataFrame:
    """First header-like row (code 2, note 1, year 1 points; ≥ 3) and how far the header reaches down."""
    t = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    starts = lambda words: t.rlike("^(?:" + "|".join(f"\\Q{w}\\E" for w in words) + ")") if words else F.lit(False)
    year = t.rlike(r"20\d{2}|19\d{2}|\d{1,2}/\d{1,2}/\d{2,4}")
    filled = t != ""
    points = F.when(~filled, 0).otherwise(
        F.when(starts(code_words), 2).otherwise(0) + F.when(starts(note_words), 1).otherwise(0) + F.when(year, 1).otherwise(0)
    )
    rows = cells.where(F.col("row_idx") < scan_rows).groupBy(*TABLE_KEY, "row_idx").agg(
        F.sum(points).alias("score"), F.bool_or(t.isin(code_words)).alias("code"), F.bool_or(t.isin(note_words)).alias("note"),
        F.bool_or(year).alias("year"), F.max(F.length(t)).alias("longest"),
        F.coalesce(F.avg(F.when(filled, parse_amount(F.col("text")).isNotNull().cast("double"))), F.lit(0.0)).alias("density"),
    )
    strong = (F.col("score") >= 3) & (F.col("code") | (F.col("note") & F.col("year")))
    soft = (F.col("density") < 0.5) & ((F.col("score") >= 2) | (F.col("longest") < 20))
    # no more rows per table than are scanned, so they meet in one array
    r = rows.groupBy(*TABLE_KEY).agg(F.collect_list(F.struct("row_idx", strong.alias("strong"), (strong | soft).alias("go"))).alias("_r"))
    first = lambda held: F.array_min(F.transform(F.filter("_r", held), lambda x: x["row_idx"]))
    r = r.withColumn("start_row", first(lambda x: x["strong"])).where("start_row is not null")
    stop = first(lambda x: ~x["go"] & (x["row_idx"] >= F.col("start_row")))
    end = F.coalesce(stop, F.array_max(F.transform("_r", lambda x: x["row_idx"])) + 1) - 1
    return r.select(*TABLE_KEY, "start_row", end.alias("end_row"))


def consolidate_headers(cells: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """One header per column: the filled header cells joined by a space (bounded by the header's rows).

    Without ``ranges`` the cells already hold start_row and end_row.
    """
    j = cells if ranges is None else cells.join(ranges, TABLE_KEY)
    inside = F.col("row_idx").between(F.col("start_row"), F.col("end_row")) & (F.trim("text") != "")
    below = (F.col("row_idx") > F.col("end_row")) & (F.col("row_idx") <= F.col("end_row") + 10)
    parts = F.sort_array(F.collect_list(F.when(inside, F.struct("row_idx", F.trim("text").alias("t")))))
    c = j.groupBy(*TABLE_KEY, "col_idx").agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("h"),
        F.bool_or(below & parse_amount(F.col("text")).isNotNull()).alias("num"),
    )
    blank = F.concat(F.when(F.coalesce("num", F.lit(False)), "Amount_").otherwise("Column_"), F.col("col_idx"))
    return c.select(*TABLE_KEY, "col_idx", F.when(F.col("h") == "", blank).otherwise(F.col("h")).alias("header"))


def unique_headers(headers: DataFrame) -> DataFrame:
    """name, name.1, name.2 … for repeated headers of a table; windows hold one table's columns."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*TABLE_KEY, "header").orderBy("col_idx")) - 1
    return headers.withColumn("header", F.when(n > 0, F.concat("header", F.lit("."), n)).otherwise(F.col("header")))


def promote_headers(cells: DataFrame, ranges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers, body): header rows leave the cells and become de-duplicated column names. ``ranges`` as in :func:`consolidate_headers`."""
    headers = unique_headers(consolidate_headers(cells, ranges))
    body = (cells if ranges is None else cells.join(ranges, TABLE_KEY)).where(F.col("row_idx") > F.col("end_row")).withColumn(
        "row_idx", F.col("row_idx") - F.col("end_row") - 1
    ).drop("start_row", "end_row")
    return headers, body


def merge_decisions(tables: DataFrame, enabled: bool = True) -> DataFrame:
    """Merge each table into the one before it, or the reason not to; plus the merged group.

    Needs doc_id, table_idx, heading, note_number, n_cols, headers (array), page_break,
    paragraphs_since, long_paragraph, is_footer, first_cell, last_cell.
    """
    fields = ["heading", "n_cols", "headers", "is_footer", "last_cell"]
    t = scan(tables, ["doc_id"], "table_idx", [Scan("prev", "lag", F.struct(*fields))])
    h, p = F.col("heading"), F.col("prev")
    norm = lambda a: F.array_distinct(F.transform(a, lambda x: F.lower(F.trim(x))))
    a, b = norm(F.col("headers")), norm(p["headers"])
    alike = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    near = ((F.col("paragraphs_since") <= 2) & ~F.col("long_paragraph")) | F.col("page_break")
    reason = (
        F.when(F.lit(not enabled), "MERGE_DISABLED").when(p.isNull(), "NO_PREV_TABLE").when(F.col("is_footer"), "CURR_IS_FOOTER")
        .when(p["is_footer"], "PREV_IS_FOOTER")
        .when(h.isNotNull() & any_of(F.lower(h), STATEMENT_WORDS), "MERGE_BLOCKED_FINANCIAL_STATEMENT")
        .when(F.col("n_cols") != p["n_cols"], "COLUMN_COUNT_MISMATCH").when(~near, "PROXIMITY_FAIL")
        .when(h.isNull() & F.col("note_number").isNull() & ~F.col("page_break"), "MERGE_WEAK_HEURISTIC_BLOCKED")
        .when(h.isNull() & F.col("page_break") & (alike < 0.5), "MERGE_BLOCKED_HEADER_MISMATCH")
        .when(h.isNotNull() & ~h.eqNullSafe(p["heading"]), "HEADING_MISMATCH")
        .when(F.trim("first_cell").isin(RESTART_CODES) & ~F.trim(p["last_cell"]).isin("0", "00", "0."), "MERGE_BLOCKED_CONTINUITY")
        .otherwise("MERGED_BY_STRONG_ANCHOR")
    )
    t = t.withColumn("reason", reason).withColumn("merged", F.col("reason") == "MERGED_BY_STRONG_ANCHOR").drop("prev")
    return scan(t, ["doc_id"], "table_idx", [Scan("merge_group", "sum", F.when(F.col("merged"), 0).otherwise(1))])


def repeated_header_row(headers: DataFrame, body: DataFrame) -> DataFrame:
    """First body row with at least two year tokens that cover half of the header's tokens."""
    tokens = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(YEAR_OR_DATE), 0)))
    head = headers.select(*TABLE_KEY, tokens(F.col("header")).alias("tok")).distinct()
    size = head.groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("n_head"))
    rows = body.where(F.col("row_idx") >= 1).select(*TABLE_KEY, "row_idx", tokens(F.col("text")).alias("tok")).distinct()
    j = rows.join(head.withColumn("_hit", F.lit(1)), [*TABLE_KEY, "tok"], "left").groupBy(*TABLE_KEY, "row_idx").agg(
        F.count(F.lit(1)).alias("n_row"), F.count("_hit").alias("n_hit")
    )
    return j.join(size, TABLE_KEY).where((F.col("n_row") >= 2) & (F.col("n_hit") >= F.col("n_head") * 0.5)).groupBy(*TABLE_KEY).agg(
        F.min("row_idx").alias("split_row")
    )


def footer_tables(cells: DataFrame) -> DataFrame:
    """Signature blocks and footers: clear footer wording in a small, wordy table without money."""
    t = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    number = F.regexp_replace(t, "[,.\\- ]", "").rlike(r"^\d+$")
    line = cells.groupBy(*TABLE_KEY, "row_idx").agg(
        F.sum(F.length(t) + 1).alias("_len"), F.bool_or(t != "").alias("_any"), F.count(F.lit(1)).alias("n"), F.count_if(number).alias("num"),
        F.bool_or(any_of(t, FOOTER_WORDS)).alias("pos"), F.bool_or(any_of(t, FINANCIAL_LABELS)).alias("neg"),
        F.bool_or(t.contains("20") | t.contains("19")).alias("yr"), F.bool_or(any_of(t, CURRENCY_WORDS)).alias("cur"),
    )
    g = line.groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.sum("num") / F.sum("n")).alias("numeric_ratio"), F.bool_or("pos").alias("pos"),
        F.bool_or("neg").alias("neg"), F.bool_or("yr").alias("yr"), F.bool_or("cur").alias("cur"),
        F.count_if(F.col("_any") & (F.col("_len") - 1 <= 80)).alias("short"),
    )
    short = (F.col("n_rows") >= 2) & (F.col("short") >= F.greatest(F.lit(1), F.floor(F.col("n_rows") / 2)))
    r = F.col("numeric_ratio")
    positive = F.col("pos") & (((F.col("n_rows") <= 20) & ((r < 0.1) | short)) | ((F.col("n_rows") <= 3) & (r < 0.05) & short))
    negative = F.col("neg") | ((r > 0.15) & (F.col("yr") | F.col("cur"))) | (r > 0.3)
    return g.select(*TABLE_KEY, "n_rows", F.round("numeric_ratio", 4).alias("numeric_ratio"), (positive & ~negative).alias("is_footer"))


def caption_rows(cells: DataFrame) -> DataFrame:
    """Rows with at most one filled cell, or two in tables of three or more columns."""
    width = cells.groupBy(*TABLE_KEY).agg((F.max("col_idx") + 1).alias("_w"))
    filled = cells.groupBy(*TABLE_KEY, "row_idx").agg(F.count_if(F.trim("text") != "").alias("n"))
    return filled.join(width, TABLE_KEY).where((F.col("n") <= 1) | ((F.col("n") <= 2) & (F.col("_w") >= 3))).select(*TABLE_KEY, "row_idx")


def grid_quality(cells: DataFrame) -> DataFrame:
    """Quality score, flags and usability of a table grid (col_idx counts what each row really has)."""
    row = cells.groupBy(*TABLE_KEY, "row_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("text") != "").alias("f"))
    g = row.groupBy(*TABLE_KEY).agg(
        F.max("n").alias("cols"), F.min("n").alias("narrow"), F.count(F.lit(1)).alias("rows"), F.sum("f").alias("filled")
    )
    head = cells.where("row_idx = 0").groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("hn"), F.count_distinct(F.trim("text")).alias("hd"))
    j = g.join(head, TABLE_KEY, "left")
    ragged = F.col("narrow") != F.col("cols")
    dup = F.coalesce(F.col("hn") != F.col("hd"), F.lit(False))
    fill = F.col("filled") / (F.col("rows") * F.col("cols"))
    raw = (
        F.lit(1.0) - F.when(ragged, 0.5).otherwise(0.0) - F.when(dup, 0.5).otherwise(0.0)
        - F.when(fill < 0.1, 0.3).when(fill < 0.5, 0.1).otherwise(0.0)
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    score = F.round(F.when(ragged | dup, F.least(bounded, F.lit(0.55))).otherwise(bounded), 2)
    flags = F.array_compact(F.array(F.when(ragged, "GRID_CORRUPTION"), F.when(dup, "DUPLICATE_PERIODS"), F.when(fill < 0.1, "LOW_FILL")))
    return j.select(*TABLE_KEY, score.alias("quality_score"), flags.alias("quality_flags")).withColumn(
        "usable", (F.col("quality_score") >= 0.6) & ~F.arrays_overlap("quality_flags", F.array(F.lit("GRID_CORRUPTION"), F.lit("DUPLICATE_PERIODS")))
    )


def tenth_percentile(values: DataFrame, keys: list[str], value: str, step: float) -> DataFrame:
    """Element int(0.1 n) of each key's sorted values, without collecting them.

    Values are counted, the counts accumulated in value order by a chunked scan (one chunk per
    ``step`` of value), and the first value whose running count passes the index is taken.
    """
    hist = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    size = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    run = scan(hist, keys, value, [Scan("_cum", "sum", F.col("_n"))], chunk=F.floor(F.col(value) / step))
    return run.join(size, keys).where(F.col("_cum") > F.floor(F.col("_total") * 0.1)).groupBy(*keys).agg(F.min(value).alias("p10"))


def token_gate(metrics: DataFrame) -> DataFrame:
    """Accept, borderline or reject from coverage, mean and p10 confidence and empty share."""
    def passes(limits: tuple) -> Column:
        return (
            (F.col("coverage") >= limits[0]) & (F.col("mean_conf") >= limits[1]) & (F.col("p10") >= limits[2]) & (F.col("empty_ratio") <= limits[3])
        )

    m = F.col("mean_conf")
    why = (
        F.when(F.col("coverage") < BORDERLINE[0], "RENDER_FIRST_LOW_TOKEN_COVERAGE").when(m < BORDERLINE[1], "RENDER_FIRST_LOW_CONFIDENCE")
        .when(F.col("empty_ratio") > BORDERLINE[3], "RENDER_FIRST_TOO_MANY_EMPTY_CELLS").otherwise("RENDER_FIRST_UNTRUSTED")
    )
    full, part = passes(ACCEPT), passes(BORDERLINE)
    return metrics.withColumn("decision", F.when(full, "accept").when(part, "borderline").otherwise("reject")).withColumn(
        "quality_score", F.when(full, 0.9 + 0.1 * m).when(part, 0.6 + 0.3 * m).otherwise(0.3 + 0.3 * m)
    ).withColumn("reason", F.when(full | part, "").otherwise(why))


def assign_tokens(tokens: DataFrame, boxes: DataFrame, tile: int = 64, small: bool | None = None) -> DataFrame:
    """Each token to its best-scored box whose area holds the token's centre.

    Where no page has many tokens or more than FEW_BOXES boxes, they meet per page, and frames dealt by page stay where they
    are; ``small`` says so, where the caller knows, otherwise two jobs ask. Else tokens and boxes meet per tile of the page, so
    that a page with many of both never forms all pairs; of the tiles that a pair shares, that with the first corner of its
    overlap keeps it. Only overlapping pairs are scored. The join is a merge join: sizes estimated before boxes or tiles are
    exploded are far too small.
    """
    def tiles(df: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
        return df.withColumn("_tx", span("x1", "x2")).withColumn("_ty", span("y1", "y2"))

    if small is None:
        small = groups_fit(boxes, TABLE_KEY, FEW_BOXES) and groups_fit(tokens, TABLE_KEY)
    side = {c: F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2")}
    tok = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    left, top = F.greatest("x1", "b_x1"), F.greatest("y1", "b_y1")
    met = (left < F.least("x2", "b_x2")) & (top < F.least("y2", "b_y2"))
    keys = [*SORT_KEY] if small else [*SORT_KEY, "_tx", "_ty"]
    b = (boxes if small else tiles(boxes)).select(*keys, "row_idx", "col_idx", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    if not small:
        met = met & (F.floor(left / tile) == F.col("_tx")) & (F.floor(top / tile) == F.col("_ty"))
    j = (tokens if small else tiles(tokens)).join(b.hint("merge"), keys).where(met).withColumn("score", F.round(box_score(tok, side), 9))
    best = j.groupBy(*SORT_KEY, "token_id").agg(
        F.max_by(
            F.struct("row_idx", "col_idx", "score", "text", "x1", "y1", centre_inside(tok, side).alias("inside")),
            F.struct("score", -F.col("row_idx"), -F.col("col_idx")),
        ).alias("m")
    )
    # asked of the best pair: in front of it, every pair of the page would be scored twice, in a method too long to be compiled
    return best.where("m.score > 0 AND m.inside").select(*TABLE_KEY, "token_id", "m.row_idx", "m.col_idx", "m.score", "m.text", "m.x1", "m.y1")


def cell_texts(assigned: DataFrame, line_height: int = 10) -> DataFrame:
    """Text per cell: tokens by line, then left to right. A gap above ``line_height`` opens a line.

    Lists are bounded by what one cell holds.
    """
    return assigned.groupBy(*SORT_KEY, "row_idx", "col_idx").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(F.floor(F.col("y1") / line_height).alias("l"), "x1", "text"))), lambda t: t["text"]), " "
        ).alias("text"),
        F.count(F.lit(1)).alias("n_tokens"),
    ).select(*TABLE_KEY, "row_idx", "col_idx", "text", "n_tokens")


def merged_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Merge ``Code, Code.1, …`` into one column, first filled value per row; n_values counts the different ones.

    A table's headers (one per column) stand beside its cells as one array, so that only the table decides where cells go.
    """
    base = F.regexp_replace("header", r"\.\d+$", "")
    heads = headers.groupBy(*TABLE_KEY).agg(F.collect_list(F.struct("col_idx", base.alias("base"))).alias("_h"))
    named = join_tables(cells, heads, TABLE_KEY).withColumn("_h", F.get(F.filter("_h", lambda x: x["col_idx"] == F.col("col_idx")), F.lit(0)))
    t = F.when(F.trim("text") != "", F.trim("text"))
    m = named.where("_h is not null").groupBy(*TABLE_KEY, "row_idx", F.col("_h.base").alias("header")).agg(
        F.min("col_idx").alias("col_idx"), F.min(F.when(t.isNotNull(), F.struct("col_idx", t.alias("t")))).alias("v"), F.count_distinct(t).alias("n_values")
    )
    return m.select(*TABLE_KEY, "row_idx", "col_idx", "header", F.coalesce("v.t", F.lit("")).alias("text"), "n_values")


def canonical_columns(cells: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`merged_columns`, and the log of conflicts apart."""
    m = merged_columns(cells, headers)
    return m.drop("n_values"), m.where("n_values > 1").select(*TABLE_KEY, "row_idx", "header", "n_values")


def drop_index_rows(cells: DataFrame) -> DataFrame:
    """Remove a first row that only numbers its columns 0, 1, 2 …"""
    is_index = cells.where("row_idx = 0").groupBy(*TABLE_KEY).agg(
        F.bool_and(F.trim("text") == F.col("col_idx").cast("string")).alias("_idx")
    ).where("_idx")
    j = cells.join(is_index, TABLE_KEY, "left")
    return j.where(~(F.col("_idx").isNotNull() & (F.col("row_idx") == 0))).select(
        *TABLE_KEY, F.when(F.col("_idx"), F.col("row_idx") - 1).otherwise(F.col("row_idx")).alias("row_idx"), "col_idx", "text"
    )


def merge_period_columns(body: DataFrame, headers: DataFrame) -> DataFrame:
    """Columns of the same period: the densest stays and is filled from the others; columns that
    contradict it stay apart as ``name (2)``."""
    from pyspark.sql import Window

    p = headers.withColumn("period", period_key(F.col("header")))
    v = body.withColumn("value", parse_amount(F.col("text")))
    dens = v.groupBy(*TABLE_KEY, "col_idx").agg(F.count("value").alias("_n"))
    # ranks span one table's columns only
    w = Window.partitionBy(*TABLE_KEY, "period").orderBy(F.desc("_n"), "col_idx")
    ranked = p.join(dens, [*TABLE_KEY, "col_idx"], "left").withColumn("_r", F.when(F.col("period").isNull(), 1).otherwise(F.row_number().over(w)))
    keep = ranked.where("_r = 1").select(*TABLE_KEY, "period", F.col("col_idx").alias("keep_col"), F.col("header").alias("keep_header"))
    dup = ranked.where("_r > 1").join(keep.where("period is not null"), [*TABLE_KEY, "period"])
    pairs = v.join(dup.select(*TABLE_KEY, "col_idx", "keep_col", "keep_header"), [*TABLE_KEY, "col_idx"])
    base = v.select(*TABLE_KEY, "row_idx", F.col("col_idx").alias("keep_col"), F.col("value").alias("base"))
    cmp = pairs.join(base, [*TABLE_KEY, "row_idx", "keep_col"], "left")
    clash = cmp.groupBy(*TABLE_KEY, "col_idx").agg(F.coalesce(F.bool_or(F.col("value") != F.col("base")), F.lit(False)).alias("conflict"))
    fill = cmp.join(clash.where("not conflict"), [*TABLE_KEY, "col_idx"]).groupBy(*TABLE_KEY, "row_idx", F.col("keep_col").alias("col_idx")).agg(
        F.max("value").alias("fill")
    )
    named = ranked.join(clash, [*TABLE_KEY, "col_idx"], "left").where("_r = 1 or conflict").withColumn(
        "header", F.when(F.col("_r") > 1, F.concat(F.regexp_replace("header", r"\.\d+$", ""), F.lit(" ("), F.col("_r"), F.lit(")"))).otherwise(F.col("header"))
    )
    out = v.join(named.select(*TABLE_KEY, "col_idx", "header"), [*TABLE_KEY, "col_idx"]).join(fill, [*TABLE_KEY, "row_idx", "col_idx"], "left")
    return out.select(*TABLE_KEY, "row_idx", "col_idx", "header", F.coalesce("value", "fill").alias("value"))


def rectangular(cells: DataFrame) -> DataFrame:
    """Pad every row to its table's widest row with empty cells."""
    width = cells.groupBy(*TABLE_KEY).agg(F.max("col_idx").alias("_w"))
    rows = cells.select(*TABLE_KEY, "row_idx").distinct().join(width, TABLE_KEY)
    grid = rows.withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.col("_w")))).drop("_w")
    return grid.join(cells, [*TABLE_KEY, "row_idx", "col_idx"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def squared_rows(rows: DataFrame) -> DataFrame:
    """:func:`rectangular` and :func:`drop_index_rows` where a window may hold a table: one record per row, its ``cells`` (col_idx, text) an array."""
    from pyspark.sql import Window

    whole = Window.partitionBy(*SORT_KEY)
    r = rows.dropna(subset=TABLE_KEY).withColumn("_w", F.max(F.array_max("cells.col_idx")).over(whole)).where("_w is not null")
    cell = lambda i, t: F.struct(i.alias("col_idx"), t.alias("text"))
    own = F.transform(F.filter("cells", lambda x: x["col_idx"].between(0, F.col("_w"))), lambda x: cell(x["col_idx"], F.coalesce(x["text"], F.lit(""))))
    missing = F.transform(F.array_except(F.sequence(F.lit(0), F.col("_w")), "cells.col_idx"), lambda i: cell(i, F.lit("")))
    r = r.withColumn("cells", F.concat(own, missing))
    numbers = F.forall("cells", lambda x: F.trim(x["text"]) == x["col_idx"].cast("string"))
    r = r.withColumn("_idx", F.coalesce(F.bool_and(F.when(F.col("row_idx") == 0, numbers)).over(whole), F.lit(False)))
    return r.where(~F.col("_idx") | (F.col("row_idx") != 0)).select(*TABLE_KEY, (F.col("row_idx") - F.col("_idx").cast("int")).alias("row_idx"), "cells")


def document_profile(blocks: DataFrame) -> DataFrame:
    """Tables, paragraphs, headings and sections per document, and whether it holds any table."""
    return blocks.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs"),
        F.count_if((F.col("kind") == "paragraph") & F.col("style").startswith("Heading")).alias("headings"),
        F.count_if(F.col("kind") == "section").alias("sections"),
    ).withColumn("is_valid", F.col("tables") > 0)
