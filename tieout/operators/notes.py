"""Row structure of notes: row types, segments, scopes, totals, blocks and plans.

Input frames hold one row per table row: doc_id, table_idx, row_idx, label,
has_numeric, and where a check needs amounts a ``value`` (one frame per amount
column, or with col_idx in the keys). Running state goes through :mod:`scans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.evidence import clean_sum, to_evidence
from tieout.functions.literals import contains_any
from tieout.functions.tolerance import Materiality, amounts_match
from tieout.operators.scans import Scan, one_chunk, scan
from tieout.session import checkpoint

TABLE_KEY = ["doc_id", "table_idx"]

# Wording of row kinds, English and Vietnamese.
OPENING = r"(?iU)\b(opening|số\s*dư?\s*đầu|đầu\s*(năm|kỳ)|beginning|balance\s*b/?f|beg\.?\s*bal)"
CLOSING = r"(?iU)\b(closing|số\s*dư?\s*cuối|cuối\s*(năm|kỳ)|ending|balance\s*c/?f|end\.?\s*bal)"
MOVEMENT = (
    r"(?iU)\b(increase|decrease|addition|disposal|tăng|giảm|mua\s*mới|thanh\s*lý|"
    r"depreciation|khấu\s*hao|amortization|amortisation|impairment|revaluation|transfer|"
    r"written\s*off|write[\s-]*off|reclassification|reclassified|"
    r"charge\s*for\s*the\s*(year|period)|paid|repayment|settled|"
    r"proceeds|receipts|provision|reversal|adjustment|exchange\s*difference)"
)
TOTAL_LIKE = r"(?iU)^\s*(total|subtotal|tổng|cộng|cộng\s*lại|grand\s*total)\s*$"
ACCOUNTING_SECTION = (
    r"(?iU)^\s*(cost|nguyên\s*giá|accumulated\s*depreciation|khấu\s*hao\s*lũy\s*kế|"
    r"accumulated\s*amortis[sz]ation|hao\s*mòn\s*lũy\s*kế|"
    r"net\s*book\s*value|giá\s*trị\s*còn\s*lại|carrying\s*amount|value\s*in\s*use|"
    r"provision|dự\s*phòng|fair\s*value|giá\s*trị\s*hợp\s*lý|"
    r"depreciated\s*value|giá\s*trị\s*hao\s*mòn)\s*$"
)
NUMBERED_HEADER = r"^\s*(\d+\.)\s*$"
LISTING_HEADING = (
    r"(?iU)(detailed\s+by|related\s+(parties|companies)|"
    r"borrowings?\s*(–|-|—)?\s*$|loan\s+agreement|interest\s+rate|"
    r"equity\s+investment|number\s+of\s+shares|transaction\s+value|"
    r"non-cash|equivalent\s+vnd)"
)
BASELINE_ROW = (
    r"(?iU)(accounting\s*profit|lợi\s*nhuận\s*kế\s*toán|profit\s*before\s*tax|"
    r"lợi\s*nhuận\s*trước\s*thuế|statutory\s*tax\s*rate|thuế\s*suất)"
)
SUBTOTAL_ROW = (
    r"(?iU)^\s*(subtotal|sub-total|gross|net|discount|less|cộng|tổng\s*phụ|"
    r"giảm\s*trừ|chiết\s*khấu)\b"
)
DERIVED_SEGMENT = (
    r"(?iU)(net\s*book\s*value|carrying\s*amount|gi[aá]\s*tr[iị]\s*c[oò]n\s*l[aạ]i|"
    r"nbv|depreciated\s*value)"
)
GENERIC_TOTAL = r"(?iU)^\s*(total|subtotal|cộng\s*cộng|tổng\s*cộng|cộng|tổng)\s*$"
FALLBACK_TOTAL = r"(?iU)^(tổng|total|cộng|tổng cộng|grand total)\b"
OPENING_TERMS = ["opening balance", "brought forward", "số đầu", "đầu kỳ", "beginning", "đầu năm"]
CLOSING_TERMS = ["closing balance", "carried forward", "số cuối", "cuối kỳ", "ending", "cuối năm"]
MOVEMENT_TERMS = [
    "addition", "additions", "disposal", "disposals", "depreciation", "acquisition",
    "transfer", "increase", "decrease", "phát sinh", "chuyển",
]
LESS_WORDS = [
    "less", "deduct", "deduction", "deductions", "contra revenue", "returns",
    "discounts", "allowances", "trừ", "giảm trừ",
]
STRICT_SPAN, RELAXED_SPAN = 5, 25


def row_kind(label: Column, has_numeric: Column) -> Column:
    """Kind of a note row from its label; a movement word without numbers heads a section."""
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    blank = (t == "") | (t == "nan")
    return (
        F.when(blank & has_numeric, "OTHER")
        .when(blank, "BLANK")
        .when(t.rlike(OPENING), "OPENING")
        .when(t.rlike(CLOSING), "CLOSING")
        .when(t.rlike(TOTAL_LIKE), "TOTAL_LIKE")
        .when(t.rlike(ACCOUNTING_SECTION), "SECTION_HEADER")
        .when(t.rlike(MOVEMENT) & ~has_numeric, "SECTION_HEADER")
        .when(t.rlike(MOVEMENT), "MOVEMENT")
        .when(t.rlike(NUMBERED_HEADER), "SECTION_HEADER")
        .otherwise("OTHER")
    )


def with_segments(rows: DataFrame, small: bool | None = None) -> DataFrame:
    """Add ``seg``: the number of section headers up to the row, the first row aside. ``small`` as in ``scan``."""
    header = F.when((F.col("kind") == "SECTION_HEADER") & (F.col("row_idx") > 0), 1).otherwise(0)
    return scan(rows, TABLE_KEY, "row_idx", [Scan("seg", "sum", header)], small=small)


def segments(rows: DataFrame, small: bool = False, totals: bool = False) -> DataFrame:
    """One row per segment: bounds, last opening and closing row, movements, confidence.

    ``rows`` needs kind and seg. Without movement rows, plain rows strictly between
    opening and closing stand in (confidence 0.6). Where no table is larger than a chunk (``small``), a window
    shows each row its segment's bounds and one aggregation does; otherwise rows meet them in a join. With ``totals``
    also the columns that :func:`scopes` reads (explicit, dense) and numeric, from the same aggregation.
    """
    at = lambda k, how: how(F.when(F.col("kind") == k, F.col("row_idx")))
    keys = [*TABLE_KEY, "seg"]
    facts = [
        F.min("row_idx").alias("start_row"),
        (F.max("row_idx") + 1).alias("end_row"),
        at("OPENING", F.max).alias("ob_row"),
        at("CLOSING", F.max).alias("cb_row"),
        F.sum(F.when(F.col("kind") == "MOVEMENT", 1).otherwise(0)).alias("n_keyword"),
        F.substring(F.lower(F.trim(F.min_by("label", "row_idx"))), 1, 60).alias("name"),
        *([*_total_rows(), F.bool_or("has_numeric").alias("numeric")] if totals else []),
    ]
    plain = F.col("kind") == "OTHER"
    if small:
        whole = Window.partitionBy(*keys)
        bounded = rows.withColumns({"_ob": at("OPENING", F.max).over(whole), "_cb": at("CLOSING", F.max).over(whole)})
        between = plain & (F.col("row_idx") > F.col("_ob")) & (F.col("row_idx") < F.col("_cb"))
        found = bounded.groupBy(*keys).agg(*facts, F.count_if(between).alias("n_fallback"))
    else:
        base = rows.groupBy(*keys).agg(*facts)
        fallback = (
            rows.where(plain).select(*keys, "row_idx")
            .join(base.where("ob_row is not null and cb_row is not null and n_keyword = 0").select(*keys, "ob_row", "cb_row"), keys)
            .where("row_idx > ob_row and row_idx < cb_row")
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fallback"))
        )
        found = base.join(fallback, keys, "left")
    both = F.col("ob_row").isNotNull() & F.col("cb_row").isNotNull()
    n_fb = F.coalesce("n_fallback", F.lit(0))
    return (
        found.withColumn("n_moves", F.when(F.col("n_keyword") > 0, F.col("n_keyword")).otherwise(n_fb))
        .withColumn(
            "confidence",
            F.when(both & (F.col("n_keyword") > 0), 1.0)
            .when(both & (n_fb > 0), 0.6)
            .when(both, 0.7)
            .when(F.col("ob_row").isNotNull() | F.col("cb_row").isNotNull(), 0.4)
            .otherwise(0.0),
        )
        .drop("n_fallback")
    )


def roll_forward(rows: DataFrame, table_type: str = "GENERIC_NOTE", materiality: Materiality | None = None,
                 segs: DataFrame | None = None) -> DataFrame:
    """Opening + movements = closing, per segment; rows need kind, seg and value (0 if unreadable)."""
    m = materiality or Materiality()
    segs = segments(rows) if segs is None else segs
    j = rows.select(*TABLE_KEY, "seg", "row_idx", "kind", "value").join(
        segs.select(*TABLE_KEY, "seg", "ob_row", "cb_row", "n_keyword"), [*TABLE_KEY, "seg"]
    )
    between = (F.col("row_idx") > F.col("ob_row")) & (F.col("row_idx") < F.col("cb_row"))
    moves = F.when(F.col("n_keyword") > 0, F.col("kind") == "MOVEMENT").otherwise(between & (F.col("kind") == "OTHER"))
    v = F.coalesce("value", F.lit(0.0))
    sums = j.groupBy(*TABLE_KEY, "seg").agg(
        F.max(F.when(F.col("row_idx") == F.col("ob_row"), v)).alias("_ob"),
        F.max(F.when(F.col("row_idx") == F.col("cb_row"), v)).alias("_cb"),
        F.coalesce(clean_sum(F.when(moves, v)), F.lit(0.0)).alias("_mv"),
    )
    out = segs.join(sums, [*TABLE_KEY, "seg"])
    derived = F.coalesce(F.col("name").rlike(DERIVED_SEGMENT), F.lit(False))
    weak = derived | (F.col("confidence") < 0.5)
    return to_evidence(
        out, "MOVEMENT_ROLLFORWARD", F.lit("OB + Movements == CB"),
        F.round(F.col("_ob") + F.col("_mv"), 4), F.col("_cb"),
        m.tolerance(F.greatest(F.abs("_ob"), F.abs("_cb")), table_type),
        warn=weak,
        reason=F.when(derived, "DERIVED_SEGMENT").otherwise("STRUCTURE_INCOMPLETE"),
    ).drop("_ob", "_cb", "_mv")


def movement_structure(rows: DataFrame) -> DataFrame:
    """Term-based structure of a table: last opening row, last closing row, movement count."""
    t = F.lower(F.trim("label"))
    is_ob, is_cb = contains_any(t, OPENING_TERMS), contains_any(t, CLOSING_TERMS)
    is_mv = contains_any(t, MOVEMENT_TERMS)
    at = lambda cond: F.max(F.when(cond, F.col("row_idx")))
    return rows.groupBy(*TABLE_KEY).agg(
        at(is_ob).alias("ob_row"), at(is_cb).alias("cb_row"),
        F.sum(F.when(is_mv, 1).otherwise(0)).alias("n_moves"),
        F.max_by(F.when(is_ob, F.col("value")), F.when(is_ob, F.col("row_idx"))).alias("ob_value"),
        F.max_by(F.when(is_cb, F.col("value")), F.when(is_cb, F.col("row_idx"))).alias("cb_value"),
        F.coalesce(clean_sum(F.when(is_mv, F.col("value"))), F.lit(0.0)).alias("moves"),
    ).where("ob_row is not null and cb_row is not null")


def roll_forward_by_terms(rows: DataFrame) -> DataFrame:
    """Validator form of the roll-forward, with the two-bound amount comparison."""
    s = movement_structure(rows).where("ob_value is not null and cb_value is not null")
    expected = F.round(F.col("ob_value") + F.col("moves"), 4)
    return s.select(
        *TABLE_KEY, "ob_row", "cb_row", "n_moves", expected.alias("expected"), F.col("cb_value").alias("actual"),
        amounts_match(expected, F.col("cb_value")).alias("ok"),
    )


def _total_rows() -> list[Column]:
    dense = F.col("has_numeric") & ~F.col("kind").isin("BLANK", "SECTION_HEADER", "OPENING", "CLOSING")
    return [F.min(F.when(F.col("kind") == "TOTAL_LIKE", F.col("row_idx"))).alias("explicit"), F.max(F.when(dense, F.col("row_idx"))).alias("dense")]


def scopes(rows: DataFrame, segs: DataFrame, listing: Column | None = None) -> DataFrame:
    """Total row per segment: first total-like row, else the last dense row of a plain segment."""
    listing = F.lit(False) if listing is None else listing
    j = segs
    if "explicit" not in segs.columns:
        j = segs.join(rows.groupBy(*TABLE_KEY, "seg").agg(*_total_rows()), [*TABLE_KEY, "seg"])
    allowed = (
        F.col("ob_row").isNull() & F.col("cb_row").isNull() & ~listing
        & (F.col("end_row") - F.col("start_row") >= 3) & (F.col("dense") > F.col("start_row"))
    )
    return j.withColumn(
        "total_row", F.coalesce("explicit", F.when(allowed, F.col("dense")))
    ).where("total_row is not null").select(*TABLE_KEY, "seg", "start_row", "end_row", "total_row")


def is_detail() -> Column:
    t = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    return (
        (F.col("row_idx") < F.col("total_row")) & ~F.col("kind").isin("BLANK", "TOTAL_LIKE")
        & ~t.rlike(BASELINE_ROW) & ~t.rlike(SUBTOTAL_ROW)
    )


def scoped_sums(rows: DataFrame, scope: DataFrame, table_type: str = "GENERIC_NOTE",
                materiality: Materiality | None = None) -> DataFrame:
    """Details of each scope add up to its total; a lone non-zero total is a warning."""
    m = materiality or Materiality()
    j = rows.select(*TABLE_KEY, "seg", "row_idx", "kind", "label", "value").join(scope, [*TABLE_KEY, "seg"])
    detail = is_detail()
    s = j.groupBy(*TABLE_KEY, "seg", "total_row").agg(
        F.max(F.when(F.col("row_idx") == F.col("total_row"), F.col("value"))).alias("_t"),
        F.coalesce(clean_sum(F.when(detail, F.coalesce("value", F.lit(0.0)))), F.lit(0.0)).alias("_s"),
        F.sum(F.when(detail, 1).otherwise(0)).alias("n_details"),
    ).where(F.col("_t").isNotNull() & ~((F.col("n_details") == 0) & (F.col("_t") == 0)))
    return to_evidence(
        s, "VERTICAL_SUM_SCOPED", F.lit("Sum(details) == Total"), F.col("_t"), F.col("_s"),
        m.tolerance(F.col("_t"), table_type), warn=F.col("n_details") == 0, reason=F.lit("NO_DETAIL_ROWS"),
    ).drop("_t", "_s")


def implicit_totals(rows: DataFrame, small: bool | None = None) -> DataFrame:
    """Listing blocks whose last or last-but-one numeric row equals the rows above it.

    The row must be unlabelled or say total, and at least two details must precede it. ``small`` as in ``scan``.
    """
    sep = F.when(F.col("kind").isin("BLANK", "SECTION_HEADER"), 1).otherwise(0)
    b = scan(rows, TABLE_KEY, "row_idx", [Scan("block", "sum", sep)], small=small).where(sep == 0)
    num = b.where("value is not null").select(*TABLE_KEY, "block", "row_idx", "label", "value")
    num = num if small else checkpoint(num)
    keys = [*TABLE_KEY, "block"]
    fwd = scan(num, keys, "row_idx", [Scan("above", "sum", F.col("value"), inclusive=False),
                                      Scan("n_above", "count", F.col("value"), inclusive=False)], small=small)
    both = scan(fwd, keys, "row_idx", [Scan("n_below", "count", F.col("value"), inclusive=False)], descending=True, small=small)
    t = F.trim(F.coalesce("label", F.lit("")))
    below = F.coalesce("n_below", F.lit(0))
    base = F.greatest(F.abs("above"), F.abs("value"))
    ok = F.abs(F.col("above") - F.col("value")) <= F.greatest(base * 1e-6, F.lit(1e-6))
    hit = both.where((below <= 1) & (F.col("n_above") >= 2) & ((t == "") | t.rlike(TOTAL_LIKE)) & ok)
    return hit.groupBy(*keys).agg(
        F.max("row_idx").alias("total_row"), F.max_by("n_above", "row_idx").alias("n_details")
    ).select(*TABLE_KEY, "block", "total_row", "n_details")


def generic_scopes(rows: DataFrame) -> DataFrame:
    """The last total-labelled row with everything above it as details."""
    return rows.groupBy(*TABLE_KEY).agg(
        F.max(F.when(F.trim("label").rlike(GENERIC_TOTAL), F.col("row_idx"))).alias("total_row"),
        F.count(F.lit(1)).alias("n_rows"),
    ).where("total_row > 0 and n_rows >= 2").select(*TABLE_KEY, "total_row")


def fallback_sums(rows: DataFrame, small: bool | None = None) -> DataFrame:
    """Basic vertical sums where nothing better applies: every total-labelled row against all
    rows above it; without one, the last numeric row, or the last row. Only labelled totals
    can be material; the tolerance is 1."""
    v = F.coalesce("value", F.lit(0.0))
    labelled = F.trim("label").rlike(FALLBACK_TOTAL)
    pick = rows.groupBy(*TABLE_KEY).agg(
        F.max(labelled).alias("_any"),
        F.max(F.when((v != 0) & (F.col("row_idx") > 0), F.col("row_idx"))).alias("_dense"),
        F.max("row_idx").alias("_last"),
    ).where("_last >= 1")
    run = scan(rows, TABLE_KEY, "row_idx", [Scan("_above", "sum", v, inclusive=False)], small=small)
    chosen = F.when(F.col("_any"), labelled).otherwise(F.col("row_idx") == F.coalesce("_dense", "_last"))
    j = run.join(pick, TABLE_KEY).where(chosen & (F.col("row_idx") > 0))
    strategy = F.when(F.col("_any"), "label_regex").when(F.col("_dense").isNotNull(), "last_numeric").otherwise("last_row")
    diff = F.round(F.coalesce("_above", F.lit(0.0)) - v, 4)
    material = F.col("_any") & (F.abs(diff) > 1.0)
    return j.select(
        *TABLE_KEY, F.col("row_idx").alias("total_row"), strategy.alias("strategy"), v.alias("expected"),
        F.round(F.coalesce("_above", F.lit(0.0)), 4).alias("actual"), diff.alias("diff"),
        material.alias("is_material"), F.when(material, "MINOR").otherwise("INFO").alias("severity"),
    )


# --- plans -------------------------------------------------------------------------


def movement_columns_plan(columns: DataFrame) -> DataFrame:
    """Tables with one opening and one closing column and movement columns in between."""
    h = F.lower(F.trim("header"))
    at = lambda p: F.when(h.rlike(p), F.col("col_idx"))
    plan = columns.groupBy(*TABLE_KEY).agg(
        F.count(at(OPENING)).alias("n_ob"), F.count(at(CLOSING)).alias("n_cb"),
        F.max(at(OPENING)).alias("ob_col"), F.max(at(CLOSING)).alias("cb_col"),
        F.collect_list(at(MOVEMENT)).alias("moves"),  # one entry per column: bounded by the table's width
    ).where("n_ob = 1 and n_cb = 1 and ob_col < cb_col")
    between = F.filter("moves", lambda c: (c > F.col("ob_col")) & (c < F.col("cb_col")))
    return plan.withColumn("move_cols", F.sort_array(between)).where(F.size("move_cols") > 0).select(
        *TABLE_KEY, "ob_col", "cb_col", "move_cols"
    )


def movement_by_columns(amounts: DataFrame, plan: DataFrame, table_type: str = "GENERIC_NOTE",
                        materiality: Materiality | None = None) -> DataFrame:
    """First row per table where opening + movements differs from closing; rows with gaps are skipped."""
    m = materiality or Materiality()
    j = amounts.join(plan, TABLE_KEY)
    move = F.array_contains("move_cols", F.col("col_idx"))
    r = j.groupBy(*TABLE_KEY, "row_idx").agg(
        F.max(F.when(F.col("col_idx") == F.col("ob_col"), F.col("value"))).alias("ob"),
        F.max(F.when(F.col("col_idx") == F.col("cb_col"), F.col("value"))).alias("cb"),
        clean_sum(F.when(move, F.col("value"))).alias("mv"),
        F.count(F.when(move, F.col("value"))).alias("n"),
        F.first(F.size("move_cols")).alias("want"),
    ).where("ob is not null and cb is not null and n = want")
    expected = F.round(F.col("ob") + F.col("mv"), 4)
    tol = m.tolerance(F.greatest(F.abs("ob"), F.abs("cb")), table_type)
    bad = r.where(F.abs(F.round(expected - F.col("cb"), 4)) > tol)
    return bad.groupBy(*TABLE_KEY).agg(
        F.min("row_idx").alias("row_idx"), F.min_by(expected, "row_idx").alias("expected"), F.min_by("cb", "row_idx").alias("actual"), F.min_by(tol, "row_idx").alias("tolerance")
    )


def netting_plan(rows: DataFrame) -> DataFrame:
    """The first (total, less, net) row triple within 5 rows, else within 25.

    Rows meet only inside neighbouring 25-row buckets. A bucket's rows (75 at most) are held in arrays;
    of a (total, less) pair only the first net row inside each span is kept, and a bucket leaves
    one triple, so no rows are multiplied.
    """
    t = F.lower(F.trim("label"))
    less = contains_any(t, LESS_WORDS)
    net = t.contains("net") & ~t.contains("book value")
    total = t.contains("total") | t.contains("gross")
    role = F.when(total & ~less & ~net, "total").when(less, "less").when(net, "net")
    r = rows.select(*TABLE_KEY, "row_idx", "value", role.alias("role")).where("role is not null")
    whole = r.groupBy(*TABLE_KEY).agg(*[F.bool_or(F.col("role") == x).alias(f"_{x}") for x in ("total", "less", "net")]).where("_total AND _less AND _net")
    r = r.join(whole.select(*TABLE_KEY), TABLE_KEY, "left_semi")  # other tables hold no triple
    bucket = F.floor(F.col("row_idx") / RELAXED_SPAN)
    near = r.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumn("_own", F.col("_b") == bucket)
    held = lambda name, own: F.sort_array(F.collect_list(F.when((F.col("role") == name) & own, F.struct(F.col("row_idx").alias("r"), F.col("value").alias("v"))))).alias(name)
    boxes = near.groupBy(*TABLE_KEY, "_b").agg(held("total", F.col("_own")), held("less", F.lit(True)), held("net", F.lit(True)))
    span = "greatest(t.r, l.r, n.r) - least(t.r, l.r, n.r)"
    first = lambda most: f"array_min(filter(net, n -> {span} <= {most}))"
    triple = "struct(NOT strict AS relaxed, t.r AS t, l.r AS l, n.r AS n, t.v AS tv, l.v AS lv, n.v AS nv)"
    both = ", ".join(f"transform(array({first(most)}), n -> {triple.replace('NOT strict', flag)})[0]" for most, flag in ((STRICT_SPAN, "false"), (RELAXED_SPAN, "true")))
    best = f"array_min(flatten(transform(total, t -> flatten(transform(filter(less, l -> abs(t.r - l.r) <= {RELAXED_SPAN}), l -> filter(array({both}), p -> p.n IS NOT NULL))))))"
    return (
        boxes.withColumn("p", F.expr(best)).where("p IS NOT NULL")
        .groupBy(*TABLE_KEY)
        .agg(F.min("p").alias("p"))
        .select(
            *TABLE_KEY, F.col("p.t").alias("total_row"), F.col("p.l").alias("less_row"), F.col("p.n").alias("net_row"),
            F.when(F.col("p.relaxed"), RELAXED_SPAN).otherwise(STRICT_SPAN).alias("max_dist"),
            F.col("p.tv").alias("total_value"), F.col("p.lv").alias("less_value"), F.col("p.nv").alias("net_value"),
        )
    )


def netting_check(plan: DataFrame, table_type: str = "GENERIC_NOTE", materiality: Materiality | None = None) -> DataFrame:
    """Net = total − less, or total + less where less is already negative."""
    m = materiality or Materiality()
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    expected = F.round(
        F.when(z("less_value") < 0, z("total_value") + z("less_value")).otherwise(z("total_value") - z("less_value")), 4
    )
    return to_evidence(
        plan.withColumn("_e", expected), "NETTING_BLOCKS", F.lit("Net = Total - Less"), F.col("_e"), z("net_value"),
        m.tolerance(F.col("_e"), table_type),
    ).drop("_e", "total_value", "less_value", "net_value")


def first_failure_only(evidence: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per table, keep evidence up to and including its first material row."""
    first = evidence.where("is_material").groupBy(*keys).agg(F.min(order).alias("_first"))
    return evidence.join(first, keys, "left").where(
        F.col("_first").isNull() | (F.col(order) <= F.col("_first"))
    ).drop("_first")


def netting_acceptance(plan: DataFrame) -> DataFrame:
    """Validator form: a positive deduction needs an allowance wording (``anchored``), two columns must
    hold (or the single one); accepted tables skip the grand-total check."""
    ok_sign = (F.col("less_value") < 0) | F.col("anchored")
    expected = F.when(F.col("less_value") < 0, F.col("total_value") + F.col("less_value")).otherwise(
        F.col("total_value") - F.col("less_value")
    )
    used = ok_sign & F.col("total_value").isNotNull() & F.col("net_value").isNotNull()
    hold = used & amounts_match(expected, F.col("net_value"))
    return plan.groupBy(*TABLE_KEY).agg(
        F.sum(F.when(used, 1).otherwise(0)).alias("n_cols"), F.sum(F.when(hold, 1).otherwise(0)).alias("n_ok")
    ).withColumn("accepted", (F.col("n_ok") >= 2) | ((F.col("n_cols") == 1) & (F.col("n_ok") == 1)))


# --- blocks ------------------------------------------------------------------------


WALK_CHUNK = 512
#: Where a walk stands when it reaches a blank row: on that row, in front of it with the blank as the next block's first
#: row, or behind a block that the blank has closed. Per state the next one, for 0, 1, 2, 3 or more rows behind the blank.
ON_BLANK, BEFORE_BLANK, BEHIND_BLOCK = 0, 1, 2
WALK = {ON_BLANK: [1, 1, 2, 2], BEFORE_BLANK: [1, 2, 2, 2], BEHIND_BLOCK: [0, 1, 1, 2]}


def _blank_groups(rows: DataFrame, small: bool | None = None) -> DataFrame:
    """Every blank row with the rows behind it; run 0 holds the rows before the first blank.

    Columns: n (rows behind), total, first_row, first_value, last_value, last_row, blank_row.
    """
    blank = (F.trim(F.coalesce("label", F.lit(""))) == "") & F.col("value").isNull()
    slim = rows.select(*TABLE_KEY, "row_idx", "value", blank.alias("_blank"))
    r = scan(slim, TABLE_KEY, "row_idx", [Scan("run", "sum", F.when(F.col("_blank"), 1).otherwise(0))], small=small)
    filled = F.when(~F.col("_blank"), F.col("row_idx"))
    return r.groupBy(*TABLE_KEY, "run").agg(
        F.count(filled).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min(filled).alias("first_row"),
        F.min_by("value", filled).alias("first_value"), F.max_by("value", filled).alias("last_value"),
        F.max(filled).alias("last_row"), F.min(F.when(F.col("_blank"), F.col("row_idx"))).alias("blank_row"),
    )


def _entered(chunks: DataFrame, begin: str) -> DataFrame:
    """The state in which the walk enters each chunk: maps of chunks are composed per span of WALK_CHUNK chunks,
    spans are chained per table, then the chunks of each span."""
    pair = lambda name: F.sort_array(F.collect_list(F.struct(name, "through")))
    spans = chunks.withColumn("span", F.expr(f"chunk div {WALK_CHUNK}")).groupBy(*TABLE_KEY, "span").agg(
        pair("chunk").alias("inner"), F.min_by("first_run", "chunk").alias("first_run")
    ).withColumn("through", F.expr("aggregate(inner, array(0, 1, 2), (m, x) -> transform(m, s -> element_at(x.through, s + 1)))"))
    chain = lambda items, start: (
        f"aggregate({items}, array({start}), (e, x) -> concat(e, array(element_at(x.through, element_at(e, -1) + 1))))"
    )
    tables = spans.groupBy(*TABLE_KEY).agg(pair("span").alias("outer"), F.min("first_run").alias("first_run"))
    tops = tables.select(*TABLE_KEY, F.expr(f"arrays_zip(transform(outer, x -> x.span), slice({chain('outer', begin)}, 1, size(outer)))").alias("z"))
    tops = tops.select(*TABLE_KEY, F.inline("z").alias("span", "start"))
    inside = spans.join(tops, [*TABLE_KEY, "span"]).select(
        *TABLE_KEY, F.expr(f"arrays_zip(transform(inner, x -> x.chunk), slice({chain('inner', 'start')}, 1, size(inner)))").alias("z")
    )
    return inside.select(*TABLE_KEY, F.inline("z").alias("chunk", "enter"))


def short_walks(rows: DataFrame) -> bool:
    """Whether no table has WALK_CHUNK rows, so that every walk is one chunk. One job over the positions alone."""
    return one_chunk(rows, "row_idx", WALK_CHUNK - 1)


def block_walk(rows: DataFrame, on_first: bool = False, edges: bool = False, small: bool | None = None, short: bool = False) -> DataFrame:
    """All blocks that a walk from blank row to blank row visits, above the table's last row.

    A blank closes a block that has a row; the row behind it is the block's sub-total and the next
    block begins behind that. A block of one row (a blank row may be that row) is not compared, and the
    next block begins with the blank that closed it. The walk has three states and its steps depend on
    row counts only, so chunks of blanks are composed as maps of states, chunk maps are chained per
    table, and every chunk is then walked from its own entry state. The walk begins in front of the first
    row, or on it (a blank row) with ``on_first``.

    Columns: block, n_details, n_counted (a leading blank included), sum_details, compared, subtotal_row,
    subtotal (NULL where that row is blank), ok; with ``edges`` also start_row (where the walk stands), end_row
    (the blank or last row that closes the block) and the rows from_row to to_row of its details. ``small`` as in ``scan``;
    ``short`` says that no table has as many rows as a chunk of the walk has blanks (:func:`short_walks`).
    """
    groups = _blank_groups(rows, small or short or None).withColumn("chunk", F.expr(f"run div {WALK_CHUNK}"))
    item = F.struct("run", "n", "total", "first_row", "first_value", "last_value", "last_row", "blank_row")
    chunks = groups.groupBy(*TABLE_KEY, "chunk").agg(F.sort_array(F.collect_list(item)).alias("items"))
    if not short:  # read three times below, and small: one row per WALK_CHUNK blank rows
        chunks = checkpoint(chunks)
    table = "array(" + ", ".join("array(" + ", ".join(map(str, WALK[k])) + ")" for k in range(3)) + ")"
    step = f"element_at(element_at({table}, s + 1), cast(least(x.n, 3) AS int) + 1)"
    chunks = chunks.withColumn("through", F.expr(f"aggregate(items, array(0, 1, 2), (m, x) -> transform(m, s -> {step}))"))
    # in front of the first row the walk stands on a blank if rows come first, else before the blank
    begin = str(ON_BLANK) if on_first else f"IF(first_run = 0, {ON_BLANK}, {BEFORE_BLANK})"
    if short or one_chunk(chunks, "chunk", 1):  # every walk ends in its first chunk: nothing to chain, nothing behind
        entered = chunks.withColumn("first_run", F.expr("items[0].run")).withColumn("enter", F.expr(begin)).withColumn("behind", F.expr("get(items, -1)"))
    else:
        states = _entered(chunks.select(*TABLE_KEY, "chunk", "through", F.expr("items[0].run").alias("first_run")), begin)
        behind = chunks.select(*TABLE_KEY, (F.col("chunk") - 1).alias("chunk"), F.expr("items[0]").alias("behind"))
        entered = chunks.join(states, [*TABLE_KEY, "chunk"]).join(behind, [*TABLE_KEY, "chunk"], "left")
    walked = entered.withColumn(
        "states", F.expr(f"aggregate(items, array(enter), (e, x) -> concat(e, transform(array(element_at(e, -1)), s -> {step})))")
    )
    each = walked.select(*TABLE_KEY, F.posexplode("items").alias("pos", "g"), "states", "items", "behind").select(
        *TABLE_KEY, "g.*", F.expr("states[pos]").alias("state"), F.expr("coalesce(get(items, pos + 1), behind)").alias("nxt"),
        F.expr("pos + 1 = size(items) AND behind IS NULL").alias("last"),
    )
    cut = F.when(F.col("last") & (F.col("n") > 0), 1).otherwise(0)  # the table's last row closes no block
    led = ((F.col("state") == BEHIND_BLOCK) & (F.col("n") >= 1)).cast("int")
    details = F.greatest(F.col("n") - cut - led, F.lit(0))
    zero = F.lit(0.0)
    without = F.when(cut == 1, F.coalesce("last_value", zero)).otherwise(0.0) + F.when(led == 1, F.coalesce("first_value", zero)).otherwise(0.0)
    counted = details + (F.col("state") == BEFORE_BLANK).cast("int")
    compared = (counted >= 2) & ~F.col("last")
    start = F.col("blank_row") + F.when(F.col("state") == ON_BLANK, 0).when(F.col("state") == BEFORE_BLANK, -1).otherwise(1)
    bounds = [
        F.coalesce(start, F.col("first_row") - 1).alias("start_row"), F.when(F.col("last"), F.coalesce("last_row", "blank_row")).otherwise(F.col("nxt.blank_row")).alias("end_row"),
        F.when(details > 0, F.col("first_row") + led).alias("from_row"), F.when(details > 0, F.col("last_row") - cut).alias("to_row"),
    ]
    out = each.select(
        *TABLE_KEY, F.col("run").alias("block"), details.alias("n_details"), counted.alias("n_counted"),
        F.when(details == 0, 0.0).otherwise(F.round(F.coalesce("total", zero) - without, 4)).alias("sum_details"),
        compared.alias("compared"), F.when(compared, F.col("nxt.first_row")).alias("subtotal_row"), F.when(compared, F.col("nxt.first_value")).alias("subtotal"),
        (F.col("last") & (F.col("n") == 0)).alias("_end"), *(bounds if edges else []),
    )
    ok = F.abs(F.round(F.col("sum_details") - F.col("subtotal"), 4)) <= 0.5
    return out.where((F.col("n_counted") >= 1) & ~F.col("_end")).drop("_end").withColumn("ok", ok)


def block_sums(rows: DataFrame) -> DataFrame:
    """Blocks of the walk against the sub-total row that follows each block."""
    return block_walk(rows, short=short_walks(rows)).where("compared AND subtotal IS NOT NULL").select(*TABLE_KEY, "block", "n_details", "sum_details", "subtotal_row", "subtotal", "ok")


def _last_value(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*TABLE_KEY).agg(F.max_by("value", "row_idx").alias("actual"))


def grand_total(walk: DataFrame, rows: DataFrame) -> DataFrame:
    """Σ of all blocks of a walk against the table's last row, where the walk has more than one block."""
    s = walk.groupBy(*TABLE_KEY).agg(F.round(F.sum("sum_details"), 4).alias("expected"), F.count(F.lit(1)).alias("n_blocks"))
    return s.where("n_blocks > 1").join(_last_value(rows), TABLE_KEY).withColumn(
        "ok", F.abs(F.round(F.col("expected") - F.col("actual"), 4)) <= 0.5
    )


def total_row_after_blank(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Last numeric row whose previous row is empty; without one none, or the last numeric row."""
    empty = (F.regexp_replace(F.coalesce("label", F.lit("")), r"[-–—(),\s]", "") == "") & F.col("value").isNull()
    r = scan(rows.withColumn("_e", empty), TABLE_KEY, "row_idx", [Scan("_prev", "lag", F.col("_e"))])
    hit = F.col("value").isNotNull() & F.coalesce("_prev", F.lit(True))
    found = r.groupBy(*TABLE_KEY).agg(
        F.max(F.when(hit, F.col("row_idx"))).alias("by_blank"),
        F.max(F.when(F.col("value").isNotNull(), F.col("row_idx"))).alias("last_numeric"),
    )
    total = F.col("by_blank") if strict else F.coalesce("by_blank", "last_numeric")
    return found.withColumn("total_row", total).where("total_row is not null").select(*TABLE_KEY, "total_row", "last_numeric")


def total_row_ranked(rows: DataFrame) -> DataFrame:
    """Total row by rank: a total-labelled numeric row, else an unlabelled numeric row after a blank.

    A labelled row in the top half with more than three numeric rows below it is not trusted.
    """
    r = scan(rows, TABLE_KEY, "row_idx", [Scan("_below", "count", F.col("value"), inclusive=False)], descending=True)
    size = rows.groupBy(*TABLE_KEY).agg((F.max("row_idx") + 1).alias("_n"))
    j = r.join(size, TABLE_KEY)
    below = F.coalesce("_below", F.lit(0))
    top_half = F.col("row_idx") < F.floor(F.col("_n") / 2)
    labelled = F.lower("label").rlike("total|tổng|cộng") & F.col("value").isNotNull() & ~(top_half & (below > 3))
    unlabelled = (F.trim(F.coalesce("label", F.lit(""))) == "") & F.col("value").isNotNull() & (below == 0)
    return j.groupBy(*TABLE_KEY).agg(
        F.coalesce(F.max(F.when(labelled, F.col("row_idx"))), F.max(F.when(unlabelled, F.col("row_idx")))).alias("total_row"),
        F.when(F.max(labelled), "keyword").when(F.max(unlabelled), "blank_label").otherwise("none").alias("source"),
    )


def total_scope_priority(structure: DataFrame, by_blank: DataFrame, tables: DataFrame) -> DataFrame:
    """Note structure's total row, else the blank-row one, else the tax special case, else none."""
    j = (
        tables.join(structure.select(*TABLE_KEY, F.col("total_row").alias("_s")), TABLE_KEY, "left")
        .join(by_blank.select(*TABLE_KEY, F.col("total_row").alias("_b")), TABLE_KEY, "left")
    )
    tax = (
        (F.col("table_type") == "TAX_NOTE") & F.col("heading").contains("reconciliation of effective tax rate")
        & (F.col("n_rows") >= 3)
    )
    return j.select(
        *TABLE_KEY,
        F.coalesce("_s", "_b", F.when(tax, F.col("n_rows") - 1)).cast("int").alias("total_row"),
        F.when(F.col("_s").isNotNull(), "note_structure_scope_0")
        .when(F.col("_b").isNotNull(), "legacy_blank_row_before_total")
        .when(tax, "legacy_tax_reconciliation_fallback")
        .otherwise("legacy_no_total_detected").alias("source"),
    )


# --- anchors and columns -----------------------------------------------------------


def anchor_roll_forward(rows: DataFrame, rel_tol: float = 0.012) -> DataFrame:
    """Between consecutive anchor rows ("balance at"), start + movements = end.

    ``rows`` needs is_anchor and value; rows labelled total or balance do not move.
    """
    r = scan(rows, TABLE_KEY, "row_idx", [Scan("block", "sum", F.when(F.col("is_anchor"), 1).otherwise(0))])
    t = F.lower(F.coalesce("label", F.lit("")))
    skip = contains_any(t, ["total", "subtotal", "balance at", "opening balance", "closing balance"])
    move = ~F.col("is_anchor") & ~skip
    b = r.where("block > 0").groupBy(*TABLE_KEY, "block").agg(
        F.max_by(F.when(F.col("is_anchor"), F.struct("row_idx", "value")), F.when(F.col("is_anchor"), F.col("row_idx"))).alias("a"),
        F.coalesce(clean_sum(F.when(move, F.col("value"))), F.lit(0.0)).alias("mv"),
    )
    nxt = scan(checkpoint(b), TABLE_KEY, "block", [Scan("end", "lag", F.col("a"))], descending=True, chunk_rows=4096)
    expected = F.round(F.coalesce("a.value", F.lit(0.0)) + F.col("mv"), 4)
    return nxt.where("end is not null and end.value is not null").select(
        *TABLE_KEY, "block", F.col("end.row_idx").alias("row_idx"), expected.alias("expected"), F.col("end.value").alias("actual"),
        amounts_match(expected, F.col("end.value"), 0.01, rel_tol).alias("ok"),
    )


def total_column(amounts: DataFrame, abs_ok: float = 0.5) -> DataFrame:
    """Last column = Σ of the columns left of it, per row with at least two other amounts."""
    width = amounts.groupBy(*TABLE_KEY).agg(F.max("col_idx").alias("_last"))
    j = amounts.join(width, TABLE_KEY)
    other = F.col("col_idx") < F.col("_last")
    r = j.groupBy(*TABLE_KEY, "row_idx").agg(
        clean_sum(F.when(other, F.col("value"))).alias("expected"),
        F.max(F.when(~other, F.col("value"))).alias("actual"),
        F.count(F.when(other, F.col("value"))).alias("n"),
    ).where("actual is not null and n >= 2")
    return r.withColumn("ok", F.abs(F.round(F.col("expected") - F.col("actual"), 4)) <= abs_ok).drop("n")


def infer_total_column(amounts: DataFrame) -> DataFrame:
    """The column that equals the sum of the others on most rows (at least two).

    Siblings are summed per row by an aggregation and joined back, so no window holds a table.
    """
    sums = amounts.groupBy(*TABLE_KEY, "row_idx").agg(
        F.sum("value").alias("_s"), F.count("value").alias("_n")
    )
    j = amounts.where("value is not null").join(sums, [*TABLE_KEY, "row_idx"])
    hit = (F.col("_n") >= 3) & amounts_match(F.col("_s") - F.col("value"), F.col("value"))
    c = j.groupBy(*TABLE_KEY, "col_idx").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("matches"))
    return c.groupBy(*TABLE_KEY).agg(
        F.max_by(F.struct("col_idx", "matches"), F.struct("matches", -F.col("col_idx"))).alias("b")
    ).where("b.matches >= 2").select(*TABLE_KEY, "b.col_idx", "b.matches")


def text_formula_percent(rows: DataFrame) -> DataFrame:
    """A row labelled ``x 20%`` equals that share of the row above; years are ignored."""
    r = scan(rows, TABLE_KEY, "row_idx", [Scan("_prev", "lag", F.col("value"))])
    pct = F.regexp_extract("label", r"(?i)[x*]\s*(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")
    year = lambda c: F.col(c).between(1900, 2100) & (F.floor(c) == F.col(c))
    expected = F.round(F.col("_prev") * F.col("_pct") / 100, 6)
    return r.withColumn("_pct", pct).where(
        F.col("_pct").isNotNull() & F.col("value").isNotNull() & F.col("_prev").isNotNull() & ~year("value") & ~year("_prev")
    ).select(
        *TABLE_KEY, "row_idx", expected.alias("expected"), F.col("value").alias("actual"),
        amounts_match(expected, F.col("value")).alias("ok"),
    )


def text_formula_equation(rows: DataFrame) -> DataFrame:
    """A label ``30 = 20 + 21`` ties the rows carrying those codes (last row per code)."""
    pattern = r"\(?(\d{1,3})\)?\s*=\s*\(?(\d{1,3})\)?\s*([+\-])\s*\(?(\d{1,3})\)?"
    g = lambda i: F.regexp_extract("label", pattern, i)
    codes = rows.withColumn("c", F.regexp_replace("code", r"[^\d]", "")).where("c <> ''").groupBy(*TABLE_KEY, "c").agg(
        F.max("row_idx").alias("_r"), F.max_by("value", "row_idx").alias("_x")
    ).select(*TABLE_KEY, "c", F.struct(F.col("_r").alias("row_idx"), F.col("_x").alias("value")).alias("v"))
    eq = rows.where(F.col("label").rlike(pattern)).select(
        *TABLE_KEY, F.col("row_idx").alias("at"), g(1).alias("k0"), g(2).alias("k1"), g(3).alias("op"), g(4).alias("k2")
    )
    for i in range(3):
        side = codes.select(*TABLE_KEY, F.col("c").alias(f"k{i}"), F.col("v").alias(f"v{i}"))
        eq = eq.join(side, [*TABLE_KEY, f"k{i}"])
    expected = F.round(F.when(F.col("op") == "+", F.col("v1.value") + F.col("v2.value")).otherwise(F.col("v1.value") - F.col("v2.value")), 4)
    return eq.where("v0.value is not null and v1.value is not null and v2.value is not null").select(
        *TABLE_KEY, F.col("at").alias("label_row"), F.col("v0.row_idx").alias("row_idx"), expected.alias("expected"),
        F.col("v0.value").alias("actual"), amounts_match(expected, F.col("v0.value")).alias("ok"),
    )


def tax_reconciliation(rows: DataFrame, rates: DataFrame | None = None, default_rate: float = 0.25) -> DataFrame:
    """Three steps: tax row = rate × profit; rows from it to the blank = next row; the rest = last row.

    The rate is the one implied by the two rows when it lies in [0, 1], else the configured one.
    Marker rows are found by aggregation and joined back, never by walking a table.
    """
    t = F.lower(F.coalesce("label", F.lit("")))
    blank = (F.trim(t) == "") & F.col("value").isNull()
    # Wording of the two anchor rows.
    profit = t.contains("accounting profit before tax") | t.contains("accounting profit/(loss) before tax") | t.contains("accounting loss before tax")
    tax = t.rlike("tax at the (company|group)[’'`]s tax rate")
    m0 = rows.groupBy(*TABLE_KEY).agg(
        F.min(F.when(profit, F.col("row_idx"))).alias("p_row"), F.max("row_idx").alias("last_row")
    ).where("p_row is not null")
    m1 = rows.join(m0, TABLE_KEY).where(tax & (F.col("row_idx") > F.col("p_row"))).groupBy(*TABLE_KEY).agg(
        F.first("p_row").alias("p_row"), F.first("last_row").alias("last_row"), F.min("row_idx").alias("t_row")
    )
    m2 = rows.join(m1, TABLE_KEY).groupBy(*TABLE_KEY, "p_row", "t_row", "last_row").agg(
        F.coalesce(F.min(F.when(blank & (F.col("row_idx") > F.col("t_row")), F.col("row_idx"))), F.max("row_idx") + 1).alias("b_row")
    )
    j = rows.join(m2, TABLE_KEY)
    r, v = F.col("row_idx"), F.col("value")
    s = j.groupBy(*TABLE_KEY, "last_row").agg(
        F.max(F.when(r == F.col("p_row"), v)).alias("p"), F.max(F.when(r == F.col("t_row"), v)).alias("t"),
        F.coalesce(clean_sum(F.when((r >= F.col("t_row")) & (r < F.col("b_row")), v)), F.lit(0.0)).alias("s1"),
        F.max(F.when(r == F.col("b_row") + 1, v)).alias("total1"),
        F.coalesce(clean_sum(F.when((r >= F.col("b_row") + 2) & (r < F.col("last_row")), v)), F.lit(0.0)).alias("more"),
        F.max(F.when(r == F.col("last_row"), v)).alias("last_value"), F.max("b_row").alias("b_row"),
    )
    if rates is not None:
        s = s.join(rates.select("doc_id", "rate"), "doc_id", "left")
    else:
        s = s.withColumn("rate", F.lit(None).cast("double"))
    implied = F.abs(F.col("t") / F.when(F.col("p") != 0, F.col("p")))
    rate = F.coalesce(F.when(implied <= 1, implied), F.col("rate"), F.lit(default_rate))
    steps = s.withColumn("_rate", rate).select(
        *TABLE_KEY, "last_row", "b_row",
        F.round(F.col("p") * F.col("_rate"), 4).alias("e1"), F.col("t").alias("a1"),
        F.col("s1").alias("e2"), F.col("total1").alias("a2"),
        F.round(F.col("s1") + F.col("more"), 4).alias("e3"), F.col("last_value").alias("a3"),
    )
    long = steps.select(*TABLE_KEY, "last_row", "b_row", F.expr("stack(3, 1, e1, a1, 2, e2, a2, 3, e3, a3) as (step, expected, actual)"))
    keep = (F.col("step") == 1) | (F.col("b_row") < F.col("last_row"))
    return long.where(keep & F.col("actual").isNotNull() & F.col("expected").isNotNull()).select(
        *TABLE_KEY, "step", "expected", "actual", (F.abs(F.round(F.col("expected") - F.col("actual"), 4)) <= 0.5).alias("ok")
    )


def anchor_slices(rows: DataFrame, rel_tol: float = 0.012) -> DataFrame:
    """Σ of the rows from one balance row up to the next equals that next balance row, for the second
    and third balance rows of a table."""
    before = scan(rows, TABLE_KEY, "row_idx", [Scan("_k", "sum", F.when(F.col("is_anchor"), 1).otherwise(0))])
    body = before.where(F.col("_k").isin(1, 2)).groupBy(*TABLE_KEY, F.col("_k").alias("slice")).agg(
        clean_sum(F.col("value")).alias("expected")
    )
    ends = before.where(F.col("is_anchor") & F.col("_k").isin(2, 3)).select(
        *TABLE_KEY, (F.col("_k") - 1).alias("slice"), F.col("value").alias("actual")
    )
    return body.join(ends, [*TABLE_KEY, "slice"]).withColumn(
        "ok", amounts_match(F.col("expected"), F.col("actual"), 0.01, rel_tol)
    )


def two_block_total(rows: DataFrame) -> DataFrame:
    """The first two blocks together against the table's last row (other tax tables).

    A first block of one row leaves the second empty; otherwise the second begins behind the row that
    follows the first block, whatever that row is.
    """
    g = _blank_groups(rows)
    at = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c)))
    few = g.where("run <= 2").groupBy(*TABLE_KEY).agg(
        F.coalesce(at(0, "n"), F.lit(0)).alias("n0"), F.coalesce(at(0, "total"), F.lit(0.0)).alias("t0"), F.coalesce(at(1, "n"), F.lit(0)).alias("n1"),
        F.coalesce(at(1, "total"), F.lit(0.0)).alias("t1"), F.coalesce(at(1, "first_value"), F.lit(0.0)).alias("f1"), F.coalesce(at(2, "total"), F.lit(0.0)).alias("t2"),
    )
    second = F.when(F.col("n0") == 1, 0.0).when(F.col("n1") == 0, F.col("t2")).when(F.col("n1") == 1, 0.0).otherwise(F.col("t1") - F.col("f1"))
    ends = rows.groupBy(*TABLE_KEY).agg(F.min("row_idx").alias("_first"), F.max("row_idx").alias("_last"), F.max_by("value", "row_idx").alias("actual"))
    two = few.join(ends, TABLE_KEY).where(F.col("_last") > F.col("_first") + F.col("n0") + 1)
    return two.select(*TABLE_KEY, F.round(F.col("t0") + second, 4).alias("expected"), "actual").withColumn("ok", F.abs(F.round(F.col("expected") - F.col("actual"), 4)) <= 0.5)


def rescue_sums(rows: DataFrame, totals: DataFrame, marked: DataFrame) -> DataFrame:
    """Tables no check has marked: every amount column's rows above the total, years aside, must
    match the total."""
    cols = ["col_idx"] if "col_idx" in rows.columns else []
    v = F.col("value")
    year = v.between(1900, 2100) & (F.floor(v) == v)
    j = rows.join(totals, TABLE_KEY).join(marked.select(*TABLE_KEY).distinct(), TABLE_KEY, "left_anti")
    s = j.groupBy(*TABLE_KEY, *cols).agg(
        clean_sum(F.when((F.col("row_idx") < F.col("total_row")) & ~year, v)).alias("_s"),
        F.max(F.when(F.col("row_idx") == F.col("total_row"), v)).alias("_t"),
    ).where("_s is not null and _t is not null")
    return s.groupBy(*TABLE_KEY).agg(F.bool_and(amounts_match(F.col("_s"), F.col("_t"))).alias("ok"))


def signed_grand_total(walk: DataFrame, rows: DataFrame, headings: DataFrame) -> DataFrame:
    """Grand totals that follow the heading.

    Revenue and deferred-tax notes subtract their second block if it has a sub-total row whose filled
    cells are all positive (deductions shown without a sign). Deferred tax ends with its second block
    and compares with the row behind that block's sub-total. Convertible bonds, preference shares and
    long-term provisions leave the last block out. ``headings``: doc_id, table_idx, heading.
    """
    h = F.lower("heading")
    kinds = headings.select(
        *TABLE_KEY, h.contains("recognised deferred tax").alias("_deferred"), (h.contains("revenue from") | h.contains("recognised deferred tax")).alias("_signed"),
        (h.contains("convertible bonds") | h.contains("preference shares") | h.contains("long-term provisions")).alias("_less_last"),
    )
    w = checkpoint(walk.select(*TABLE_KEY, "block", "compared", "sum_details", "subtotal_row", "subtotal"))  # read three times
    first = w.groupBy(*TABLE_KEY).agg(F.min("block").alias("_first"), F.max("block").alias("_last"), F.count(F.lit(1)).alias("n_blocks")).where("n_blocks > 1")
    second = w.join(first, TABLE_KEY).where("block > _first").groupBy(*TABLE_KEY).agg(F.min("block").alias("_second"))
    # frames that no hot table reaches: one row per table
    bounds = first.join(second, TABLE_KEY).join(kinds, TABLE_KEY, "left")
    j = w.join(bounds, TABLE_KEY).withColumn("_is", F.col("block") == F.col("_second"))
    flip = F.coalesce("_signed", F.lit(False)) & F.col("_is") & F.col("compared") & F.coalesce(F.col("subtotal") > 0, F.lit(True))
    out = (F.coalesce("_deferred", F.lit(False)) & (F.col("block") > F.col("_second"))) | (F.coalesce("_less_last", F.lit(False)) & (F.col("block") == F.col("_last")))
    part = F.when(out, 0.0).when(flip, -F.col("sum_details")).otherwise(F.col("sum_details"))
    s = j.groupBy(*TABLE_KEY).agg(
        F.round(F.sum(part), 4).alias("expected"), F.max("n_blocks").alias("n_blocks"),
        F.max(F.when(F.col("_is") & F.coalesce("_deferred", F.lit(False)), F.col("subtotal_row") + 1)).alias("_row"),
    )
    last = rows.groupBy(*TABLE_KEY).agg(F.max("row_idx").alias("_end"))
    place = s.join(last, TABLE_KEY).select(*TABLE_KEY, "expected", "n_blocks", F.coalesce("_row", "_end").alias("row_idx"))
    return place.join(rows.select(*TABLE_KEY, "row_idx", F.coalesce("value", F.lit(0.0)).alias("actual")), [*TABLE_KEY, "row_idx"]).select(
        *TABLE_KEY, "expected", "n_blocks", "actual", (F.abs(F.round(F.col("expected") - F.col("actual"), 4)) <= 0.5).alias("ok")
    )
