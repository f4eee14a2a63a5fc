"""Scalar-layer queries (amount, code, label, period, formula and box functions)."""

from pyspark.sql import functions as F

from tieout.functions import amounts as A
from tieout.functions import text as X
from tieout.plans import views as V
from tieout.queries import oracle_views as O
from tieout.queries.registry import query

_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _priced(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return li.withColumn("txt", V.locale_text(F.col("l_extendedprice"), F.col("l_partkey") % 8))


@query(
    "amount_parse_simple",
    f"""SELECT {_KEYS}, CASE l_partkey % 8 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice
        WHEN 3 THEN -l_extendedprice
        WHEN 2 THEN TRY_CAST(CASE WHEN l_extendedprice < 1000 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', '') ELSE
             replace(translate(format('{{:,.2f}}', l_extendedprice), ',.', '.,'), ',', '') END AS DOUBLE)
        WHEN 6 THEN CASE WHEN l_extendedprice < 1000 THEN floor(l_extendedprice) END
        END AS amount FROM lineitem""",
)
def amount_parse_simple(spark, sf):
    return _priced(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.parse_simple(F.col("txt")).alias("amount")
    )


_ROBUST = """CASE l_partkey % 8 WHEN 3 THEN -l_extendedprice WHEN 4 THEN -l_extendedprice
        WHEN 6 THEN floor(l_extendedprice) WHEN 7 THEN NULL ELSE l_extendedprice END"""


@query("amount_parse_robust", f"SELECT {_KEYS}, {_ROBUST} AS amount FROM lineitem")
def amount_parse_robust(spark, sf):
    return _priced(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.parse_amount(F.col("txt")).alias("amount")
    )


@query(
    "amount_parse_bounded",
    f"SELECT {_KEYS}, CASE WHEN l_partkey % 8 = 1 THEN 0 ELSE coalesce({_ROBUST}, 0) END AS amount FROM lineitem",
)
def amount_parse_bounded(spark, sf):
    # every eighth amount is blown past the accepted magnitude
    txt = F.when(F.col("l_partkey") % 8 == 1, F.concat(F.lit("9999999999999"), F.col("txt"))).otherwise(F.col("txt"))
    return _priced(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.parse_bounded(txt).alias("amount")
    )


@query(
    "amount_parse_rule",
    f"""SELECT {_KEYS}, CASE l_partkey % 8 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice
        WHEN 3 THEN -l_extendedprice
        WHEN 2 THEN TRY_CAST(replace(translate(format('{{:,.2f}}', l_extendedprice), ',.', '.,'), ',', '') AS DOUBLE)
        WHEN 6 THEN CASE WHEN l_extendedprice < 1000 THEN floor(l_extendedprice) ELSE 0 END
        ELSE 0 END AS amount FROM lineitem""",
)
def amount_parse_rule(spark, sf):
    return _priced(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.parse_rule_amount(F.col("txt")).alias("amount")
    )


@query(
    "numeric_view",
    f"""WITH {O.LINES}, t AS (SELECT *, 3 AS col_idx, l_extendedprice AS v FROM lines UNION ALL
          SELECT *, 4, round(l_extendedprice - l_quantity, 2) FROM lines)
        SELECT l_orderkey AS table_idx, row_idx + 1 AS row_idx, col_idx,
          CASE l_partkey % 8 WHEN 3 THEN -v WHEN 4 THEN -v WHEN 6 THEN floor(v) WHEN 7 THEN NULL ELSE v END AS value
        FROM t
        UNION ALL SELECT l_orderkey, row_idx + 1, c, CASE WHEN c = 0 THEN CAST(l_partkey AS DOUBLE) WHEN c = 2 AND l_partkey % 4 = 0 THEN CAST(l_partkey % 30 AS DOUBLE) END
        FROM lines, (VALUES (0), (1), (2)) x(c)""",
)
def numeric_view(spark, sf):
    from tieout.operators.columns import amounts_of

    cells = V.cell_rows(spark, sf)
    # the code column of each table, found by its header, is masked
    codes = cells.where("row_idx = 0 AND lower(text) RLIKE 'code'").select("doc_id", "table_idx", "col_idx")
    return amounts_of(cells.where("row_idx > 0"), codes).select("table_idx", "row_idx", "col_idx", "value")


@query(
    "code_normalize",
    """SELECT p_partkey, upper(regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g')) AS norm,
              regexp_matches(upper(regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g')), '^[0-9]+[A-Z]?$') AS brand_valid,
              CASE WHEN p_partkey % 71 < 10 THEN '0' ELSE '' END || (p_partkey % 71) AS padded,
              (p_partkey % 100) || 'A' AS suffixed, true AS suffixed_valid FROM part""",
)
def code_normalize(spark, sf):
    k = F.col("p_partkey")
    suffixed = X.normalize_code(F.concat(F.lit(" "), k % 100, F.lit("_a**")))
    return V.table(spark, sf, "part").select(
        "p_partkey",
        X.normalize_code(F.col("p_brand")).alias("norm"),
        X.valid_code(X.normalize_code(F.col("p_brand"))).alias("brand_valid"),
        X.pad_code(F.concat((k % 71).cast("string"), F.lit(".0"))).alias("padded"),
        suffixed.alias("suffixed"),
        X.valid_code(suffixed).alias("suffixed_valid"),
    )


@query(
    "year_like",
    """SELECT o_orderkey, true AS is_year, false AS half_is_year, o_totalprice BETWEEN 1900 AND 2100
              AND floor(o_totalprice) = o_totalprice AS price_is_year FROM orders""",
)
def year_like(spark, sf):
    y = F.year("o_orderdate").cast("double")
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        A.is_year_like(y).alias("is_year"),
        A.is_year_like(y + 0.5).alias("half_is_year"),
        A.is_year_like(F.col("o_totalprice")).alias("price_is_year"),
    )


@query(
    "percentage_and_range",
    f"""SELECT {_KEYS}, l_discount >= 0 AS pct_ok, l_discount * 2000 BETWEEN 0 AND 100 AS pct_capped,
        l_tax >= 0.02 AND l_tax <= 0.06 AS tax_in_range FROM lineitem""",
)
def percentage_and_range(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        *[c.strip() for c in _KEYS.split(",")],
        A.valid_percentage(F.col("l_discount")).alias("pct_ok"),
        A.valid_percentage(F.col("l_discount") * 2000, allow_over_100=False).alias("pct_capped"),
        A.valid_range(F.col("l_tax"), 0.02, 0.06).alias("tax_in_range"),
    )


_YEARLY = """WITH y AS (SELECT o_custkey, year(o_orderdate) AS yr,
      round(CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE), 2) AS rev FROM orders GROUP BY 1, 2)"""


@query(
    "change_against_prior_year",
    _YEARLY
    + """ SELECT a.o_custkey, CAST(a.yr AS INTEGER) AS yr, a.rev, coalesce(b.rev, 0) AS prev,
        CASE WHEN coalesce(b.rev, 0) = 0 THEN CASE WHEN a.rev > 0 THEN 'inf' ELSE '0' END
             ELSE CAST(CAST((a.rev - b.rev) / abs(b.rev) * 100 AS DECIMAL(20,4)) AS VARCHAR) END AS change,
        round(CASE WHEN coalesce(b.rev, 0) <> 0 THEN a.rev / b.rev ELSE -1 END, 6) AS ratio
        FROM y a LEFT JOIN y b ON a.o_custkey = b.o_custkey AND a.yr = b.yr + 1""",
)
def change_against_prior_year(spark, sf):
    y = (
        V.table(spark, sf, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("yr"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("rev"))
    )
    prior = y.select("o_custkey", (F.col("yr") + 1).alias("yr"), F.col("rev").alias("p"))
    j = y.join(prior, ["o_custkey", "yr"], "left").withColumn("prev", F.coalesce("p", F.lit(0.0)))
    change = A.pct_change(F.col("rev"), F.col("prev"))
    return j.select(
        "o_custkey", "yr", "rev", "prev",
        F.when(change == float("inf"), "inf").when(F.col("prev") == 0, "0")
        .otherwise(change.cast("decimal(20,4)").cast("string")).alias("change"),
        F.round(A.safe_divide(F.col("rev"), F.col("prev"), -1.0), 6).alias("ratio"),
    )


@query(
    "format_and_round",
    """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS formatted,
        round_even(o_orderkey + 0.5, 0) AS rounded FROM orders""",
)
def format_and_round(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        A.format_amount(F.col("o_totalprice"), 2).alias("formatted"),
        A.round_amount(F.col("o_orderkey") + F.lit(0.5), 0).cast("double").alias("rounded"),
    )


@query(
    "label_normalize",
    """SELECT c_custkey, lower(trim(regexp_replace(c_name || '   ' || c_mktsegment, '\\s+', ' ', 'g'))) AS label,
        'café no. ' || c_custkey AS folded FROM customer""",
)
def label_normalize(spark, sf):
    messy = F.concat(F.lit("  "), F.col("c_name"), F.lit(" \t "), F.col("c_mktsegment"), F.lit(" "))
    wide = F.concat(F.lit(" ＣＡＦÉ No. "), F.col("c_custkey"), F.lit(" "))
    return V.table(spark, sf, "customer").select(
        "c_custkey", X.normalize_label(messy).alias("label"), X.normalize_note_text(wide).alias("folded")
    )


@query(
    "note_ref_normalize",
    """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS note_ref, CAST(c_custkey % 90 AS VARCHAR) AS from_heading,
        '' AS from_plain FROM customer""",
)
def note_ref_normalize(spark, sf):
    n = (F.col("c_custkey") % 90).cast("string")
    heading = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Cash (NOTE  "), F.lpad(n, 3, "0"), F.lit(")")))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Thuyết minh số "), n))
        .otherwise(F.concat(F.lit("TM.0"), n, F.lit(" tiền")))
    )
    return V.table(spark, sf, "customer").select(
        "c_custkey",
        X.normalize_note_ref(F.col("c_name")).alias("note_ref"),
        X.note_number_from_heading(heading).alias("from_heading"),
        X.note_number_from_heading(F.col("c_mktsegment")).alias("from_plain"),
    )


@query(
    "unit_hints",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'VND_000' WHEN 1 THEN 'VND' WHEN 2 THEN 'VND_000' ELSE
       '' END AS unit, count(*) AS n FROM documents GROUP BY 1, 2""",
)
def unit_hints(spark, sf):
    suffix = (
        F.when(F.col("doc_id") % 4 == 0, " Unit: VND’000")
        .when(F.col("doc_id") % 4 == 1, " Currency VND only")
        .when(F.col("doc_id") % 4 == 2, " triệu đồng")
        .otherwise("")
    )
    return (
        V.table(spark, sf, "documents")
        .groupBy("doc_id", X.unit_hint(F.concat(F.col("text"), suffix)).alias("unit"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "period_keys",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y')
         WHEN 1 THEN strftime(o_orderdate, '%d/%m/') || '20' || strftime(o_orderdate, '%y') ELSE strftime(o_orderdate, '%Y') END AS period,
       CAST(CASE o_orderkey % 3 WHEN 1 THEN -1 ELSE year(o_orderdate) END AS INTEGER) AS yr, true AS is_period FROM orders""",
)
def period_keys(spark, sf):
    d = F.col("o_orderdate")
    header = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("At "), F.dayofmonth(d), F.lit("-"), F.month(d), F.lit("-"), F.year(d)))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "d/M/yy"))
        .otherwise(F.concat(F.lit("Năm "), F.year(d), F.lit(" (CY)")))
    )
    return V.table(spark, sf, "orders").select(
        "o_orderkey", X.period_key(header).alias("period"),
        F.coalesce(X.year_of(header), F.lit(-1)).alias("yr"), X.has_year_pattern(header).alias("is_period"),
    )


@query(
    "inline_formula_terms",
    """SELECT p_partkey, lpad(CAST(p_partkey % 90 + 10 AS VARCHAR), 2, '0') AS target,
       lpad(CAST(p_partkey % 53 + 10 AS VARCHAR), 2, '0') || ',' || (p_partkey % 41 + 20) || ',-' || (p_partkey % 37 + 30)
       || ',-' || (p_partkey % 29 + 50) || ',' || (p_partkey % 23 + 60) AS terms FROM part""",
)
def inline_formula_terms(spark, sf):
    k = F.col("p_partkey")
    label = F.concat(
        F.col("p_name"), F.lit(" ("), k % 90 + 10, F.lit(" = "), k % 53 + 10, F.lit(" + ("), k % 41 + 20,
        F.lit(" - "), k % 37 + 30, F.lit(") - ("), k % 29 + 50, F.lit(" - "), k % 23 + 60, F.lit("))"),
    )
    return V.table(spark, sf, "part").select(
        "p_partkey", X.formula_target(label).alias("target"),
        F.array_join(X.formula_terms(label), ",").alias("terms"),
    )


@query(
    "flat_formula_terms",
    """SELECT p_partkey, (p_partkey % 53 + 10) || ',' || (p_partkey % 41 + 20) || 'a,-' || (p_partkey % 37 + 30) AS terms FROM part""",
)
def flat_formula_terms(spark, sf):
    k = F.col("p_partkey")
    label = F.concat(F.lit("30 = "), k % 53 + 10, F.lit(" + "), k % 41 + 20, F.lit("a - "), k % 37 + 30)
    return V.table(spark, sf, "part").select(
        "p_partkey", F.array_join(X.flat_formula_terms(label), ",").alias("terms")
    )


@query(
    "table_slugs",
    """SELECT p_partkey, 'tbl_' || lpad(CAST(p_partkey + 1 AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey + 1 AS VARCHAR))) AS INTEGER), '0') || '_' ||
       regexp_replace(substr(regexp_replace(p_name || ' & ' || p_type, '[^A-Za-z0-9]', '_', 'g'), 1, 50), '^_+|_+$', '', 'g') AS slug FROM part""",
)
def table_slugs(spark, sf):
    heading = F.concat_ws(" & ", "p_name", "p_type")
    return V.table(spark, sf, "part").select(
        "p_partkey", X.table_slug(F.col("p_partkey") + 1, heading).alias("slug")
    )


@query(
    "canonical_types",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FS_CASH_FLOW' WHEN 'O' THEN 'TAX_NOTE' ELSE 'P' END AS table_type FROM orders""",
)
def canonical_types(spark, sf):
    s = F.col("o_orderstatus")
    raw = F.when(s == "F", " fs_cash_flow ").when(s == "O", "TAX_NOTE").otherwise(F.lower(s))
    return V.table(spark, sf, "orders").select("o_orderkey", X.canonical_table_type(raw).alias("table_type"))


@query(
    "box_geometry",
    """WITH b AS (SELECT p_partkey, p_size AS x1, p_size AS y1, p_size + 10 AS x2, p_size + 4 AS y2,
         p_partkey % 50 AS u1, p_partkey % 47 AS v1, p_partkey % 50 + 20 AS u2, p_partkey % 47 + 12 AS v2 FROM part),
       i AS (SELECT *, least(x2, u2) - greatest(x1, u1) AS w, least(y2, v2) - greatest(y1, v1) AS h FROM b)
       SELECT p_partkey, round(CASE WHEN w > 0 AND h > 0 THEN w * h / (40.0 + 240.0 - w * h) ELSE 0 END, 9) AS iou,
         round(CASE WHEN w > 0 AND h > 0 THEN w * h / 40.0 ELSE 0 END, 9) AS inside,
         (x1 + 5) BETWEEN u1 AND u2 AND (y1 + 2) BETWEEN v1 AND v2 AS centred FROM i""",
)
def box_geometry(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    token = {"x1": s, "y1": s, "x2": s + 10, "y2": s + 4}
    cell = {"x1": k % 50, "y1": k % 47, "x2": k % 50 + 20, "y2": k % 47 + 12}
    return V.table(spark, sf, "part").select(
        "p_partkey", F.round(X.iou(token, cell), 9).alias("iou"),
        F.round(X.containment(token, cell), 9).alias("inside"), X.centre_inside(token, cell).alias("centred"),
    )


@query(
    "spreadsheet_safe_text",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '''=' || p_name WHEN 1 THEN '-' || p_partkey WHEN 2 THEN '''@' || p_type
        ELSE p_brand END AS safe FROM part""",
)
def spreadsheet_safe_text(spark, sf):
    k = F.col("p_partkey")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("="), F.col("p_name")))
        .when(k % 4 == 1, F.concat(F.lit("-"), k))
        .when(k % 4 == 2, F.concat(F.lit("@"), F.col("p_type")))
        .otherwise(F.col("p_brand"))
    )
    return V.table(spark, sf, "part").select("p_partkey", X.spreadsheet_safe(raw).alias("safe"))


@query(
    "sum_of_details",
    """SELECT o_orderkey AS table_idx, o_custkey AS doc_id, t AS expected, s AS actual, round(s - t, 4) AS diff,
         greatest(1.0, least(0.008 * abs(t), 1000000.0)) AS tolerance,
         abs(round(s - t, 4)) > greatest(1.0, least(0.008 * abs(t), 1000000.0)) AS is_material,
         CASE WHEN abs(round(s - t, 4)) > greatest(1.0, least(0.008 * abs(t), 1000000.0)) THEN 'MAJOR' ELSE 'INFO' END AS severity
       FROM (SELECT o_orderkey, o_custkey, s, CASE WHEN o_orderkey % 3 = 0 THEN s ELSE o_totalprice END AS t FROM orders JOIN
         (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1)
         ON l_orderkey = o_orderkey)""",
)
def sum_of_details(spark, sf):
    from tieout.operators.sums import details_against_total

    return details_against_total(V.note_amounts(spark, sf), table_type="GENERIC_NOTE").select(
        "doc_id", "table_idx", "expected", "actual", "diff", "tolerance", "is_material", "severity"
    )
