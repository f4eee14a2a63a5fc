"""Headings, header rows, merges, grid quality, tokens and table clean-up."""

from pyspark.sql import functions as F

from tieout.operators import ingest as I
from tieout.operators.scans import groups_fit
from tieout.plans import views as V
from tieout.plans.normalize import normalize_tables
from tieout.queries import oracle_views as O
from tieout.queries.registry import query
from tieout.session import deal


def _event_blocks(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("block_idx"),
        F.when(F.col("event_type") == "purchase", "table").otherwise("paragraph").alias("kind"),
        F.when(F.col("event_type") == "signup", "Heading 1").otherwise("Normal").alias("style"), F.concat(F.lit("E"), "event_id").alias("text"),
    )


@query(
    "heading_attach_last",
    """SELECT user_id AS doc_id, event_id AS block_idx, h AS heading FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 'E' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM events) WHERE event_type = 'purchase'""",
)
def heading_attach_last(spark, sf):
    return I.attach_last_heading(_event_blocks(spark, sf)).select("doc_id", "block_idx", "heading")


@query(
    "document_profiles",
    """SELECT user_id AS doc_id, count(*) FILTER (event_type = 'purchase') AS tables, count(*) FILTER (event_type <> 'purchase') AS paragraphs, count(*) FILTER (event_type = 'signup') AS headings, CAST(0 AS BIGINT) AS sections,
       count(*) FILTER (event_type = 'purchase') > 0 AS is_valid FROM events GROUP BY 1""",
)
def document_profiles(spark, sf):
    return I.document_profile(_event_blocks(spark, sf))


def _lines(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _doc_blocks(spark, sf):
    """Document lines as blocks: every seventh line stands for a table."""
    is_table = F.col("pos") % 7 == 6
    return _lines(spark, sf).select(
        "doc_id", F.col("pos").alias("block_idx"), F.when(is_table, "table").otherwise("paragraph").alias("kind"), F.col("pos").alias("table_idx"),
        F.when(F.col("pos") % 5 == 0, "Heading 2").otherwise("Normal").alias("style"),
        F.concat("line", F.when(F.col("pos") % 9 == 0, " Balance sheet").otherwise("")).alias("text"),
        (F.col("pos") % 3 == 0).alias("is_bold"), (F.col("pos") % 4 == 0).alias("is_upper"),
    )


_JUNK = """(length({t}) < 3 OR (NOT regexp_matches({l}, 'balance sheet|equity') AND (length(regexp_replace({t}, '[^0-9]', '', 'g')) + length(regexp_replace({t}, '[^$.,() ]', '', 'g'))) / length({t}) > 0.5))"""


@query(
    "heading_attach_scored",
    f"""WITH b AS (SELECT doc_id, pos, line || CASE WHEN pos % 9 = 0 THEN ' Balance sheet' ELSE '' END AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
      c AS (SELECT t.doc_id, t.pos AS table_idx, p.text, t.pos - p.pos - 1 AS dist, trim(p.text, ' ') AS tt, lower(p.text) AS l,
         CASE WHEN p.pos % 9 = 0 OR contains(lower(p.text), 'tax') THEN 10 ELSE 0 END + CASE WHEN p.pos % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN p.pos % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN p.pos % 4 = 0 THEN 2 ELSE 0 END - (t.pos - p.pos - 1) * 0.5 AS score
        FROM b t JOIN b p ON p.doc_id = t.doc_id AND p.pos < t.pos AND p.pos >= t.pos - 6 WHERE t.pos % 7 = 6),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY score DESC, dist) AS r FROM c WHERE score >= 5 AND text <> '' AND NOT {_JUNK.format(t='tt', l='l')})
      SELECT t.doc_id, CAST(t.pos AS INTEGER) AS table_idx, k.text AS heading, (CASE WHEN score IS NULL THEN 0 ELSE least(1.0, score / 10) END)::DOUBLE AS heading_confidence, CASE WHEN k.text IS NULL THEN 'none' ELSE 'paragraph' END AS heading_source
      FROM b t LEFT JOIN k ON k.doc_id = t.doc_id AND k.table_idx = t.pos AND r = 1 WHERE t.pos % 7 = 6""",
)
def heading_attach_scored(spark, sf):
    return I.attach_scored_heading(_doc_blocks(spark, sf))


@query(
    "heading_junk_filter",
    """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN false WHEN 7 THEN true WHEN 8 THEN false ELSE true END AS junk FROM orders""",
)
def heading_junk_filter(spark, sf):
    k = F.col("o_orderkey")
    price = F.format_number("o_totalprice", 2)
    text = (
        F.when(k % 10 == 0, "Mã số").when(k % 10 == 1, F.concat(F.lit("Note "), k)).when(k % 10 == 2, F.concat(F.lit("Note "), k, F.lit(": Inventories")))
        .when(k % 10 == 3, price).when(k % 10 == 4, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 10 == 5, "VND'000")
        .when(k % 10 == 6, F.concat(F.lit("Balance sheet "), price)).when(k % 10 == 7, "Unit: VND million").when(k % 10 == 8, F.concat(F.lit("Payables to "), F.col("o_orderpriority")))
        .otherwise("ab")
    )
    return V.table(spark, sf, "orders").select("o_orderkey", I.heading_junk(text).alias("junk"))


@query("heading_from_first_row", f"WITH {O.CELLS} SELECT DISTINCT doc_id, table_idx, 'Description' AS heading FROM cells")
def heading_from_first_row(spark, sf):
    return I.heading_from_first_row(V.cell_rows(spark, sf))


def _two_row_header(spark, sf):
    """Cells with a second header row of units under the first one."""
    c = V.cell_rows(spark, sf)
    shifted = c.withColumn("row_idx", F.when(F.col("row_idx") > 0, F.col("row_idx") + 1).otherwise(0))
    units = c.where("row_idx = 0").withColumn("row_idx", F.lit(1)).withColumn("text", F.when(F.col("col_idx") >= 3, "VND").otherwise(""))
    return shifted.unionByName(units)


def _two_row_header_nested(rows):
    """:func:`_two_row_header` of rows that hold their cells as an array."""
    units = F.transform("cells", lambda x: F.struct(x["col_idx"].alias("col_idx"), F.when(x["col_idx"] >= 3, "VND").otherwise("").alias("text")))
    row = lambda at, cells: F.struct(at.alias("row_idx"), cells.alias("cells"))
    r = F.col("row_idx")
    both = F.when(r == 0, F.array(row(r, F.col("cells")), row(r + 1, units))).otherwise(F.array(row(r + 1, F.col("cells"))))
    return rows.select("doc_id", "table_idx", F.inline(both))


@query("header_row_ranges", f"WITH {O.CELLS} SELECT DISTINCT doc_id, table_idx, 0 AS start_row, 1 AS end_row FROM cells")
def header_row_ranges(spark, sf):
    cells = _two_row_header(spark, sf)
    return I.header_range(cells, ["code"], ["note"])


@query(
    "promoted_headers",
    f"""WITH {O.CELLS} SELECT doc_id, table_idx, col_idx, CASE WHEN col_idx >= 3 THEN 'Amount VND' || CASE WHEN col_idx = 4 THEN '.1' ELSE '' END ELSE text END AS header FROM cells WHERE row_idx = 0""",
)
def promoted_headers(spark, sf):
    cells = _two_row_header(spark, sf)
    same = cells.withColumn("text", F.when((F.col("row_idx") == 0) & (F.col("col_idx") >= 3), "Amount").otherwise(F.col("text")))
    headers, _ = I.promote_headers(same, I.header_range(cells, ["code"], ["note"]))
    return headers


@query(
    "normalized_tables",
    f"""WITH {O.CELLS} SELECT doc_id, table_idx, 3 AS cy_col, 4 AS py_col, 1 AS code_col, 2 AS note_col, CAST(count(*) FILTER (row_idx > 0) AS BIGINT) AS body_cells FROM cells GROUP BY 1, 2""",
)
def normalized_tables(spark, sf):
    dealt = V.dealt_cell_rows(spark, sf)
    out = normalize_tables(_two_row_header(spark, sf)) if dealt is None else normalize_tables(_two_row_header_nested(dealt[0]), dealt[1])
    n = out["body"].groupBy("doc_id", "table_idx").agg(F.count(F.lit(1)).alias("body_cells"))
    return out["metadata"].drop("strategy").join(n, ["doc_id", "table_idx"])


def _table_sequence(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    heads = F.array(F.lit("Inventories"), F.lit("Inventories"), F.lit("Cash flow statement"), F.lit(None).cast("string"))
    return o.select(
        F.col("o_custkey").alias("doc_id"), k.alias("table_idx"), F.element_at(heads, (k % 4 + 1).cast("int")).alias("heading"),
        F.when(k % 3 == 0, F.lit("7")).alias("note_number"), F.when(k % 7 == 0, 4).otherwise(5).alias("n_cols"),
        F.when(k % 2 == 0, F.array(F.lit("Code"), F.lit("2024"))).otherwise(F.array(F.lit("code "), F.lit("2023"))).alias("headers"),
        (k % 6 == 0).alias("page_break"), (k % 5).alias("paragraphs_since"), (k % 11 == 0).alias("long_paragraph"), (k % 13 == 0).alias("is_footer"),
        F.when(k % 5 == 0, "01").otherwise("Other").alias("first_cell"), F.lit("Total").alias("last_cell"),
    )


@query(
    "split_table_merges",
    """WITH t AS (SELECT o_custkey AS d, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Inventories' WHEN 1 THEN 'Inventories' WHEN 2 THEN 'Cash flow statement' END AS h, o_orderkey % 3 = 0 AS note, CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 5 END AS nc, o_orderkey % 2 AS hs,
        o_orderkey % 6 = 0 AS pb, o_orderkey % 5 AS ps, o_orderkey % 11 = 0 AS lp, o_orderkey % 13 = 0 AS ft FROM orders),
      p AS (SELECT *, lag(k) OVER w AS pk, lag(h) OVER w AS ph, lag(nc) OVER w AS pnc, lag(hs) OVER w AS phs, lag(ft) OVER w AS pft FROM t WINDOW w AS (PARTITION BY d ORDER BY k)),
      r AS (SELECT *, CASE WHEN pk IS NULL THEN 'NO_PREV_TABLE' WHEN ft THEN 'CURR_IS_FOOTER' WHEN pft THEN 'PREV_IS_FOOTER' WHEN h = 'Cash flow statement' THEN 'MERGE_BLOCKED_FINANCIAL_STATEMENT' WHEN nc <> pnc THEN 'COLUMN_COUNT_MISMATCH'
        WHEN NOT ((ps <= 2 AND NOT lp) OR pb) THEN 'PROXIMITY_FAIL' WHEN h IS NULL AND NOT note AND NOT pb THEN 'MERGE_WEAK_HEURISTIC_BLOCKED' WHEN h IS NULL AND pb AND hs <> phs THEN 'MERGE_BLOCKED_HEADER_MISMATCH'
        WHEN h IS NOT NULL AND h IS DISTINCT FROM ph THEN 'HEADING_MISMATCH' WHEN k % 5 = 0 THEN 'MERGE_BLOCKED_CONTINUITY' ELSE 'MERGED_BY_STRONG_ANCHOR' END AS reason FROM p)
      SELECT d AS doc_id, k AS table_idx, reason, CAST(sum(CASE WHEN reason = 'MERGED_BY_STRONG_ANCHOR' THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY k) AS BIGINT) AS merge_group FROM r""",
)
def split_table_merges(spark, sf):
    return I.merge_decisions(_table_sequence(spark, sf)).select("doc_id", "table_idx", "reason", "merge_group")


@query(
    "repeated_header_splits",
    f"WITH {O.CELLS} SELECT doc_id, table_idx, CAST(min(row_idx) + 1 AS INTEGER) AS split_row FROM cells WHERE row_idx > 0 AND row_idx % 3 = 0 AND col_idx = 0 GROUP BY 1, 2",
)
def repeated_header_splits(spark, sf):
    c = V.cell_rows(spark, sf)
    headers = c.where("row_idx = 0").select("doc_id", "table_idx", "col_idx", F.when(F.col("col_idx") == 3, "At 2024").when(F.col("col_idx") == 4, "31/12/2023").otherwise(F.col("text")).alias("header"))
    # every third body row repeats the period header; other cells hold no dates
    body = c.where("row_idx > 0").withColumn(
        "text",
        F.when((F.col("row_idx") % 3 == 0) & (F.col("col_idx") == 3), "2024").when((F.col("row_idx") % 3 == 0) & (F.col("col_idx") == 4), "at 31/12/2023")
        .otherwise("x"),
    ).withColumn("row_idx", F.col("row_idx") + 1)
    return I.repeated_header_row(headers, body)


@query(
    "footer_tables",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) || CASE WHEN doc_id % 4 = 0 THEN ' Chief Accountant' WHEN doc_id % 4 = 1 THEN ' Total assets, prepared by' ELSE '' END AS line FROM documents),
      t AS (SELECT doc_id, lower(trim(line, ' ')) AS t FROM l), r AS (SELECT *, regexp_matches(regexp_replace(t, '[,.\\- ]', '', 'g'), '^[0-9]+$') AS num FROM t),
      g AS (SELECT doc_id, count(*) AS n_rows, round(avg(CASE WHEN num THEN 1.0 ELSE 0 END), 4) AS numeric_ratio, {pos} AS pos, {neg} AS neg, bool_or(contains(t, '20') OR contains(t, '19')) AS yr, {cur} AS cur, count(*) FILTER (t <> '' AND length(t) <= 80) AS short FROM r GROUP BY 1),
      s AS (SELECT *, n_rows >= 2 AND short >= greatest(1, n_rows // 2) AS sl FROM g)
      SELECT doc_id, n_rows, numeric_ratio::DOUBLE AS numeric_ratio, pos AND ((n_rows <= 20 AND (numeric_ratio < 0.1 OR sl)) OR (n_rows <= 3 AND numeric_ratio < 0.05 AND sl)) AND NOT (neg OR (numeric_ratio > 0.15 AND (yr OR cur)) OR numeric_ratio > 0.3) AS is_footer FROM s""".replace(
        "{pos}", "bool_or(" + " OR ".join(f"contains(t, '{w}')" for w in I.FOOTER_WORDS) + ")"
    ).replace("{neg}", "bool_or(" + " OR ".join(f"contains(t, '{w}')" for w in I.FINANCIAL_LABELS) + ")").replace(
        "{cur}", "bool_or(" + " OR ".join(f"contains(t, '{w}')" for w in I.CURRENCY_WORDS) + ")"
    ),
)
def footer_tables(spark, sf):
    tail = F.when(F.col("doc_id") % 4 == 0, " Chief Accountant").when(F.col("doc_id") % 4 == 1, " Total assets, prepared by").otherwise("")
    cells = _lines(spark, sf).select("doc_id", F.lit(0).alias("table_idx"), F.col("pos").alias("row_idx"), F.lit(0).alias("col_idx"), F.concat("line", tail).alias("text"))
    return I.footer_tables(cells).drop("table_idx")


@query(
    "caption_rows",
    f"WITH {O.CELLS} SELECT doc_id, table_idx, row_idx FROM (SELECT doc_id, table_idx, row_idx, count(*) FILTER (trim(text) <> '' AND NOT (row_idx % 2 = 1 AND col_idx >= 2)) AS n FROM cells GROUP BY 1, 2, 3) WHERE n <= 2",
)
def caption_rows(spark, sf):
    c = V.cell_rows(spark, sf)
    return I.caption_rows(c.withColumn("text", F.when((F.col("row_idx") % 2 == 1) & (F.col("col_idx") >= 2), "").otherwise(F.col("text"))))


@query(
    "grid_quality",
    f"""WITH {O.CELLS}, c AS (SELECT *, CASE WHEN row_idx = 0 AND col_idx = 4 AND table_idx % 7 = 0 THEN 'Note' WHEN table_idx % 3 = 0 AND row_idx > 0 AND col_idx > 0 THEN '' ELSE text END AS t FROM cells WHERE NOT (table_idx % 5 = 0 AND row_idx = 1 AND col_idx = 4)),
      r AS (SELECT doc_id, table_idx, row_idx, count(*) AS n, count(*) FILTER (trim(t) <> '') AS f FROM c GROUP BY 1, 2, 3), g AS (SELECT doc_id, table_idx, max(n) <> min(n) AS ragged, sum(f) / (count(*) * max(n)) AS fill FROM r GROUP BY 1, 2),
      s AS (SELECT *, table_idx % 7 = 0 AS dup, greatest(0, 1.0 - CASE WHEN ragged THEN 0.5 ELSE 0 END - CASE WHEN table_idx % 7 = 0 THEN 0.5 ELSE 0 END - CASE WHEN fill < 0.1 THEN 0.3 WHEN fill < 0.5 THEN 0.1 ELSE 0 END) AS raw FROM g)
      SELECT doc_id, table_idx, round(CASE WHEN ragged OR dup THEN least(raw, 0.55) ELSE raw END, 2)::DOUBLE AS quality_score, concat_ws(',', CASE WHEN ragged THEN 'GRID_CORRUPTION' END, CASE WHEN dup THEN 'DUPLICATE_PERIODS' END, CASE WHEN fill < 0.1 THEN 'LOW_FILL' END) AS quality_flags,
        NOT ragged AND NOT dup AND raw >= 0.6 AS usable FROM s""",
)
def grid_quality(spark, sf):
    k = F.col("table_idx")
    c = V.cell_rows(spark, sf).where(~((k % 5 == 0) & (F.col("row_idx") == 1) & (F.col("col_idx") == 4)))
    c = c.withColumn(
        "text",
        F.when((F.col("row_idx") == 0) & (F.col("col_idx") == 4) & (k % 7 == 0), "Note")
        .when((k % 3 == 0) & (F.col("row_idx") > 0) & (F.col("col_idx") > 0), "").otherwise(F.col("text")),
    )
    return I.grid_quality(c).withColumn("quality_flags", F.array_join("quality_flags", ","))


@query(
    "token_quality_gate",
    """WITH v AS (SELECT label, vec_id, round(0.75 + 0.25 * unnest(embedding)::DOUBLE, 3) AS c FROM embeddings), r AS (SELECT label, c, row_number() OVER (PARTITION BY label ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM v),
      m AS (SELECT label, max(c) FILTER (i = floor(n * 0.1)) AS p10, round(avg(c), 4) AS mean_conf, round(avg(CASE WHEN c >= 0.7 THEN 1.0 ELSE 0 END), 4) AS coverage, (label % 4) * 0.2 AS empty_ratio FROM r GROUP BY 1)
      SELECT label, p10, CASE WHEN coverage >= 0.9 AND mean_conf >= 0.85 AND p10 >= 0.7 AND empty_ratio <= 0.3 THEN 'accept' WHEN coverage >= 0.7 AND mean_conf >= 0.7 AND p10 >= 0.5 AND empty_ratio <= 0.5 THEN 'borderline' ELSE 'reject' END AS decision,
        CASE WHEN coverage >= 0.7 AND mean_conf >= 0.7 AND p10 >= 0.5 AND empty_ratio <= 0.5 THEN '' WHEN coverage < 0.7 THEN 'RENDER_FIRST_LOW_TOKEN_COVERAGE' WHEN mean_conf < 0.7 THEN 'RENDER_FIRST_LOW_CONFIDENCE' WHEN empty_ratio > 0.5 THEN 'RENDER_FIRST_TOO_MANY_EMPTY_CELLS' ELSE 'RENDER_FIRST_UNTRUSTED' END AS reason FROM m""",
)
def token_quality_gate(spark, sf):
    v = V.table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("e")).select("label", F.round(F.lit(0.75) + F.lit(0.25) * F.col("e").cast("double"), 3).alias("c"))
    p10 = I.tenth_percentile(v, ["label"], "c", 0.01)
    m = v.groupBy("label").agg(F.round(F.avg("c"), 4).alias("mean_conf"), F.round(F.avg((F.col("c") >= 0.7).cast("double")), 4).alias("coverage"))
    m = m.join(p10, "label").withColumn("empty_ratio", (F.col("label") % 4) * F.lit(0.2))
    return I.token_gate(m).select("label", "p10", "decision", "reason")


def _tokens(li):
    """Order lines as tokens on a page per order, three columns of boxes per line number."""
    x, y = F.col("l_partkey") % 3 * 100 + F.col("l_suppkey") % 70, F.col("l_linenumber") * 20 + F.col("l_partkey") % 5
    # a token is one mark on the page, however often its line item is listed
    return li.distinct().select(
        "doc_id", "table_idx", (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 8 + F.col("l_linenumber")).alias("token_id"),
        x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 10).alias("y2"), F.concat(F.lit("T"), "l_partkey").alias("text"),
    )


def _boxes(orders):
    grid = orders.withColumn("row_idx", F.explode(F.array(*[F.lit(i) for i in range(1, 8)]))).withColumn("col_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return grid.select(
        "doc_id", "table_idx", "row_idx", "col_idx", (F.col("col_idx") * 100).alias("x1"), (F.col("row_idx") * 20).alias("y1"),
        (F.col("col_idx") * 100 + 90).alias("x2"), (F.col("row_idx") * 20 + 18).alias("y2"),
    )


def _assigned(spark, sf):
    """Tokens in their boxes. Where no order is large, lines and orders are dealt by page before tokens and boxes are made of them."""
    page = lambda k: {"doc_id": F.col(k) % 1000, "table_idx": F.col(k)}
    li = V.table(spark, sf, "lineitem").withColumns(page("l_orderkey")).select("doc_id", "table_idx", "l_partkey", "l_suppkey", "l_linenumber")
    o = V.table(spark, sf, "orders").withColumns(page("o_orderkey")).select("doc_id", "table_idx")
    small = groups_fit(li, ["table_idx"]) and groups_fit(o, ["table_idx"], I.FEW_BOXES // 21)
    if small:
        size = li.count()
        li, o = (deal(df.dropna(subset=I.TABLE_KEY), I.SORT_KEY, size) for df in (li, o))
    return I.assign_tokens(_tokens(li), _boxes(o), small=small)


_TOK = """tk AS (SELECT DISTINCT l_orderkey AS k, l_partkey, l_suppkey, l_linenumber, l_partkey % 3 AS c, l_partkey % 3 * 100 + l_suppkey % 70 AS x1, l_linenumber * 20 + l_partkey % 5 AS y1 FROM lineitem),
  ta AS (SELECT *, greatest(0, least(x1 + 30, c * 100 + 90) - x1) AS w FROM tk WHERE x1 + 15 <= c * 100 + 90)"""


@query(
    "token_cell_assignment",
    f"WITH {_TOK} SELECT k % 1000 AS doc_id, k AS table_idx, l_partkey * 100000 + l_suppkey * 8 + l_linenumber AS token_id, l_linenumber AS row_idx, CAST(c AS INTEGER) AS col_idx FROM ta",
)
def token_cell_assignment(spark, sf):
    return _assigned(spark, sf).select("doc_id", "table_idx", "token_id", "row_idx", "col_idx")


@query(
    "token_cell_text",
    f"WITH {_TOK} SELECT k % 1000 AS doc_id, k AS table_idx, l_linenumber AS row_idx, CAST(c AS INTEGER) AS col_idx, string_agg('T' || l_partkey, ' ' ORDER BY y1 // 10, x1, 'T' || l_partkey) AS text, count(*) AS n_tokens FROM ta GROUP BY 1, 2, 3, 4",
)
def token_cell_text(spark, sf):
    return I.cell_texts(_assigned(spark, sf))


@query(
    "canonical_columns",
    f"""WITH {O.CELLS}, p AS (SELECT table_idx, doc_id, row_idx, max(text) FILTER (col_idx = 1) AS a, max(text) FILTER (col_idx = 2) AS b FROM cells WHERE row_idx > 0 GROUP BY 1, 2, 3),
      m AS (SELECT doc_id, table_idx, row_idx, 1 AS col_idx, CASE WHEN row_idx % 2 = 0 THEN b ELSE a END AS text, row_idx % 2 = 1 AND b <> '' AND b <> a AS conflict FROM p)
      SELECT doc_id, table_idx, row_idx, 'Code' AS header, text, conflict FROM m
      UNION ALL SELECT doc_id, table_idx, row_idx, 'Column ' || col_idx, text, false FROM cells WHERE row_idx > 0 AND col_idx NOT IN (1, 2)""",
)
def canonical_columns(spark, sf):
    # code and note both act as "Code"; on even rows the first of the two is blank
    c = V.cell_rows(spark, sf).where("row_idx > 0").withColumn("text", F.when((F.col("row_idx") % 2 == 0) & (F.col("col_idx") == 1), "").otherwise(F.col("text")))
    headers = c.select("doc_id", "table_idx", "col_idx").distinct().withColumn("header", F.when(F.col("col_idx") == 1, "Code").when(F.col("col_idx") == 2, "Code.1").otherwise(F.concat(F.lit("Column "), "col_idx")))
    return I.merged_columns(c, headers).select("doc_id", "table_idx", "row_idx", "header", "text", (F.col("n_values") > 1).alias("conflict"))


@query(
    "index_rows_dropped",
    f"WITH {O.CELLS} SELECT doc_id, table_idx, CAST(count(*) AS BIGINT) AS n, CAST(max(row_idx) AS INTEGER) AS last_row FROM (SELECT doc_id, table_idx, row_idx - CASE WHEN table_idx % 2 = 0 THEN 1 ELSE 0 END AS row_idx FROM cells WHERE NOT (table_idx % 2 = 0 AND row_idx = 0)) GROUP BY 1, 2",
)
def index_rows_dropped(spark, sf):
    c = V.cell_rows(spark, sf).withColumn("text", F.when((F.col("row_idx") == 0) & (F.col("table_idx") % 2 == 0), F.col("col_idx").cast("string")).otherwise(F.col("text")))
    return I.drop_index_rows(c).groupBy("doc_id", "table_idx").agg(F.count(F.lit(1)).alias("n"), F.max("row_idx").alias("last_row"))


@query(
    "period_columns_merged",
    f"""WITH {O.LINES}, c AS (SELECT l_orderkey AS k, row_idx, CASE WHEN row_idx % 2 = 0 THEN l_extendedprice END AS a, CASE WHEN row_idx % 2 = 1 OR l_orderkey % 3 = 0 THEN floor(l_extendedprice) END AS b FROM lines),
      n AS (SELECT k, count(a) AS na, count(b) AS nb, k % 3 = 0 AND count(a) > 0 AND bool_or(a IS NOT NULL AND b IS NOT NULL AND a <> b) AS clash FROM c GROUP BY 1),
      j AS (SELECT c.*, na >= nb AS a_first, coalesce(clash, false) AS clash FROM c JOIN n USING (k))
      SELECT k % 1000 AS doc_id, k AS table_idx, row_idx, CASE WHEN a_first THEN 3 ELSE 4 END AS col_idx, CASE WHEN a_first THEN '31/12/2018' ELSE '31/12/2018.1' END AS header, CASE WHEN clash THEN CASE WHEN a_first THEN a ELSE b END ELSE CASE WHEN a_first THEN coalesce(a, b) ELSE coalesce(b, a) END END AS value FROM j
      UNION ALL SELECT k % 1000, k, row_idx, CASE WHEN a_first THEN 4 ELSE 3 END, '31/12/2018 (2)', CASE WHEN a_first THEN b ELSE a END FROM j WHERE clash""",
)
def period_columns_merged(spark, sf):
    lines = V.order_lines(spark, sf)
    r, p = F.col("row_idx"), F.col("l_extendedprice")
    body = lines.withColumn("col_idx", F.explode(F.array(F.lit(3), F.lit(4)))).select(
        (F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("table_idx"), "row_idx", "col_idx",
        F.when(
            F.col("col_idx") == 3, F.when(r % 2 == 0, p.cast("decimal(18,2)").cast("string")).otherwise("")
        ).otherwise(F.when((r % 2 == 1) | (F.col("l_orderkey") % 3 == 0), F.format_number(F.floor(p), 0)).otherwise("")).alias("text"),
    )
    headers = body.select("doc_id", "table_idx", "col_idx").distinct().withColumn("header", F.when(F.col("col_idx") == 3, "31/12/2018").otherwise("31/12/2018.1"))
    return I.merge_period_columns(body, headers)


@query(
    "rectangular_rows",
    f"WITH {O.CELLS}, c AS (SELECT * FROM cells WHERE NOT (row_idx % 2 = 1 AND col_idx >= 3)), w AS (SELECT table_idx, max(col_idx) AS w FROM c GROUP BY 1) SELECT doc_id, table_idx, row_idx, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (text = '' OR (row_idx % 2 = 1 AND col_idx >= 3)) AS empty FROM cells JOIN w USING (table_idx) WHERE col_idx <= w GROUP BY 1, 2, 3",
)
def rectangular_rows(spark, sf):
    c = V.cell_rows(spark, sf).where(~((F.col("row_idx") % 2 == 1) & (F.col("col_idx") >= 3)))
    return I.rectangular(c).groupBy("doc_id", "table_idx", "row_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "").alias("empty"))


_SPANS = """sp AS MATERIALIZED (SELECT doc_id, table_idx, row_idx, col_idx, CASE WHEN row_idx = 0 AND col_idx = 4 AND table_idx % 11 = 3 THEN 'Note' WHEN table_idx % 3 = 0 AND row_idx > 0 AND col_idx > 0 THEN '' ELSE text END AS text,
    CASE WHEN table_idx % 7 = 0 AND row_idx = 1 AND col_idx = 0 THEN 2 END AS row_span, CASE WHEN (table_idx % 5 = 0 AND row_idx = 1 AND col_idx = 3) OR (table_idx % 19 = 0 AND row_idx = 1 AND col_idx = 2) THEN 2 END AS col_span
    FROM cells WHERE NOT (row_idx = 1 AND col_idx = 4 AND (table_idx % 5 = 0 OR table_idx % 9 = 4)) AND table_idx % 17 <> 1)"""


@query(
    "grid_invariants",
    f"""WITH {O.CELLS}, {_SPANS},
      ow AS (SELECT doc_id, table_idx, max(row_idx) + 1 AS nr FROM sp GROUP BY 1, 2),
      po AS (SELECT doc_id, table_idx, pr, pc, count(*) AS n, bool_or(pr > row_idx) AS merged, bool_or(trim(text) <> '') AS f FROM (
        SELECT *, unnest(range(col_idx, col_idx + coalesce(col_span, 1))) AS pc FROM (SELECT *, unnest(range(row_idx, row_idx + coalesce(row_span, 1))) AS pr FROM sp)) GROUP BY 1, 2, 3, 4),
      ro AS (SELECT doc_id, table_idx, nr, pr, count(*) AS width, max(pc) + 1 AS reach, count(*) FILTER (f) AS filled, bool_or(merged AND (n > 1 OR pr >= nr)) AS mis, bool_or(n > 1 AND NOT merged) AS col FROM po JOIN ow USING (doc_id, table_idx) GROUP BY 1, 2, 3, 4),
      gr AS (SELECT doc_id, table_idx, nr, max(reach) FILTER (pr < nr) AS cols, min(width) FILTER (pr < nr) AS narrow, count(*) FILTER (pr < nr) AS held, sum(filled) FILTER (pr < nr) AS filled, bool_or(mis) AS mis, bool_or(col) AS col FROM ro GROUP BY 1, 2, 3),
      hd AS (SELECT doc_id, table_idx, count(*) <> count(DISTINCT trim(text)) AS twice FROM sp WHERE row_idx = 0 GROUP BY 1, 2),
      fl AS (SELECT t.doc_id, t.table_idx, nr IS NULL AS empty, coalesce(narrow <> cols OR held <> nr, false) AS ragged, coalesce(twice, false) AS twice, coalesce(CASE WHEN t.table_idx % 13 = 2 THEN cols <> 6 END, false) AS mism, coalesce(mis, false) AS mis, coalesce(col, false) AS col,
        filled / (nr * cols) AS fill FROM (SELECT DISTINCT l_orderkey % 1000 AS doc_id, l_orderkey AS table_idx FROM lineitem) t LEFT JOIN gr USING (doc_id, table_idx) LEFT JOIN hd USING (doc_id, table_idx)),
      sc AS (SELECT *, greatest(0, least(1, 1.0 - CASE WHEN ragged THEN 0.5 ELSE 0 END - CASE WHEN twice THEN 0.5 ELSE 0 END - CASE WHEN mism THEN 0.2 ELSE 0 END - CASE WHEN mis THEN 0.2 ELSE 0 END - CASE WHEN col THEN 0.1 ELSE 0 END
        - CASE WHEN fill < 0.1 THEN 0.3 WHEN fill < 0.5 THEN 0.1 ELSE 0 END)) AS raw FROM fl),
      fs AS (SELECT *, CASE WHEN empty THEN 0.0 WHEN ragged OR twice THEN least(raw, 0.55) ELSE raw END AS s FROM sc)
      SELECT doc_id, table_idx, round(s, 2)::DOUBLE AS quality_score, concat_ws(',', CASE WHEN empty THEN 'empty_grid' END, CASE WHEN ragged THEN 'row_col_count' END, CASE WHEN twice THEN 'duplicate_periods' END, CASE WHEN mism THEN 'grid_col_mismatch' END,
        CASE WHEN mis THEN 'vmerge_misalign' END, CASE WHEN col THEN 'soft_anomaly' END) AS violations, s >= 0.6 AND NOT empty AND NOT ragged AND NOT twice AS usable FROM fs""",
)
def grid_invariants(spark, sf):
    """Cells of orders with merges over columns and rows, some onto other cells, out of the table, or missing."""
    from tieout.operators import grids as G

    k, r, c = F.col("table_idx"), F.col("row_idx"), F.col("col_idx")
    cells = V.cell_rows(spark, sf).where(~((r == 1) & (c == 4) & ((k % 5 == 0) | (k % 9 == 4))) & (k % 17 != 1))
    text = F.when((r == 0) & (c == 4) & (k % 11 == 3), "Note").when((k % 3 == 0) & (r > 0) & (c > 0), "").otherwise(F.col("text"))
    cells = cells.withColumns({
        "text": text, "row_span": F.when((k % 7 == 0) & (r == 1) & (c == 0), 2),
        "col_span": F.when(((k % 5 == 0) & (r == 1) & (c == 3)) | ((k % 19 == 0) & (r == 1) & (c == 2)), 2),
    })
    tables = V.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("table_idx")).distinct().withColumn("expected_cols", F.when(F.col("table_idx") % 13 == 2, 6))
    return G.grid_invariants(cells, tables).select("doc_id", "table_idx", "quality_score", F.array_join("violations", ",").alias("violations"), "usable")
