"""Statement formulas, duplicate-code policies, lookups and reconciliation."""

from pyspark.sql import functions as F

from tieout import catalogue as C
from tieout.operators import statements as S
from tieout.plans import views as V
from tieout.queries import oracle_views as O
from tieout.queries.registry import query


def _values(rows):
    return "(VALUES " + ",".join("(" + ",".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def _formula_oracle(cte, facts, rules, ok, keys="doc_id, period_ord"):
    """Formula check over a fact CTE body ``facts`` with columns keys, code, value."""
    kids = [(f, ",".join(c.lstrip("-") for c in k)) for f, _, k in rules]
    return f"""WITH {cte}, facts AS ({facts}),
      terms(formula, parent, child, sign, ord) AS {_values(C.signed_terms(rules))},
      wanted(formula, w) AS {_values(kids)},
      k AS (SELECT {keys}, formula, parent, round(CAST(sum(CAST(sign * value AS DECIMAL(20,4))) AS DOUBLE), 4) AS computed,
              list(child) AS found FROM terms JOIN facts ON code = child GROUP BY ALL)
      SELECT {', '.join('k.' + c.strip() for c in keys.split(','))}, k.formula, k.computed, f.value AS reported,
        round(k.computed - f.value, 4) AS diff, {ok} AS ok,
        array_to_string(list_filter(string_split(w, ','), lambda x: NOT list_contains(k.found, x)), ',') AS missing
      FROM k JOIN facts f ON {' AND '.join('f.' + c.strip() + ' = k.' + c.strip() for c in keys.split(','))} AND f.code = k.parent
      JOIN wanted USING (formula)"""


_NONZERO = """SELECT doc_id, code, period_ord, CASE period_ord WHEN 0 THEN b.cy ELSE b.py END AS value FROM
   (SELECT doc_id, code, arg_max({{'cy': cy, 'py': py}}, {{'nz': abs(cy) + abs(py) <> 0, 't': table_idx, 'r': row_idx}}) AS b FROM {t} GROUP BY 1, 2),
   (VALUES (0), (1)) p(period_ord)"""
_SUMMED = """SELECT doc_id, code, period_ord, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 4) AS value FROM fsl
   WHERE regexp_matches(code, '^[0-9]+[A-Z]?$') GROUP BY 1, 2, 3"""


@query(
    "balance_parent_children",
    _formula_oracle(O.BS, _NONZERO.format(t="fs"), C.BALANCE_RULES, "round(k.computed - f.value, 4) = 0"),
)
def balance_parent_children(spark, sf):
    return S.balance_check(V.statement_rows(spark, sf, "FS_BALANCE_SHEET"))


@query(
    "balance_parent_children_rounded",
    _formula_oracle(O.BS, _NONZERO.format(t="fs"), C.BALANCE_RULES, "abs(round(k.computed - f.value, 4)) <= 0.5"),
)
def balance_parent_children_rounded(spark, sf):
    return S.balance_check(V.statement_rows(spark, sf, "FS_BALANCE_SHEET"), exact=False)


@query(
    "income_formulas_baseline",
    _formula_oracle(O.FS, _NONZERO.format(t="fs"), C.INCOME_RULES_BASELINE, "round(k.computed - f.value, 4) = 0"),
)
def income_formulas_baseline(spark, sf):
    return S.income_check_baseline(V.statement_rows(spark, sf))


def _with_gaps(spark, sf):
    """Cash-flow rows where every 18 lost its code, so the uncoded-row rule has work."""
    rows = V.statement_rows(spark, sf, "FS_CASH_FLOW")
    return rows.withColumn("code", F.when(F.col("code") == "18", "").otherwise(F.col("code")))


_CF_FACTS = """SELECT * FROM (WITH g AS MATERIALIZED (SELECT doc_id, CASE WHEN code = '18' THEN '' ELSE code END AS code, cy, py, CAST(table_idx AS HUGEINT) * 1000000000000000000 + row_idx AS pos FROM fs),
   f AS MATERIALIZED (SELECT doc_id, min(pos) AS first FROM g WHERE code BETWEEN '14' AND '20' GROUP BY 1),
   b AS MATERIALIZED (SELECT doc_id, max(pos) AS pos FROM g JOIN f USING (doc_id) WHERE pos < first GROUP BY 1),
   i AS (SELECT g.doc_id, cy, py FROM g JOIN b USING (doc_id, pos) WHERE code = '' AND abs(cy) + abs(py) <> 0),
   s AS MATERIALIZED (SELECT doc_id, code, round(CAST(sum(CAST(cy AS DECIMAL(20,4))) AS DOUBLE), 4) AS cy,
           round(CAST(sum(CAST(py AS DECIMAL(20,4))) AS DOUBLE), 4) AS py FROM g WHERE regexp_matches(code, '^[0-9]+[A-Z]?$') GROUP BY 1, 2
         UNION ALL SELECT doc_id, '18', cy, py FROM i)
   SELECT doc_id, code, 0 AS period_ord, cy AS value FROM s UNION ALL SELECT doc_id, code, 1, py FROM s)"""


@query(
    "cash_flow_formulas_baseline",
    _formula_oracle(O.FS, _CF_FACTS, C.CASH_FLOW_RULES_BASELINE, "round(k.computed - f.value, 4) = 0"),
)
def cash_flow_formulas_baseline(spark, sf):
    return S.cash_flow_check_baseline(_with_gaps(spark, sf))


def _evidence_sql(body, kind_cols, severity="MAJOR"):
    """Wrap a body that yields kind_cols, expected, actual, base into evidence columns."""
    return f"""SELECT {kind_cols}, expected, actual, round(actual - expected, 4) AS diff,
      greatest(1.0, least(0.008 * abs(base), 1000000.0)) AS tolerance,
      abs(round(actual - expected, 4)) > greatest(1.0, least(0.008 * abs(base), 1000000.0)) AS is_material,
      CASE WHEN abs(round(actual - expected, 4)) > greatest(1.0, least(0.008 * abs(base), 1000000.0)) THEN '{severity}' ELSE 'INFO' END AS severity
      FROM ({body})"""


EV = ["expected", "actual", "diff", "tolerance", "is_material", "severity"]


@query(
    "balance_identities",
    f"""WITH {O.BS}, facts AS (SELECT doc_id, table_idx, period_ord, code, arg_max(value, row_idx) AS value FROM fsl GROUP BY 1, 2, 3, 4),
      terms(formula, parent, child, sign, ord) AS {_values(C.signed_terms(C.BALANCE_IDENTITIES))},
      k AS (SELECT doc_id, table_idx, period_ord, formula, parent, round(sum(value), 4) AS computed FROM terms JOIN facts ON code = child GROUP BY ALL)
      {_evidence_sql('''SELECT k.doc_id, k.table_idx, k.period_ord, k.formula AS assertion, f.value AS expected, k.computed AS actual,
          greatest(abs(f.value), abs(k.computed)) AS base FROM k JOIN facts f ON f.doc_id = k.doc_id AND f.table_idx = k.table_idx
          AND f.period_ord = k.period_ord AND f.code = k.parent''', 'doc_id, table_idx, period_ord, assertion')}""",
)
def balance_identities(spark, sf):
    items = S.long_items(V.statement_rows(spark, sf, "FS_BALANCE_SHEET"))
    return S.balance_identities(items).select("doc_id", "table_idx", "period_ord", "assertion", *EV)


@query(
    "income_formulas_templates",
    f"""WITH {O.FS}, fl AS (SELECT * REPLACE (CASE WHEN code = '40' AND doc_id % 3 = 0 THEN 'Other (40 = 31 - (32 - 33))' ELSE label END AS label) FROM fs),
      facts AS ({_SUMMED}),
      d AS (SELECT doc_id, bool_or(code = '10') AS h10, bool_or(code IN ('23','24','27')) AS h24, bool_or(label LIKE '%(40 = %') AS ex FROM fl GROUP BY 1),
      t(formula, parent, child, sign, variant) AS (VALUES ('10','10','01',1,'h10'),('10','10','02',-1,'h10'),('20','20','10',1,'h10'),('20','20','11',-1,'h10'),
       ('20','20','01',1,'n10'),('20','20','02',-1,'n10'),('20','20','11',-1,'n10'),
       ('30','30','20',1,'a'),('30','30','21',1,'a'),('30','30','22',-1,'a'),('30','30','24',1,'h24'),('30','30','25',-1,'a'),('30','30','26',-1,'a'),
       ('40','40','31',1,'no40'),('40','40','32',-1,'no40'),('40','40','31',1,'ex40'),('40','40','32',-1,'ex40'),('40','40','33',1,'ex40'),
       ('50','50','30',1,'a'),('50','50','40',1,'a'),('60','60','50',1,'a'),('60','60','51',-1,'a'),('60','60','52',-1,'a'),
       ('60 by owner','60','61',1,'a'),('60 by owner','60','62',1,'a')),
      k AS (SELECT d.doc_id, formula, parent, period_ord, round(CAST(sum(CAST(sign * value AS DECIMAL(20,4))) AS DOUBLE), 4) AS computed
        FROM d JOIN t ON variant = 'a' OR (variant = 'h10' AND h10) OR (variant = 'n10' AND NOT h10) OR (variant = 'h24' AND h24)
          OR (variant = 'no40' AND NOT ex) OR (variant = 'ex40' AND ex)
        JOIN facts ON facts.doc_id = d.doc_id AND facts.code = child GROUP BY ALL)
      SELECT k.doc_id, k.period_ord, formula, computed, f.value AS reported, round(computed - f.value, 4) AS diff,
        abs(round(computed - f.value, 4)) <= 0.5 AS ok
      FROM k JOIN facts f ON f.doc_id = k.doc_id AND f.period_ord = k.period_ord AND f.code = parent""",
)
def income_formulas_templates(spark, sf):
    rows = V.statement_rows(spark, sf)
    rows = rows.withColumn(
        "label",
        F.when((F.col("code") == "40") & (F.col("doc_id") % 3 == 0), "Other (40 = 31 - (32 - 33))").otherwise(F.col("label")),
    )
    return S.income_check_templates(rows)


@query(
    "income_rules",
    f"""WITH {O.FS}, s AS (SELECT doc_id, period_ord,
        {', '.join(f"coalesce(round(CAST(sum(CASE WHEN code = '{c}' THEN CAST(value AS DECIMAL(20,4)) END) AS DOUBLE), 4), 0) AS s{c}" for c in '01 02 10 11 21 22 25 26 31 32 51 52'.split())},
        {', '.join(f"arg_min(value, {{'t': table_idx, 'r': row_idx}}) FILTER (code = '{c}') AS f{c}" for c in '20 30 40 50 60'.split())},
        coalesce(arg_min(value, {{'t': table_idx, 'r': row_idx}}) FILTER (code = '24' AND lower(label) LIKE '%share%'),
                 arg_min(value, {{'t': table_idx, 'r': row_idx}}) FILTER (lower(label) LIKE '%share of%'),
                 arg_min(value, {{'t': table_idx, 'r': row_idx}}) FILTER (code = '24')) AS f24,
        bool_or(code = '10') AS h10 FROM fsl GROUP BY 1, 2),
      e AS (SELECT doc_id, period_ord, '20' AS c, f20 AS expected, CASE WHEN h10 THEN s10 - s11 ELSE s01 - s02 - s11 END AS a FROM s
       UNION ALL SELECT doc_id, period_ord, '30', f30, coalesce(f20,0) + s21 - s22 + coalesce(f24,0) - s25 - s26 FROM s
       UNION ALL SELECT doc_id, period_ord, '40', f40, s31 - s32 FROM s
       UNION ALL SELECT doc_id, period_ord, '50', f50, coalesce(f30,0) + coalesce(f40,0) FROM s
       UNION ALL SELECT doc_id, period_ord, '60', f60, coalesce(f50,0) - s51 - s52 FROM s)
      {_evidence_sql("SELECT doc_id, period_ord, 'Formula code ' || c AS assertion, expected, round(a, 4) AS actual, greatest(abs(expected), abs(round(a, 4))) AS base FROM e WHERE expected IS NOT NULL", 'doc_id, period_ord, assertion')}""",
)
def income_rules(spark, sf):
    return S.income_rules(S.long_items(V.statement_rows(spark, sf))).select("doc_id", "period_ord", "assertion", *EV)


def _in(codes):
    return "(" + ",".join(f"'{c}'" for c in codes.split()) + ")"


def _tot(codes):
    return f"coalesce(round(CAST(sum(CASE WHEN code IN {_in(codes)} THEN CAST(value AS DECIMAL(20,4)) END) AS DOUBLE), 4), 0)"


@query(
    "cash_flow_rules",
    f"""WITH {O.FS}, g AS (SELECT * REPLACE (CASE WHEN code = '13' AND lower(label) LIKE '%cash generated from operations%' THEN '' ELSE code END AS code) FROM fsl),
      s AS (SELECT doc_id, table_idx, period_ord, {_tot('09 10 11 12 14 15 17')} AS ops, {_tot('13')} AS s13, {_tot('21 22 23 24 25 26 27')} AS s30,
        {_tot('31 32 33 34 35 36')} AS s40, {_tot('60 61')} AS s6061, {_tot('20')} AS t20,
        count(*) FILTER (code = '13') AS n13, min(row_idx) FILTER (code = '12') AS p12, min(row_idx) FILTER (code = '13') AS p13, max(row_idx) FILTER (code = '14') AS p14,
        {', '.join(f"arg_min(value, row_idx) FILTER (code = '{c}') AS f{c}" for c in '08 20 30 40 50 70'.split())} FROM g GROUP BY 1, 2, 3),
      d AS (SELECT doc_id, period_ord, round(sum(t20), 4) AS doc20 FROM s GROUP BY 1, 2),
      j AS (SELECT * FROM s JOIN d USING (doc_id, period_ord)),
      e AS (SELECT doc_id, table_idx, period_ord, '20' AS c, f20 AS expected, coalesce(f08, 0) + ops + CASE WHEN n13 = 1 AND p12 < p13 AND p14 > p13 THEN 0 ELSE s13 END AS a FROM j
       UNION ALL SELECT doc_id, table_idx, period_ord, '30', f30, s30 FROM j UNION ALL SELECT doc_id, table_idx, period_ord, '40', f40, s40 FROM j
       UNION ALL SELECT doc_id, table_idx, period_ord, '50', f50, doc20 + coalesce(f30, 0) + coalesce(f40, 0) FROM j
       UNION ALL SELECT doc_id, table_idx, period_ord, '70', f70, coalesce(f50, 0) + s6061 FROM j)
      {_evidence_sql("SELECT doc_id, table_idx, period_ord, 'Formula code ' || c AS assertion, expected, round(a, 4) AS actual, greatest(abs(expected), abs(round(a, 4))) AS base FROM e WHERE expected IS NOT NULL", 'doc_id, table_idx, period_ord, assertion')}""",
)
def cash_flow_rules(spark, sf):
    items = S.long_items(V.statement_rows(spark, sf, "FS_CASH_FLOW"))
    return S.cash_flow_rules(items).select("doc_id", "table_idx", "period_ord", "assertion", *EV)


@query(
    "cash_flow_registry",
    f"""WITH {O.FS}, facts AS ({_SUMMED}),
      t0(formula, parent, child, sign, ord) AS {_values(C.signed_terms(C.CASH_FLOW_PROFILES))},
      sizes AS (SELECT parent, count(*) AS n FROM t0 GROUP BY 1),
      d AS (SELECT doc_id, doc_id % 2 = 0 AND bool_or(code = '40') AS ex FROM fs GROUP BY 1),
      ch AS (SELECT doc_id, parent, child, sign, 'profile' AS src FROM d, t0 WHERE NOT (parent = '40' AND ex)
        UNION ALL SELECT doc_id, '40', c, s, 'explicit' FROM d, (VALUES ('31', 1), ('32', -1)) v(c, s) WHERE ex),
      k AS (SELECT ch.doc_id, parent, src, period_ord, round(CAST(sum(CAST(sign * value AS DECIMAL(20,4))) AS DOUBLE), 4) AS computed, count(*) AS present
        FROM ch JOIN facts ON facts.doc_id = ch.doc_id AND code = child GROUP BY ALL)
      SELECT k.doc_id, k.period_ord, k.parent AS formula, computed, f.value AS reported, round(computed - f.value, 4) AS diff,
        CASE WHEN src = 'explicit' THEN 'explicit_inline_formula' WHEN present >= greatest(2, least(4, n // 2)) THEN 'section_profile' ELSE 'legacy_profile_only' END AS source,
        abs(round(computed - f.value, 4)) <= 0.5 AS ok
      FROM k JOIN facts f ON f.doc_id = k.doc_id AND f.period_ord = k.period_ord AND f.code = k.parent JOIN sizes ON sizes.parent = k.parent""",
)
def cash_flow_registry(spark, sf):
    rows = V.statement_rows(spark, sf, "FS_CASH_FLOW")
    rows = rows.withColumn(
        "label", F.when((F.col("code") == "40") & (F.col("doc_id") % 2 == 0), "Net = 31 - 32").otherwise(F.col("label"))
    )
    return S.cash_flow_registry_check(rows)


@query(
    "statement_reconciliation",
    f"""WITH {O.FS}, li AS (SELECT doc_id, period_ord, code, arg_min(value, {{'t': table_idx, 'r': row_idx}}) AS v FROM fsl GROUP BY 1, 2, 3),
      n AS (SELECT doc_id, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 4) AS v FROM fsl WHERE code = '04' AND period_ord = 0 GROUP BY 1),
      e AS (SELECT a.doc_id, a.period_ord, 'RECON_CF_VS_BS_CASH' AS rule_id, b.v AS expected, a.v AS actual FROM li a JOIN li b USING (doc_id, period_ord) WHERE a.code = '70' AND b.code = '11'
       UNION ALL SELECT a.doc_id, a.period_ord, 'RECON_IS_VS_EQUITY_PROFIT', a.v, b.v FROM li a JOIN li b USING (doc_id, period_ord) WHERE a.code = '60' AND b.code = '50'
       UNION ALL SELECT n.doc_id, 0, 'RECON_NOTE_4_CASH_VS_BS', b.v, n.v FROM n JOIN li b ON b.doc_id = n.doc_id AND b.period_ord = 0 AND b.code = '11')
      {_evidence_sql('SELECT *, greatest(abs(expected), abs(actual)) AS base FROM e', 'doc_id, period_ord, rule_id')}""",
)
def statement_reconciliation(spark, sf):
    items = S.long_items(V.statement_rows(spark, sf))
    # the view's code 11 stands for cash on the balance sheet, code 04 for the cash note
    balance = items.withColumn("code", F.when(F.col("code") == "11", "110").otherwise(F.col("code")))
    note = S.dedup_sum(items.where("code = '04' AND period_ord = 0"), ["doc_id"])
    return S.reconcile_statements(items, balance, items, items, note).select("doc_id", "period_ord", "rule_id", *EV)


@query(
    "derived_account_facts",
    f"""WITH {O.BS}, spec(account_key, code, sign) AS {_values([x for x in C.DERIVED_FACTS])}
      SELECT doc_id, account_key, period_ord, round(CAST(sum(CAST(sign * value AS DECIMAL(20,4))) AS DOUBLE), 4) AS value FROM fsl JOIN spec USING (code) GROUP BY 1, 2, 3""",
)
def derived_account_facts(spark, sf):
    return S.derived_facts(S.long_items(V.statement_rows(spark, sf, "FS_BALANCE_SHEET")))


for _name, _fn, _sql in [
    ("duplicate_codes_sum", S.dedup_sum, "round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 4)"),
    ("duplicate_codes_first", S.dedup_first, "arg_min(value, {'t': table_idx, 'r': row_idx})"),
    ("duplicate_codes_last", S.dedup_last, "arg_max(value, {'t': table_idx, 'r': row_idx})"),
]:

    @query(_name, f"WITH {O.FS} SELECT doc_id, code, period_ord, {_sql} AS value FROM fsl GROUP BY 1, 2, 3")
    def _dedup(spark, sf, _fn=_fn):
        return _fn(S.long_items(V.statement_rows(spark, sf)), ["doc_id", "code", "period_ord"])


@query(
    "duplicate_codes_keep_nonzero",
    f"""WITH {O.FS}, b AS (SELECT doc_id, code, arg_max({{'cy': cy, 'py': py}}, {{'nz': abs(cy) + abs(py) <> 0, 't': table_idx, 'r': row_idx}}) AS b FROM fs GROUP BY 1, 2)
      SELECT doc_id, code, b.cy AS cy, b.py AS py FROM b""",
)
def duplicate_codes_keep_nonzero(spark, sf):
    return S.dedup_keep_nonzero(V.statement_rows(spark, sf), ["doc_id", "code"])


@query(
    "line_item_lookup",
    f"WITH {O.FS} SELECT doc_id, period_ord, arg_min(value, {{'t': table_idx, 'r': row_idx}}) AS value FROM fsl WHERE code = '30' GROUP BY 1, 2",
)
def line_item_lookup(spark, sf):
    return S.line_item(S.long_items(V.statement_rows(spark, sf)), "30", "value")


@query(
    "code_and_label_lookup",
    f"""WITH {O.FS} SELECT doc_id, code, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 4) AS value, count(*) AS n
       FROM fsl WHERE contains(lower(label), 'share of') GROUP BY 1, 2""",
)
def code_and_label_lookup(spark, sf):
    from tieout.functions.evidence import clean_sum

    items = S.find_by_label(S.long_items(V.statement_rows(spark, sf)), "Share OF")
    return items.groupBy("doc_id", "code").agg(clean_sum(F.col("value")).alias("value"), F.count(F.lit(1)).alias("n"))


@query(
    "statement_parts_union",
    f"""WITH {O.FS} SELECT doc_id, CASE WHEN row_idx % 7 = 0 THEN lpad(CAST(row_idx % 13 AS VARCHAR), 2, '0') ELSE code END AS code, count(*) AS n, min(table_idx) AS first_table
       FROM fs GROUP BY 1, 2""",
)
def statement_parts_union(spark, sf):
    rows = V.statement_rows(spark, sf)
    # every seventh code slid into the note column
    lost = F.col("row_idx") % 7 == 0
    shifted = rows.withColumn("note", F.when(lost, (F.col("row_idx") % 13).cast("string")).otherwise("")).withColumn(
        "code", F.when(lost, "").otherwise(F.col("code"))
    )
    merged = S.union_parts(shifted.where("table_idx < 3"), shifted.where("table_idx >= 3"))
    return merged.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min("table_idx").alias("first_table"))


@query(
    "narrative_statements",
    f"""WITH {O.BS}, c AS (SELECT doc_id, table_idx, CASE WHEN row_idx % 10 < table_idx THEN chr(CAST(97 + row_idx % 26 AS INTEGER)) ELSE code END AS code FROM fs)
       SELECT doc_id, 'T' || table_idx AS statement_type, avg(CASE WHEN regexp_matches(lower(code), '^[a-z]$') THEN 1.0 ELSE 0.0 END) >= 0.3 AS is_narrative FROM c GROUP BY 1, 2""",
)
def narrative_statements(spark, sf):
    rows = V.statement_rows(spark, sf, "FS_BALANCE_SHEET")
    rows = rows.withColumn(
        "code", F.when(F.col("row_idx") % 10 < F.col("table_idx"), F.char(97 + F.col("row_idx") % 26)).otherwise(F.col("code"))
    ).withColumn("statement_type", F.concat(F.lit("T"), F.col("table_idx")))
    return S.is_narrative(rows)


@query(
    "balance_form_signature",
    f"""WITH {O.BS}, h AS (SELECT doc_id * 10 + table_idx AS doc_id, count(DISTINCT code) FILTER (code IN {tuple(C.NEW_FORM_MARKERS)}) AS new_hits,
       count(DISTINCT code) FILTER (code IN {tuple(C.OLD_FORM_MARKERS)}) AS old_hits FROM fs GROUP BY 1) SELECT *, new_hits > old_hits AS is_new_form FROM h""",
)
def balance_form_signature(spark, sf):
    rows = V.statement_rows(spark, sf, "FS_BALANCE_SHEET")
    return S.balance_form(rows.withColumn("doc_id", F.col("doc_id") * 10 + F.col("table_idx")))


@query(
    "user_formula_table",
    f"""WITH {O.FS}, r AS (SELECT DISTINCT l_partkey % 60 AS a FROM lineitem), t AS (SELECT 'U' || a AS formula, lpad(CAST(a AS VARCHAR), 2, '0') AS parent, lpad(CAST(a + d AS VARCHAR), 2, '0') AS child, CASE d WHEN 2 THEN -1 ELSE 1 END AS sign FROM r, (VALUES (1), (2)) x(d)),
      facts AS ({_SUMMED}), k AS (SELECT doc_id, period_ord, formula, parent, round(CAST(sum(CAST(sign * value AS DECIMAL(20,4))) AS DOUBLE), 4) AS computed, count(*) AS n FROM t JOIN facts ON code = child GROUP BY ALL)
      SELECT k.doc_id, k.period_ord, formula, computed, f.value AS reported, round(computed - f.value, 4) AS diff, abs(round(computed - f.value, 4)) <= 0.5 AS ok FROM k JOIN facts f ON f.doc_id = k.doc_id AND f.period_ord = k.period_ord AND f.code = parent""",
)
def user_formula_table(spark, sf):
    # a formula table that a user derives from data: each code ties to the next two
    a = V.table(spark, sf, "lineitem").select((F.col("l_partkey") % 60).alias("a")).distinct()
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    terms = a.withColumn("d", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat(F.lit("U"), "a").alias("formula"), pad(F.col("a")).alias("parent"), pad(F.col("a") + F.col("d")).alias("child"),
        F.when(F.col("d") == 2, -1).otherwise(1).alias("sign"),
    )
    facts = S.dedup_sum(S.long_items(V.statement_rows(spark, sf)), ["doc_id", "code", "period_ord"])
    return S.check_formulas(facts, terms, ["doc_id", "period_ord"], exact=False).drop("missing")
