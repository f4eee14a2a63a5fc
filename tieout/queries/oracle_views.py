"""DuckDB spellings of the document-shaped views, as CTE bodies."""

from tieout.plans.views import BALANCE_CODES, RULE_IDS, STATUS_TEXTS

LINES = """lines AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS row_idx
  FROM lineitem)"""

NOTE = f"""{LINES},
note_sums AS (
  SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS s, count(*) AS n
  FROM lineitem GROUP BY 1),
note AS (
  SELECT o_custkey AS doc_id, l_orderkey AS table_idx, row_idx,
         'Item ' || l_linenumber AS label, l_extendedprice AS value
  FROM lines JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_custkey, o_orderkey, CAST(n AS INTEGER), '', NULL FROM note_sums JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_custkey, o_orderkey, CAST(n + 1 AS INTEGER), 'Total',
         CASE WHEN o_orderkey % 3 = 0 THEN s ELSE o_totalprice END
  FROM note_sums JOIN orders ON l_orderkey = o_orderkey)"""

_BS = "[" + ",".join(f"'{c}'" for c in BALANCE_CODES) + "]"


def statement(code: str) -> str:
    return f"""fs AS (
  SELECT l_suppkey AS doc_id, CAST(year(l_shipdate) - 1995 AS INTEGER) AS table_idx,
         (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey AS row_idx,
         {code} AS code,
         CASE l_partkey % 5 WHEN 0 THEN 'Share of profit of associates'
              WHEN 1 THEN 'Cash generated from operations' WHEN 2 THEN 'Total expenses'
              ELSE 'Other items' END AS label,
         CASE WHEN l_quantity = 7 THEN 0 ELSE l_extendedprice END AS cy,
         CASE WHEN l_quantity = 7 THEN 0 ELSE round(l_extendedprice - l_quantity, 2) END AS py
  FROM lineitem),
fsl AS (
  SELECT doc_id, table_idx, row_idx, code, label, 0 AS period_ord, cy AS value FROM fs
  UNION ALL
  SELECT doc_id, table_idx, row_idx, code, label, 1, py FROM fs)"""


FS = statement("lpad(CAST(l_partkey % 71 AS VARCHAR), 2, '0')")
BS = statement(f"{_BS}[CAST(l_partkey % {len(BALANCE_CODES)} AS INTEGER) + 1]")

ROLL = """roll AS (
  SELECT user_id AS doc_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS table_idx,
         CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INTEGER) AS row_idx,
         CASE event_type WHEN 'signup' THEN 'OPENING' WHEN 'purchase' THEN 'CLOSING' ELSE 'MOVEMENT' END AS kind,
         CASE event_type WHEN 'signup' THEN 'Opening balance' WHEN 'purchase' THEN 'Closing balance'
              WHEN 'click' THEN 'Additions' WHEN 'view' THEN 'Other items' ELSE 'Cost' END AS label,
         value, event_type, ts, event_id
  FROM events)"""


def locale(amount: str, pick: str) -> str:
    grouped = f"format('{{:,.2f}}', {amount})"
    plain = f"CAST(CAST({amount} AS DECIMAL(18,2)) AS VARCHAR)"
    return f"""CASE {pick} WHEN 0 THEN {plain} WHEN 1 THEN {grouped}
      WHEN 2 THEN translate({grouped}, ',.', '.,') WHEN 3 THEN '(' || {grouped} || ')'
      WHEN 4 THEN {plain} || ' -' WHEN 5 THEN 'VND ' || {grouped}
      WHEN 6 THEN replace(format('{{:,}}', CAST(floor({amount}) AS BIGINT)), ',', chr(160))
      ELSE '—' END"""


CELLS = f"""{LINES},
heads AS (SELECT l_orderkey, max(year(l_shipdate)) AS y FROM lineitem GROUP BY 1),
cells AS (
  SELECT l_orderkey % 1000 AS doc_id, l_orderkey AS table_idx, row_idx + 1 AS row_idx, c.col_idx AS col_idx, c.text AS text
  FROM (SELECT *, unnest([
     {{'col_idx': 0, 'text': 'Item ' || l_partkey}},
     {{'col_idx': 1, 'text': lpad(CAST(l_partkey % 71 AS VARCHAR), 2, '0')}},
     {{'col_idx': 2, 'text': CASE WHEN l_partkey % 4 = 0 THEN CAST(l_partkey % 30 AS VARCHAR) ELSE '' END}},
     {{'col_idx': 3, 'text': {locale('l_extendedprice', 'l_partkey % 8')}}},
     {{'col_idx': 4, 'text': {locale('round(l_extendedprice - l_quantity, 2)', 'l_partkey % 8')}}}]) AS c FROM lines)
  UNION ALL
  SELECT l_orderkey % 1000, l_orderkey, 0, c.col_idx, c.text
  FROM (SELECT *, unnest([
     {{'col_idx': 0, 'text': 'Description'}},
     {{'col_idx': 1, 'text': CASE WHEN l_orderkey % 5 = 0 THEN 'Item code' ELSE 'Code' END}},
     {{'col_idx': 2, 'text': 'Note'}},
     {{'col_idx': 3, 'text': '31/12/' || y}},
     {{'col_idx': 4, 'text': 'Year ' || (y - 1)}}]) AS c FROM heads))"""

BLOCKS = """bsums AS (SELECT l_orderkey, l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1, 2),
braw AS (
  SELECT l_orderkey, l_returnflag AS b, 0 AS part, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, 'Item ' || l_linenumber AS label, l_extendedprice AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_returnflag, part, 0, 0, 0, CASE part WHEN 2 THEN 'Subtotal' ELSE '' END,
     CASE part WHEN 2 THEN round(s + CASE WHEN l_orderkey % 4 = 0 THEN 5 ELSE 0 END, 2) END FROM bsums, (VALUES (1), (2), (3)) p(part)
  UNION ALL SELECT l_orderkey, 'Z', 4, 0, 0, 0, 'Total', round(sum(s), 2) FROM bsums GROUP BY 1),
blocks AS (SELECT l_orderkey % 1000 AS doc_id, l_orderkey AS table_idx,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY b, part, ln, pk, sk, value) - 1 AS INTEGER) AS row_idx, label, value, b, part FROM braw)"""

NETTING = LINES + """,
netting AS (SELECT l_orderkey % 1000 AS doc_id, l_orderkey AS table_idx, row_idx,
  CASE l_returnflag WHEN 'A' THEN 'Gross total' WHEN 'R' THEN 'Less: allowances' ELSE 'Net amount' END AS label,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS value FROM lines)"""

DAILY = """dw AS (SELECT user_id AS doc_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS table_idx, CAST(hour(ts) AS INTEGER) AS row_idx,
  round(sum(value) FILTER (event_type = 'signup'), 2) AS s, round(sum(value) FILTER (event_type = 'click'), 2) AS c,
  round(sum(value) FILTER (event_type = 'view'), 2) AS v, round(sum(value) FILTER (event_type = 'purchase'), 2) AS p FROM events GROUP BY 1, 2, 3),
daily AS (SELECT doc_id, table_idx, row_idx, coalesce(s, 0) AS ob, c AS m1, v AS m2,
  CASE WHEN doc_id % 3 = 0 THEN round(coalesce(s, 0) + coalesce(c, 0) + coalesce(v, 0), 2) ELSE coalesce(p, 0) END AS cb FROM dw)"""


def _pick(xs, e):
    return "[" + ",".join(f"'{x}'" for x in xs) + f"][CAST({e} + 1 AS INTEGER)]"


RESULTS = f"""res AS (SELECT o_custkey AS doc_id, o_orderkey AS table_idx, {_pick(STATUS_TEXTS, f'o_orderkey % {len(STATUS_TEXTS)}')} AS status,
  {_pick(RULE_IDS, f'o_orderkey % {len(RULE_IDS)}')} AS rule_id, {_pick(['PASS', 'FAIL', 'WARN', 'FAIL_TOOL_EXTRACT', 'INFO_SKIPPED', 'FAIL_TOOL_LOGIC', 'ERROR', 'PASS', 'FAIL_TOOL_EXTRACT'], 'o_orderkey % 9')} AS enum,
  o_totalprice AS max_diff, o_orderpriority || ' ' || (o_orderkey % 50) AS heading, 'file_' || (o_custkey % 20) AS source,
  ['ooxml', 'ooxml_fallback', 'render'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS engine, (o_orderkey % 11) / 10.0 AS q, o_orderkey % 13 AS flag,
  o_orderkey % 5 AS assertions, (o_orderkey % 9) / 10.0 AS ev, o_orderpriority AS validator_type, o_orderstatus AS failure_reason_code FROM orders)"""

SEVERITY = """CASE WHEN rule_id IN ('MATH_EQ', 'CROSS_CHECK_MISMATCH', 'ROW_TOTAL_GRAND_TOTAL') THEN CASE WHEN max_diff >= 100000 THEN 'HIGH' WHEN max_diff >= 10000 THEN 'MEDIUM' ELSE 'LOW' END
  WHEN rule_id = 'BALANCE_SHEET_VALIDATION' THEN 'MEDIUM' WHEN rule_id = 'FAIL_TOOL_LOGIC_VALIDATOR_CRASH' THEN 'HIGH' ELSE 'LOW' END"""
CONFIDENCE = """CASE WHEN table_idx % 4 = 1 THEN 'MEDIUM' WHEN rule_id IN ('MATH_EQ', 'CROSS_CHECK_MISMATCH') THEN 'HIGH' WHEN table_idx % 4 = 2 THEN 'LOW' ELSE 'HIGH' END"""
