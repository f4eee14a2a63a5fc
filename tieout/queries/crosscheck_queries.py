"""Account facts, as-of reads, first use, tie-outs, catalogues and rates."""

from pyspark.sql import functions as F

from tieout import catalogue as C
from tieout.operators import classify as Y
from tieout.operators import crosscheck as K
from tieout.plans import views as V
from tieout.queries import oracle_views as O
from tieout.queries.registry import query
from tieout.queries.statement_queries import EV, _evidence_sql, _values


def _facts(spark, sf):
    o = V.table(spark, sf, "orders").where("o_orderkey % 2 = 0")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("account_key"), F.col("o_orderkey").alias("seq"),
                    F.col("o_totalprice").alias("cy"), F.round(F.col("o_totalprice") - F.col("o_orderkey") % 7, 2).alias("py"))


def _probes(spark, sf):
    o = V.table(spark, sf, "orders").where("o_orderkey % 2 = 1")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("account_key"), F.col("o_orderkey").alias("seq"),
                    F.col("o_orderkey").alias("table_idx"), F.col("o_orderstatus").alias("heading"),
                    F.col("o_totalprice").alias("cy"), F.col("o_totalprice").alias("py"))


_LOG = """fl AS (SELECT o_custkey AS doc_id, o_orderpriority AS account_key, o_orderkey AS seq, o_totalprice AS cy, round(o_totalprice - o_orderkey % 7, 2) AS py FROM orders WHERE o_orderkey % 2 = 0),
  pr AS (SELECT o_custkey AS doc_id, o_orderpriority AS account_key, o_orderkey AS seq, o_totalprice AS cy, o_totalprice AS py FROM orders WHERE o_orderkey % 2 = 1),
  ao AS (SELECT pr.*, fl.cy AS fact_cy, fl.py AS fact_py FROM pr ASOF LEFT JOIN fl ON pr.doc_id = fl.doc_id AND pr.account_key = fl.account_key AND pr.seq > fl.seq)"""


@query("facts_as_of", f"WITH {_LOG} SELECT doc_id, account_key, seq, fact_cy, fact_py FROM ao")
def facts_as_of(spark, sf):
    return K.as_of_facts(_probes(spark, sf), _facts(spark, sf)).select("doc_id", "account_key", "seq", "fact_cy", "fact_py")


@query(
    "cross_check_baseline",
    f"WITH {_LOG} SELECT doc_id, account_key, seq, round(fact_cy - cy, 4) AS diff_cy, round(fact_py - py, 4) AS diff_py, abs(round(fact_cy - cy, 4)) <= 0.5 AS ok_cy, abs(round(fact_py - py, 4)) <= 0.5 AS ok_py FROM ao WHERE fact_cy IS NOT NULL",
)
def cross_check_baseline(spark, sf):
    return K.cross_check(_probes(spark, sf), _facts(spark, sf)).select("doc_id", "account_key", "seq", "diff_cy", "diff_py", "ok_cy", "ok_py")


def _odd(a, b):
    return f"(abs({a}) > 1000 AND abs({b}) > 1000 AND (abs({a}) > abs({b}) * 10 OR abs({b}) > abs({a}) * 10))"


@query(
    "cross_check_guarded",
    f"WITH {_LOG} SELECT doc_id, account_key, seq, round(cy - fact_cy, 4) AS diff_cy, abs(round(cy - fact_cy, 4)) <= 1 AS ok_cy FROM ao WHERE fact_cy IS NOT NULL AND NOT {_odd('cy', 'fact_cy')} AND NOT {_odd('py', 'fact_py')}",
)
def cross_check_guarded(spark, sf):
    return K.cross_check(_probes(spark, sf), _facts(spark, sf), guards=True).select("doc_id", "account_key", "seq", "diff_cy", "ok_cy")


@query(
    "accumulated_facts",
    """SELECT o_custkey AS doc_id, o_orderpriority AS account_key, o_orderkey AS seq, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey), 2) AS running_cy
       FROM orders""",
)
def accumulated_facts(spark, sf):
    o = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("account_key"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("cy"), F.col("o_totalprice").alias("py"), "o_orderstatus",
    )
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return K.running_facts(o, sign).select("doc_id", "account_key", "seq", F.round("running_cy", 2).alias("running_cy"))


@query("first_use_of_account", "SELECT o_custkey AS doc_id, o_orderpriority AS account_key, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2")
def first_use_of_account(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("account_key"), F.col("o_orderkey").alias("seq"))
    return K.first_use(o).select("doc_id", "account_key", "seq")


@query(
    "key_precedence",
    """WITH n AS (SELECT c_custkey AS doc_id, c_mktsegment AS a1, 'N' || c_nationkey AS a2, 'R' || n_regionkey AS a3 FROM customer JOIN nation ON c_nationkey = n_nationkey),
      o AS (SELECT DISTINCT o_custkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'N' || c_nationkey ELSE 'R' || n_regionkey END AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 5 = 0)
      SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.doc_id = n.doc_id AND k = a1) THEN a1 WHEN EXISTS (SELECT 1 FROM o WHERE o.doc_id = n.doc_id AND k = a2) THEN a2
        WHEN EXISTS (SELECT 1 FROM o WHERE o.doc_id = n.doc_id AND k = a3) THEN a3 ELSE 'code 131' END AS account_key FROM n""",
)
def key_precedence(spark, sf):
    # nation is a fixed 25-row table, so the optimizer's own size check broadcasts it
    c = V.table(spark, sf, "customer").join(V.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = c.select(
        F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("a1"), F.concat(F.lit("N"), "c_nationkey").alias("a2"),
        F.concat(F.lit("R"), "n_regionkey").alias("a3"),
    )
    o = V.table(spark, sf, "orders").where("o_orderkey % 5 = 0").join(names, F.col("o_custkey") == F.col("doc_id"))
    k = F.col("o_orderkey") % 3
    facts = o.select("doc_id", F.when(k == 0, F.col("a1")).when(k == 1, F.col("a2")).otherwise(F.col("a3")).alias("account_key"))
    cand = names.select("doc_id", F.expr("stack(4, a1, 1, a2, 2, a3, 3, 'code 131', cast(null as int)) as (account_key, priority)"))
    return K.resolve_key(cand, facts, ["doc_id"])


@query(
    "combined_account_choice",
    """SELECT o_custkey AS doc_id, CASE WHEN s AND l THEN 'combined' WHEN l AND NOT s THEN 'long' ELSE 'short' END AS account_key
       FROM (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS s, bool_or(o_orderpriority = '5-LOW') AS l FROM orders GROUP BY 1)""",
)
def combined_account_choice(spark, sf):
    p = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("s"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("l")
    )
    return p.select("doc_id", K.presence_key(F.col("s"), F.col("l"), "short", "long", "combined").alias("account_key"))


@query(
    "note_reconciliation_report",
    """WITH n AS (SELECT o_custkey AS doc_id, round(CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE), 2) AS s FROM orders GROUP BY 1),
      f AS (SELECT doc_id, round(s + floor(s * 0.005), 2) AS cy, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE s END AS py FROM n WHERE doc_id % 4 <> 3)
      SELECT n.doc_id, CASE WHEN f.doc_id IS NULL THEN 'UNMATCHED' WHEN abs(s - f.cy) <= greatest(1.0, 0.01 * greatest(abs(s), abs(f.cy), 1)) AND coalesce(abs(s - f.py) <= greatest(1.0, 0.01 * greatest(abs(s), abs(f.py), 1)), false) THEN 'MATCH' ELSE 'MISMATCH' END AS status,
        coalesce(round(abs(s - f.cy), 2), -1) AS delta_cy FROM n LEFT JOIN f USING (doc_id)""",
)
def note_reconciliation_report(spark, sf):
    n = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    notes = n.select("doc_id", F.lit("sales").alias("account_key"), F.col("s").alias("cy"), F.col("s").alias("py"))
    facts = n.where("doc_id % 4 <> 3").select(
        "doc_id", F.lit("sales").alias("account_key"), F.round(F.col("s") + F.floor(F.col("s") * 0.005), 2).alias("cy"), F.when(F.col("doc_id") % 5 != 0, F.col("s")).alias("py")
    )
    return K.note_report(notes, facts).select("doc_id", "status", F.coalesce(F.round("delta_cy", 2), F.lit(-1.0)).alias("delta_cy"))


_HEADINGS = ["cash", "accrued expenses – short-term", "inventories", "long-term borrowings", "Trading securities", "share capital", "revenue from sales of goods", "equity investments in other entities"]


def _slots(spark, sf):
    """Every order is a note with its heading; total price and line sums fill the slots."""
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    heading = F.element_at(F.array(*[F.lit(h) for h in _HEADINGS]), (k % 8 + 1).cast("int"))
    slot = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(w).alias("locator")) for s, w in
                               [("T1", ""), ("T1", "cost"), ("T1", "allowance"), ("G", ""), ("G", "carrying"), ("T2", "")]]))
    return o.select(
        F.col("o_custkey").alias("doc_id"), k.alias("table_idx"), heading.alias("heading"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("n_subtotals"), slot.alias("x"),
        F.col("o_totalprice").alias("cy"), F.round(F.col("o_totalprice") - 3, 2).alias("py"),
    ).select("doc_id", "table_idx", "heading", "n_subtotals", "x.slot", "x.locator", "cy", "py")


def _form_facts(spark, sf):
    o = V.table(spark, sf, "orders").where("o_orderkey % 3 = 0")
    accounts = ["cash", "accrued expenses", "141", "long-term borrowings", "trading securities", "10", "investments in other entities"]
    return o.select(
        F.col("o_custkey").alias("doc_id"), F.explode(F.array(*[F.lit(a) for a in accounts])).alias("account_key"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("cy"), F.round(F.col("o_totalprice") - 3, 2).alias("py"),
    )


@query(
    "note_tie_outs_by_form",
    f"""WITH fm(grp, mt, pat, slot, loc, account, sign, once) AS {_values([r[:7] + (int(r[7]),) for r in C.FORM_MAP])},
      h AS (SELECT o_custkey AS doc_id, o_orderkey AS table_idx, lower({O._pick(_HEADINGS, 'o_orderkey % 8')}) AS heading, CASE WHEN o_orderstatus = 'F' THEN 'S' ELSE 'M' END AS grp, slot, loc, o_totalprice AS cy, round(o_totalprice - 3, 2) AS py
        FROM orders, (VALUES ('T1', ''), ('T1', 'cost'), ('T1', 'allowance'), ('G', ''), ('G', 'carrying'), ('T2', '')) s(slot, loc)),
      p AS (SELECT doc_id, table_idx, h.slot, h.loc AS locator, once, CASE WHEN account = '' THEN heading ELSE account END AS account_key,
         sign * CASE WHEN h.loc = 'carrying' THEN py ELSE cy END AS cy, sign * CASE WHEN h.loc = 'carrying' THEN cy ELSE py END AS py
        FROM h JOIN fm ON fm.grp = h.grp AND fm.slot = h.slot AND fm.loc = h.loc AND CASE WHEN mt = 'exact' THEN heading = pat ELSE contains(heading, pat) END),
      f AS (SELECT o_custkey AS doc_id, account_key, o_orderkey AS seq, o_totalprice AS cy, round(o_totalprice - 3, 2) AS py FROM orders,
        (VALUES ('cash'), ('accrued expenses'), ('141'), ('long-term borrowings'), ('trading securities'), ('10'), ('investments in other entities')) a(account_key) WHERE o_orderkey % 3 = 0),
      j AS (SELECT p.*, f.cy AS fcy, f.py AS fpy FROM p ASOF JOIN f ON f.doc_id = p.doc_id AND f.account_key = p.account_key AND p.table_idx > f.seq),
      u AS (SELECT *, min(table_idx) OVER (PARTITION BY doc_id, account_key, once) AS first FROM j)
      SELECT doc_id, account_key, table_idx, slot, locator, round(fcy - cy, 4) AS diff_cy, abs(round(fcy - cy, 4)) <= 0.5 AS ok_cy, abs(round(fpy - py, 4)) <= 0.5 AS ok_py FROM u WHERE once = 0 OR table_idx = first""",
)
def note_tie_outs_by_form(spark, sf):
    out = K.tie_out_forms(_slots(spark, sf), _form_facts(spark, sf))
    return out.select("doc_id", "account_key", "table_idx", "slot", "locator", "diff_cy", "ok_cy", "ok_py")


@query(
    "fixed_asset_bands",
    """WITH s AS (SELECT l_orderkey AS k, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE), 2) AS p, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1),
      e AS (SELECT k, 'cost roll' AS c, round(p + q, 4) AS expected, CASE WHEN k % 5 = 0 THEN round(p + q + 9, 2) ELSE round(p + q, 2) END AS actual, q, p FROM s
       UNION ALL SELECT k, 'depreciation roll', round(q + 10, 4), round(q + 10, 2), q, p FROM s
       UNION ALL SELECT k, 'opening net', round(p - q, 4), round(p - q, 2), q, p FROM s
       UNION ALL SELECT k, 'closing net', round(CASE WHEN k % 5 = 0 THEN round(p + q + 9, 2) ELSE round(p + q, 2) END - round(q + 10, 2), 4), round(p - 10, 2), q, p FROM s)
      SELECT k % 1000 AS doc_id, k AS table_idx, c AS "check", expected, actual, abs(round(expected - actual, 4)) <= 0.5 AS ok FROM e""",
)
def fixed_asset_bands(spark, sf):
    s = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("p"), F.sum("l_quantity").alias("q"))
    p, q = F.col("p"), F.col("q")
    cost_cb = F.when(F.col("k") % 5 == 0, F.round(p + q + 9, 2)).otherwise(F.round(p + q, 2))
    labels = ["Cost", "Opening balance", "Additions", "Closing balance", "Accumulated depreciation", "Opening balance", "Charge for the year", "Closing balance", "Net book value", "Opening balance", "Closing balance"]
    none = F.lit(None).cast("double")
    values = [none, p, q, cost_cb, none, q, F.lit(10.0), F.round(q + 10, 2), none, F.round(p - q, 2), F.round(p - 10, 2)]
    value = F.when(F.col("row_idx") == 0, values[0])
    for i, v in enumerate(values[1:], start=1):
        value = value.when(F.col("row_idx") == i, v)
    rows = s.withColumn("row_idx", F.explode(F.array(*[F.lit(i) for i in range(len(labels))]))).select(
        (F.col("k") % 1000).alias("doc_id"), F.col("k").alias("table_idx"), "row_idx",
        F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("row_idx") + 1).alias("label"), value.alias("value"),
    )
    return K.fixed_assets(rows)


@query(
    "acquisition_identity",
    """WITH s AS (SELECT l_orderkey AS k, round(sum(l_extendedprice) FILTER (l_linenumber <= 3), 2) AS a, round(sum(l_extendedprice) FILTER (l_linenumber > 3), 2) AS g FROM lineitem GROUP BY 1)
      SELECT k % 1000 AS doc_id, k AS table_idx, round(coalesce(a, 0) + coalesce(g, 0), 4) AS expected, round(coalesce(a, 0) + coalesce(g, 0) + k % 2, 2) AS actual, k % 2 = 0 AS ok FROM s""",
)
def acquisition_identity(spark, sf):
    n = F.col("l_linenumber")
    s = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.round(F.sum(F.when(n <= 3, F.col("l_extendedprice"))), 2).alias("a"), F.round(F.sum(F.when(n > 3, F.col("l_extendedprice"))), 2).alias("g")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    labels = ["Net identifiable assets acquired", "Goodwill on acquisition", "Consideration transferred"]
    r = F.col("row_idx")
    rows = s.withColumn("row_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        (F.col("k") % 1000).alias("doc_id"), F.col("k").alias("table_idx"), "row_idx", F.element_at(F.array(*[F.lit(x) for x in labels]), r + 1).alias("label"),
        F.when(r == 0, F.col("a")).when(r == 1, F.col("g")).otherwise(F.round(z("a") + z("g") + F.col("k") % 2, 2)).alias("value"),
    )
    return K.signed_identity(rows, [("net identifiable", 1), ("goodwill", 1)], "consideration")


@query(
    "listed_cell_check",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE), 2) AS v, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2)
      {_evidence_sql("SELECT l_orderkey % 1000 AS doc_id, l_orderkey AS table_idx, l_linenumber AS row_idx, 'Cross-check price' AS assertion, round(v - q * 10, 2) AS expected, v AS actual, greatest(abs(round(v - q * 10, 2)), abs(v)) AS base FROM b", 'doc_id, table_idx, row_idx, assertion')}""",
)
def listed_cell_check(spark, sf):
    b = V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.sum("l_quantity").alias("q"))
    cells = b.select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_orderkey").alias("table_idx"), F.col("l_linenumber").alias("row_idx"), F.lit(0).alias("col_idx"), "value", "q")
    spec = cells.select("doc_id", "table_idx", "row_idx", "col_idx", F.round(F.col("value") - F.col("q") * 10, 2).alias("expected_value"), F.lit("price").alias("reference_name"))
    return K.listed_items(cells.drop("q"), spec).select("doc_id", "table_idx", "row_idx", "assertion", *EV)


@query(
    "anchor_index_join",
    """WITH a AS (SELECT s_nationkey AS doc_id, lower(s_name) AS label_norm, CAST(s_suppkey AS VARCHAR) AS note_ref_norm, s_acctbal AS value FROM supplier)
      SELECT n_nationkey AS doc_id, count(*) AS n_anchors, round(CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE), 2) AS total, min(note_ref_norm) AS first_ref FROM nation JOIN a ON doc_id = n_nationkey GROUP BY 1""",
)
def anchor_index_join(spark, sf):
    s = V.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("doc_id"), F.lit("FS_BALANCE_SHEET").alias("statement_type"), F.lit(0).alias("table_idx"), F.col("s_suppkey").alias("row_idx"),
        F.lit("1-10").alias("code"), F.col("s_name").alias("label"), F.col("s_name").alias("note_ref"), F.lit(0).alias("period_ord"), F.col("s_acctbal").alias("value"),
    )
    a = K.anchor_index(s)
    # notes refer to the same lines by number and by label
    by_ref = V.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").cast("string").alias("note_ref_norm"), F.lower("s_name").alias("label_norm"))
    j = a.join(by_ref, ["doc_id", "note_ref_norm", "label_norm"])
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_anchors"), F.round(F.sum("value"), 2).alias("total"), F.min("note_ref_norm").alias("first_ref"))


@query(
    "heading_catalogue",
    """SELECT p_partkey, p_partkey % 3 <> 2 AS exact, true AS contained FROM part WHERE p_partkey % 3 <> 1""",
)
def heading_catalogue(spark, sf):
    k = F.col("p_partkey")
    h = V.table(spark, sf, "part").select(
        "p_partkey", F.when(k % 3 == 0, " Tangible Fixed Assets").when(k % 3 == 1, F.col("p_type")).otherwise(F.concat(F.lit("Note 7: short-term borrowings "), k)).alias("heading")
    )
    contained = K.catalogue_match(h, C.TABLES_NEED_COLUMN_CHECK, exact=False)
    exact = K.catalogue_match(h, C.TABLES_NEED_COLUMN_CHECK).select("p_partkey", F.lit(True).alias("exact"))
    return contained.join(exact, "p_partkey", "left").select("p_partkey", F.coalesce("exact", F.lit(False)).alias("exact"), F.lit(True).alias("contained"))


_FORM_NAMES = sorted({name for _, names in C.FORMS for name in names})
_FORM_SQL = ", ".join(f"('{form}', '{name}')" for form, names in C.FORMS for name in names)


@query(
    "heading_forms",
    f"""WITH c(form, name) AS (VALUES {_FORM_SQL}), n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT DISTINCT name FROM c)),
      p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE name END AS name FROM part JOIN n ON i = p_partkey % {len(_FORM_NAMES)}),
      f AS (SELECT p_partkey, string_agg(form, ',' ORDER BY form) AS forms FROM p LEFT JOIN c USING (name) GROUP BY 1)
      SELECT p_partkey, coalesce(forms, '') AS forms, CASE WHEN p.name IS NULL THEN 'fallback:generic_note' WHEN contains(p.name, 'tax') THEN 'tax' ELSE 'legacy_catalog:cross_check_table' END AS reason
      FROM p JOIN f USING (p_partkey)""",
)
def heading_forms(spark, sf):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in _FORM_NAMES]), (k % len(_FORM_NAMES) + 1).cast("int"))
    h = V.table(spark, sf, "part").select(k, k.alias("doc_id"), F.lit(0).alias("table_idx"), F.when(k % 5 == 4, "Something else").otherwise(F.concat(F.lit(" "), F.initcap(name))).alias("heading"), F.array().cast("array<string>").alias("found"))
    reason = F.when(F.col("reason").contains("tax"), "tax").otherwise(F.col("reason"))
    routed = Y.route(h).select(F.col("doc_id").alias("p_partkey"), reason.alias("reason"))
    return K.heading_forms(h).select("p_partkey", F.array_join("forms", ",").alias("forms")).join(routed, "p_partkey")


@query(
    "tax_rate_resolution",
    """SELECT s_suppkey, round(rate0, 6)::DOUBLE AS rate FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 0.1 + s_suppkey * 0.0001 WHEN s_nationkey % 5 = 0 THEN 0.2 + s_nationkey * 0.001 ELSE 0.22 END AS rate0 FROM supplier)""",
)
def tax_rate_resolution(spark, sf):
    s = V.table(spark, sf, "supplier")
    files = s.select("s_suppkey", F.concat(F.lit("in/"), "s_name").alias("rel_path"), F.concat(F.lit("n"), "s_nationkey").alias("base_name"))
    by_path = s.where("s_suppkey % 10 = 0").select(F.concat(F.lit("in/"), "s_name").alias("name"), (F.lit(0.1) + F.col("s_suppkey") * F.lit(0.0001)).alias("rate"))
    nat = V.table(spark, sf, "nation")
    by_name = nat.where("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), (F.lit(0.2) + F.col("n_nationkey") * F.lit(0.001)).alias("rate"))
    default = nat.agg(F.lit("default").alias("name"), F.lit(0.22).alias("rate")).select("name", "rate")
    return K.tax_rates(files, by_path.unionByName(by_name).unionByName(default)).select("s_suppkey", F.round("rate", 6).alias("rate"))
