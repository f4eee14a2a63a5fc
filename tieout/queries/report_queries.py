"""Sources, sinks, whole-model audit, and the remaining note checks."""

import uuid

from pyspark.sql import functions as F

from tieout.operators import notes as N
from tieout.operators import results as R
from tieout.operators import statements as S
from tieout.operators.scans import groups_fit, stored
from tieout.plans import audit as P
from tieout.plans import views as V
from tieout.queries import oracle_views as O
from tieout.queries import statement_queries  # noqa: F401  (its statements are parts of the model's)
from tieout.queries.registry import ORACLES, query
from tieout.streaming.incremental import incremental_audit
from tieout.queries.result_queries import _MARKS, _marks, _results
from tieout.session import deal, ensure_checkpoint_dir
from tieout.sources import corpus, sinks

_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("corpus_scan", " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n_rows FROM {t}" for t in _NAMES))
def corpus_scan(spark, sf):
    out = None
    for t in _NAMES:
        part = V.table(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("source"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "result_summary_rows",
    f"WITH {O.RESULTS} SELECT doc_id, table_idx, heading, status, enum AS status_enum, rule_id, validator_type, engine AS extractor_engine, failure_reason_code, 'run-1' AS run_id FROM res",
)
def result_summary_rows(spark, sf):
    return sinks.summary(_results(spark, sf), "run-1").drop("status_category", "quality_score")


@query("contract_findings", f"WITH {O.RESULTS} SELECT doc_id, table_idx, heading, enum AS status_enum, rule_id, validator_type, failure_reason_code, engine AS extractor_engine FROM res")
def contract_findings(spark, sf):
    return sinks.safe_text_columns(sinks.findings(_results(spark, sf)))


@query(
    "run_metadata",
    f"""WITH {O.RESULTS}, s AS (SELECT l_orderkey AS table_idx, count(DISTINCT l_linenumber) AS r, count(*) AS c FROM lineitem GROUP BY 1)
      SELECT res.table_idx, enum AS status_enum, coalesce(r, 0) AS row_count, coalesce(c, 0) AS cell_count FROM res LEFT JOIN s USING (table_idx)""",
)
def run_metadata(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc_id"))
    cells = V.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row_idx")).join(o, "l_orderkey").withColumnRenamed("l_orderkey", "table_idx")
    return sinks.run_metadata(cells, _results(spark, sf)).select("table_idx", "status_enum", "row_count", "cell_count")


@query(
    "marked_cell_export",
    f"""WITH {_MARKS}, c AS (SELECT l_orderkey AS table_idx, l_linenumber AS row_idx, l_partkey % 2 AS col_idx, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
      SELECT c.table_idx, c.row_idx, c.col_idx, n, CASE WHEN ok IS NULL THEN '' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS mark, k.comment FROM c LEFT JOIN k ON k.table_idx = c.table_idx AND k.row_idx = c.row_idx AND k.col_idx = c.col_idx AND k.kind = 'validation'""",
)
def marked_cell_export(spark, sf):
    failed = V.table(spark, sf, "orders").where("o_orderkey % 5 = 0").select((F.col("o_orderkey") % 1000).alias("doc_id"), F.col("o_orderkey").alias("table_idx"))
    marks = R.resolve_marks(_marks(spark, sf), failed).where("kind = 'validation'")
    cells = _marks(spark, sf).groupBy("doc_id", "table_idx", "row_idx", "col_idx").agg(F.count(F.lit(1)).alias("n"))
    return sinks.marked_cells(cells, marks).drop("doc_id")


def _model(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    size = 2 * lines.count() if groups_fit(lines, ["l_orderkey"]) else None
    note = V.note_amounts(spark, sf) if size is None else V.lay_amounts(deal(V.amount_lines(spark, sf, lines), N.TABLE_KEY, size))
    note = note.withColumn("has_numeric", F.col("value").isNotNull()).withColumn("seg", F.lit(0))
    note = note.withColumn("kind", N.row_kind(F.col("label"), F.col("has_numeric")))
    note = stored(note, N.TABLE_KEY, dealt=size)  # every note rule reads them
    items = S.long_items(V.statement_rows(spark, sf)).unionByName(S.long_items(V.statement_rows(spark, sf, "FS_BALANCE_SHEET")))
    return P.AuditFrames(notes=note, items=items)


def _model_sql() -> str:
    """Evidence of every rule of the model: statement rules as in their own statements, note rules over all notes."""
    tol = "greatest(1.0, least(0.008 * abs(t), 1000000.0))"
    own = lambda name, table, rule: f"SELECT doc_id, {table} AS table_idx, '{rule}' AS rule_id, assertion, expected, actual, diff, tolerance, is_material, severity, CAST(NULL AS VARCHAR) AS reason_code FROM ({ORACLES[name]})"
    return f"""WITH {O.NOTE}, n AS (SELECT doc_id, table_idx, max(value) FILTER (label = 'Total') AS t, round(CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (label <> 'Total') AS DOUBLE), 4) AS s FROM note GROUP BY 1, 2)
      SELECT doc_id, table_idx, 'MOVEMENT_ROLLFORWARD' AS rule_id, 'OB + Movements == CB' AS assertion, 0.0::DOUBLE AS expected, 0.0::DOUBLE AS actual, 0.0::DOUBLE AS diff, 0.0::DOUBLE AS tolerance, false AS is_material, 'INFO' AS severity, 'STRUCTURE_INCOMPLETE' AS reason_code FROM n
      UNION ALL SELECT doc_id, table_idx, 'VERTICAL_SUM_SCOPED', 'Sum(details) == Total', t, s, round(s - t, 4), {tol}, abs(round(s - t, 4)) > {tol}, CASE WHEN abs(round(s - t, 4)) > {tol} THEN 'MAJOR' ELSE 'INFO' END, NULL FROM n
      UNION ALL {own('income_rules', 'CAST(NULL AS BIGINT)', 'IS_FORMULA_CHECK')} UNION ALL {own('balance_identities', 'table_idx', 'BS_FORMULA_CHECK')}"""


@query("whole_model_audit", f"SELECT rule_id, severity, count(*) AS n, count(*) FILTER (is_material) AS n_material, count(reason_code) AS n_warned FROM ({_model_sql()}) GROUP BY 1, 2")
def whole_model_audit(spark, sf):
    e = P.audit(_model(spark, sf))
    return e.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_material").alias("n_material"), F.count("reason_code").alias("n_warned"))


@query("whole_model_evidence", _model_sql())
def whole_model_evidence(spark, sf):
    return P.audit(_model(spark, sf))


@query(
    "equity_slices",
    f"""WITH {O.ROLL}, b AS (SELECT *, sum(CASE WHEN kind = 'OPENING' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, table_idx ORDER BY row_idx) AS k FROM roll),
      s AS (SELECT doc_id, table_idx, CAST(k AS BIGINT) AS slice, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 4) AS expected FROM b WHERE k IN (1, 2) GROUP BY 1, 2, 3),
      a AS (SELECT doc_id, table_idx, k - 1 AS slice, value AS actual FROM b WHERE kind = 'OPENING')
      SELECT s.doc_id, s.table_idx, s.slice, expected, actual, abs(expected - actual) <= greatest(0.01, 0.012 * greatest(abs(expected), abs(actual), 1)) AS ok FROM s JOIN a USING (doc_id, table_idx, slice)""",
)
def equity_slices(spark, sf):
    rows = V.roll_rows(spark, sf).withColumn("is_anchor", F.col("kind") == "OPENING")
    return N.anchor_slices(rows)


@query(
    "tax_remaining_tables",
    f"""WITH {O.BLOCKS}, m AS MATERIALIZED (SELECT * FROM blocks),
      x AS MATERIALIZED (SELECT table_idx, count(*) AS n, coalesce(min(row_idx) FILTER (label = '' AND value IS NULL), count(*)) AS e1 FROM m GROUP BY 1),
      y AS MATERIALIZED (SELECT table_idx, n, e1, CASE WHEN e1 = 1 THEN e1 ELSE e1 + 2 END AS s2 FROM x WHERE n - 1 > e1 + 1),
      z AS MATERIALIZED (SELECT y.table_idx, n, e1, s2, coalesce(min(row_idx) FILTER (label = '' AND value IS NULL AND row_idx >= s2), n) AS e2 FROM y JOIN m USING (table_idx) GROUP BY 1, 2, 3, 4),
      t AS MATERIALIZED (SELECT table_idx, n, round(CAST(sum(CASE WHEN row_idx < e1 OR (row_idx >= s2 AND row_idx < e2) THEN CAST(value AS DECIMAL(20,2)) ELSE 0 END) AS DOUBLE), 4) AS expected FROM z JOIN m USING (table_idx) GROUP BY 1, 2)
      SELECT doc_id, table_idx, expected, value AS actual, abs(round(expected - value, 4)) <= 0.5 AS ok FROM t JOIN m USING (table_idx) WHERE m.row_idx = t.n - 1""",
)
def tax_remaining_tables(spark, sf):
    return N.two_block_total(V.block_rows(spark, sf))


@query(
    "sum_to_total_rescue",
    f"""WITH {O.NOTE}, n AS (SELECT doc_id, table_idx, max(value) FILTER (label = 'Total') AS t, CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (label <> 'Total' AND NOT (value BETWEEN 1900 AND 2100 AND floor(value) = value)) AS DOUBLE) AS s FROM note GROUP BY 1, 2)
      SELECT doc_id, table_idx, abs(s - t) <= greatest(0.01, 0.008 * greatest(abs(s), abs(t), 1)) AS ok FROM n WHERE table_idx % 4 <> 0 AND s IS NOT NULL""",
)
def sum_to_total_rescue(spark, sf):
    rows = V.note_amounts(spark, sf)
    marked = V.table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_idx"))
    total = rows.where("label = 'Total'").select("doc_id", "table_idx", F.col("row_idx").alias("total_row"))
    return N.rescue_sums(rows, total, marked)


@query(
    "previous_results_read",
    """SELECT 'R' || (o_orderkey % 7) AS rule_id, o_orderpriority AS heading, o_orderstatus AS status_enum, count(*) AS n, sum(o_orderkey)::BIGINT AS seqs FROM orders GROUP BY 1, 2, 3""",
)
def previous_results_read(spark, sf):
    """A previous run in all its forms, written from the orders and read again."""
    k = F.col("o_orderkey")
    r = V.table(spark, sf, "orders").select(
        F.concat(F.lit("R"), k % 7).alias("rule_id"), F.col("o_orderpriority").alias("heading"), F.col("o_orderstatus").alias("status_enum"), k.alias("seq"), (k % 3).alias("_form"), F.expr("o_orderkey div 1000").alias("_part")
    )
    path = f"{ensure_checkpoint_dir(spark)}/previous-{uuid.uuid4().hex}"
    r.where("_form = 0").drop("_form", "_part").write.json(path)
    lists = r.where("_form > 0").groupBy("_form", "_part").agg(F.collect_list(F.struct("rule_id", "heading", "status_enum", "seq")).alias("results"))
    lists.where("_form = 1").select(F.to_json(F.struct("results"))).write.mode("append").text(path)
    pretty = lists.where("_form = 2").select(F.to_json("results", {"pretty": "true"}))
    pretty.write.mode("append").option("maxRecordsPerFile", 1).text(path)
    back = corpus.read_previous_results(spark, path)
    return back.groupBy("rule_id", "heading", "status_enum").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@query(
    "incremental_audit_restarted",
    f"""WITH {O.NOTE}, n AS (SELECT doc_id, table_idx, max(value) FILTER (label = 'Total') AS t, round(CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (label <> 'Total') AS DOUBLE), 4) AS s FROM note GROUP BY 1, 2)
      SELECT doc_id, table_idx, 'VERTICAL_SUM_SCOPED' AS rule_id, t AS expected, s AS actual, abs(round(s - t, 4)) > greatest(1.0, least(0.008 * abs(t), 1000000.0)) AS is_material FROM n""",
)
def incremental_audit_restarted(spark, sf):
    """Notes arrive as files in two steps; the stream is started again from its checkpoint and the sink holds each note once."""
    base = f"{ensure_checkpoint_dir(spark)}/incremental-{uuid.uuid4().hex}"
    rows = V.note_amounts(spark, sf).withColumn("has_numeric", F.col("value").isNotNull()).withColumn("seg", F.lit(0))
    rows = rows.withColumn("kind", N.row_kind(F.col("label"), F.col("has_numeric")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batch):
        return N.scoped_sums(batch, N.scopes(batch, N.segments(batch))).select("doc_id", "table_idx", "rule_id", "expected", "actual", "is_material")

    for step in (0, 1):  # a document is in one file, so batches hold whole documents
        rows.where(F.pmod("doc_id", F.lit(2)) == step).repartition("doc_id").write.mode("append").parquet(f"{base}/in")
        incremental_audit(spark, f"{base}/in", schema, run, f"{base}/out", f"{base}/state", files_per_batch=5).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")
