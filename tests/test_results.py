import json

from pyspark.sql import functions as F

from tieout.operators import crosscheck as K
from tieout.operators import ingest as I
from tieout.operators import results as R
from tieout.plans import audit as P
from tieout.sources import corpus, sinks
from tieout.streaming.incremental import incremental_audit


def test_status_order_is_semantics(rows):
    df = rows("s string", ("FAIL: 2 passed",), ("FAIL: x",), ("Extraction failed",), ("khớp",), ("odd",))
    assert [r[0] for r in df.select(R.status_enum(F.col("s"))).collect()] == ["PASS", "FAIL", "FAIL_TOOL_EXTRACT", "PASS", "UNKNOWN"]


def test_marks_fail_beats_pass(rows):
    marks = rows("doc_id string, table_idx int, row_idx int, col_idx int, kind string, ok boolean, comment string, rule_id string, seq int",
                 ("d", 0, 0, 0, "validation", True, "", "r", 0), ("d", 0, 0, 0, "cross_ref", False, "x", "r", 1),
                 ("d", 0, 1, 0, "validation", False, "y", "r", 2), ("d", 0, 1, 0, "validation", True, "", "r", 3), ("d", 0, 1, 0, "cross_ref", True, "", "r", 4),
                 ("d", 1, 0, 0, "validation", True, "", "r", 5))
    got = sorted((r.table_idx, r.row_idx, r.kind, r.ok) for r in R.resolve_marks(marks, rows("doc_id string, table_idx int", ("d", 1))).collect())
    assert got == [(0, 0, "cross_ref", False), (0, 1, "validation", False)]


def test_run_diff_first_run_and_changes(rows):
    s = "rule_id string, heading string, status_enum string, severity string, confidence string, seq int"
    cur = rows(s, ("r", "a", "FAIL", "HIGH", "HIGH", 1), ("r", "b", "PASS", "LOW", "HIGH", 2), ("r", "c", "WARN", "LOW", "LOW", 3))
    prev = rows(s, ("r", "a", "FAIL", "LOW", "HIGH", 1), ("r", "z", "FAIL", "LOW", "HIGH", 2), ("r", "c", "WARN", "LOW", "LOW", 3))
    assert {r.heading: r.diff_status for r in R.run_diff(cur, None).collect()} == {"a": "NEW", "c": "NEW"}
    assert {r.heading: r.diff_status for r in R.run_diff(cur, prev).collect()} == {"a": "CHANGED", "z": "RESOLVED", "c": "UNCHANGED"}


def test_batch_summary(rows):
    r = R.batch_summary(rows("ok boolean, tables int", (True, 5), (True, 3), (False, 0))).collect()[0]
    assert (r.total_files, r.successful, r.tables) == (3, 2, 8) and abs(r.success_rate - 66.666667) < 1e-6


def test_as_of_ignores_later_and_same_writes(rows):
    facts = rows("doc_id string, account_key string, seq long, cy double, py double", ("d", "a", 1, 10.0, 1.0), ("d", "a", 5, 20.0, 2.0))
    probes = rows("doc_id string, account_key string, seq long", ("d", "a", 1), ("d", "a", 2), ("d", "a", 5), ("d", "a", 6), ("d", "b", 6))
    for chunk in (1, 3, 1000):
        got = {(r.account_key, r.seq): r.fact_cy for r in K.as_of_facts(probes, facts, chunk_rows=chunk).collect()}
        assert got == {("a", 1): None, ("a", 2): 10.0, ("a", 5): 10.0, ("a", 6): 20.0, ("b", 6): None}


def test_form_map_first_use(rows):
    slots = rows("doc_id string, table_idx long, heading string, n_subtotals int, slot string, locator string, cy double, py double",
                 ("d", 5, "Cash", 2, "T1", "", 10.0, 1.0), ("d", 6, "Cash", 2, "T1", "", 99.0, 1.0), ("d", 7, "Trading securities", 1, "T1", "allowance", 4.0, 4.0))
    facts = rows("doc_id string, account_key string, seq long, cy double, py double", ("d", "cash", 1, 10.0, 1.0),
                 ("d", "allowance for diminution in the value of trading securities", 1, -4.0, -4.0))
    got = {r.table_idx: (r.ok_cy, r.ok_py) for r in K.tie_out_forms(slots, facts).collect()}
    assert got == {5: (True, True), 7: (True, True)}


def test_merge_reasons(rows):
    s = ("doc_id string, table_idx int, heading string, note_number string, n_cols int, headers array<string>, page_break boolean, "
         "paragraphs_since int, long_paragraph boolean, is_footer boolean, first_cell string, last_cell string")
    t = rows(s, ("d", 0, "A", "1", 3, ["x"], False, 0, False, False, "a", "b"), ("d", 1, "A", "1", 3, ["x"], False, 0, False, False, "a", "b"),
             ("d", 2, "A", "1", 4, ["x"], False, 0, False, False, "a", "b"), ("d", 3, "B", "1", 4, ["x"], False, 5, False, False, "a", "b"))
    got = [(r.reason, r.merge_group) for r in I.merge_decisions(t).orderBy("table_idx").collect()]
    assert got == [("NO_PREV_TABLE", 1), ("MERGED_BY_STRONG_ANCHOR", 1), ("COLUMN_COUNT_MISMATCH", 2), ("PROXIMITY_FAIL", 3)]


def test_corpus_keeps_bad_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id":"d","table_idx":0,"row_idx":0,"col_idx":0,"text":"x"}\n{broken\n')
    good, bad = corpus.split_errors(corpus.read_corpus(spark, str(tmp_path), fmt="json").cache())
    assert good.count() == 1 and bad.count() == 1


def test_previous_results_and_sinks(spark, rows, tmp_path):
    assert corpus.read_previous_results(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"rule_id": "r", "heading": "h", "status_enum": "FAIL"}]}))
    assert corpus.read_previous_results(spark, str(tmp_path / "p.json")).collect()[0].heading == "h"
    res = rows("doc_id string, table_idx int, heading string, status string, status_enum string, rule_id string", ("d", 0, "=h", "s", "PASS", "r"))
    sinks.write_summary(res, str(tmp_path / "s"), "run-1")
    sinks.write_contract(res, str(tmp_path / "c"), "run-1")
    sinks.freeze_baseline(rows("rule_id string, n int", ("r", 1)), str(tmp_path / "b"), "v1")
    assert spark.read.parquet(str(tmp_path / "s")).collect()[0].run_id == "run-1"
    assert spark.read.parquet(str(tmp_path / "c" / "findings")).collect()[0].heading == "'=h"
    assert spark.read.parquet(str(tmp_path / "b" / "metadata")).collect()[0].version == "v1"


def test_registry_keeps_order_and_drops_duplicates():
    reg = P.Registry()
    for name in ("a", "b", "a"):
        reg.register(P.FrameRule(name, lambda f: None, ["T"]))
    assert [r.rule_id for r in reg.resolve("T")] == ["a", "b"]
    assert not P.Flags({"nonbaseline_present_code_composition": True}).on("nonbaseline_present_code_composition")


def test_evidence_fills_missing_differences(rows):
    res = rows("doc_id string, table_idx int, status_enum string, severity string, max_diff double", ("d", 0, "FAIL", "HIGH", None), ("d", 1, "FAIL", "HIGH", 5.0), ("d", 2, "PASS", "HIGH", 99.0))
    ev = rows("doc_id string, table_idx int, diff double", ("d", 0, -7.0), ("d", 0, 3.0))
    assert [(r.table_idx, r.max_diff) for r in R.top_findings(res, evidence=ev).collect()] == [(0, 7.0), (1, 5.0)]
    assert [r.table_idx for r in R.top_findings(res).collect()] == [1, 0]


def test_audit_is_gated_by_table_type_and_mode(rows):
    notes = rows(
        "doc_id string, table_idx int, row_idx int, label string, value double, has_numeric boolean, seg int, kind string",
        *[("d", t, r, label, v, True, 0, "OTHER") for t in (0, 1, 2) for r, (label, v) in enumerate((("Gross total", 1000.0), ("Less returns", 200.0), ("Net sales", 600.0)))],
    )
    netting = lambda **kw: sorted(r.table_idx for r in P.audit(P.AuditFrames(notes=notes, **kw)).where("rule_id = 'NETTING_BLOCKS'").collect())
    types = rows("doc_id string, table_idx int, table_type string", ("d", 0, "GENERIC_NOTE"), ("d", 1, "TAX_NOTE"), ("d", 2, "GENERIC_NOTE"))
    modes = rows("doc_id string, table_idx int, mode string", ("d", 0, "HIERARCHICAL_NETTING"), ("d", 1, "HIERARCHICAL_NETTING"), ("d", 2, "UNDETERMINED"))
    assert netting() == [0, 1, 2] and netting(table_types=types) == [0, 2] and netting(table_types=types, modes=modes) == [0]
    assert netting(flags=P.Flags({"netting_blocks": False})) == []


def test_incremental_audit_equals_batch(spark, rows, tmp_path):
    from tieout.operators.sums import details_against_total

    schema = "doc_id string, table_idx int, row_idx int, label string, value double"
    for i in range(3):
        rows(schema, (f"d{i}", 0, 0, "a", 5.0), (f"d{i}", 0, 1, "Total", 5.0 + i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda df: details_against_total(df, "GENERIC_NOTE").select("doc_id", "expected", "actual")
    q = incremental_audit(spark, str(tmp_path / "in"), schema, run, str(tmp_path / "out"), str(tmp_path / "ckpt"), files_per_batch=1)
    q.awaitTermination(120)
    key = lambda df: sorted((r.doc_id, r.expected, r.actual) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(run(spark.read.parquet(str(tmp_path / "in"))))


def test_tenth_percentile_matches_sorted_index(rows):
    vals = [0.91, 0.5, 0.77, 0.5, 0.99, 0.62, 0.88, 0.7, 0.71, 0.95]
    df = rows("k string, c double", *[("a", v) for v in vals], ("b", 0.3))
    got = {r.k: r.p10 for r in I.tenth_percentile(df, ["k"], "c", 0.01).collect()}
    assert got == {"a": sorted(vals)[int(len(vals) * 0.1)], "b": 0.3}
