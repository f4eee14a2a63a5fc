import json

from tieout.sources import corpus

ROW = {"rule_id": "R1", "heading": "Cash", "status_enum": "FAIL", "seq": 1}


def test_previous_results_in_all_forms(spark, tmp_path):
    rows = [{**ROW, "seq": i} for i in range(12)]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows[:3]))
    (tmp_path / "array.json").write_text(json.dumps(rows[3:5]))
    (tmp_path / "pretty.json").write_text(json.dumps(rows[5:8], indent=2))
    (tmp_path / "wrapped.json").write_text(json.dumps({"results": rows[8:10], "run": "x"}))
    (tmp_path / "wrapped_pretty.json").write_text(json.dumps({"results": rows[10:]}, indent=1))
    (tmp_path / "empty.json").write_text("\n")
    got = corpus.read_previous_results(spark, str(tmp_path)).collect()
    assert sorted(r.seq for r in got) == list(range(12)) and {r.rule_id for r in got} == {"R1"}
    assert corpus.read_previous_results(spark, str(tmp_path / "gone")).count() == 0
    assert corpus.read_previous_results(spark, None).count() == 0


def test_broken_files_are_set_aside(spark, tmp_path):
    spark.createDataFrame([("d", 0, 0, 0, "x", 1, 1)], corpus.CELL_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/t")
    (tmp_path / "t" / "broken.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    good, bad = corpus.split_errors(corpus.read_corpus(spark, f"{tmp_path}/t"))
    assert [r.text for r in good.collect()] == ["x"]
    assert ["broken.parquet" in r.error for r in bad.collect()] == [True]


def test_bad_json_records_keep_their_text(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"doc_id": "a", "table_idx": 1}\n{oops\n')
    good, bad = corpus.split_errors(corpus.read_corpus(spark, str(tmp_path / "c.json"), fmt="json").cache())
    assert [r.doc_id for r in good.collect()] == ["a"] and [r.error for r in bad.collect()] == ["{oops"]
