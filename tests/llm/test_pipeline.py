import random

import corpus_pipeline
from tieout.llm import queries

WORDS = [f"word{i}" for i in range(300)]


def test_pipeline_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    clean = [(i, " ".join(rng.choices(WORDS, k=80))) for i in range(120)]
    item = " ".join(rng.choices(WORDS, k=20))
    junk = [(200 + i, " ".join(w + "%%%" for w in rng.choices(WORDS, k=60))) for i in range(60)]
    copies = [(300 + i, clean[i][1]) for i in range(10)] + [(320 + i, clean[i][1] + " tail") for i in range(10)]
    leaks = [(400 + i, " ".join(rng.choices(WORDS, k=40)) + " " + item.upper() + ". more") for i in range(5)]
    rows = clean + junk + copies + leaks + [clean[0], (None, " ".join(rng.choices(WORDS, k=50)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t)) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 200 <= i < 300 else 1, 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == [(False, i) for i in range(120)] + [(True, None)]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_stages_pass_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14))
