import random

from pyspark.sql import functions as F

from tieout.operators import scans
from tieout.operators.scans import Scan, dense_positions, scan
from tieout.session import checkpoint


def brute(rows):
    out, last = [], None
    running = 0.0
    prev = None
    for _, pos, v in sorted(rows, key=lambda r: r[1]):
        before = running
        if v is not None:
            running += v
        out.append((pos, running if any(x[2] is not None for x in rows if x[1] <= pos) else None, before, prev, last))
        prev = v
        last = v if v is not None else last
    return out


def test_scan_matches_brute_force_across_chunks(spark):
    rnd = random.Random(7)
    data = [(k, p, None if rnd.random() < 0.3 else float(rnd.randint(1, 9))) for k in ("hot", "b") for p in range(60 if k == "hot" else 5)]
    df = spark.createDataFrame(data, "k string, pos int, v double")
    outs = [Scan("run", "sum", "v"), Scan("before", "sum", "v", inclusive=False), Scan("prev", "lag", "v"), Scan("last", "last", "v", inclusive=False)]
    for chunk_rows in (1, 4, 1000):
        got = scan(df, ["k"], "pos", outs, chunk_rows=chunk_rows)
        for k in ("hot", "b"):
            have = sorted((r.pos, r.run, r.before or 0.0, r.prev, r.last) for r in got.where(F.col("k") == k).collect())
            assert have == brute([d for d in data if d[0] == k])


def test_descending_scan(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "k string, pos int, v double")
    got = scan(df, ["k"], "pos", [Scan("n", "count", "v", inclusive=False), Scan("nxt", "lag", "v")], descending=True, chunk_rows=3)
    by = {r.pos: (r.n, r.nxt) for r in got.collect()}
    assert by[9] == (None, None) or by[9] == (0, None)
    assert by[0] == (9, 1.0) and by[5] == (4, 6.0)


def test_dense_positions(spark):
    df = spark.createDataFrame([("a", i * 37 % 101) for i in range(101)], "k string, v int")
    got = dense_positions(df, ["k"], ["v"], [F.floor(F.col("v") / 10)])
    assert all(r.row_idx == r.v for r in got.collect())


def test_small_groups_need_one_shuffle_and_no_join(spark, capsys, monkeypatch):
    rnd = random.Random(3)
    data = [(k, rnd.randint(0, 50), i) for k in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(data, "k string, v int, i int")
    plain = dense_positions(df, ["k"], ["v", "i"], [F.floor(F.col("v") / 10)])
    run = scan(checkpoint(plain), ["k"], "row_idx", [Scan("s", "sum", "i"), Scan("p", "lag", "i")])
    for out in (plain, run):
        out.explain()
        plan = capsys.readouterr().out
        assert "Join" not in plan and plan.count("Exchange") == 1
    few = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(scans, "CHUNK_ROWS", 7)  # groups are larger now: in chunks, with the same numbers
    assert sorted(map(tuple, dense_positions(df, ["k"], ["v", "i"], [F.floor(F.col("v") / 10)]).collect())) == few
    cut = scan(plain, ["k"], "row_idx", [Scan("s", "sum", "i"), Scan("p", "lag", "i")], chunk_rows=7)
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted(map(tuple, run.collect()), key=repr)


def test_checkpoint_is_columnar(spark, capsys):
    kept = checkpoint(spark.createDataFrame([(1, "x", [1.0, None])], "k int, `two words` string, a array<double>"))
    kept.select("k").explain()
    assert "FileScan parquet" in capsys.readouterr().out
    assert [tuple(r) for r in kept.collect()] == [(1, "x", [1.0, None])]
