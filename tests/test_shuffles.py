"""Steps that move each row once: notes dealt before they are laid out, facts as of a note, header ranges, merged columns."""

from pyspark.sql import functions as F

from tieout.operators import crosscheck as X
from tieout.operators import ingest as I
from tieout.operators import tie_outs as T
from tieout.session import deal

KEY = ["doc_id", "table_idx"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_notes_give_the_same_sums(rows):
    labels = ["", "", "Segment revenue", "Cost", "Other income", "", "Operating result", "Tax", "", "Profit after tax"]
    values = [None, None, 5.0, 7.0, 2.0, None, 9.0, 1.0, None, 10.0]
    notes = rows("doc_id long, table_idx long", *[(k % 3, k) for k in range(9)])
    lay = F.posexplode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(v).cast("double").alias("v")) for a, v in zip(labels, values)])).alias("row_idx", "x")
    none = F.lit(None).cast("double")

    def cells(df):
        cell = lambda i, text, v: F.struct(F.lit(i).alias("col_idx"), text.alias("text"), v.alias("value"))
        return df.select(*KEY, lay).select(*KEY, "row_idx", F.array(cell(0, F.col("x.label"), none), cell(1, F.lit(""), F.col("x.v"))).alias("cells"))

    heads = notes.withColumn("heading", F.lit("Business segments"))
    want = T.segment_sums(cells(notes), heads).collect()
    got = T.segment_sums(cells(deal(notes, KEY, 90)), heads, 90).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 18


def test_facts_of_small_documents_are_moved_once(rows):
    schema = "doc_id long, account_key string, seq long, cy double, py double"
    facts = rows(schema, *[(d, a, s, float(s), 1.0) for d in (1, 2) for a in ("cash", "tax") for s in (1, 5, 900000)], (1, None, 1, 3.0, 1.0))
    notes = rows(schema, *[(d, a, s, 2.0, 2.0) for d in (1, 3) for a in ("cash", "tax") for s in (1, 2, 6, 1000000)], (1, None, 7, 2.0, 2.0))
    small, cut = X.as_of_facts(notes, facts), X.as_of_facts(notes, facts, chunk_rows=2)
    assert plan(small).count("Exchange hashpartitioning") == 1 < plan(cut).count("Exchange hashpartitioning")
    assert sorted(map(str, small.collect())) == sorted(map(str, cut.collect()))


def test_header_range_joins_nothing(rows):
    texts = [["Item", "x", "y"], ["Code", "Note", "2024"], ["", "", "VND"], ["A long description of a balance", "1", "2,000"], ["Code", "Note", "2023"]]
    cells = rows("doc_id int, table_idx int, row_idx int, col_idx int, text string", *[(1, 1, r, c, t) for r, line in enumerate(texts) for c, t in enumerate(line)], (1, 2, 0, 0, "no header"))
    got = I.header_range(cells, ["code"], ["note"])
    assert "Join" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1, 2)]


def test_merged_columns_count_different_values(rows):
    cells = rows("doc_id int, table_idx int, row_idx int, col_idx int, text string", (1, 1, 0, 1, " a "), (1, 1, 0, 2, "b"), (1, 1, 1, 1, ""), (1, 1, 1, 2, "c"), (1, 1, 0, 3, "v"), (1, 1, 0, 4, "no header"))
    heads = rows("doc_id int, table_idx int, col_idx int, header string", (1, 1, 1, "Code"), (1, 1, 2, "Code.1"), (1, 1, 3, "Amount"))
    got = sorted(map(tuple, I.merged_columns(cells, heads).collect()))
    assert got == [(1, 1, 0, 1, "Code", "a", 2), (1, 1, 0, 3, "Amount", "v", 1), (1, 1, 1, 1, "Code", "c", 1)]
    m, log = I.canonical_columns(cells, heads)
    assert m.count() == 3 and [tuple(r) for r in log.collect()] == [(1, 1, 0, "Code", 2)]
