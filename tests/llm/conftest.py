import pytest


@pytest.fixture
def table(spark):
    """table("a long, b string", rows) -> DataFrame."""

    def make(schema, rows=()):
        return spark.createDataFrame(list(rows), schema)

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(table):
    """docs((doc_id, text), ...) -> documents with columns that clash with the operators' own."""

    def make(*rows, source="s"):
        out = table(DOCS, [(i, t, "en", source if not callable(source) else source(i), len(t or "")) for i, t in rows])
        for name in ("score", "shard", "slot", "block", "position", "size", "key", "label", "n", "id", "cell", "owner", "n_bytes"):
            out = out.selectExpr("*", f"'x' AS {name}")
        return out

    return make
