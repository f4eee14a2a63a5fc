"""Corpus sources: blocks, cells and previous results from parquet, JSON or CSV folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_SCHEMA = "doc_id STRING, table_idx INT, row_idx INT, col_idx INT, text STRING, row_span INT, col_span INT"
BLOCK_SCHEMA = (
    "doc_id STRING, block_idx INT, kind STRING, style STRING, text STRING, is_bold BOOLEAN, is_upper BOOLEAN, table_idx INT"
)
RESULT_SCHEMA = (
    "rule_id STRING, heading STRING, status_enum STRING, severity STRING, confidence STRING, table_id STRING, "
    "owner STRING, review_status STRING, comment STRING, seq BIGINT"
)


def read_corpus(spark: SparkSession, path: str, schema: str = CELL_SCHEMA, fmt: str = "parquet") -> DataFrame:
    """All documents of a folder with an ``error`` column; a bad record or file never stops the others.

    JSON and CSV records that do not fit the schema keep their raw text in ``error``. Of parquet, a
    file that cannot be read, or that holds no rows, is one row whose ``error`` names it.
    """
    if fmt == "parquet":
        read = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").parquet(path)
        rows = read.select("*", F.lit(None).cast("string").alias("error"))
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("_file"))
        seen = read.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("_file")).distinct()
        lost = files.join(seen, "_file", "left_anti")
        return rows.unionByName(lost.select(F.concat(F.lit("unreadable or empty: "), "_file").alias("error")), allowMissingColumns=True)
    reader = spark.read.schema(f"{schema}, error STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "error")
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def split_errors(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    return corpus.where("error is null").drop("error"), corpus.where("error is not null")


def read_previous_results(spark: SparkSession, path: str | None) -> DataFrame:
    """A previous run, nothing when absent. Files hold JSON lines (results, arrays of results or
    ``{results: […]}``) or one such document over several lines.

    Lines are parsed in parallel. Only files with a line that is no JSON value of its own are read
    whole, one task each; their names reach the driver.
    """
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], RESULT_SCHEMA)
    one = f"STRUCT<results: ARRAY<STRUCT<{_struct(RESULT_SCHEMA)}>>, {_struct(RESULT_SCHEMA)}, _bad: STRING>"
    many = f"ARRAY<STRUCT<{_struct(RESULT_SCHEMA)}>>"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.trim("value").alias("line")).where("line <> ''")
    keep_bad = {"columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select(
        "_file", F.when(F.col("line").startswith("["), F.from_json("line", many)).alias("many"),
        F.when(~F.col("line").startswith("["), F.from_json("line", one, keep_bad)).alias("one"),
    )
    broken = F.col("one._bad").isNotNull() | (F.col("one").isNull() & F.col("many").isNull())
    whole = [r[0] for r in parsed.where(broken).select("_file").distinct().collect()]
    parts = [parsed.where(~F.col("_file").isin(whole)) if whole else parsed]
    if whole:
        text = spark.read.text(whole, wholetext=True).select(F.trim("value").alias("line"))
        parts.append(text.select(F.when(F.col("line").startswith("["), F.from_json("line", many)).alias("many"), F.when(~F.col("line").startswith("["), F.from_json("line", one, keep_bad)).alias("one")))
    names = [part.split()[0] for part in RESULT_SCHEMA.split(", ")]
    out = None
    for part in parts:
        single = part.where("one IS NOT NULL AND one.results IS NULL AND one._bad IS NULL").select(*[F.col(f"one.{n}") for n in names])
        for frame in (single, part.select(F.inline("many")), part.select(F.inline("one.results"))):
            out = frame if out is None else out.unionByName(frame)
    return out


def _struct(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (part.split() for part in schema.split(", ")))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
