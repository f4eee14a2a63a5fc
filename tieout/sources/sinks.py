"""Sinks: result summary, contract tables, run metadata, marked cell export, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.text import spreadsheet_safe
from tieout.operators.results import status_counts

TABLE_KEY = ["doc_id", "table_idx"]
SUMMARY_COLUMNS = [
    "doc_id", "table_idx", "heading", "status", "status_enum", "status_category", "rule_id", "validator_type",
    "extractor_engine", "quality_score", "failure_reason_code", "run_id",
]


def safe_text_columns(df: DataFrame) -> DataFrame:
    """Every string column made safe for spreadsheets."""
    return df.select(
        *[spreadsheet_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    )


def summary(results: DataFrame, run_id: str) -> DataFrame:
    """One row per table with the contract's columns; missing ones are NULL."""
    out = results.withColumn("run_id", F.lit(run_id))
    for c in SUMMARY_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*SUMMARY_COLUMNS)


def write_summary(results: DataFrame, path: str, run_id: str) -> None:
    summary(results, run_id).write.mode("append").partitionBy("run_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    safe_text_columns(df).write.mode("overwrite").option("header", True).csv(path)


def findings(results: DataFrame) -> DataFrame:
    cols = ["doc_id", "table_idx", "heading", "status_enum", "rule_id", "validator_type", "failure_reason_code", "extractor_engine"]
    return results.select(*[c for c in cols if c in results.columns])


def write_contract(results: DataFrame, path: str, run_id: str) -> None:
    """Summary counts with the integrity row, findings, and run metadata as three tables."""
    status_counts(results).coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")
    safe_text_columns(findings(results)).write.mode("overwrite").parquet(f"{path}/findings")
    results.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("written_at")).write.mode(
        "overwrite"
    ).parquet(f"{path}/metadata")


def run_metadata(cells: DataFrame, results: DataFrame) -> DataFrame:
    """Rows and cells per table beside its result."""
    size = cells.groupBy(*TABLE_KEY).agg(F.count_distinct("row_idx").alias("row_count"), F.count(F.lit(1)).alias("cell_count"))
    return results.join(size, TABLE_KEY, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0))).withColumn(
        "cell_count", F.coalesce("cell_count", F.lit(0))
    )


def marked_cells(cells: DataFrame, marks: DataFrame) -> DataFrame:
    """Cells beside their mark: PASS, FAIL or none, by position."""
    at = [*TABLE_KEY, "row_idx", "col_idx"]
    m = marks.select(*at, F.col("ok"), F.col("comment"))
    return cells.join(m, at, "left").withColumn(
        "mark", F.when(F.col("ok").isNull(), "").when(F.col("ok"), "PASS").otherwise("FAIL")
    ).drop("ok")


def freeze_baseline(aggregate: DataFrame, path: str, version: str) -> None:
    """Store a failure aggregate as the new baseline with its metadata row."""
    aggregate.write.mode("overwrite").parquet(f"{path}/groups")
    aggregate.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("frozen_at")).write.mode(
        "overwrite"
    ).parquet(f"{path}/metadata")
