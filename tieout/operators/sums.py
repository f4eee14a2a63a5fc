"""Sum-of-details checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions.evidence import clean_sum, to_evidence
from tieout.functions.tolerance import Materiality

TABLE_KEY = ["doc_id", "table_idx"]


def details_against_total(
    amounts: DataFrame,
    table_type: str,
    materiality: Materiality | None = None,
    keys: list[str] | None = None,
    total_label: str = "(?iu)^\\s*total\\s*$",
) -> DataFrame:
    """Rows above a table's total row must add up to it, per amount column.

    ``amounts`` has doc_id, table_idx, row_idx, label, value and optionally col_idx.
    One aggregation with map-side partial sums; no window and no join. Columns
    whose total cell is not a number are skipped.
    """
    m = materiality or Materiality()
    keys = keys or TABLE_KEY + (["col_idx"] if "col_idx" in amounts.columns else [])
    is_total = F.col("label").rlike(total_label)
    sums = amounts.groupBy(*keys).agg(
        clean_sum(F.when(~is_total, F.col("value"))).alias("_details"),
        F.max_by(F.when(is_total, F.col("value")), F.when(is_total, F.col("row_idx"))).alias("_total"),
    )
    usable = sums.where(F.col("_total").isNotNull()).withColumn(
        "_details", F.coalesce("_details", F.lit(0.0))
    )
    return to_evidence(
        usable,
        "SUM_WITHIN_TOLERANCE",
        F.lit("Sum(details) == Total"),
        F.col("_total"),
        F.col("_details"),
        m.tolerance(F.col("_total"), table_type),
    ).drop("_details", "_total")
