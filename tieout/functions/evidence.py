"""Evidence rows: the one output shape shared by every check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE_COLUMNS = [
    "doc_id", "table_idx", "rule_id", "assertion", "expected", "actual", "diff",
    "tolerance", "is_material", "severity", "reason_code",
]


def clean_sum(c: Column) -> Column:
    """Sum of amounts with float noise removed, so results do not depend on row order."""
    return F.round(F.sum(c), 4)


def to_evidence(
    df: DataFrame,
    rule_id: str,
    assertion: Column,
    expected: Column,
    actual: Column,
    tolerance: Column,
    severity: str = "MAJOR",
    warn: Column | None = None,
    reason: Column | None = None,
) -> DataFrame:
    """Add the evidence columns: a gap beyond the tolerance is material.

    ``warn`` rows carry a reason code instead of a comparison: all four numbers
    are 0 and the row is never material.
    """
    warn = F.lit(False) if warn is None else warn
    reason = F.lit(None).cast("string") if reason is None else reason
    zero = F.lit(0.0)
    staged = (
        df.withColumn("_warn", warn)
        .withColumn("rule_id", F.lit(rule_id))
        .withColumn("assertion", assertion)
        .withColumn("_reason", reason)
        .withColumn("expected", F.when(F.col("_warn"), zero).otherwise(expected))
        .withColumn("actual", F.when(F.col("_warn"), zero).otherwise(actual))
        .withColumn("tolerance", F.when(F.col("_warn"), zero).otherwise(tolerance))
    )
    staged = staged.withColumn("diff", F.round(F.col("actual") - F.col("expected"), 4))
    staged = staged.withColumn(
        "is_material", ~F.col("_warn") & (F.abs(F.col("diff")) > F.col("tolerance"))
    )
    return (
        staged.withColumn("severity", F.when(F.col("is_material"), severity).otherwise("INFO"))
        .withColumn("reason_code", F.when(F.col("_warn"), F.col("_reason")))
        .drop("_warn", "_reason")
    )
