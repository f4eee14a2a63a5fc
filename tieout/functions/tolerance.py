"""Materiality, amount comparison and severity as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tieout.functions.literals import literal_map

# Relative tolerance per table family.
PROFILE = {
    "BALANCE_SHEET": 0.001,
    "INCOME_STATEMENT": 0.005,
    "CASH_FLOW": 0.005,
    "EQUITY": 0.003,
    "MOVEMENT": 0.002,
    "NOTE_BREAKDOWN": 0.008,
    "TAX_NOTE": 0.005,
    "FIXED_ASSET": 0.003,
}
FALLBACK_RELATIVE = 0.008


@dataclass(frozen=True)
class Materiality:
    """Tolerance settings; override any of them per job.

    Statement tables arrive typed ``FS_*``, which the default profile does not
    list, so they use the fallback. ``statement_profile()`` gives the variant that
    maps them to their own tolerance.
    """

    floor: float = 1.0
    ceiling: float = 1_000_000.0
    profile: dict = field(default_factory=lambda: dict(PROFILE))
    fallback: float = FALLBACK_RELATIVE

    def statement_profile(self) -> "Materiality":
        extended = dict(self.profile)
        for k in ("BALANCE_SHEET", "INCOME_STATEMENT", "CASH_FLOW", "EQUITY"):
            extended["FS_" + k] = self.profile[k]
        return Materiality(self.floor, self.ceiling, extended, self.fallback)

    def relative(self, table_type: Column | str) -> Column:
        if isinstance(table_type, str):
            return F.lit(self.profile.get(table_type, self.fallback))
        known = literal_map(self.profile.items())
        return F.coalesce(F.try_element_at(known, table_type), F.lit(self.fallback)).cast("double")

    def tolerance(self, value: Column, table_type: Column | str) -> Column:
        raw = self.relative(table_type) * F.abs(value)
        return F.greatest(F.lit(self.floor), F.least(raw, F.lit(self.ceiling)))


def severity_by_ratio(diff: Column, tolerance: Column) -> Column:
    ratio = F.abs(diff) / tolerance
    return (
        F.when(F.abs(diff) <= tolerance, "INFO")
        .when(ratio > 10, "CRITICAL")
        .when(ratio > 3, "MAJOR")
        .otherwise("MINOR")
    )


def compare_bound(expected: Column, actual: Column, abs_tol: float = 0.01, rel_tol: float = 0.008) -> Column:
    reference = F.greatest(F.abs(expected), F.abs(actual), F.lit(1.0))
    return F.greatest(F.lit(abs_tol), F.lit(rel_tol) * reference)


def amounts_match(expected: Column, actual: Column, abs_tol: float = 0.01, rel_tol: float = 0.008) -> Column:
    """True when the gap is within the larger of both bounds; NULL on either side is False."""
    return F.coalesce(
        F.abs(expected - actual) <= compare_bound(expected, actual, abs_tol, rel_tol), F.lit(False)
    )


def compare_amounts(expected: Column, actual: Column, abs_tol: float = 0.01, rel_tol: float = 0.008) -> Column:
    """struct(ok, abs_delta, rel_delta_pct, bound) with bound in abs / rel / none."""
    reference = F.greatest(F.abs(expected), F.abs(actual), F.lit(1.0))
    known = expected.isNotNull() & actual.isNotNull()
    return F.struct(
        amounts_match(expected, actual, abs_tol, rel_tol).alias("ok"),
        F.abs(expected - actual).alias("abs_delta"),
        F.when(known, F.abs(expected - actual) / reference * 100).alias("rel_delta"),
        F.when(~known, "none")
        .when(F.lit(abs_tol) >= F.lit(rel_tol) * reference, "abs")
        .otherwise("rel")
        .alias("bound"),
    )
