"""Audit of notes from their rows alone: structure, mode, the rules a mode allows, fallback, and what stays unverified.

``notes`` are rows (doc_id, table_idx, row_idx, label, value) of one amount column; ``headings`` name the tables.
``columns`` (doc_id, table_idx, row_idx, col_idx, header, value) adds the movement by columns where it is given.
Kinds, segments, scopes and plans are derived here, one frame with a row per table, so that no flag is an input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout import catalogue as K
from tieout.functions.evidence import EVIDENCE_COLUMNS
from tieout.functions.tolerance import Materiality
from tieout.operators import classify as C
from tieout.operators import notes as N
from tieout.operators.scans import one_chunk, stored
from tieout.operators.sums import details_against_total
from tieout.session import checkpoint, fixed_table

TABLE_KEY = ["doc_id", "table_idx"]

# Rules that a mode allows. Movement modes run every rule; without a clear structure only those that need none.
NOTE_RULES = ["MOVEMENT_ROLLFORWARD", "NOTE_BREAKDOWN_TOTALS", "VERTICAL_SUM_SCOPED", "MOVEMENT_BY_COLUMNS", "NETTING_BLOCKS"]
ALLOWED = {
    "MOVEMENT_BY_ROWS": NOTE_RULES,
    "MOVEMENT_BY_COLUMNS": NOTE_RULES,
    "HIERARCHICAL_NETTING": ["NETTING_BLOCKS"],
    "GENERIC_NUMERIC_NOTE": ["NOTE_BREAKDOWN_TOTALS", "VERTICAL_SUM_SCOPED", "MOVEMENT_BY_COLUMNS", "NETTING_BLOCKS"],
    "LISTING_TOTALS": ["VERTICAL_SUM_SCOPED"],
    "LISTING_NO_TOTAL": [],
    "UNDETERMINED": ["MOVEMENT_BY_COLUMNS", "NETTING_BLOCKS"],
}


def structured(notes: DataFrame, small: bool | None = None) -> DataFrame:
    """Rows with has_numeric, kind and seg; rows that have them are taken as they are. ``small`` as in ``scans.scan``."""
    if "seg" in notes.columns:
        return notes
    rows = notes.withColumn("has_numeric", F.col("value").isNotNull())
    return N.with_segments(rows.withColumn("kind", N.row_kind(F.col("label"), F.col("has_numeric"))), small)


def note_plans(rows: DataFrame, headings: DataFrame, columns: DataFrame | None = None, segs: DataFrame | None = None) -> DataFrame:
    """One row per table: is_movement, has_scopes, has_column_plan, has_netting_plan, numeric, mode, status.

    A movement needs a segment with opening, closing and a movement row. Headings without totals have no scopes;
    listings without explicit scopes may have implicit totals. status is OK, NO_TOTAL or UNDETERMINED. ``segs``: segments of the rows with their totals, where a caller has them.
    """
    small = one_chunk(rows)
    segs = checkpoint(N.segments(rows, small, totals=True)) if segs is None else segs  # read per table and for scopes
    h = F.lower(F.trim(F.coalesce("heading", F.lit(""))))
    named = headings.select(*TABLE_KEY, "heading", h.rlike(N.LISTING_HEADING).alias("_listing"), h.isin([x.lower() for x in K.TABLES_WITHOUT_TOTAL]).alias("_no_total"))
    moving = segs.groupBy(*TABLE_KEY).agg(F.bool_or(F.col("ob_row").isNotNull() & F.col("cb_row").isNotNull() & (F.col("n_moves") >= 1)).alias("is_movement"), F.bool_or("numeric").alias("numeric"))
    scoped = note_scopes(rows, segs, headings).select(*TABLE_KEY).distinct().withColumn("_scoped", F.lit(True))
    implicit = N.implicit_totals(rows.join(named.where("_listing AND NOT _no_total").select(*TABLE_KEY), TABLE_KEY, "left_semi"), small).select(*TABLE_KEY).distinct().withColumn("_implicit", F.lit(True))
    netting = N.netting_plan(rows).select(*TABLE_KEY).distinct().withColumn("_netting", F.lit(True))
    plan = None if columns is None else N.movement_columns_plan(columns.select(*TABLE_KEY, "col_idx", "header").distinct()).select(*TABLE_KEY).withColumn("_columns", F.lit(True))
    j = named.join(moving, TABLE_KEY).join(scoped, TABLE_KEY, "left").join(implicit, TABLE_KEY, "left").join(netting, TABLE_KEY, "left")
    j = j.join(plan, TABLE_KEY, "left") if plan is not None else j.withColumn("_columns", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    flags = j.select(
        *TABLE_KEY, "heading", "is_movement", "numeric", "_no_total", (~F.col("_no_total") & (yes("_scoped") | yes("_implicit"))).alias("has_scopes"),
        yes("_columns").alias("has_column_plan"), (yes("_netting") & ~F.col("is_movement")).alias("has_netting_plan"),
    )
    status = F.when(F.col("_no_total") & ~F.col("has_netting_plan"), "NO_TOTAL").when(F.col("is_movement") | F.col("has_netting_plan") | F.col("has_scopes"), "OK").otherwise("UNDETERMINED")
    return C.note_mode(flags).withColumn("status", status).drop("_no_total")


def note_scopes(rows: DataFrame, segs: DataFrame, headings: DataFrame) -> DataFrame:
    """Scopes of all tables; a listing has explicit totals only, a heading without totals none."""
    h = F.lower(F.trim(F.coalesce("heading", F.lit(""))))
    bare = headings.where(h.isin([x.lower() for x in K.TABLES_WITHOUT_TOTAL])).select(*TABLE_KEY)
    marked = segs.join(bare, TABLE_KEY, "left_anti").join(headings.select(*TABLE_KEY, h.rlike(N.LISTING_HEADING).alias("_listing")), TABLE_KEY, "left")
    return N.scopes(rows, marked, F.coalesce("_listing", F.lit(False)))


def _evidence(df: DataFrame, rule_id: str | None = None) -> DataFrame:
    if rule_id is not None:
        df = df.withColumn("rule_id", F.lit(rule_id))
    for c in EVIDENCE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    kinds = {"expected": "double", "actual": "double", "diff": "double", "tolerance": "double", "is_material": "boolean"}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in EVIDENCE_COLUMNS])


def audit_notes(notes: DataFrame, headings: DataFrame, columns: DataFrame | None = None, table_type: str = "GENERIC_NOTE", materiality: Materiality | None = None) -> DataFrame:
    """Evidence of every note, with its mode.

    Rules run where the mode allows them. Tables without a clear structure get a warning and the basic sums, unless they
    are listings; numeric tables without any finding are reported as unverified.
    """
    m = materiality or Materiality()
    rows = notes if "seg" in notes.columns else stored(structured(notes), TABLE_KEY)
    small = one_chunk(rows)
    segs = checkpoint(N.segments(rows, small, totals=True))  # read for plans, roll-forwards and scopes
    plans = checkpoint(note_plans(rows, headings, columns, segs))
    parts = {
        "MOVEMENT_ROLLFORWARD": N.roll_forward(rows, table_type, m, segs),
        "NOTE_BREAKDOWN_TOTALS": details_against_total(rows, table_type, m),
        "VERTICAL_SUM_SCOPED": N.scoped_sums(rows, note_scopes(rows, segs, headings), table_type, m),
        "NETTING_BLOCKS": N.first_failure_only(N.netting_check(N.netting_plan(rows).withColumn("col_idx", F.lit(0)), table_type, m), TABLE_KEY, "col_idx"),
    }
    if columns is not None:
        by_columns = N.movement_by_columns(columns, N.movement_columns_plan(columns.select(*TABLE_KEY, "col_idx", "header").distinct()), table_type, m)
        parts["MOVEMENT_BY_COLUMNS"] = by_columns.withColumn("assertion", F.lit("OB + Movements == CB by column")).withColumn(
            "diff", F.round(F.col("actual") - F.col("expected"), 4)
        ).withColumn("is_material", F.lit(True)).withColumn("severity", F.lit("MAJOR"))
    found = reduce(DataFrame.unionByName, [_evidence(df, rule) for rule, df in parts.items()])
    allow = fixed_table(found.sparkSession, [(mode, rule) for mode, rules in ALLOWED.items() for rule in rules], "mode string, rule_id string")
    modes = plans.select(*TABLE_KEY, "mode", "status", "numeric")
    kept = found.join(modes.select(*TABLE_KEY, "mode"), TABLE_KEY).join(allow, ["mode", "rule_id"], "left_semi")
    unclear = modes.where("status = 'UNDETERMINED'")
    warned = unclear.withColumn("reason_code", F.lit("STRUCTURE_UNDETERMINED")).withColumn("assertion", F.lit("NOTE structure undetermined"))
    basic = N.fallback_sums(rows, small).join(unclear.where("numeric AND mode <> 'LISTING_NO_TOTAL'").select(*TABLE_KEY), TABLE_KEY, "left_semi")
    basic = _evidence(basic.withColumn("assertion", F.lit("Sum above == Total")).withColumn("tolerance", F.lit(1.0)), "BASIC_NUMERIC_CHECKS").join(modes.select(*TABLE_KEY, "mode"), TABLE_KEY)
    real = checkpoint(kept.unionByName(basic))
    silent = modes.where("numeric").join(real.select(*TABLE_KEY).distinct(), TABLE_KEY, "left_anti")
    silent = silent.withColumn("reason_code", F.lit("RULES_RAN_NO_EVIDENCE")).withColumn("assertion", F.lit("Numeric table unverified"))
    warn = lambda df, rule: _evidence(df.withColumn("is_material", F.lit(False)).withColumn("severity", F.lit("INFO")), rule).join(modes.select(*TABLE_KEY, "mode"), TABLE_KEY)
    return real.unionByName(warn(warned, "NOTE_STRUCTURE_UNDETERMINED")).unionByName(warn(silent, "UNVERIFIED_NUMERIC_TABLE"))
