"""Table grids with merged cells: occupancy, invariants and quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_KEY = ["doc_id", "table_idx"]


def occupied(cells: DataFrame) -> DataFrame:
    """Every grid position that cells cover: pos_row, pos_col, n (cells that cover it), merged (one comes from above), filled.

    ``cells``: doc_id, table_idx, row_idx, col_idx (where the cell begins), text, row_span, col_span (NULL counts as 1). A
    cell is copied to the positions it spans, so the work grows with the grid.
    """
    span = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    c = cells.select(*TABLE_KEY, "row_idx", "col_idx", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("f"), span("row_span").alias("rs"), span("col_span").alias("cs"))
    c = c.withColumn("pos_row", F.explode(F.sequence("row_idx", F.col("row_idx") + F.col("rs") - 1)))
    c = c.withColumn("pos_col", F.explode(F.sequence("col_idx", F.col("col_idx") + F.col("cs") - 1)))
    return c.groupBy(*TABLE_KEY, "pos_row", "pos_col").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("pos_row") > F.col("row_idx")).alias("merged"), F.bool_or("f").alias("filled"))


def grid_invariants(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Score, flags, violations and usability of every table of ``tables`` (doc_id, table_idx, expected_cols or NULL).

    Hard violations: no cell at all, rows of another width than the grid, a header text twice. Soft ones: another width
    than the document announces, a vertical merge that meets another cell or leaves the table, any other position that
    two cells cover. Hard ones hold the score at 0.55; a table is usable from 0.6 on without a hard violation.
    """
    own = cells.groupBy(*TABLE_KEY).agg((F.max("row_idx") + 1).alias("rows"))
    pos = occupied(cells).join(own, TABLE_KEY)
    inside = F.col("pos_row") < F.col("rows")
    row = pos.groupBy(*TABLE_KEY, "rows", "pos_row").agg(
        F.count(F.lit(1)).alias("width"), (F.max("pos_col") + 1).alias("reach"), F.count_if("filled").alias("filled"),
        F.bool_or(F.col("merged") & ((F.col("n") > 1) | ~inside)).alias("misaligned"), F.bool_or((F.col("n") > 1) & ~F.col("merged")).alias("collides"),
    )
    kept = F.col("pos_row") < F.col("rows")
    g = row.groupBy(*TABLE_KEY, "rows").agg(
        F.max(F.when(kept, F.col("reach"))).alias("cols"), F.min(F.when(kept, F.col("width"))).alias("narrow"), F.count_if(kept).alias("held"),
        F.sum(F.when(kept, F.col("filled"))).alias("filled"), F.bool_or("misaligned").alias("misaligned"), F.bool_or("collides").alias("collides"),
    )
    head = cells.where("row_idx = 0").groupBy(*TABLE_KEY).agg((F.count(F.lit(1)) != F.count_distinct(F.trim(F.coalesce("text", F.lit(""))))).alias("twice"))
    j = tables.select(*TABLE_KEY, "expected_cols").join(g, TABLE_KEY, "left").join(head, TABLE_KEY, "left")
    empty = F.col("rows").isNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    ragged = yes((F.col("narrow") != F.col("cols")) | (F.col("held") != F.col("rows")))
    twice, mismatch = yes(F.col("twice")), yes(F.col("expected_cols") != F.col("cols"))
    fill = F.col("filled") / (F.col("rows") * F.col("cols"))
    cost = lambda c, x: F.when(c, x).otherwise(0.0)
    raw = (
        F.lit(1.0) - cost(ragged, 0.5) - cost(twice, 0.5) - cost(mismatch, 0.2) - cost(yes(F.col("misaligned")), 0.2) - cost(yes(F.col("collides")), 0.1)
        - F.when(fill < 0.1, 0.3).when(fill < 0.5, 0.1).otherwise(0.0)
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    score = F.when(empty, 0.0).otherwise(F.round(F.when(ragged | twice, F.least(bounded, F.lit(0.55))).otherwise(bounded), 2))
    flags = F.array(F.when(empty, "empty_grid"), F.when(ragged, "GRID_CORRUPTION"), F.when(twice, "DUPLICATE_PERIODS"), F.when(fill < 0.1, "LOW_FILL"))
    broken = F.array(
        F.when(empty, "empty_grid"), F.when(ragged, "row_col_count"), F.when(twice, "duplicate_periods"), F.when(mismatch, "grid_col_mismatch"),
        F.when(yes(F.col("misaligned")), "vmerge_misalign"), F.when(yes(F.col("collides")), "soft_anomaly"),
    )
    return j.select(
        *TABLE_KEY, score.alias("quality_score"), F.array_compact(flags).alias("quality_flags"), F.array_compact(broken).alias("violations"),
        ((score >= 0.6) & ~empty & ~ragged & ~twice).alias("usable"),
    )
