"""The table normalisation chain as composed DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.operators import columns as L
from tieout.operators import ingest as I
from tieout.operators.scans import groups_fit
from tieout.session import checkpoint, deal, stored_by_group

# Header wording that marks code and note columns.
CODE_WORDS = ["code", "mã số", "mã"]
NOTE_WORDS = ["note", "notes", "thuyết minh"]


def normalize_tables(cells: DataFrame, dealt: int | None = None) -> dict[str, DataFrame]:
    """Raw cells -> headers, body and column metadata (code, note, CY and PY columns).

    The squared cells, the header ranges and the headers are read several times below, so each
    is written to the checkpoint folder once instead of being derived again per use. Where no table is large they are
    stored in buckets of the table, and the cells are moved once. ``dealt``: cells already come as records of rows
    with an array ``cells`` (col_idx, text), dealt by table with this number, and no table is large.
    """
    if dealt is None and not _small(cells):
        squared = checkpoint(I.drop_index_rows(I.rectangular(cells)))
        ranges = checkpoint(I.header_range(squared, CODE_WORDS, NOTE_WORDS))
        headers, body = I.promote_headers(squared, ranges)
        headers = checkpoint(headers)
    else:
        if dealt is None:
            dealt = cells.count()
            cells = deal(cells, I.SORT_KEY, dealt).groupBy(*I.TABLE_KEY, "row_idx").agg(F.collect_list(F.struct("col_idx", "text")).alias("cells"))
        rows = stored_by_group(I.squared_rows(cells), I.SORT_KEY, "row_idx", dealt)
        squared = rows.select(*I.TABLE_KEY, "row_idx", F.inline("cells"))
        ranges = stored_by_group(I.header_range(squared, CODE_WORDS, NOTE_WORDS), I.SORT_KEY, "start_row", dealt)
        # a range per table: its bucket is read into memory, and rows are not sorted for the join
        ranged = rows.join(ranges.hint("shuffle_hash"), I.SORT_KEY).select(*I.TABLE_KEY, "row_idx", "start_row", "end_row", F.inline("cells"))
        headers, body = I.promote_headers(ranged)
        headers = stored_by_group(headers, I.SORT_KEY, "col_idx", dealt)
    periods = L.period_columns(headers, L.numeric_evidence(body))
    meta = (
        periods.join(L.code_columns(headers).withColumnRenamed("col_idx", "code_col"), L.TABLE_KEY, "left")
        .join(L.note_columns(headers).withColumnRenamed("col_idx", "note_col"), L.TABLE_KEY, "left")
    )
    return {"headers": headers, "body": body, "metadata": meta}


def _small(cells: DataFrame) -> bool:
    """Whether a window may hold each table and rows are numbered from 0."""
    return groups_fit(cells, I.TABLE_KEY) and cells.where("row_idx is null or row_idx < 0 or col_idx < 0").isEmpty()
