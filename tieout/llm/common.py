"""Helpers shared by the operators: reading, written tables, slices of Arrow batches, spread-out ranks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.session import ensure_checkpoint_dir

SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read from there: lineage ends here."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """(values of column 0, values of ``column``) of consecutive rows, ``limit`` bytes of text at most (or one row)."""
    ids, texts = batch.column(0), batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield ids[start:i].to_pylist(), texts[start:i].to_pylist()
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield ids[start:].to_pylist(), texts[start:].to_pylist()


def placed_rows(docs: DataFrame, prefix: str) -> DataFrame:
    """``docs`` with the file and the row of it that each row is read from, as ``prefix``file and ``prefix``row.

    Files of one folder sort by name in the order in which a sorted table was written. A frame that
    is not read from files is written first.
    """
    place = [F.col("_metadata.file_name").alias(f"{prefix}file"), F.col("_metadata.row_index").alias(f"{prefix}row")]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return stored(docs).select("*", *place)


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """A 128-bit key of a text; NULL counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cell: Column, name: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2... along (cell, order) without one task per group.

    ``cell`` is an integer that deals the rows of a group evenly; a task sorts one cell, and one
    row per cell meets per group. NULL keys form a group of their own.
    """
    keys = list(keys)
    work = df.withColumn("__cell", cell)
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order)
    sizes = work.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__cell").alias("__k_cell"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    match = F.col("__cell") == F.col("__k_cell")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return (
        work.withColumn("__in", F.row_number().over(inside))
        .join(offsets, match)
        .select(*df.columns, (F.col("__before") + F.col("__in") - 1).cast("long").alias(name))
    )
