"""Session settings and the two decisions every job shares: checkpoints and broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.literals import sql_literal

BROADCAST_ROWS = 100_000
BUCKET_ROWS = 1_000_000


def local_session(name: str = "tieout", cpus: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    existing = context._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not current:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        current = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    context.setCheckpointDir(current)
    return current


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage on reliable storage, so a lost executor costs no recomputation.

    Rows are written as Parquet into the checkpoint folder: compressed, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by_group(df: DataFrame, keys: list[str], order: str, rows: int) -> DataFrame:
    """As :func:`checkpoint`, in buckets of ``keys``: later scans, joins and aggregations per group move no row.

    A group is one bucket's, so callers first see that none is large. ``rows`` sets the number of buckets; ``df`` is dealt
    by :func:`deal` with the same number, so that one task writes one file.
    """
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    df.write.option("path", f"{ensure_checkpoint_dir(spark)}/{name}").bucketBy(buckets(spark, rows), *keys).sortBy(*keys, order).saveAsTable(name)
    return spark.table(name)


def buckets(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def deal(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    return df.repartition(buckets(df.sparkSession, rows), *keys)


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A catalogue of fixed values as a broadcast side, built from literals.

    ``schema`` is ``"name type, name type"``. Larger inputs are not hinted, so the
    optimizer picks the join from their size.
    """
    fields = [part.split() for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(f"cast(c{i} as {t}) as {n}" for i, (n, t) in enumerate(fields))
    aliases = ", ".join(f"c{i}" for i in range(len(fields)))
    out = spark.sql(f"SELECT {columns} FROM VALUES {values} AS v({aliases})")
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out
