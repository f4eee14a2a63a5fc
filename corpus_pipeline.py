"""A corpus pipeline: quality, near duplicates, benchmark decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; its result is written
as Parquet and read again as the next stage's input. All stages but the last return the columns of
documents; the last adds shard and slot. Mixing keeps every document: its decision is the order of the
written rows, and the slots of the last stage follow it.

NULL and empty texts pass every filter but the quality score, which treats them as zero bytes;
repeated rows are copies, of which one stays; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import byte_cnn
from tieout.llm.common import placed_rows, stored, table
from tieout.llm.decontaminate import decontaminate
from tieout.llm.mixing import mix
from tieout.llm.ngram_join import near_duplicates
from tieout.llm.shard_packing import shard

LEAST_SCORE = 0.3
SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network does not reject; it learns from the labelled rows of the whole table."""
    net = byte_cnn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(byte_cnn.text_scores(F.col("text"), net) >= LEAST_SCORE)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; repeated rows are copies."""
    rows = placed_rows(docs, "__")
    number = F.coalesce(F.lpad(F.expr("cast(cast(doc_id AS decimal(20, 0)) + 9223372036854775808BD AS string)"), 20, "0"), F.lit("~"))  # sorts as doc_id does, NULL last
    name = F.concat_ws("#", number, "__file", F.lpad(F.col("__row").cast("string"), 12, "0"))
    named = rows.withColumn("__name", name)
    groups = near_duplicates(named.select(F.col("__name").alias("doc_id"), "text"))
    copies = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__name"))
    return named.join(copies, "__name", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order of their sources."""
    mixed = mix(docs, prefix="__mix_", tie=F.md5(F.coalesce("text", F.lit(""))))
    return mixed.orderBy("__mix_position").select([F.col(f"`{c}`") for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot; slots follow the mixed order."""
    return shard(docs, SHARDS, keep=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The first stage is a learned model and the third an edit distance, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if n == 0 else stored(docs), sf_dir)
    return docs
