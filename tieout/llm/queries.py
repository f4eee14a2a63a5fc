"""The operators applied to the given tables with production parameters, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import byte_cnn
from tieout.llm.common import folder, table
from tieout.llm.decontaminate import find_contamination
from tieout.llm.mixing import mix
from tieout.llm.ngram_join import near_duplicates
from tieout.llm.periodic_runs import find_runs, repeating
from tieout.llm.repeated_bytes import remove_repeats
from tieout.llm.shard_packing import shard
from tieout.llm.site_template import extract_main_text
from tieout.llm.skip_chain_crf import find_personal_data
from tieout.llm.telephony import UNIT, telephony
from tieout.llm.token_alignment import align
from tieout.llm.token_counts import count_tokens
from tieout.llm.warc_segments import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op3_telephony_audio")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = telephony(table(spark, sf_dir, "documents"))
    return audio.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "codec", F.length("pcm"), F.crc32("pcm"), F.round("rms", 3), "peak", "crossings").alias("feature"),
    )


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_whole_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


MIX_SQL = """
WITH RECURSIVE
n AS (SELECT coalesce(source, '') AS source, count(*) AS n, floor(sqrt(count(*)) * 1000)::BIGINT AS w FROM documents GROUP BY 1),
p AS (SELECT greatest(1024, 4 * count(*))::BIGINT AS period, count(*)::BIGINT AS s, sum(w)::BIGINT AS total FROM n),
f AS (SELECT source, n, (period - s) * w // total AS whole, (period - s) * w % total AS rest, period, s FROM n, p),
parts AS (
  SELECT source, n, 1 + whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= period - s - sum(whole) OVER () THEN 1 ELSE 0 END AS parts, period
  FROM f),
blocks AS (
  SELECT row_number() OVER (ORDER BY (j + 1) * period // parts + CASE WHEN (j + 1) * period % parts > 0 THEN 1 ELSE 0 END, source)::BIGINT AS id,
    source, j, j * period // parts AS release, ((j + 1) * period + parts - 1) // parts AS deadline, period
  FROM parts, LATERAL (SELECT unnest(range(parts::BIGINT)) AS j)),
ready AS (SELECT release, list(id) AS ids FROM blocks GROUP BY release),
edf AS (
  SELECT -1::BIGINT AS slot, NULL::BIGINT AS id, CAST([] AS BIGINT[]) AS waiting, (SELECT max(period) FROM blocks) AS period
  UNION ALL
  SELECT slot + 1, list_min(now), list_filter(now, lambda x: x <> list_min(now)), period
  FROM (
    SELECT e.slot, e.period, list_concat(e.waiting, coalesce(r.ids, CAST([] AS BIGINT[]))) AS now
    FROM edf e LEFT JOIN ready r ON r.release = e.slot + 1 WHERE e.slot + 1 < e.period)),
template AS (SELECT b.source, b.j, e.slot, b.release, b.deadline, b.period FROM edf e JOIN blocks b ON b.id = e.id),
ranked AS (
  SELECT doc_id, coalesce(source, '') AS source,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, ''))) - 1 AS rank FROM documents),
placed AS (
  SELECT r.doc_id, r.source, r.rank, r.rank // 8 AS block, r.rank // 8 // p.parts AS turn, r.rank // 8 % p.parts AS j FROM ranked r JOIN parts p USING (source))
SELECT doc_id, source, block::BIGINT AS block, (turn * period + release)::BIGINT AS release, (turn * period + deadline)::BIGINT AS deadline,
  (turn * period + slot)::BIGINT AS slot, row_number() OVER (ORDER BY turn * period + slot, rank)::BIGINT - 1 AS position
FROM placed JOIN template USING (source, j)
"""


@query("op1_pfair_mixing", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return mix(docs)


@query("op7_best_fit_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = shard(table(spark, sf_dir, "documents"), 8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query("op9_segmented_archives", ARCHIVE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(table(spark, sf_dir, "pages"), folder(spark, "warc"))
    whole = F.col("payload").isNotNull()
    return read.select(
        "page_id",
        F.when(whole, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query("op2_benchmark_contamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query("op8_byte_network_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_site_template_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, vocabulary("piece_bpe_32k.model"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), repeating)


@query("op11_repeated_bytes")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
