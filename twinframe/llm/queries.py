"""The queries of the training-data operators (one a number) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, decontaminate, langid, licenses, quality, sentencepieces, sharding, toxicity, urls, warc
from ._io import bound_batches, table

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again: number of ids and chunks, a digest of the ids, and whether the
    round trip gives the text back."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepieces.encode(docs, "doc_id", "text")
    return sentencepieces.summary(coded, "doc_id", "text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "url", "html")
    read = warc.read_archives(spark, archives.select("path"), payloads=False)
    return read.select(F.col("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.query(docs)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", *quality.BASE, "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license_sentences", "license", "licenses")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sentencepiece, op2_warc, op3_langid, op4_decontamination, op5_quality, op6_toxicity, op7_sharding, op8_url_filters, op9_licenses, op10_ngram_join)
    return {f.__name__: f for f in every}


def oracles() -> dict[str, str]:
    slots = ",".join(map(str, sharding.lookup_table(SHARDS)))
    return {
        "op2_warc": warc.ORACLE,
        "op5_quality": quality.ORACLE,
        "op7_sharding": f"""
            WITH k AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {sharding.SIZE} AS slot FROM documents)
            SELECT doc_id, slot, 'shard-' || lpad((string_split('{slots}', ','))[slot + 1], 3, '0') AS shard FROM k""",
        "op8_url_filters": urls.oracle(),
        "op9_licenses": licenses.oracle(),
        "op10_ngram_join": dedup.ORACLE,
    }
