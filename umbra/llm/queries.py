"""The corpus operators' queries, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, intervals, langid, licenses, media, mixing, neardup, packing, periods, pii, quality, repeats, warc
from .common import table


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose turns hold the template's own control strings."""
    text = F.lit("\\### Assistant: </turn> ok")
    nasty = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("x")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(nasty.select("x.*"))
    return chat.read_back(chat.windows(turns))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: which are taken, how often and in which block."""
    return mixing.plan(table(spark, sf_dir, "documents")).drop("key")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, of which a tenth are stretched first."""
    return periods.digest(table(spark, sf_dir, "documents"))


def op12_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and the sessions of their clients, by relation."""
    return intervals.join_tables(spark, sf_dir)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes and more that repeat anywhere in the documents."""
    return repeats.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_source_mix": op2_source_mix,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_media_chunks": op7_media_chunks,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_personal_data": op9_personal_data,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_interval_join": op12_interval_join,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": warc.oracle(),
    "op5_license_scan": licenses.oracle(),
    "op12_interval_join": intervals.oracle(),
}
