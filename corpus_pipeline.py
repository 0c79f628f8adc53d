"""The corpus pipeline: five stages, each over all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, near_dedup, quality_model, quality_rules, sentencepiece_codec
from quillspark.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words in a shingle and least similarity in percent of the near-dedup stage; op7's query has its own.
SHINGLE, PERCENT = 5, 80


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, predicts as 1.

    Judged by text alone: null texts like empty ones, rows that repeat alike, null ids like others; an empty table stays empty.
    """
    model = quality_model.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score_quality(docs, model, carry=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep, each judged by its own row whatever its id.

    Null or empty texts fail; rows that repeat are all kept or all dropped; an empty table stays empty.
    """
    return quality_rules.quality_rules(docs, keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by shingles of five words: the one with the smallest id, null ids last.

    Rows are linked under keys of their own, so that ids may be null or repeat: different texts under one id stay, and of rows
    that repeat one stays. Texts without words are linked with nothing and stay; an empty table stays empty.
    """
    keyed = materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "keyed")
    judged = near_dedup.near_duplicates(keyed, "_row", percent=PERCENT, shingle=SHINGLE)
    grouped = judged.where("NOT kept").select("_row", "component_id")
    linked = materialise(grouped.union(grouped.select("component_id", "component_id").distinct()), "linked")
    named = linked.join(keyed.select("_row", "doc_id"), "_row").withColumn("place", F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    first = materialise(named.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place._row").alias("_row")), "first")
    dropped = linked.select("_row").join(_sized(first), "_row", "left_anti")
    return keyed.join(_sized(materialise(dropped, "dropped")), "_row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each by its own row whatever its id.

    Documents without words are never taken twice; rows that repeat are taken one by one; an empty table stays empty.
    """
    mixed = mixing.mix_sources(docs, carry=("text", "lang", "n_chars"))
    copies = F.when(F.col("size") == 0, F.least("copies", F.lit(1))).otherwise(F.col("copies")).cast("int")
    taken = mixed.withColumn("_copies", copies).where("_copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that the mix took, with both checks; null texts have null ids, repeated rows equal results."""
    return sentencepiece_codec.encode_documents(docs, carry=("lang", "source"))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("sentencepiece encoding and decoding", encode),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None

#: Most row keys broadcast (8 bytes each); beyond it the documents are shuffled by key.
BROADCAST_ROWS = 2_000_000


def _sized(ids: DataFrame) -> DataFrame:
    """A table of one id a row, broadcast if its counted rows are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
