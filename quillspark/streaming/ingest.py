"""Streaming ingestion, beyond batch rebuilds: chunks arrive, edges and embedding records are appended."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import graph, vector
from quillspark.sources import relations as R


def ingest_chunks(chunks: DataFrame, edges_path: str, records_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the edges and embedding records of each micro-batch of raw chunks.

    Parquet writes of a batch carry its number, so that a batch that is run again after a failure replaces its own rows.
    Running suffixes of ids go on from the other batches stored so far, so ids are unique in the whole table.
    """

    def store(batch: DataFrame, number: int) -> None:
        relations = R.explode_relations(R.load_chunks(batch)).persist()
        try:
            graph.edges(relations).write.mode("overwrite").parquet(f"{edges_path}/batch={number}")
            vector.embedding_records(relations, _taken(batch.sparkSession, records_path, number)).write.mode("overwrite").parquet(f"{records_path}/batch={number}")
        finally:
            relations.unpersist()

    writer = chunks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _taken(spark: SparkSession, records_path: str, number: int) -> DataFrame:
    """(base, used): how often the other stored batches hold each id's base."""
    none = spark.createDataFrame([], "base string, used bigint")
    try:
        stored = spark.read.parquet(records_path)
    except AnalysisException:  # no batch is stored yet
        return none
    return stored.where(F.col("batch") != number).groupBy("base").agg(F.count("*").alias("used"))


def windowed_activity(edges: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, relation, cnt) over event time; rows later than the watermark are left out."""
    return edges.withWatermark(time, late).groupBy(F.window(time, length), "relation").agg(F.count("*").alias("cnt"))
