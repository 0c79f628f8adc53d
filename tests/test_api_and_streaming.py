import pytest
from pyspark.sql import functions as F

from quillspark.api import Engine, UnknownBook
from quillspark.streaming.ingest import ingest_chunks, windowed_activity
from tests.test_graph import KNIGHT, relations


@pytest.fixture(scope="module")
def engine(spark):
    titles = spark.createDataFrame([("1", "The Knight"), ("2", "No edges")], "book_id string, title string")
    return Engine(relations(spark, KNIGHT), titles)


def test_health_and_books(engine):
    assert engine.health() == {"status": "ok", "books_loaded": 1, "vectors_indexed": 2}
    assert [r["title"] for r in engine.books().collect()] == ["The Knight"]


def test_query(engine):
    found = engine.query("1", "who protects the friend of the knight?")
    assert found["hop_depth"] == 1 and {c["path"][-1] for c in found["chains"]} == {"lord"}
    assert {(s["src"], s["dst"]) for s in found["sources"]} == {("knight", "squire"), ("squire", "lord")} and "(note" in found["answer"]
    assert engine.query("1", "who is the friend of the knight?")["chains"] == []


def test_errors(engine):
    with pytest.raises(UnknownBook):
        engine.query("9", "who?")
    with pytest.raises(ValueError):
        engine.query("1", "")


def test_ingest(spark, tmp_path):
    schema = "book_id string, chunk_id string, relations string"
    spark.createDataFrame([("1", "0", "[{'entity1': 'A', 'entity2': 'B', 'relation': 'owns'}]"), ("1", "1", "bad")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest_chunks(stream, str(tmp_path / "e"), str(tmp_path / "r"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "e")).select("src", "dst").collect() == [("a", "b")]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_windowed_activity(spark):
    t = spark.createDataFrame([("2024-01-01 00:10:00", "owns"), ("2024-01-01 00:20:00", "owns"), ("2024-01-01 01:10:00", "owns")], "ts string, relation string")
    found = windowed_activity(t.withColumn("ts", F.to_timestamp("ts"))).orderBy("window").collect()
    assert [r["cnt"] for r in found] == [2, 1]
