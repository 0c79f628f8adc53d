"""Nearest neighbours by blocks against a join of all pairs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import blocks, vector


def tables(spark):
    draw = random.Random(3)
    some = [[float(draw.randint(0, 2)) for _ in range(6)] for _ in range(12)]
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0], [-0.0] * 6, [1e200] * 6]
    books = ["a", "b", None]
    records = [(f"r{n:03d}", draw.choice(some + odd), draw.choice(books)) for n in range(300)]
    queries = [(n, draw.choice(some + odd), draw.choice([*books, "none"])) for n in range(60)]
    return (
        spark.createDataFrame(queries, "query_id long, vector array<double>, book string"),
        spark.createDataFrame(records, "id string, vector array<double>, book string"),
    )


def by_join(queries, records, k, within):
    q, r = queries.withColumnRenamed("vector", "qv"), records.withColumnRenamed("vector", "rv")
    both = q.join(r, within) if within else q.drop("book").crossJoin(r)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    found = both.select("query_id", "id", vector.squared_distance(F.col("qv"), F.col("rv")).alias("distance"))
    return found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def listed(found):
    return sorted((r["query_id"], r["place"], r["id"], repr(r["distance"])) for r in found.collect())


@pytest.mark.parametrize("k", [1, 4, 500])
@pytest.mark.parametrize("within", ["book", None])
@pytest.mark.parametrize("at_a_time", [100_000, 25])
def test_as_by_join(spark, monkeypatch, k, within, at_a_time):
    monkeypatch.setattr(vector, "BROADCAST_QUERIES", at_a_time)
    q, r = tables(spark)
    assert listed(vector.nearest(q, r, k, within)) == listed(by_join(q, r, k, within))


def test_no_pair_of_rows_is_made(spark):
    q, r = tables(spark)
    for within in ("book", None):
        assert "Join" not in vector.nearest(q, r, 3, within)._jdf.queryExecution().optimizedPlan().toString()


def test_small_blocks(spark, monkeypatch):
    import pyarrow as pa

    q, r = tables(spark)
    asked, rows = q.where("book = 'a'").toArrow(), r.where("book = 'a'").select("id", F.col("vector").alias("rv"), F.col("book").alias("group")).toArrow()
    held = blocks.Queries(asked["book"].to_pylist(), asked["vector"].combine_chunks())
    best = {}
    for most in (20_000, 3):
        monkeypatch.setattr(blocks, "BLOCK_VECTORS", most)
        monkeypatch.setattr(blocks, "KEPT_IDS", 1 if most == 3 else 100)
        found = {}
        for batch in pa.Table.to_batches(rows, max_chunksize=7):
            for numbers, ids, distances in blocks.nearest_in_task(iter([batch]), held, 2):
                for n, i, d in zip(numbers.tolist(), ids, distances):
                    found.setdefault(n, []).append((d is not None, d != d, d if d is not None and d == d else 0.0, i))
        best[most] = {n: sorted(x)[:2] for n, x in found.items()}
    assert best[20_000] == best[3]
