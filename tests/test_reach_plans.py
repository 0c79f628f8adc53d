"""Reach reads what it has seen once a hop, and agreement looks from the sampled starts only."""

from quillspark.operators import paths
from quillspark.plans.more_queries import reachability_agreement
from tests.conftest import SF


def test_reach_joins_once_a_hop(spark):
    rows = [("b", "a", "b"), ("b", "b", "c"), ("b", "c", "a"), ("b", "c", "d"), ("b", "d", "d"), ("b", "d", "e")]
    arcs = spark.createDataFrame(rows, "book_id string, node string, other string")
    starts = spark.createDataFrame([("b", "a"), ("b", "e"), ("b", "alone"), ("b", "d")], "book_id string, start string")
    found = paths.reach(starts, arcs, 3)
    least = {("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("d", "e", 1)}
    assert {(r["start"], r["node"], r["depth"]) for r in found.collect()} == least and found.count() == len(least)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3


def test_agreement_is_from_sampled_starts(spark):
    plan = reachability_agreement(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi, ((book_id" in plan
