"""Reach by two hops in blocks of starts against the search that groups ways, and that no way is grouped."""

import random

import pytest

from quillspark.operators import paths, reached
from quillspark.plans.graph_queries import n_hop_reach
from tests.conftest import SF


def pairs(spark):
    draw = random.Random(5)
    found = {(b, f"n{draw.randint(0, 40)}", f"n{draw.randint(0, 40)}") for b in ("a", "b") for _ in range(60)}
    found |= {("a", "hub", f"n{i}") for i in range(30)} | {("a", f"n{i}", "hub") for i in range(5, 40)}  # a hub of both
    found |= {("c", "x", "x"), ("d", "x", "x"), ("d", "x", "y"), ("e", "x", "y"), ("e", "y", "x"), ("", "", "é"), ("", "é", "z")}
    return spark.createDataFrame(sorted(found), "book_id string, node string, other string")


@pytest.mark.parametrize(("ways", "listed"), [(1_000_000, 4_000_000), (50, 7)])
def test_as_by_grouping(spark, monkeypatch, ways, listed):
    monkeypatch.setattr(paths, "BLOCK_WAYS", ways)
    monkeypatch.setattr(reached, "WAYS", listed)
    arcs = pairs(spark)
    rows = lambda t: sorted(t.select("book_id", "start", "node", "depth").collect())
    found, truth = paths.reach_in_two(arcs), paths.reach(arcs.selectExpr("book_id", "node AS start").distinct(), arcs, 2)
    assert rows(found) == rows(truth) and found.dtypes == truth.dtypes


def test_of_no_arcs(spark):
    assert paths.reach_in_two(pairs(spark).where("book_id = 'none'")).count() == 0


def test_no_way_is_grouped(spark):
    plan = n_hop_reach(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("FlatMapCoGroupsInArrow")[0] and plan.count("FlatMapCoGroupsInArrow") == 1
