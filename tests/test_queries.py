"""Every registered query of the library against the SQL for the same rows."""

import pytest

import __spark_entry__ as entry
from quillspark import registry
from tests.conftest import SF, rows


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert rows(found) == rows(duck.sql(registry.ORACLES[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def plain_embedding(text, dimensions=64):
    import hashlib
    import math
    import re

    counts = [0.0] * dimensions
    for word in filter(None, re.split("[^a-z0-9]+", text.lower())):
        counts[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dimensions] += 1
    total = 0.0
    for c in counts:
        total += c * c
    return [c / math.sqrt(total) for c in counts]


def test_hybrid_hits_brute_force(spark):
    from quillspark.operators import evaluation, graph, vector
    from quillspark.plans.evaluation_queries import hybrid_hits
    from quillspark.sources import relations as R

    r = R.event_relations(spark, SF)
    records = [(x["id"], x["book_id"], plain_embedding(x["text"])) for x in vector.embedding_records(r).collect()]
    asked = evaluation.one_hop_questions(graph.edges(r)).where("seq % 50 = 0").collect()
    truth = set()
    for q in asked:
        v = plain_embedding(f"{q['question'].removesuffix('?')} and who protects the friend of {q['answer']}?")
        near = sorted((sum((a - b) * (a - b) for a, b in zip(v, w)), i) for i, book, w in records if book == q["book_id"])[:5]
        truth |= {(f"{q['book_id']}|{q['seq']}", round(d, 6)) for d, _ in near}
    found = hybrid_hits(spark, SF).join(vector.embedding_records(r).select("id", "text"), "id").collect()
    assert len(found) == sum(min(5, sum(b == q["book_id"] for _, b, _ in records)) for q in asked)
    texts = {q["book_id"] + "|" + str(q["seq"]): f"{q['question'].removesuffix('?')} and who protects the friend of {q['answer']}?" for q in asked}
    for x in found:
        d = sum((a - b) * (a - b) for a, b in zip(plain_embedding(texts[x["qid"]]), plain_embedding(x["text"])))
        assert (x["qid"], round(d, 6)) in truth


def test_fuzzy_pairs_brute_force(spark):
    import difflib

    from quillspark.plans.common import event_nodes
    from quillspark.plans.more_queries import fuzzy_name_pairs

    names = [(r["book_id"], r["node"]) for r in event_nodes(spark, SF).collect()]
    truth = {
        (b, x, y) for b, x in names for c, y in names
        if b == c and x < y and difflib.SequenceMatcher(None, x, y).ratio() > 0.6
    }
    assert {(r["book_id"], r["a"], r["b"]) for r in fuzzy_name_pairs(spark, SF).collect()} == truth


def test_three_hop_questions(spark, duck):
    from quillspark.plans.evaluation_queries import THREE_HOP_SQL, three_hop_questions

    assert rows(three_hop_questions(spark, SF).toPandas()) == rows(duck.sql(THREE_HOP_SQL).df())


def test_retrieval_is_stable(spark):
    from quillspark.plans.evaluation_queries import retrieval_stability

    found = retrieval_stability(spark, SF).first()
    assert found["n_questions"] == found["n_equal"] > 0


def test_stability_asks_every_templated_edge(spark, duck):
    from quillspark import schema as S
    from quillspark.plans.common import EVENTS, listed
    from quillspark.plans.evaluation_queries import retrieval_stability

    templated = duck.sql(f"with {EVENTS} select count(*) from e where relation in {listed(S.PREDICATES)}").df().iloc[0, 0]
    assert retrieval_stability(spark, SF).first()["n_questions"] == templated
