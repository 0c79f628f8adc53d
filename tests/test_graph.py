"""Graphs, paths, trajectories, retrieval and resolution on small fixed cases, and paths against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation, graph, paths, resolution, retrieval, temporal, vector
from quillspark.sources import relations as R

RAW = "book_id string, chunk_id int, seq bigint, entity1 string, entity2 string, entity1Type string, entity2Type string, relation string"


def relations(spark, triples, book="1"):
    return spark.createDataFrame([(book, t[3] if len(t) > 3 else i, i, t[0], t[2], "PER", "PER", t[1]) for i, t in enumerate(triples)], RAW)


def edges(spark, triples):
    return graph.edges(relations(spark, triples))


def test_parallel_edges_and_surface_forms(spark):
    r = relations(spark, [("Tarzan", "companion_of", "Taug"), ("Tarzan", "companion_of", "Taug"), ("Bolgani, the gorilla", "enemy_of", "Tarzan"), ("Bolgani", "enemy_of", "Tarzan")])
    assert graph.edges(r).count() == 4
    forms = {n["node"]: n["surface_forms"] for n in graph.nodes(r).collect()}
    assert forms == {"tarzan": ["Tarzan"], "taug": ["Taug"], "bolgani": ["Bolgani", "Bolgani, the gorilla"]}


def test_trajectories(spark):
    e = edges(spark, [("a", "companion_of", "b", 0), ("a", "owns", "c", 9), ("a", "screaming at", "c", 5)])
    book = temporal.book_trajectory(e).collect()
    assert len(book) == 6 and sum(r["cnt"] for r in book) == 2
    pairs = spark.createDataFrame([("1", "b", "a"), ("1", "a", "nobody")], "book_id string, a string, b string")
    counts = {(r["lo"], r["hi"], r["bin"]): r["cnt"] for r in temporal.pair_trajectory(e, pairs).collect()}
    assert counts["a", "b", 1] == 1 and sum(counts.values()) == 1 and len(counts) == 12


def test_active_pairs(spark):
    e = edges(spark, [("tarzan", "companion_of", "teeka", 0), ("teeka", "friend_of", "tarzan", 1), ("tarzan", "companion_of", "taug", 1), ("tarzan", "enemy_of", "numa", 90)])
    found = [(r["lo"], r["hi"], r["cnt"]) for r in temporal.active_pairs(e, 2).where("bin = 1").orderBy("place").collect()]
    assert found == [("tarzan", "teeka", 2), ("tarzan", "taug", 1)]


def test_weighted_mean(spark):
    t = spark.createDataFrame([("x", 1, 1), ("x", 2, 0), ("x", 3, 3), ("y", 1, 0)], "book_id string, bin int, cnt bigint")
    assert {r["book_id"]: r["mean_bin"] for r in temporal.weighted_mean_bin(t, ["book_id"]).collect()} == {"x": 2.5, "y": None}


MIXED = [("taug", "companion_of", "akut"), ("teeka", "companion_of", "taug"), ("akut", "child_of", "duro")]


def test_reach_and_paths_of_a_mixed_graph(spark):
    arcs = graph.arcs(edges(spark, MIXED))
    starts = spark.createDataFrame([("1", s) for s in ("taug", "duro", "akut")], "book_id string, start string")
    reach = {(r["start"], r["node"]): r["depth"] for r in paths.reach(starts, arcs, 2).collect()}
    assert reach["taug", "teeka"] == 1 and not any(s == "duro" for s, _ in reach)
    one = {(r["start"], r["end"]): r["directions"] for r in paths.paths_up_to(starts, arcs, 1).collect()}
    assert one["taug", "teeka"] == ["reverse"]
    assert ("akut", "duro") in {(r["start"], r["end"]) for r in paths.paths_up_to(starts, arcs, 2).collect()}


def plain_search(triples, start, hops, most, allowed):
    """Depth-first search written from the definition: neighbours by first appearance, forward arcs before backward ones."""
    symmetric = {"friend_of", "enemy_of"}
    arcs = []
    for direction in ("forward", "reverse"):
        met = {}
        for i, (s, r, d) in enumerate(triples):
            node, other = (s, d) if direction == "forward" else (d, s)
            met.setdefault((node, other), []).append((i, r))
        arcs.append(met)

    def nexts(node):
        seen = []
        for direction, met in zip(("forward", "reverse"), arcs):
            for (n, other), found in met.items():
                for _, r in found if n == node else []:
                    arc = (other, r, direction)
                    if (direction == "forward" or r in symmetric) and arc not in seen:
                        seen.append(arc)
        return seen

    out = []

    def walk(path, rels, dirs):
        for other, r, direction in nexts(path[-1]):
            if len(out) >= most:
                return
            if other in path[:-1] or r not in allowed:
                continue
            out.append((path + [other], rels + [r], dirs + [direction]))
            if len(rels) + 1 < hops:
                walk(path + [other], rels + [r], dirs + [direction])

    walk([start], [], [])
    kept = []
    for p in out:
        if all(p[:2] != k[:2] for k in kept):
            kept.append(p)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_paths_follow_a_depth_first_search(spark, seed):
    draw = random.Random(seed)
    kinds = ["friend_of", "enemy_of", "owns", "child_of"]
    triples = [(f"n{draw.randrange(7)}", draw.choice(kinds), f"n{draw.randrange(7)}") for _ in range(40)]
    allowed = kinds[:3]
    starts = spark.createDataFrame([("1", "n0", allowed)], "book_id string, start string, allowed array<string>")
    found = paths.paths_up_to(starts, graph.arcs(edges(spark, triples)), 3).orderBy("rank").collect()
    assert [(r["path"], r["relations"], r["directions"]) for r in found] == [tuple(p) for p in plain_search(triples, "n0", 3, 20, allowed)]


def test_reach_is_the_ends_of_paths(spark):
    draw = random.Random(9)
    arcs = graph.arcs(edges(spark, [(f"n{draw.randrange(9)}", "owns", f"n{draw.randrange(9)}") for _ in range(14)]))
    starts = arcs.select("book_id", F.col("node").alias("start")).distinct()
    ends = {(r["start"], r["end"]) for r in paths.paths_up_to(starts, arcs, 2, 10_000).collect() if r["end"] != r["start"]}
    assert ends == {(r["start"], r["node"]) for r in paths.reach(starts, arcs, 2).collect()}


def test_exact_paths_take_the_last_group_whole(spark):
    e = edges(spark, [("a", "owns", "b"), ("b", "owns", "c"), ("b", "owns", "c"), ("b", "owns", "d")])
    order = spark.createDataFrame([("1", "a", 0), ("1", "b", 1)], "book_id string, start string, first_seen bigint")
    found = paths.paths_exact(order, graph.all_arcs(e), 2, 1).collect()
    assert sorted(r["path"] for r in found) == [["a", "b", "c"], ["a", "b", "c"], ["a", "b", "d"]]


KNIGHT = [("knight", "friend_of", "squire"), ("squire", "protector_of", "lord")]


def search(spark, triples, question, entity1, entity2, relation):
    q = spark.createDataFrame([("q", "1", question)], "qid string, book_id string, question string")
    hits = spark.createDataFrame([("q", 1, "1", entity1, entity2, relation)], "qid string, place bigint, book_id string, entity1 string, entity2 string, relation string")
    return retrieval.annotated_hits(q, hits), retrieval.chains_for(retrieval.expansions(q, hits), edges(spark, triples))


def test_chain_for_a_two_step_question(spark):
    hits, chains = search(spark, KNIGHT, "who protects the friend of the knight?", "knight", "squire", "friend_of")
    assert hits.first()["direction_match"] is False
    assert [(r["end"], r["answer"]) for r in chains.collect()] == [("lord", "squire")]


def test_no_chain_back_to_the_start(spark):
    triples = [("knight", "companion_of", "squire"), ("squire", "protector_of", "lord")]
    _, chains = search(spark, triples, "who protects the companion of the knight?", "knight", "squire", "companion_of")
    assert {r["end"] for r in chains.collect()} == {"lord"}


def test_no_chains_for_one_relation(spark):
    assert search(spark, KNIGHT, "who is the friend of the knight?", "knight", "squire", "friend_of")[1].count() == 0


def test_chain_that_goes_on_after_its_target_is_dropped(spark):
    schema = "hit_id string, qid string, book_id string, start string, other string, target string, path array<string>, relations array<string>, directions array<string>, rank array<bigint>"
    a = ["mrs. transome", "harold", "jermyn"]
    chains = spark.createDataFrame([
        ("h", "q", "1", a[0], "x", "parent_father_of", a, ["parent_mother_of", "parent_father_of"], ["forward"] * 2, [1, 1]),
        ("h", "q", "1", a[0], "x", "parent_father_of", [*a, "daughters"], ["parent_mother_of", "parent_father_of", "parent_father_of"], ["forward"] * 3, [1, 1, 1]),
    ], schema)
    assert [r["path"] for r in retrieval.select_chains(chains).collect()] == [a]


def test_hybrid_search(spark):
    r = relations(spark, KNIGHT)
    records = vector.embedding_records(r).withColumn("vector", vector.hashed_embedding(F.col("text")))
    q = spark.createDataFrame([("q", "1", "who protects the friend of the knight?"), ("z", "9", "who?")], "qid string, book_id string, question string")
    hits, facts, chains = retrieval.hybrid_search(q, records, graph.edges(r), 2)
    assert hits.count() == 2 and facts.count() == 2 and {c["end"] for c in chains.collect()} == {"lord"}


def test_lines(spark):
    t = spark.createDataFrame([("A is B", True), ("A is B", False), ("A is B", None)], "t string, m boolean")
    assert [("(note" in r["x"]) for r in t.select(retrieval.fact_line(F.col("t"), F.col("m")).alias("x")).collect()] == [False, True, False]
    c = spark.createDataFrame([(["a", "b", "c"], ["friend_of", "owned_by"], ["reverse", "forward"])], "p array<string>, r array<string>, d array<string>")
    assert c.select(retrieval.chain_line(F.col("p"), F.col("r"), F.col("d"))).first()[0] == "b is a friend of a. b is owned by c"
    lines = spark.createDataFrame([("q", 2, "x"), ("q", 1, "y"), ("q", 3, "x")], "qid string, ord int, line string")
    assert retrieval.facts_text(lines).first()["facts_text"] == "y\nx"


def test_resolution(spark):
    names = ["mr. morel", "walter morel", "jacob", "jacob jr.", "count isnard", "count d'angiers", "her son", "gertrude holt", "mrs. holt", "felix holt"]
    n = spark.createDataFrame([("1", x) for x in names], "book_id string, node string")
    found = {r["raw_name"]: (r["tier"], r["canonical_form"]) for r in resolution.resolution_map(n).collect()}
    assert found == {"mr. morel": (resolution.VARIANT, "walter morel"), "her son": (resolution.PRONOUN, None), "mrs. holt": (resolution.AMBIGUOUS, None)}
    resolved = {r["node"]: (r["canonical"], r["excluded"]) for r in resolution.resolve(n, resolution.resolution_map(n)).collect()}
    assert resolved["mr. morel"] == ("walter morel", False) and resolved["mrs. holt"] == ("mrs. holt", True)


def test_embedding_records(spark):
    rows = [("106", 10, i, "Taug", "Tarzan", "PER", "PER", r) for i, r in enumerate(["companion_of"] * 3 + ["owns"])] + [("106", 10, 9, "Numa, the lion", "Taug", "PER", "PER", "owns")]
    found = {r["id"]: r for r in vector.embedding_records(spark.createDataFrame(rows, RAW)).collect()}
    assert set(found) == {"106_10_Taug_Tarzan_companion_of", "106_10_Taug_Tarzan_owns", "106_10_Numa, the lion_Taug_owns"}
    assert found["106_10_Numa, the lion_Taug_owns"]["entity1"] == "numa" and "Numa, the lion" in found["106_10_Numa, the lion_Taug_owns"]["text"]


def test_chain_question(spark):
    c = spark.createDataFrame([(["companion_of"] * 2, ["forward"] * 2), (["companion_of", "owns"], ["forward"] * 2)], "r array<string>, d array<string>")
    found = [r[0] for r in c.select(evaluation.chain_question(F.lit("taug"), F.col("r"), F.col("d"))).collect()]
    assert found == ["Who is taug a companion of? Then, who is that entity a companion of?", None]


def test_outcomes(spark):
    t = spark.createDataFrame([([], ["a"]), (["a", "b"], ["a"]), (["c"], ["a"])], "x array<string>, g array<string>")
    found = t.select(evaluation.outcome(F.col("x"), F.col("g")).alias("o"), evaluation.precision(F.col("x"), F.col("g")).alias("p")).collect()
    assert [(r["o"], r["p"]) for r in found] == [("DECLINED", None), ("HIT", 0.5), ("WRONG", 0.0)]


def test_tables(spark, tmp_path):
    e = edges(spark, KNIGHT)
    R.write_table(e, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    records = vector.embedding_records(relations(spark, KNIGHT))
    assert R.write_records(records, str(tmp_path / "r"), 1) == 2
    with pytest.raises(ValueError):
        R.write_records(records.unionAll(records), str(tmp_path / "r2"))
    R.write_csv(graph.nodes(relations(spark, KNIGHT)), str(tmp_path / "c"))
    assert R.read_csv(spark, str(tmp_path / "c"), "utf-8").count() == 3
    R.write_json(e, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_approximate_neighbours(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id bigint, vector array<double>")
    assert {r["id"] for r in vector.approximate_nearest(v, [3.0, 0.0], 1, 4.0).collect()} == {3}
