"""Hybrid retrieval: vector hits, the graph's facts about them, and chains that answer the question, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import schema as S
from quillspark.functions import text as X
from quillspark.operators import graph, paths, questions as Q, resolution, vector


def annotated_hits(question_rows: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (qid, place, book_id, entity1, entity2, relation, distance) of questions (qid, question, ...) with direction columns."""
    return Q.with_directions(hits.join(question_rows.select("qid", "question"), "qid"))


def expansions(question_rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that chains start from: (hit_id, qid, book_id, start, other, allowed, target, depth).

    Only for questions with more than one relation and a decided target, and hits with a decided end.
    """
    plan = Q.question_plan(question_rows).where("hop_depth > 0 AND target IS NOT NULL")
    usable = annotated_hits(question_rows, hits).join(plan, "qid").where("expand_from IS NOT NULL")
    extra = (F.col("expand_from") == F.col("entity1")) | X.is_symmetric(F.col("relation"))
    return usable.select(
        F.concat_ws("|", "qid", "place").alias("hit_id"), "qid", "book_id", F.col("expand_from").alias("start"),
        F.when(F.col("expand_from") == F.col("entity1"), F.col("entity2")).otherwise(F.col("entity1")).alias("other"),
        F.col("relations").alias("allowed"), "target", (F.col("hop_depth") + extra.cast("int")).alias("depth"),
    )


def select_chains(chains: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Chains that end in the target relation, say something new, and answer with a name; adds answer.

    chains: (hit_id, qid, book_id, start, other, target, path, relations, directions, rank). A chain is redundant if a shorter
    one of the same hit, on a prefix of its path, ends in the target already.
    """
    shorter = chains.where(F.element_at("relations", -1) == F.col("target")).select("hit_id", F.col("path").alias("prefix")).distinct()
    ends = chains.where(F.element_at("relations", -1) == F.col("target"))
    again = (F.size("prefix") < F.size("path")) & (F.slice("path", 1, F.size("prefix")) == F.col("prefix"))
    kept = ends.alias("c").join(shorter.alias("s"), (F.col("c.hit_id") == F.col("s.hit_id")) & again, "left_anti")
    last = F.element_at("directions", -1)
    answer = F.when(X.is_symmetric(F.col("target")) | (last != "forward"), F.element_at("path", -1)).otherwise(F.element_at("path", -2))
    kept = kept.withColumn("answer", answer)
    if resolutions is not None:
        kept = resolution.resolve(kept, resolutions, "answer").drop("answer", "excluded").withColumnRenamed("canonical", "answer")
    trivial = (F.size("path") == 2) & ((F.col("answer") == F.col("start")) | (F.col("answer") == F.col("other")))
    return kept.where(~X.is_pronoun_generic(F.col("answer")) & ~trivial)


def hybrid_search(
    question_rows: DataFrame, records: DataFrame, edge_table: DataFrame, k: int = 5, resolutions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, facts, chains) for questions (qid, book_id, question) against records (id, text, book_id, entity1, entity2, relation, vector).

    hits carry direction_match and are never filtered by it; facts are all edges between a hit's entities; books without edges
    give no hits.
    """
    q = question_rows.withColumn("vector", vector.hashed_embedding(F.col("question"))).withColumnRenamed("qid", "query_id")
    near = vector.nearest(q, records, k, "book_id")
    hits = near.withColumnRenamed("query_id", "qid").join(records.drop("vector"), "id")
    hits = hits.join(edge_table.select("book_id").distinct(), "book_id", "left_semi")
    hits = annotated_hits(question_rows, hits)
    facts = graph.pair_facts(
        hits.select("qid", "place", "book_id", F.col("entity1").alias("a"), F.col("entity2").alias("b")), edge_table
    ).select("qid", "place", "book_id", "src", "relation", "dst", "chunk_id", "seq")
    return hits, facts, chains_for(expansions(question_rows, hits.select("qid", "place", "book_id", "entity1", "entity2", "relation")), edge_table, resolutions)


def chains_for(starts: DataFrame, edge_table: DataFrame, resolutions: DataFrame | None = None, max_depth: int = 4) -> DataFrame:
    """Chains of each expansion, no deeper than its own depth."""
    return select_chains(paths.paths_up_to(starts, graph.arcs(edge_table), max_depth, S.MAX_PATHS, key="hit_id"), resolutions)


def distinct_facts(facts: DataFrame) -> DataFrame:
    """The first occurrence of each fact of a question over its hits, in order."""
    order = Window.partitionBy("qid", "src", "relation", "dst", "chunk_id").orderBy("place", "seq")
    return facts.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def fact_line(text, match):
    """A fact as a line; with a warning only if the direction is known to be wrong."""
    return F.concat(F.lit("- "), text, F.when(match == F.lit(False), " (note: stored in the other direction than asked)").otherwise(""))


def chain_line(path, relations, directions):
    """A chain's hops as sentences in their stored order."""
    hops = F.transform(
        F.sequence(F.lit(1), F.size(relations)),
        lambda i: X.sentence(
            F.when(F.element_at(directions, i) == "reverse", F.element_at(path, i + 1)).otherwise(F.element_at(path, i)),
            F.when(F.element_at(directions, i) == "reverse", F.element_at(path, i)).otherwise(F.element_at(path, i + 1)),
            F.element_at(relations, i),
        ),
    )
    return F.array_join(hops, ". ")


def facts_text(lines: DataFrame) -> DataFrame:
    """(qid, facts_text) from (qid, ord, line): distinct lines in order, joined; at most the hits of one question each."""
    first = lines.groupBy("qid", "line").agg(F.min("ord").alias("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return first.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("facts_text"))
