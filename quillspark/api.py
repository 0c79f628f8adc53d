"""A facade for serving: health, books and answers to questions, over tables that were built before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import graph, questions, retrieval, vector

MAX_QUESTION, HITS = 500, 5


class UnknownBook(LookupError):
    """The book has no edges; a web layer answers 404."""


class Engine:
    """relations as sources.relations gives them; titles (book_id, title). answer turns (question, facts text) into an answer."""

    def __init__(self, relations: DataFrame, titles: DataFrame | None = None, resolutions: DataFrame | None = None,
                 answer: Callable[[str, str], str] | None = None):
        self.edges = graph.edges(relations)
        self.records = vector.embedding_records(relations).withColumn("vector", vector.hashed_embedding(F.col("text")))
        self.titles, self.resolutions = titles, resolutions
        self.answer = answer or (lambda question, facts: facts)

    def health(self) -> dict:
        return {"status": "ok", "books_loaded": self.edges.select("book_id").distinct().count(), "vectors_indexed": self.records.count()}

    def books(self) -> DataFrame:
        """(book_id, title) of books with an edge, by title; the id stands in for a missing one."""
        found = self.edges.select("book_id").distinct()
        if self.titles is None:
            return found.withColumn("title", F.col("book_id")).orderBy("title")
        return found.join(self.titles, "book_id", "left").select("book_id", F.coalesce("title", "book_id").alias("title")).orderBy("title")

    def query_batch(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Hits, distinct facts and chains for questions (qid, book_id, question), all in one pass."""
        hits, facts, chains = retrieval.hybrid_search(asked, self.records, self.edges, HITS, self.resolutions)
        return hits, retrieval.distinct_facts(facts), chains.dropDuplicates(["qid", "path", "relations"])

    def query(self, book_id: str, question: str) -> dict:
        """Sources, chains and an answer for one question: a batch of one, its few rows brought to the driver."""
        if not 1 <= len(question) <= MAX_QUESTION:
            raise ValueError(f"a question has 1 to {MAX_QUESTION} characters")
        spark = self.edges.sparkSession
        if self.edges.where(F.col("book_id") == book_id).isEmpty():
            raise UnknownBook(book_id)
        asked = spark.createDataFrame([("q", book_id, question)], "qid string, book_id string, question string")
        hits, facts, chains = self.query_batch(asked)
        hit_lines = hits.select(F.col("place").alias("ord"), retrieval.fact_line(F.col("text"), F.col("direction_match")).alias("line"))
        lines = [r["line"] for r in hit_lines.orderBy("ord").collect()]
        chain_rows = chains.select("path", "relations", "directions", "answer", retrieval.chain_line("path", "relations", "directions").alias("line")).collect()
        text = "\n".join(dict.fromkeys([*lines, *(r["line"] for r in chain_rows)])) or "(none)"
        depth = questions.question_plan(asked).first()["hop_depth"]
        return {
            "question": question, "hop_depth": depth, "answer": self.answer(question, text),
            "sources": [r.asDict() for r in facts.drop("qid").orderBy("place", "seq").collect()],
            "chains": [{k: r[k] for k in ("path", "relations", "directions", "answer")} for r in chain_rows],
        }
