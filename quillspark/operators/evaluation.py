"""Question generation, scoring and paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import schema as S
from quillspark.functions import text as X


def hash_order(seed: int, *keys: str) -> Column:
    """A repeatable random order of rows that any engine can follow: md5 of the keys and a seed."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))).cast("binary"))


def hash_sample(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(hash_order(seed, *keys), *keys).limit(n)


def one_hop_questions(edge_table: DataFrame) -> DataFrame:
    """(book_id, seq, question, answer, relation): a forward question for every templated edge."""
    return edge_table.where(F.col("relation").isin(*S.PREDICATES)).select(
        "book_id", "seq", X.question_forward(F.col("src"), F.col("relation")).alias("question"), F.col("dst").alias("answer"), "relation"
    )


def chain_question(start: Column, relations: Column, directions: Column) -> Column:
    """A question for each hop, joined by "Then, "; null if any hop has no template."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size(relations)),
        lambda i: F.when(
            F.element_at(directions, i) == "reverse",
            X.question_reverse(F.when(i == 1, start).otherwise("that entity"), F.element_at(relations, i)),
        ).otherwise(X.question_forward(F.when(i == 1, start).otherwise("that entity"), F.element_at(relations, i))),
    )
    later = F.transform(
        steps, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit("Then, "), F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))
    )
    return F.when(~F.exists(steps, lambda s: s.isNull()), F.array_join(later, " "))


def walk_questions(walks: DataFrame, cap: int | None = 5) -> DataFrame:
    """(book_id, anchor, sequence, question, gold, gold_size, is_unique): nested questions for two-step walks, so many for each sequence."""
    noun = F.create_map(*(F.lit(x) for r, w, n in S.ROLE_STEPS for x in (f"{r}:{w}", n)))
    name = F.array_join(F.transform(X.tokens(F.col("anchor")), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))), " ")
    made = walks.select(
        "book_id", "anchor", F.concat("first", F.lit(" > "), "second").alias("sequence"),
        F.concat(F.lit("Who is the "), noun[F.col("second")], F.lit(" of the "), noun[F.col("first")], F.lit(" of "), name, F.lit("?")).alias("question"),
        "gold", F.size("gold").alias("gold_size"), (F.size("gold") == 1).alias("is_unique"),
    )
    if cap is None:
        return made
    order = Window.partitionBy("book_id", "sequence").orderBy("anchor")
    return made.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def outcome(answers: Column, gold: Column) -> Column:
    """DECLINED without answers, HIT if one is right, else WRONG."""
    return F.when(F.size(answers) == 0, "DECLINED").when(F.arrays_overlap(answers, gold), "HIT").otherwise("WRONG")


def precision(answers: Column, gold: Column) -> Column:
    return F.bround(F.try_divide(F.size(F.array_intersect(answers, gold)), F.size(answers)), 2)


def outcome_shares(scored: DataFrame, *by: str) -> DataFrame:
    """(by, n, hit, declined, wrong): counts and shares by group; overall too where groups are named."""
    share = lambda o: F.round(F.avg((F.col("outcome") == o).cast("double")), 6)
    aggs = [F.count("*").alias("n"), share("HIT").alias("hit"), share("DECLINED").alias("declined"), share("WRONG").alias("wrong")]
    return scored.rollup(*by).agg(*aggs) if by else scored.agg(*aggs)


def gate(hop_depth: Column, target: Column, expected: Column) -> Column:
    """The first gate that a question fails on the way to a chain."""
    return (
        F.when(hop_depth == 0, "G1 hop_depth 0").when(target.isNull(), "G2 target_relation None")
        .when(target != expected, "G3 target_relation wrong").otherwise("passed parse gates")
    )


def paired(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """One row: questions in both arms, in one only, and of the shared ones hits gained and lost."""
    both = a.select(*keys, F.col("outcome").alias("oa")).join(b.select(*keys, F.col("outcome").alias("ob")), list(keys), "full_outer")
    return both.agg(
        F.count_if(F.col("oa").isNotNull() & F.col("ob").isNotNull()).alias("n_both"), F.count_if(F.col("ob").isNull()).alias("only_old"),
        F.count_if(F.col("oa").isNull()).alias("only_new"), F.count_if((F.col("oa") != "HIT") & (F.col("ob") == "HIT")).alias("gained"),
        F.count_if((F.col("oa") == "HIT") & (F.col("ob") != "HIT")).alias("lost"),
    )


def quartiles(rows: DataFrame, value: str) -> DataFrame:
    """rows with the quartile of a value, edges included below, ties together."""
    edges = rows.agg(*(F.expr(f"percentile({value}, {q})").alias(f"q{i}") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))))
    quartile = F.when(F.col(value) <= F.col("q1"), 1).when(F.col(value) <= F.col("q2"), 2).when(F.col(value) <= F.col("q3"), 3).otherwise(4)
    return rows.join(F.broadcast(edges)).withColumn("quartile", quartile).drop("q1", "q2", "q3")  # a single row


def accuracy_at(ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, accuracy) from one ranked list: rows (qid, place, correct), correct at k if any place up to k is."""
    best = ranked.groupBy("qid").agg(F.min(F.when(F.col("correct"), F.col("place"))).alias("best"))
    return best.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), (F.coalesce("best", F.lit(2**31 - 1)) <= k).alias("ok")) for k in ks)))).groupBy("k").agg(
        F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy")
    )


def possessive_questions(edge_table: DataFrame) -> DataFrame:
    """(book_id, seq, relation, kind, subject, question): each templated edge asked by its noun and by the noun's first synonym."""
    nouns = F.create_map(*(F.lit(x) for kv in S.RELATION_NOUNS.items() for x in kv))
    synonyms = F.create_map(*(F.lit(x) for r, ns in S.NOUN_SYNONYMS.items() for x in (r, ns[0])))
    asked = lambda kind, subject, noun: F.struct(
        F.lit(kind).alias("kind"), subject.alias("subject"), F.concat(F.lit("Who is "), subject, F.lit("'s "), noun, F.lit("?")).alias("question")
    )
    both = F.array(
        asked("anchor_noun", F.col("dst"), F.try_element_at(nouns, F.col("relation"))),
        asked("synonym_noun", F.col("src"), F.try_element_at(synonyms, F.col("relation"))),
    )
    return edge_table.select("book_id", "seq", "relation", F.inline(both)).where("question IS NOT NULL")


def failure_bucket(relation: Column, kind: Column) -> Column:
    """Whether a failed possessive question was to be expected, and why, or is new."""
    return (
        F.when((kind == "synonym_noun") & ~relation.isin(*S.NOUN_SYNONYMS), "EXPECTED no synonym")
        .when(~relation.isin(*S.PREDICATES), "EXPECTED untemplated").otherwise("NEW")
    )


def direction_accuracy(questions: DataFrame, hits: DataFrame, facts: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, n_questions, baseline, hybrid): is the fact asked for the first hit itself, and is it among the facts of the first k hits?

    questions (qid, relation, answer); hits (qid, place, relation, entity2); facts (qid, place, relation, dst). One ranking to the
    largest k serves all.
    """
    own = questions.select("qid", F.col("relation").alias("asked"), "answer")
    first = hits.where("place = 1").select("qid", F.col("relation").alias("hr"), F.col("entity2").alias("he"))
    met = facts.join(own, "qid").where("relation = asked AND dst = answer").groupBy("qid").agg(F.min("place").alias("best"))
    each = own.join(first, "qid", "left").join(met, "qid", "left").select(
        F.coalesce((F.col("hr") == F.col("asked")) & (F.col("he") == F.col("answer")), F.lit(False)).cast("double").alias("top"),
        F.coalesce("best", F.lit(2**31 - 1)).alias("best"),
    )
    per_k = each.select("top", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("best") <= k).cast("double").alias("ok")) for k in ks))))
    return per_k.groupBy("k").agg(F.count("*").alias("n_questions"), F.round(F.avg("top"), 6).alias("baseline"), F.round(F.avg("ok"), 6).alias("hybrid"))


def answer_among_hits(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(hops, n_questions, accuracy): is the answer an end of any hit? questions (qid, hops, answer); hits (qid, entity1, entity2)."""
    found = hits.join(questions.select("qid", "answer"), "qid").where("entity1 = answer OR entity2 = answer").select("qid").distinct().withColumn("ok", F.lit(True))
    return questions.join(found, "qid", "left").groupBy("hops").agg(
        F.count("*").alias("n_questions"), F.round(F.avg(F.col("ok").isNotNull().cast("double")), 6).alias("accuracy")
    )


def canonical_outcome(rows: DataFrame, resolutions: DataFrame, *keys: str) -> DataFrame:
    """(keys, outcome): outcome of answers against gold, both sides replaced by their canonical names. rows: (book_id, keys, answers, gold)."""
    from quillspark.operators import resolution

    parts = F.array(F.struct(F.lit("a").alias("side"), F.col("answers").alias("names")), F.struct(F.lit("g").alias("side"), F.col("gold").alias("names")))
    members = rows.select("book_id", *keys, F.inline(parts)).select("book_id", *keys, "side", F.explode_outer("names").alias("name"))
    named = resolution.resolve(members, resolutions, "name")
    pick = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("canonical")))
    return named.groupBy("book_id", *keys).agg(pick("a").alias("answers"), pick("g").alias("gold")).select(
        "book_id", *keys, outcome(F.col("answers"), F.col("gold")).alias("outcome")
    )


def retrieval_flags(questions: DataFrame, hits: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, anchor_retrieved, first_step_retrieved) of nested questions (qid, anchor, relation, first_nodes).

    The anchor is retrieved if a hit has it at an end; the first step if such a hit's other end is one of first_nodes and any fact
    between the two has the first relation.
    """
    at = hits.join(questions, "qid").where("entity1 = anchor OR entity2 = anchor")
    other = F.when(F.col("entity1") == F.col("anchor"), F.col("entity2")).otherwise(F.col("entity1"))
    known = facts.select("qid", "place", F.col("relation").alias("fact")).distinct()
    stepped = at.withColumn("other", other).where(F.array_contains("first_nodes", F.col("other"))).join(known, ["qid", "place"]).where("fact = first_relation")
    a, s = at.select("qid").distinct().withColumn("a", F.lit(True)), stepped.select("qid").distinct().withColumn("s", F.lit(True))
    return questions.select("qid").join(a, "qid", "left").join(s, "qid", "left").select(
        "qid", F.col("a").isNotNull().alias("anchor_retrieved"), F.col("s").isNotNull().alias("first_step_retrieved")
    )


def lost_hits(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(population, n, pure, single, median_gold): hits that are asked no more, beside all hits of before. rows: (keys, outcome, precision, gold_size)."""
    hits = before.where("outcome = 'HIT'").join(after.select(*keys).distinct().withColumn("kept", F.lit(True)), list(keys), "left")
    lost = hits.where("kept IS NULL").withColumn("population", F.lit("lost"))
    return hits.withColumn("population", F.lit("all")).unionByName(lost).groupBy("population").agg(
        F.count("*").alias("n"), F.count_if(F.col("precision") == 1).alias("pure"), F.count_if(F.col("gold_size") == 1).alias("single"),
        F.expr("percentile(gold_size, 0.5)").alias("median_gold"),
    )


def gate_outcomes(rows: DataFrame) -> DataFrame:
    """(gate, same_relation, outcome, n, share): outcomes by gate and by whether a walk repeats a relation, with the share of each such row."""
    n = rows.groupBy("gate", "same_relation", "outcome").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("gate", "same_relation"))  # a few rows
    return n.select("gate", "same_relation", "outcome", "n", F.round(F.col("n") / total, 6).alias("share"))
