"""Names, sentences, questions and phrases on small fixed cases."""

import pytest
from pyspark.sql import functions as F

from quillspark import schema as S
from quillspark.functions import text as X
from quillspark.operators import questions as Q, temporal, vector
from quillspark.sources import relations as R


def apply(spark, f, *columns):
    names = [f"c{i}" for i in range(len(columns))]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*columns))], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r["x"] for r in table.select("i", f(*map(F.col, names)).alias("x")).orderBy("i").collect()]


def test_vocabulary_sizes():
    assert len(S.CANONICAL_RELATIONS) == 47 and len(S.PREDICATES) == 31 and len(S.SYMMETRIC_RELATIONS) == 7


def test_canonical_names(spark):
    names = ["Bolgani, the gorilla", "Numa, the lion", "  Tarzan  ", "Bulabantu", "\tX, THE  y \n", "", None]
    once = apply(spark, X.normalize_entity, names)
    assert once == ["bolgani", "numa", "tarzan", "bulabantu", "x", "", None]
    assert apply(spark, X.normalize_entity, once) == once


@pytest.mark.parametrize("flagged, names", [
    (True, ["her", "his", "her own son", "  her son  ", "daughters", "sonnes", "children", "thee", "hers", "son", "my son", "mother"]),
    (False, ["harold", "mrs. transome", "the king of camelot", "", "  ", "lawyer"]),
])
def test_pronoun_generic(spark, flagged, names):
    assert set(apply(spark, X.is_pronoun_generic, names)) == {flagged}


def test_nameable(spark):
    names = ["her son", "mother", "the count", "gentlewoman", "a b c d e f g", "", "harold transome", "taug"]
    assert apply(spark, X.is_nameable, names) == [False] * 6 + [True] * 2


def test_core_words(spark):
    assert apply(spark, X.core_tokens, ["mrs. holt", "the count", "count d'angiers"]) == [["holt"], [], ["d'angiers"]]


def test_variant_pairs(spark):
    a, b = ["mr. morel", "jacob", "count isnard", "morel"], ["walter morel", "jacob jr.", "count d'angiers", "gertrude"]
    assert apply(spark, lambda x, y: X.is_variant_pair(x, y) & ~X.differs_only_by_suffix(x, y), a, b) == [True, False, False, False]


def test_sentences(spark):
    rows = (["Taug"] * 4, ["Akut"] * 4, ["companion_of", "owned_by", "travels_by", "screaming at"])
    assert apply(spark, X.sentence, *rows) == [
        "Taug is a companion of Akut", "Taug is owned by Akut", "Taug travels by Akut", "Taug screaming at Akut",
    ]


def test_questions(spark):
    assert apply(spark, X.question_forward, ["Will", "Bob", "Ann"], ["child_of", "travel_to", "believes_in"]) == [
        "Who is Will a child of?", "Where does Bob travel to?", None,
    ]
    assert apply(spark, X.question_reverse, ["paris", "x"], ["travel_to", "believes_in"]) == ["Who travels to paris?", None]


def test_name_shapes(spark):
    assert apply(spark, X.name_shape, ["Sir Kay", "Ludwig van Beethoven", "anna of kent", "Taug"]) == ["title", "particle", "multiword", "plain"]


DIRECTIONS = [
    ("Who is Taug a protector of?", "taug", "protector_of", "forward"), ("Who protects Taug?", "Taug", "protector_of", "reverse"),
    ("who is the friend of knight", "knight", "friend_of", "reverse"), ("who is Taug's employer?", "taug", "employer_of", "reverse"),
    ("who is Harold Transome's mother?", "harold", "parent_mother_of", "reverse"), ("what does x believe", "x", "believes_in", None),
    ("Who is a protector of Kala?", "taug", "protector_of", None), ("the old mother ship of Ann", "an", "parent_mother_of", None),
    ("Where did Taug travel to", "taug", "travel_to", None), ("who is the husband of Esther?", "esther", "spouse_of", "reverse"),
]


def test_directions(spark):
    table = spark.createDataFrame([(i, *d[:3], "nobody") for i, d in enumerate(DIRECTIONS)], "i int, question string, entity1 string, relation string, entity2 string")
    assert [r["d1"] for r in Q.with_directions(table).orderBy("i").collect()] == [d[3] for d in DIRECTIONS]


def test_expansion_side_and_undecided_match(spark):
    table = spark.createDataFrame(
        [(q, "kala", "taug", "friend_of") for q in ("Who is kala a friend of?", "Who is a friend of taug?", "what now")],
        "question string, entity1 string, entity2 string, relation string",
    )
    found = [(r["direction_match"], r["expand_from"]) for r in Q.with_directions(table).collect()]
    assert found == [(True, "taug"), (True, "kala"), (None, None)]


@pytest.mark.parametrize("question, depth, target", [
    ("who is the friend of x?", 0, "friend_of"), ("who protects the friend of the knight?", 1, "protector_of"), ("what is this?", 0, None),
    ("the friend of the friend of x", 0, "friend_of"),
    ("the friend of the enemy of the rival of the mentor of the leader of x", 3, "friend_of"), ("who is x's brother's friend?", 1, "friend_of"),
    ("the son of x", 2, None),
])
def test_plans(spark, question, depth, target):
    plan = Q.question_plan(spark.createDataFrame([(1, question)], "qid int, question string")).first()
    assert (plan["hop_depth"], plan["target"]) == (depth, target)


PHRASES = {
    "near the end of the book": (0.95, 1.0, "point_window", 20, 20), "in the first third": (0.0, 1 / 3, "fractional_span", 1, 7),
    "the last quarter": (0.75, 1.0, "fractional_span", 16, 20), "by the middle of the story": (0.0, 0.5, "cumulative", 1, 11),
    "early in the book": (0.0, 0.15, "point_window", 1, 4), "the second half": (0.5, 1.0, "fractional_span", 11, 20),
}


def test_phrases(spark):
    table = spark.createDataFrame([(p,) for p in PHRASES], "q string").withColumn("s", temporal.parse_phrase(F.col("q")))
    for r in table.withColumn("b", temporal.resolve_bins(F.col("s"), F.lit(20))).collect():
        start, end, kind, first, last = PHRASES[r["q"]]
        assert (r["s"]["start_frac"], r["s"]["end_frac"]) == pytest.approx((start, end)) and r["s"]["kind"] == kind
        assert (r["b"]["start_bin"], r["b"]["end_bin"]) == (first, last)
    assert apply(spark, temporal.parse_phrase, ["who is he?", "nothing here"]) == [None, None]


def test_bins_stay_in_range(spark):
    from quillspark.plans.other_queries import phrase_bins

    assert phrase_bins(spark, "").where("NOT (1 <= start_bin AND start_bin <= end_bin AND end_bin <= bins)").count() == 0


def test_bin_formulas(spark):
    assert [r["x"] for r in spark.createDataFrame([(1280,), (10,), (150,)], "n int").select(temporal.num_bins(F.col("n")).alias("x")).collect()] == [20, 6, 10]
    cases = spark.createDataFrame([(100, 0, 882, 20, 3), (105, 100, 982, 20, 1), (882, 0, 882, 20, 20)], "c int, a int, b int, n int, want int")
    assert cases.where(temporal.bin_of(F.col("c"), F.col("a"), F.col("b"), F.col("n")) != F.col("want")).count() == 0


def test_parsing(spark):
    texts = ["[]", "[{'entity1': \"O'Brien\", 'entity2': 'x', 'relation': 'owns'}]", "[{'entity1': ", None, "7"]
    found = apply(spark, R.parse_relations, texts)
    assert found[0] == [] and found[1][0]["entity1"] == "O'Brien" and found[2:] == [None, None, None]


def test_chunks_with_bad_relations_go(spark):
    raw = spark.createDataFrame([("1", "0", "[]"), ("1", "1", "[{"), ("1", "2", "[{'entity1': 'a', 'entity2': 'b', 'relation': 'owns'}]")], "book_id string, chunk_id string, relations string")
    chunks = R.load_chunks(raw)
    assert chunks.count() == 2 and [(r["chunk_id"], r["entity1"]) for r in R.explode_relations(chunks).collect()] == [(2, "a")]


def test_embedding_is_a_unit_vector(spark):
    v = apply(spark, vector.hashed_embedding, ["a b a", "a b a"])
    assert v[0] == v[1] and len(v[0]) == 64 and sum(x * x for x in v[0]) == pytest.approx(1)


def test_model_embedding(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    embed = vector.model_embedding(load)
    assert apply(spark, lambda c: embed(c), ["abc", ""]) == [[3.0, 1.0], [0.0, 1.0]]


def test_guess_language(spark):
    texts = ["le chat et la souris des champs est une", "der und die das ist nicht", "el perro para la casa con una", "the cat"]
    assert apply(spark, X.guess_language, texts) == ["likely_french", "likely_german", "likely_spanish", "likely_english"]
