"""Cases in which an operator once did less than its whole job."""

import os
import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quillspark.llm import common, components, fingerprints, license_scan, mixing, near_dedup, sentencepiece_codec
from tests.conftest import rows
from tests.llm.test_against_brute_force import components_of, edited_copies, lower, shingles


def near_copies_dropped(texts, size=5, percent=80):
    """Ids that share a component with a smaller one, by brute force over all pairs."""
    sets, top = {}, {}
    for key, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[key], top[key] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}, key
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((top[a], top[b]))
                top = {k: lo if v == hi else v for k, v in top.items()}
    return {k for k, v in top.items() if k != v}


def stage_dropped(spark, texts):
    rows = [(k, t, "en", "a", len(t)) for k, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    return {k for k, _ in texts} - {r["doc_id"] for r in kept}


def test_pipeline_near_dedup_takes_five_words_and_four_fifths(spark):
    longer = [f"a{i}" for i in range(118)]
    own = [f"b{i}" for i in range(200)]
    edited = [f"e{i}" if i % 40 == 20 else w for i, w in enumerate(own)]
    texts = [
        (1, " ".join(longer[:100])), (2, " ".join(longer)),  # 96 / 114 by five words, 98 / 116 by three
        (3, " ".join(own)), (4, " ".join(edited)),  # 171 / 221 by five words, 183 / 213 by three
    ]
    assert stage_dropped(spark, texts) == near_copies_dropped(texts) == {2}


def test_pipeline_near_dedup_brute_force(spark):
    texts = list(enumerate(edited_copies(40, 120, 12, 21) + edited_copies(30, 60, 8, 22)))
    assert stage_dropped(spark, texts) == near_copies_dropped(texts)


@pytest.mark.parametrize("n, sources", [(100, 1), (300, 3), (64, 2)])
def test_op5_slice_that_ends_on_the_target(spark, n, sources):
    made = [(i, "w " * 10, f"s{i % sources}") for i in range(n)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    mixed = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert rows(mixed) == rows(con.sql(mixing.SQL).df())
    if sources == 1:
        assert mixed.taken.sum() == 15 * n


@pytest.mark.parametrize("broken", [lambda words: words[:-1], lambda words: words[::-1], lambda words: [words[0], *words]])
def test_op10_checks_are_of_whole_texts(monkeypatch, broken):
    """Wrong joining of right words is reported by both checks."""
    pieces = sentencepiece_codec.codec(open(sentencepiece_codec.default_model(), "rb").read())
    texts = ["some words in a row", "two  spaces été 🙂", "a b"]
    assert pieces(texts)[1:] == ([True] * 3, [True] * 3)
    whole = pieces.split
    monkeypatch.setattr(pieces, "split", lambda text: broken(whole(text)))
    assert pieces(texts)[1:] == ([False] * 3, [False] * 3)


def test_op1_words_of_a_notice_in_any_order_are_no_notice():
    index = license_scan.LicenseIndex()
    label, notice, (first, second) = license_scan.NOTICES[0]
    start, end = notice.index(first) + len(first), notice.index(second)
    between, after = notice[start:end].split(), notice[end + len(second) :].split()
    mixed = " ".join([first, *between[::-1], second, *after[::-1]])
    assert sorted(mixed.split()) == sorted(notice.split())
    assert label not in index.scan(license_scan.words_of(mixed))[1]
    assert index.scan(license_scan.words_of(notice))[1] == {label: 1.0}
    edited = " ".join([first, *between[:3], "indeed", *between[4:], second, *after[2:5], "indeed", *after[6:]])
    assert label in index.scan(license_scan.words_of(edited))[1]
    assert "all-rights-reserved" in index.scan(license_scan.words_of("Copyright 2020 by Some Company Inc. All rights reserved."))[1]


def test_op8_lexicon_keeps_the_whole_band(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "MAX_LEXICON", 10, raising=False)
    texts = [" ".join(f"w{i % k}x{k}" for k in range(2, 40)) for i in range(60)]
    counts = Counter(w for t in texts for w in set(t.split()))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    band = [w for w, n in counts.items() if fingerprints.LEAST_SHARE * 60 <= n <= fingerprints.MOST_SHARE * 60]
    assert len(fingerprints.build_lexicon(docs)) == len(band) > 100


def test_op7_recall_of_pairs_just_over_the_limit(spark):
    """2,000 planted pairs at 0.85 to 0.90, each a group of its own: none is missed."""
    draw, made, close = random.Random(8), [], 0
    for i in range(2_000):
        words = [f"{i}w{j}" for j in range(draw.randrange(80, 160))]
        copy = list(words)
        while True:
            at = draw.randrange(len(copy))
            edited = [*copy[:at], f"{i}e{len(made)}x{at}", *copy[at + 1 :]]
            a, b = shingles(" ".join(words)), shingles(" ".join(edited))
            if 100 * len(a & b) < 85 * len(a | b):
                break
            copy = edited
        a, b = shingles(" ".join(words)), shingles(" ".join(copy))
        close += 100 * len(a & b) <= 90 * len(a | b)
        made += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    assert close > 1_900
    found = near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string"))
    assert found.where("component_id = doc_id - doc_id % 2").count() == 4_000


def test_op7_repeated_ids_in_a_large_group(spark, monkeypatch):
    """Several sets under one id take part with all of them."""
    monkeypatch.setattr(near_dedup, "SMALL_GROUP", 4)
    monkeypatch.setattr(near_dedup, "RARE", 3)
    texts = edited_copies(50, 100, 12, 31)
    made = [(i % 40, t) for i, t in enumerate(texts)]
    sets = [(k, shingles(t)) for k, t in made]
    truth = {k: k for k, _ in made}
    for i, (k, a) in enumerate(sets):
        for j, b in sets[:i]:
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                lo, hi = sorted((truth[k], truth[j]))
                truth = {x: lo if v == hi else v for x, v in truth.items()}
    found = near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert len(found) == 50 and {r["doc_id"]: r["component_id"] for r in found} == truth


@pytest.mark.parametrize("most", [common.TASK_ROWS, 0])
def test_written_tables_are_removed_once_used(spark, monkeypatch, most):
    monkeypatch.setattr(common, "TASK_ROWS", most)
    before = set(common._written)
    found = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(30)], "src bigint, dst bigint"))
    left = set(common._written) - before
    assert found.count() == 31 and len(left) == 2  # what the result is read from
    assert all(os.path.isdir(p.removeprefix("file:")) for p in left)


def test_join_back_to_a_written_aggregate_is_split(spark):
    """Half of the rows have one key: adaptive execution splits its join once the aggregate is written out."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    }
    held = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        made = common.materialise(spark.range(200_000).selectExpr("if(id % 2 = 0, 0, id) AS k", "id"), "rows")
        joined = made.join(common.materialise(made.groupBy("k").count(), "counts"), "k")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
