"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import (
    fingerprints, language_id, license_scan, mixing, near_dedup, quality_model, quality_rules, sentencepiece_codec, sharding, url_filter,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the long text goes on and on about many things " * 20_000
ROWS = [
    (1, "Released under the MIT License.", "en", "a", 31), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t ", "fr", None, 4),
    (5, LONG, "en", "a", len(LONG)), (6, "same words here again and again", "en", "b", 31), (6, "same words here again and again", "en", "b", 31),
    (7, "same words here again and again", None, None, 31), (None, "a text without an id", "de", "c", 20), (None, None, None, None, None),
    (8, "été à la plage où il fait beau", "fr", "c", 30), (9, "x", "en", "c", 1),
]
CLASHING = [
    "size", "n", "id", "slot", "shard", "label", "score", "u", "q", "slice", "target", "bands", "key", "_id", "_key", "_text", "_q_w", "n_words",
    "component", "rep", "ids", "rank", "term", "edge", "kept", "copies", "held_out",
]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, DOCS)
    return made.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, None, 0), (6, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")


def model(docs, labels):
    return quality_model.train_quality(docs, labels)


OPERATORS = {
    "license": lambda d, lab: license_scan.scan_licenses(d),
    "quality": lambda d, lab: quality_model.score_quality(d, model(d, lab)),
    "shards": lambda d, lab: sharding.shard_documents(d),
    "carried": lambda d, lab: sharding.shard_documents(d, n_shards=3, carry=("text", "size")).drop("text"),
    "mix": lambda d, lab: mixing.mix_sources(d),
    "language": lambda d, lab: language_id.identify_languages(d, *language_id.train_languages(d)),
    "near": lambda d, lab: near_dedup.near_duplicates(d),
    "edits": lambda d, lab: fingerprints.fingerprint_edits(d),
    "marks": lambda d, lab: fingerprints.fingerprint_documents(d),
    "rules": lambda d, lab: quality_rules.quality_rules(d),
    "pieces": lambda d, lab: sentencepiece_codec.encode_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_one_result(docs, labels, name):
    assert OPERATORS[name](docs, labels).count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.where("false"), labels.where("false")).count() == 0


def test_edge_results(docs, labels):
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert (found[1]["base_labels"], found[1]["n_base"], found[1]["first_word"]) == ("mit", 1, 1)
    assert (found[2]["n_words"], found[2]["first_word"], found[2]["labels"], found[2]["score"]) == (0, None, "", 0.0)
    near = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert near[7]["component_id"] == 6 and not near[7]["kept"] and near[6]["kept"]
    assert near[3]["n_shingles"] == 0 and near[3]["component_id"] == 3 and near[None]["kept"]
    assert near[9]["n_shingles"] == 1
    mixed = mixing.mix_sources(docs).where("doc_id = 5").first()
    assert mixed["size"] == len(LONG.split())
    spoken = {r["doc_id"]: r for r in language_id.identify_languages(docs, *language_id.train_languages(docs)).collect()}
    assert spoken[2]["lang_pred"] == spoken[3]["lang_pred"] == spoken[4]["lang_pred"] == "und"
    ruled = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert ruled[2]["base_failed"] and ruled[5]["n_words"] == len(LONG.split()) and not ruled[5]["kept"]
    coded = {r["doc_id"]: r for r in sentencepiece_codec.encode_documents(docs).collect()}
    assert coded[2]["ids"] is None and coded[3]["ids"] == b"" and all(r["parity"] for k, r in coded.items() if k not in (2, None))
    edited = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).where("doc_id IS NOT NULL").collect()}
    assert edited[6]["fingerprint"] == edited[7]["fingerprint"] and edited[2]["n_chars"] == 0


def test_urls(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    pages = [
        (1, "http://a.example.net/en/x", '<link rel="canonical" href="http://b.example.org/y/">'), (2, "https://b.example.org/y?utm_source=q#top", None),
        (3, "http://c.net/fr/z", '<meta http-equiv="refresh" content="0; url=https://www.b.example.org/y">'), (4, None, None), (5, "no scheme", "<p>"),
        (6, "HTTP://WWW.Example.COM/en/1", ""), (7, "http://example.com/en/1", ""), (8, "http://x.com", ""), (9, "http://notexample.com/en/", ""),
        (9, "http://notexample.com/en/", ""), (10, "http://d.org/1", '<link href="/2" rel=canonical>'), (11, "http://d.org/2", None), (12, "http://org.de/a", None),
    ]
    table = spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id bigint, url string, html string, host string, key string")
    found = {r["page_id"]: r for r in url_filter.filter_urls(table).collect()}
    assert [found[i]["verdict"] for i in (1, 2, 3)] == ["block"] * 3 and found[1]["rule"] is None and found[3]["rule"] == "net/fr/"
    assert (found[4]["host"], found[4]["path"], found[4]["verdict"]) == ("", "", "allow") and found[5]["host"] == ""
    assert (found[6]["rule"], found[7]["rule"]) == ("www.example.com/en/", "example.com/en/")
    assert found[8]["rule"] is None and found[9]["rule"] == "com/" and found[10]["verdict"] == "allow"


def test_alias_of_an_allowed_page_is_allowed(spark):
    pages = [
        (1, "http://a.org/1", '<link rel="canonical" href="http://b.com/1">'), (2, "http://b.com/1", ""), (3, "http://c.net/es/1", '<link rel="canonical" href="http://a.org/1">'),
    ]
    found = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert found == {1: "allow", 2: "allow", 3: "block"}


def test_stages_on_edge_rows(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, kept.where("false"), str(tmp_path)).count() == 0
        assert stage(spark, kept, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.drop_near_copies(spark, kept, "").where("doc_id IN (6, 7)").count() == 1
    assert corpus_pipeline.encode(spark, kept, "").count() == len(ROWS)
