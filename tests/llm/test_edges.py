"""Nulls, empty and long texts, repeated rows, empty tables and extra columns with clashing names, for every operator and stage."""

import pytest

import corpus_pipeline
from inkspan.llm import embedding_dedup, html_density, language_id, minhash_dedup, packing, paragraph_dedup, pii, quality_llr, sentencepiece_fst, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, vertex int, id string, h int, length string, places int, places_kept int, component string, piece int, bit int, word string, marked int"
LONG = " ".join(f"word{i}" for i in range(60_000))
ROWS = [(1, "some words in a text, with mail a@b.com", "en", "s", 5), (1, "some words in a text, with mail a@b.com", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t ", "fr", None, 3), (None, "null id text", "en", "s", 3), (5, LONG, "en", "s", 9), (6, LONG + " more", "en", None, 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4, "z", 5, 6, "w", 7) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "language": lambda s, d: language_id.predict_documents(d),
    "pii": lambda s, d: pii.find_personal_data(d),
    "minhash": lambda s, d: minhash_dedup.near_duplicates(d),
    "sentencepiece": lambda s, d: sentencepiece_fst.decode(sentencepiece_fst.encode(d)),
    "paragraphs": lambda s, d: paragraph_dedup.remove_repeats(d, min_words=2),
    "quality": lambda s, d: quality_llr.quality_filter(d, labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, docs, none, name):
    got = OPERATORS[name](spark, docs).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert OPERATORS[name](spark, none).collect() == []


def test_minhash_of_odd_rows(spark, docs):
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert [got[i]["n_shingles"] for i in (2, 3, 4)] == [0, 0, 0]
    assert (got[6]["component_id"], got[6]["kept"]) == (5, False)


def test_packing_of_odd_rows(spark, docs, none):
    got = packing.pack_documents(docs).collect()
    assert len([r for r in got if r["doc_id"] == 1]) == 2 and sum(r["length"] for r in got if r["doc_id"] in (2, 3, 4)) == 3
    assert packing.pack_documents(none).collect() == []


def test_embeddings(spark):
    nan, schema = float("nan"), "vec_id long, embedding array<float>, label int, vertex string, keys int, pos int, rep string"
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0), (9, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (10, [1.0], 0)]
    got = [tuple(r)[:4] for r in embedding_dedup.embedding_components(spark.createDataFrame([(*r, "a", 1, 2, "b") for r in rows], schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)], (None, 0, None, True)], key=str)
    assert embedding_dedup.embedding_components(spark.createDataFrame([], schema)).collect() == []


def test_pages(spark):
    schema = "page_id long, url string, html string, key string, host string, id int, alias_group int"
    rows = [(1, "http://a.b/c", "<p>text"), (1, "http://a.b/c", "<p>text"), (None, None, None), (2, "", ""), (3, "http://a.b/" + "x" * 100_000, "<p>" + "y " * 100_000)]
    pages, empty = spark.createDataFrame([(*r, "k", "h", 1, 2) for r in rows], schema), spark.createDataFrame([], schema)
    assert url_filter.filter_urls(pages).count() == 5 and url_filter.filter_urls(empty).count() == 0
    texts = {r["page_id"]: r["text"] for r in html_density.extract_main_text(pages).collect()}
    assert (texts[1], texts[2], texts[None]) == ("text", "", "") and len(texts[3]) == 199_999
    assert html_density.extract_main_text(empty).count() == 0


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, docs, none, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, docs, "")
    if stage != "best_fit_packing":
        assert got.columns == list(corpus_pipeline.COLUMNS)
    assert got.count() > 0 and run(spark, none, "").count() == 0


def test_pipeline_decides_and_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in out}
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert ids <= set(every) and 0.4 * len(every) < len(ids) < len(every)
    kept = [t for i, t in every.items() if i in ids]
    assert len(kept) == len(set(kept))  # one of each group of copies
    gone = {t for i, t in every.items() if i not in ids and t and any(c.isalpha() for c in t)}
    assert len(gone - set(kept)) < 0.3 * len(every)
