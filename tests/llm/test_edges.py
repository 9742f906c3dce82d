"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns, through every query and stage."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import registry

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
PAGES = "page_id bigint, url string, html string"
VECTORS = "vec_id bigint, embedding array<float>, label int"
EXTRA = ["id", "size", "target", "taken", "source_size", "key", "doc", "at", "n", "group", "path", "score", "predicted", "held_out", "digest", "first", "second", "block", "root", "piece", "length", "row", "passes", "__c_x"]

LONG = " ".join(f"w{i % 5003}x{i}" for i in range(60_000))
PROSE = "\n".join(" ".join(f"p{i}q{j}" for j in range(30)) for i in range(6))
NEAR = PROSE.replace("p3q7 ", "other ")


def odd_documents():
    rows = [
        (1, PROSE, "en", "a", len(PROSE)),
        (2, PROSE, "en", "b", len(PROSE)),
        (2, PROSE, "en", "b", len(PROSE)),
        (3, NEAR, "en", "a", len(NEAR)),
        (4, LONG, None, None, len(LONG)),
        (5, "", "de", "a", 0),
        (6, None, "de", "b", None),
        (None, "no id here at all", None, "a", 17),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (7, " \t\n ", "fr", "c", 4),
        (8, "one", "fr", "c", 3),
        (9, "ein wort und noch ein wort " * 9, "de", "c", 243),
        (9, "the same id with another text", "en", "c", 29),
        (10, "1234 !!! ???", "en", None, 12),
        (11, "über ퟿￿ \U0001f600 naïve", "de", "b", 14),
    ]
    return rows


ODD_LABELS = [(1, 1, 0), (2, 1, None), (5, 0, 0), (6, None, 1), (None, 1, 0), (9, 0, 0), (999, 1, 1), (1, 1, 0)]
ODD_PAGES = [
    (1, "http://Example.org:80/a?b#c", "<p>" + "text " * 60),
    (2, None, "<p>" + "text " * 60),
    (2, None, "<p>" + "text " * 60),
    (None, "http://x/", "<p>" + "text " * 60),
    (3, "not a url at all", None),
    (4, "http://[broken", ""),
    (5, "http://x/y", "<div><p>unclosed <b>bold &amp; &lt;" + "long " * 50_000),
    (6, "", "plain, no tags"),
]
NAN, INF = float("nan"), float("inf")
ODD_VECTORS = [
    (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1),
    (7, [0.0, 0.0], 1), (8, [NAN, 1.0], 1), (9, [INF, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [], 1), (None, None, None),
]


def write(spark, folder, documents, labels, pages, vectors, extra=False):
    for name, schema, rows in (("documents", DOCUMENTS, documents), ("labels", LABELS, labels), ("pages", PAGES, pages), ("embeddings", VECTORS, vectors)):
        df = spark.createDataFrame(rows, schema)
        if extra:
            df = df.withColumns({c: F.lit("clash") for c in EXTRA if c not in df.columns})
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), odd_documents(), ODD_LABELS, ODD_PAGES, ODD_VECTORS)


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("clash"), odd_documents(), ODD_LABELS, ODD_PAGES, ODD_VECTORS, extra=True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


def rows_of(df, leave=("shard", "offset", "sequence_id")):
    return sorted((tuple(sorted((k, str(v)) for k, v in r.asDict().items() if k not in leave)) for r in df.collect()))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_on_odd_tables(spark, odd, clashing, empty, name):
    query = registry.QUERIES[name]
    plain = rows_of(query(spark, odd))
    many = {"op6_html": len(ODD_PAGES), "op8_warc": len(ODD_PAGES), "op7_neighbours": len(ODD_VECTORS)}.get(name, len(odd_documents()))
    assert len(plain) >= many if name == "op9_packing" else len(plain) == many
    assert rows_of(query(spark, clashing)) == plain
    assert rows_of(query(spark, empty)) == []


def test_stages_on_odd_tables(spark, odd, clashing, empty, tmp_path):
    for folder in (odd, clashing, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.write.parquet(f"{tmp_path}/{folder.replace('/', '_')}-{name}")
            if k < len(corpus_pipeline.STAGES) - 1:
                docs = spark.read.parquet(f"{tmp_path}/{folder.replace('/', '_')}-{name}")
    assert spark.read.parquet(f"{tmp_path}/{empty.replace('/', '_')}-pack").count() == 0


def test_vectors_that_link_with_nothing(spark, odd):
    found = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in registry.QUERIES["op7_neighbours"](spark, odd).collect()}
    # 1, 2, 2, 3 and the null id hang together: each has four links
    assert {x for x in found if x[1]} == {(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False)}
    assert all(c == v and k for v, n, c, k in found if not n)


def test_every_null_page_id_is_a_response(spark, tmp_path):
    body = "<p>" + "same " * 40
    folder = write(spark, tmp_path / "t", [], [], [(None, "http://a/", body), (None, "http://b/", body)], [])
    found = registry.QUERIES["op8_warc"](spark, folder).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in found] == [(None, "response", None)] * 2


def test_classes_of_repeated_rows(spark, odd):
    found = {(r.doc_id, r.n_links, r.class_id) for r in registry.QUERIES["op3_ngram_join"](spark, odd).collect()}
    assert {x for x in found if x[0] in (1, 2, 3)} == {(1, 3, 1), (2, 3, 1), (3, 3, 1)}
    assert all(n == 0 and c == d for d, n, c in found if d not in (1, 2, 3))
