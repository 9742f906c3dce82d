"""Each stage of the pipeline against SQL or the tokenizer itself, on what the stage before has written."""

import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import jaccard, lines, mixing, packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Stage name to the rows that it got and the rows that it gave."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        given, docs = docs, spark.read.parquet(f"{folder}/{name}")
        out[name] = given.toPandas(), docs.toPandas()
    return out


def sql(documents, query):
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(query).df()


def test_stages_and_columns(written):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "mix", "pack"]
    columns = list(written["quality"][0].columns)
    assert all(list(written[n][1].columns) == columns for n, _ in corpus_pipeline.STAGES[:-1])


def test_quality_keeps_good_documents(spark, written):
    given, kept = written["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stayed = set(kept.doc_id)
    good, bad = ([d in stayed for d in given.doc_id if labels.get(d) == q] for q in (1, 0))
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1
    same = given[given.doc_id.isin(stayed)].sort_values("doc_id").reset_index(drop=True)
    assert same.equals(kept.sort_values("doc_id").reset_index(drop=True))


def test_line_dedup_is_its_sql(written):
    given, kept = written["line_dedup"]
    want = dict(sql(given, lines.ORACLE)[["doc_id", "text"]].itertuples(index=False))
    assert dict(kept[["doc_id", "text"]].itertuples(index=False)) == want
    assert (kept.n_chars == kept.text.str.len()).all()


def test_join_keeps_one_of_each_class(written):
    given, kept = written["ngram_join"]
    want = sql(given, jaccard.ORACLE)
    assert sorted(kept.doc_id) == sorted(want[want.doc_id == want.class_id].doc_id)


def test_mix_takes_what_its_sql_says(written):
    given, kept = written["mix"]
    want = sql(given, mixing.ORACLE).set_index("doc_id").taken
    got = kept.text.map(lambda t: len(t.split())).groupby(kept.doc_id).sum()
    assert got.to_dict() == want[want > 0].to_dict()
    texts = given.set_index("doc_id").text
    assert all(t in texts[d] for d, t in zip(kept.doc_id, kept.text))


def test_pack_holds_every_token_once(written):
    given, pieces = written["pack"]
    plain = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    want = []
    for doc, text in zip(given.doc_id, given.text):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cuts(len(ids), 1024))]
    assert sorted(want) == sorted(pieces[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert pieces.sequence_id.nunique() <= packing.least_bins(pieces.length.to_numpy(), 1024) + 1


def test_run_gives_the_last_stages_rows(spark, written):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows[columns].sort_values(columns).reset_index(drop=True).equals(written["pack"][1][columns].sort_values(columns).reset_index(drop=True))
