"""Evaluation formulas, the stream, and the registered queries against their SQL."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import evaluate, lookup
from tidemark.plans import registry
from tidemark.streaming.score import score_stream, warm_up

#: Scores of a run with 5000 answers: fp, fn, err, p99 ms, latency, detection and final score.
SCORES = [
    (0, 0, 0, 1, 3000.00, 3000.00, 6000.00), (5, 5, 0, 3, 2522.88, 2001.27, 4524.15), (0, 0, 0, 100, 1000.00, 3000.00, 4000.00), (30, 20, 0, 10, 2000.00, 1157.02, 3157.02),
    (100, 50, 0, 300, 522.88, 581.13, 1104.01), (500, 250, 0, 200, 698.97, -327.12, 371.85), (500, 300, 0, 10, 2000.00, -3000.00, -1000.00), (0, 0, 5000, 60000, -3000.00, -3000.00, -6000.00),
]


def test_scores(spark):
    rows = spark.createDataFrame([(i, 0, 0, a, b, c, 5000, float(p)) for i, (a, b, c, p, *_) in enumerate(SCORES)], "i int, tp int, tn int, fp int, fn int, err int, n int, p99 double")
    found = evaluate.contest_score(rows).orderBy("i").collect()
    for r, (*_, latency, detection, final) in zip(found, SCORES):
        assert (r.latency_score, r.detection_score, r.final_score) == pytest.approx((latency, detection, final), abs=0.011)
        assert r.components.cut_triggered == (r.components.rate_component is None)


def test_confusion_and_percentile(spark):
    rows = [(True, False, 200, 1.0), (True, True, 200, 2.0), (False, True, 200, 3.0), (False, False, 200, 4.0), (False, None, 500, 5.0), (True, None, None, 6.0)]
    df = spark.createDataFrame(rows, "expected_fraud boolean, approved boolean, http_status int, latency_ms double")
    assert tuple(evaluate.confusion(df).first()) == (1, 1, 1, 1, 2, 6)
    assert evaluate.p99(df).first().p99 == pytest.approx(np.percentile([1, 2, 3, 4, 5, 6], 99))
    assert tuple(evaluate.dataset_summary(df).first()) == (6, 3, 0.5)
    assert evaluate.confusion(df.limit(0)).first().n == 0


def test_lookup_joins(spark):
    risks = spark.createDataFrame([("5411", 1500)], "mcc string, fixed int")
    rows = spark.createDataFrame([(1, "5411"), (2, "54119"), (3, "1"), (4, None)], "id int, mcc string")
    assert {r.id: r.risk for r in lookup.join_risk(rows, risks).collect()} == {1: 1500, 2: 1500, 3: 5000, 4: 5000}
    asked = spark.createDataFrame([("c", "m"), ("c", "x"), ("d", "m")], "customer string, merchant string")
    known = spark.createDataFrame([("c", ["m", "m", None])], "customer string, known_merchants array<string>")
    assert [tuple(r) for r in lookup.known_merchants(asked, known).collect()] == [("c", "m")]


def test_stream_is_the_batch(spark, tmp_path):
    refs = spark.createDataFrame([(i, [i * 100] * 14, i % 2) for i in range(30)], "ref_id bigint, q array<int>, label int")
    (tmp_path / "in").mkdir()
    bodies = [json.dumps({"transaction": {"amount": 100.0 * i, "requested_at": "2026-03-11T20:23:35Z"}}) for i in range(12)] + ["[]", "x"]
    (tmp_path / "in" / "a.txt").write_text("\n".join(bodies))
    for _ in range(2):  # a second run finds nothing new
        score_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", refs).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(found) == 14 and sum(r.status == 400 for r in found) == 2 and all((r.response is None) == (r.status == 400) for r in found)
    assert warm_up(spark, refs) == 32


def test_stream_answers_every_line(spark, tmp_path):
    refs = spark.createDataFrame([(i, [i * 100] * 14, i % 2) for i in range(30)], "ref_id bigint, q array<int>, label int")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("{}\n{}\nx\n{}\nx\n")
    score_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", refs).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.status for r in found) == [200, 200, 200, 400, 400] and len({r.id for r in found}) == 2


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    found = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLES:
        assert found.count() > 0
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = con.sql(registry.ORACLES[name]).df()
    got = found.toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_judged_requests_without_an_answer_are_errors(spark):
    expected = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False)], "id int, expected_fraud boolean")
    answers = spark.createDataFrame([(1, False, 200, 1.0), (2, True, 200, 1.0), (4, True, 500, 1.0), (9, True, 200, 1.0)], "id int, approved boolean, http_status int, latency_ms double")
    r = evaluate.confusion(evaluate.judged(expected, answers)).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.err, r.n) == (1, 1, 0, 0, 2, 4)


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from tidemark import session

    class Context:
        master, applicationId = "spark://host:7077", "none"

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Session())
    Context.master = "local[4]"
    assert session.shared_dir(Session()).startswith("file:///")


def test_ivf_index_has_the_rounds_of_production(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(registry.cluster, "k_means", lambda refs, iterations, n: seen.append(iterations) or refs)
    monkeypatch.setattr(registry.cluster, "write_index", lambda assigned, path, iterations, n: seen.append(iterations) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        registry.QUERIES["ivf_search"](spark, "/root/testdata/sf0.001")
    assert seen == [registry.DEFAULT.iterations] * 2


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "frauds", "fraud_score", "approved"] and df.count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_cheap(spark):
    """Scans read the columns they need; the features need no Python; top-k is limited before it is dealt out."""
    from tidemark.operators import search
    from tidemark.plans import adapters as A

    plan = registry.QUERIES["features_orders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "l_extendedprice" not in plan
    refs = A.embedding_refs(spark, "/root/testdata/sf0.001")
    plan = search.nearest_pairs(A.as_queries(refs), refs, n=64)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
