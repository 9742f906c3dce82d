"""Payloads: golden vectors, accepted and rejected bodies, framing."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.features import vectorize
from tidemark.sources import corpus, payloads


def payload(id="tx", amount=384.88, installments=3, at="2026-03-11T20:23:35Z", avg=769.76, n=3, known=("M1", "M2"), merchant="M1", mcc="5912", merchant_avg=298.95, online=False, card=True, km=13.7090520965, last=("2026-03-11T14:58:35Z", 18.8626479774)):
    return {
        "id": id,
        "transaction": {"amount": amount, "installments": installments, "requested_at": at},
        "customer": {"avg_amount": avg, "tx_count_24h": n, "known_merchants": list(known)},
        "merchant": {"id": merchant, "mcc": mcc, "avg_amount": merchant_avg},
        "terminal": {"is_online": online, "card_present": card, "km_from_home": km},
        "last_transaction": None if last is None else {"timestamp": last[0], "km_from_current": last[1]},
    }


#: Vectors that the rules give for three payloads.
GOLDEN = [
    (payload(amount=41.12, installments=2, at="2026-03-11T18:45:53Z", avg=82.24, n=3, mcc="5411", merchant_avg=60.25, km=29.2331036248, last=None), [41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60], 8),
    (payload(amount=9505.97, installments=10, at="2026-03-14T05:15:12Z", avg=81.28, n=20, merchant="X", mcc="7802", merchant_avg=54.86, km=952.27, last=None), [9506, 8333, 10000, 2174, 8333, -10000, -10000, 9523, 10000, 0, 10000, 10000, 7500, 55], 10),
    (payload(), [385, 2500, 500, 8696, 3333, 2257, 189, 137, 1500, 0, 10000, 0, 2000, 299], 9),
]


def bodies(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "key bigint, body string")


@pytest.mark.parametrize("checked", [False, True])
def test_golden_vectors(spark, checked):
    rows = bodies(spark, [json.dumps(p) for p, _, _ in GOLDEN])
    parsed = payloads.parse_checked(rows) if checked else payloads.parse_trusted(rows)
    found = vectorize(parsed).collect()
    assert sorted((r.q, r.tag) for r in found) == sorted((q, t) for _, q, t in GOLDEN)


def test_parsed_fields(spark):
    r = payloads.parse_checked(bodies(spark, [json.dumps(payload())])).first()
    assert r.valid and r.has_last and (r.requested_ts, r.last_ts) == (1773260615, 1773241115)
    assert (r.amount, r.installments, r.customer_avg, r.tx_count_24h, r.merchant_id, r.mcc) == (384.88, 3, 769.76, 3, "M1", "5912")


#: Bodies that the rules reject and accept.
REJECTED = [
    "[]", "", "x", '{"transaction":null}', '{"transaction":{"amount":"x"}}', '{"transaction":{"amount":1', '{"merchant":{"id":"a"}}',
    '{"customer":{"known_merchants":null}}', '{"transaction":{"amount":null}}', '{"transaction":{"requested_at":7}}', '{"merchant":{"mcc":1}}', '{"terminal":[]}', '{"last_transaction":3}', None,
]
ACCEPTED = ["{}", '{"last_transaction":null}', '{"x":{"y":[1,"}"]}}', '{"transaction":{"amount":1}} tail', '{"terminal":{"is_online":"true"}}', '{"merchant":{"mcc":"5411"}}', '{"last_transaction":{}}']


def test_rejected_and_accepted_bodies(spark):
    found = payloads.parse_checked(bodies(spark, REJECTED + ACCEPTED)).orderBy("key").collect()
    assert [r.valid for r in found] == [False] * len(REJECTED) + [True] * len(ACCEPTED)


def test_defaults_and_edges(spark):
    rows = payloads.parse_checked(bodies(spark, ["{}", '{"last_transaction":{}}', '{"terminal":{"is_online":"true","card_present":true}}', '{"transaction":{"installments":3.7,"amount":10}}']))
    a, b, c, d = vectorize(rows).orderBy("key").collect()
    assert not a.has_last and a.q[5] == a.q[6] == -10000 and a.q[11] == 10000 and a.q[12] == 5000
    assert b.has_last and b.q[6] == 0
    assert not c.is_online and c.card_present
    assert d.installments == 3 and d.q[2] == 0


def test_last_after_current_is_zero_minutes(spark):
    r = vectorize(payloads.parse_trusted(bodies(spark, [json.dumps(payload(last=("2026-03-12T00:00:00Z", 5000.0)))]))).first()
    assert (r.q[5], r.q[6]) == (0, 10000)


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([p for p, _, _ in GOLDEN]))
    assert payloads.read_payloads(spark, str(tmp_path / "a.json")).count() == 3


def test_http_framing(spark):
    text = b"POST /x HTTP/1.1\r\ncontent-length: 2\r\n\r\n{}GET /ready HTTP/1.1\r\n\r\nPUT / HTTP/1.1\r\nContent-Length:3\r\n\r\nabcPOST / HTTP/1.1\r\nContent-Length: 9\r\n\r\nabc"
    rows = payloads.http_requests(spark.createDataFrame([(7, bytearray(text)), (8, None), (9, bytearray(b"GET "))], "c int, buffer binary"), keys=("c",)).collect()
    assert [(r.c, r.place, r.method, r.length, r.body, r.action) for r in rows] == [
        (7, 0, "POST", 2, "{}", "score"), (7, 1, "GET", -1, "", "ready"), (7, 2, "PUT", 3, "abc", "reject"), (7, 3, None, None, None, "wait"), (9, 0, None, None, None, "wait"),
    ]
    assert bytes(rows[3].rest) == b"POST / HTTP/1.1\r\nContent-Length: 9\r\n\r\nabc" and bytes(rows[4].rest) == b"GET " and rows[0].rest is None


@pytest.mark.parametrize("cut", [1, 20, 43, 47, 60])
def test_requests_cut_into_chunks_are_whole_again(spark, cut):
    text = "POST /x HTTP/1.1\r\nContent-Length: 4\r\n\r\n\"ü\"GET / HTTP/1.1\r\n\r\n".encode()
    chunks = spark.createDataFrame([(1, 5, bytearray(text[cut:])), (1, 2, bytearray(text[:cut])), (2, 1, bytearray(text)), (1, 9, None)], "c int, seq int, chunk binary")
    found = payloads.http_requests(payloads.joined_chunks(chunks, "c", "seq", "chunk"), keys=("c",)).collect()
    assert sorted((r.c, r.place, r.body, r.action) for r in found) == [(c, i, b, a) for c in (1, 2) for i, b, a in ((0, '"ü"', "score"), (1, "", "ready"))]


CORPUS = [
    {"vector": [0.01, 0.0833, 0.05, 0.8261, 0.1667, -1, -1, 0.0432, 0.25, 0, 1, 0, 0.2, 0.0416], "label": "legit"},
    {"vector": [0.5796, 0.9167, 1.0, 0.0435, 0, 0.0056, 0.4394, 0.4598, 0.4, 1, 0, 1, 0.85, 0.0032], "label": "fraud"},
    {"other": 1},
]
QUANTISED = [([100, 833, 500, 8261, 1667, -10000, -10000, 432, 2500, 0, 10000, 0, 2000, 416], 0, 8), ([5796, 9167, 10000, 435, 0, 56, 4394, 4598, 4000, 10000, 0, 10000, 8500, 32], 1, 7), ([0] * 14, 0, 1)]


@pytest.mark.parametrize("name,zipped", [("c.json", False), ("c.json.gz", True), ("c.bin", True), ("d.bin", False)])
def test_corpus(spark, tmp_path, name, zipped):
    data = json.dumps(CORPUS).encode()
    (tmp_path / name).write_bytes(gzip.compress(data) if zipped else data)
    read = corpus.read_corpus_any if name.endswith("bin") else corpus.read_corpus
    found = corpus.references(read(spark, str(tmp_path / name))).collect()
    assert sorted((r.q, r.label, r.tag) for r in found) == sorted(QUANTISED)


def test_corpus_errors(spark):
    short = spark.createDataFrame([([0.1], "fraud")], "vector array<double>, label string")
    with pytest.raises(Exception, match="dimensions"):
        corpus.references(short).collect()
    with pytest.raises(ValueError, match="more than"):
        corpus.references(spark.createDataFrame([([0.0] * 14, "x")] * 3, "vector array<double>, label string"), max_refs=2)


def test_risk_file(spark, tmp_path):
    (tmp_path / "r.json").write_text('{\n "5411": 0.15,\n "7995": 0.85, "54": 0.1}')
    found = corpus.read_mcc_risk(spark, str(tmp_path / "r.json")).collect()
    assert {r.mcc: r.fixed for r in found} == {"5411": 1500, "7995": 8500}


def test_to_json_of_a_verdict(spark):
    from tidemark.operators.verdict import answers, verdicts

    rows = verdicts(spark.createDataFrame([(i, i) for i in range(6)], "id int, frauds int"))
    found = {r.id: r.response for r in answers(rows).collect()}
    assert found == {i: f'{{"approved":{str(i < 3).lower()},"fraud_score":{i / 5}}}' for i in range(6)}
    assert {r.status for r in answers(rows.withColumn("valid", F.lit(False))).collect()} == {400}
