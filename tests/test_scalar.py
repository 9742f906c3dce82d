"""Scalar functions at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import MCC_RISK
from tidemark.functions import scalar as S


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("x,y", [(-1.0, 0), (0.0, 0), (1.0, 10000), (1.25, 10000), (0.00005, 1), (0.5, 5000)])
def test_unit_fixed(spark, x, y):
    assert one(spark, S.unit_fixed, x, "double") == y


@pytest.mark.parametrize("x,y", [(0.03125, 312), (0.09375, 938), (-1.0, -10000), (9.9, 32767), (-9.9, -32768), (0.0833, 833)])
def test_quantize_half_even_and_saturated(spark, x, y):
    assert one(spark, S.quantize, x, "double") == y


@pytest.mark.parametrize(
    "s,y",
    [("2026-03-11T20:23:35Z", 1773260615), ("2026-03-11T14:58:35Z", 1773241115), ("2026-03-11T20:23:35.9+03:00", 1773249815), ("2026-03-11 20:23:35", 1773260615), ("bad", 0), ("2026-03-11", 0), (None, 0), ("2026-13-41T00:00:00Z", 0)],
)
def test_iso_epoch(spark, s, y):
    assert one(spark, S.iso_epoch, s, "string") == y


def test_hours_and_weekdays(spark):
    assert one(spark, S.weekday_utc, 0, "bigint") == 3
    assert one(spark, S.weekday_utc, 1773260615, "bigint") == 2
    assert one(spark, S.hour_utc, 1773260615, "bigint") == 20
    assert one(spark, S.hour_utc, -1, "bigint") == 23


@pytest.mark.parametrize("mcc,y", [("5411", 1500), ("0000", 5000), ("54", 5000), ("54119", 1500), (None, 5000), ("", 5000)])
def test_mcc(spark, mcc, y):
    assert one(spark, S.mcc_risk, mcc, "string") == y


def test_every_risk(spark):
    found = spark.createDataFrame([(c,) for c in MCC_RISK], "x string").select("x", S.mcc_risk(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in found} == {c: int(v * 10000 + 0.5) for c, v in MCC_RISK.items()}
    assert one(spark, S.mcc_normal, "54", "string") == "5400"


def test_known_merchants(spark):
    rows = [(["a", None], "a"), (["a", None], "b"), (None, "a"), ([""], ""), (["x" * 256], "x" * 256), (["x" * 255], "x" * 255), (["a"], None)]
    found = spark.createDataFrame(rows, "k array<string>, m string").select(S.merchant_known(F.col("k"), F.col("m")).alias("y")).collect()
    assert [r.y for r in found] == [True, False, False, False, False, True, False]


@pytest.mark.parametrize("h,y", [("Content-Length: 42", 42), ("content-length:7", 7), ("CONTENT-LENGTH:   100", 100), ("Host: x", -1), ("content-length: x", 0)])
def test_content_length(spark, h, y):
    assert one(spark, S.content_length, h, "string") == y


def test_tags(spark):
    v = [0.0] * 14
    v[5], v[9], v[11] = -1.0, 1.0, 0.51
    assert one(spark, S.reference_tag, v, "array<double>") == 6
    assert one(spark, lambda c: S.short_tag(c), 9, "int") == 1


def test_box_bound_is_below_every_member(spark):
    r = random.Random(1)
    members = [[r.randint(-10000, 10000) for _ in range(14)] for _ in range(20)]
    low, high = [min(c) for c in zip(*members)], [max(c) for c in zip(*members)]
    q = [[r.randint(-20000, 20000) for _ in range(14)] for _ in range(30)]
    found = spark.createDataFrame([(i, x, low, high) for i, x in enumerate(q)], "id int, q array<int>, low array<int>, high array<int>").select("id", S.box_bound(S.dims("q"), S.dims("low"), S.dims("high")).alias("lb")).collect()
    for row in found:
        assert row.lb <= min(sum((a - b) ** 2 for a, b in zip(q[row.id], m)) for m in members)


def test_numbers_as_json_has_them(spark):
    r = random.Random(2)
    texts = ["0", "0.0", "1", "-1.0", "384.88", "0.0833", "0.00001", "12345.6789", "1e-3", "1E5"] + [f"{r.randint(0, 10**9)}.{r.randint(0, 10**9)}" for _ in range(500)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.from_json(F.concat(F.lit('{"x":'), "t", F.lit("}")), "x double").getField("x").alias("x")).collect()
    assert all(row.x == float(row.t) for row in found)
