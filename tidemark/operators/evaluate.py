"""Confusion matrix, latency percentile and the contest's scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the scoring rules.
SCORE_UNIT, EPSILON_MIN, FAILURE_CUT, PENALTY, FLOOR, LATENCY_CUT_MS, LATENCY_BEST_MS = 1000.0, 0.001, 0.15, 300.0, -3000.0, 2000.0, 1.0


def confusion(results: DataFrame) -> DataFrame:
    """results (expected_fraud, approved, http_status): one row of tp, tn, fp, fn, err, n; positive means denied."""
    fine = F.col("http_status") == 200
    fraud, denied = F.col("expected_fraud"), ~F.col("approved")
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return results.agg(count(fine & fraud & denied, "tp"), count(fine & ~fraud & ~denied, "tn"), count(fine & ~fraud & denied, "fp"), count(fine & fraud & ~denied, "fn"), count(~F.coalesce(fine, F.lit(False)), "err"), F.count(F.lit(1)).alias("n"))


def judged(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """expected (id, expected_fraud) with the answer to each (id, approved, http_status, latency_ms); a request without an answer has status 0, which counts as an error."""
    named = answers.select(F.col("id").alias("__id"), "approved", "http_status", "latency_ms")
    return expected.join(named, F.col("id") == F.col("__id"), "left").withColumn("http_status", F.coalesce("http_status", F.lit(0))).drop("__id")


def p99_of(latency: str = "latency_ms") -> Column:
    return F.percentile(latency, F.lit(0.99))


def p99(results: DataFrame, latency: str = "latency_ms") -> DataFrame:
    return results.agg(p99_of(latency).alias("p99"))


def summary() -> list[Column]:
    total, frauds = F.count(F.lit(1)), F.count_if("expected_fraud")
    return [total.alias("total"), frauds.alias("fraud_count"), F.try_divide(frauds.cast("double"), total).alias("fraud_rate")]


def dataset_summary(results: DataFrame) -> DataFrame:
    return results.agg(*summary())


def weighted_errors() -> Column:
    return F.col("fp") + 3 * F.col("fn") + 5 * F.col("err")


def detection_score() -> Column:
    e, n = weighted_errors(), F.col("n")
    rate = (F.col("fp") + F.col("fn") + F.col("err")) / n
    good = SCORE_UNIT * F.log10(1.0 / F.greatest(e / n, F.lit(EPSILON_MIN))) - PENALTY * F.log10(1.0 + e)
    return F.when(rate > FAILURE_CUT, FLOOR).otherwise(good)


def latency_score() -> Column:
    return F.when(F.col("p99") > LATENCY_CUT_MS, FLOOR).otherwise(SCORE_UNIT * F.log10(1000.0 / F.greatest("p99", F.lit(LATENCY_BEST_MS))))


def contest_score(matrix: DataFrame) -> DataFrame:
    """matrix (tp, tn, fp, fn, err, n, p99) with e, failure_rate, detection_score, latency_score, final_score and the record of components (null where cut)."""
    out = matrix.withColumns({"e": weighted_errors(), "failure_rate": (F.col("fp") + F.col("fn") + F.col("err")) / F.col("n"), "detection_score": detection_score(), "latency_score": latency_score()})
    out = out.withColumn("final_score", F.col("detection_score") + F.col("latency_score"))
    cut = F.col("failure_rate") > FAILURE_CUT
    record = F.struct(F.when(~cut, SCORE_UNIT * F.log10(1.0 / F.greatest(F.col("e") / F.col("n"), F.lit(EPSILON_MIN)))).alias("rate_component"), F.when(~cut, -PENALTY * F.log10(1.0 + F.col("e"))).alias("absolute_penalty"), cut.alias("cut_triggered"))
    return out.withColumn("components", record)
