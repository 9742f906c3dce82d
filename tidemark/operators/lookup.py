"""Join-shaped operators: risk by merchant code, merchants a customer knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import SCALE
from tidemark.functions.scalar import mcc_normal


def join_risk(rows: DataFrame, risks: DataFrame, mcc: str = "mcc") -> DataFrame:
    """rows with risk, fixed point; codes that risks (mcc, fixed) has not get half the scale. Spark sends the small side by its size."""
    named = risks.select(F.col("mcc").alias("__mcc"), F.col("fixed").alias("__fixed"))
    return rows.join(named, mcc_normal(F.col(mcc)) == F.col("__mcc"), "left").withColumn("risk", F.coalesce("__fixed", F.lit(SCALE // 2))).drop("__mcc", "__fixed")


def known_merchants(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose (customer, merchant) stands in known (customer, known_merchants): a semi join on the exploded list."""
    pairs = known.select("customer", F.explode("known_merchants").alias("merchant"))
    return rows.join(pairs, ["customer", "merchant"], "left_semi")
