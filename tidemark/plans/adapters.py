"""The driver's tables as transactions, labelled references and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import MCC_RISK
from tidemark.functions.features import vectorize
from tidemark.functions.scalar import quantize_vector

#: Codes that parts are sold under: those with a risk, and two without.
CODES = [*sorted(MCC_RISK), "5732", "6011"]
#: Customers below this balance count as frauds.
FRAUD_BELOW = 1500.0
#: Partitions that are there in the query on routing.
THERE = [0, 1, 2, 3, 5, 8]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(size: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CODES]), (size % len(CODES) + 1).cast("int"))


def epoch(c: str):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction for each order: id, customer and the columns of a request.

    The merchant is the supplier of the order's first line, its code goes by the part's size; averages, counts and known
    merchants come from the customer's earlier orders. Of the merchants a customer knows only the order's own is listed: no more is ever asked of the list, and
    a customer of many orders has no list that grows with each.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("installments"), F.min(F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("f"))
    lines = lines.select("l_orderkey", "installments", F.col("f.l_suppkey").alias("s"), F.col("f.l_partkey").alias("p"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), code_of(F.col("p_size")).alias("mcc"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.abs("s_acctbal").alias("merchant_avg"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), "c_acctbal")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), (F.col("o_totalprice") / 40).alias("amount"), epoch("o_orderdate").alias("requested_ts"),
        F.col("o_orderpriority").substr(1, 1).isin("1", "2").alias("is_online"), (F.col("o_orderstatus") == "F").alias("card_present"),
    )
    rows = orders.join(lines, F.col("id") == F.col("l_orderkey"), "left").join(parts, "p", "left").join(suppliers, "s", "left").join(customers, "customer", "left")
    rows = rows.withColumn("merchant_id", F.coalesce(F.concat(F.lit("S"), F.col("s").cast("string")), F.lit("")))
    own = W.partitionBy("customer").orderBy("requested_ts", "id")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    visit = F.row_number().over(W.partitionBy("customer", "merchant_id").orderBy("requested_ts", "id"))
    rows = rows.withColumn("__visit", visit)
    day = W.partitionBy("customer").orderBy("requested_ts").rangeBetween(-86400, 0)
    return rows.select(
        "id", "customer", "amount", F.coalesce("installments", F.lit(0)).cast("int").alias("installments"), "requested_ts",
        F.coalesce(F.avg("amount").over(before), F.lit(0.0)).alias("customer_avg"),
        F.count(F.lit(1)).over(day).cast("int").alias("tx_count_24h"),
        F.when(F.col("__visit") > 1, F.array("merchant_id")).otherwise(F.array().cast("array<string>")).alias("known_merchants"),
        "merchant_id", F.coalesce("mcc", F.lit("")).alias("mcc"), F.coalesce("merchant_avg", F.lit(0.0)).alias("merchant_avg"), "is_online", "card_present",
        F.coalesce(F.abs("c_acctbal") / 10, F.lit(0.0)).alias("km_from_home"),
        F.lag("requested_ts").over(own).isNotNull().alias("has_last"), F.coalesce(F.lag("requested_ts").over(own), F.lit(0)).alias("last_ts"),
        F.coalesce(F.abs(F.col("amount") - F.lag("amount").over(own)) / 10, F.lit(0.0)).alias("km_from_last"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize(transactions(spark, sf_dir))


def reference_vectors(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """A reference for each customer: the vector of the last order, fraud if the balance is low. (ref_id, q, label, tag)."""
    last = asked.groupBy("customer").agg(F.max(F.struct("requested_ts", "id", "q", "tag")).alias("l"))
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), (F.col("c_acctbal") < FRAUD_BELOW).cast("int").alias("label"))
    return last.join(labels, "customer").select(F.col("customer").alias("ref_id"), F.col("l.q").alias("q"), "label", F.col("l.tag").alias("tag"))


def embedding_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, q, label, tag): quantised embeddings; tag is the label's parity, a key to partition by."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), quantize_vector(F.col("embedding")).alias("q"), F.col("label").cast("int").alias("label"), (F.col("label") % 2).cast("int").alias("tag"))


def as_queries(refs: DataFrame) -> DataFrame:
    return refs.select(F.col("ref_id").alias("id"), "q", "tag")
