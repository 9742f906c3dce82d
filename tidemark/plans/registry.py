"""Named queries over the driver's tables and their SQL counterparts. Each runs over its whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, DIMENSIONS, MCC_RISK, SCALE
from tidemark.functions import scalar as S
from tidemark.functions.features import vectorize
from tidemark.operators import cluster, evaluate, kernel, lookup, search, verdict
from tidemark.plans import adapters as A
from tidemark.plans import sql
from tidemark.session import materialize, scratch_path
from tidemark.sources.corpus import read_corpus, read_mcc_risk, references
from tidemark.sources.payloads import http_requests, joined_chunks, parse_checked
from tidemark.streaming.score import score_stream

FLAGSHIP = "fraud_score_orders"
WIDTH = 64  # dimensions of the embeddings


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(A.vectors(spark, sf_dir).select("id", "customer", "requested_ts", "q", "tag"), "vectors")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(A.embedding_refs(spark, sf_dir), "embeddings")


def features_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vectors(spark, sf_dir).select("id", *[F.get("q", i).alias(f"q{i}") for i in range(DIMENSIONS)])


def request_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vectors(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum(S.short_tag(F.col("tag"))).alias("short_tags"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    refs = materialize(A.reference_vectors(spark, sf_dir, asked), "references")
    return verdict.verdicts(verdict.judged_by_vector(asked, kernel.Corpus(refs)))


def fraud_score_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def knn_exact_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _embeddings(spark, sf_dir)
    return search.nearest(A.as_queries(refs), refs, n=WIDTH).select("id", "rn", "ref_id", "d")


def kernel_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _embeddings(spark, sf_dir)
    return kernel.nearest_kernel(A.as_queries(refs), refs).select("id", "rn", "ref_id", "d")


def partitioned_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _embeddings(spark, sf_dir)
    return search.nearest_in_partition(A.as_queries(refs), refs, n=WIDTH).select("id", "rn", "ref_id", "d")


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes where a label of 5 or more counts as fraud."""
    refs = _embeddings(spark, sf_dir).withColumn("label", (F.col("label") >= 5).cast("int"))
    asked = A.as_queries(refs)
    return verdict.verdicts(verdict.votes(asked, kernel.nearest_kernel(asked, refs)))


def knn_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _embeddings(spark, sf_dir)
    return verdict.majority(kernel.nearest_kernel(A.as_queries(refs), refs)).select("id", "label", "n")


def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact votes by clusters; the clusters are k-means cells of the partitions, written and opened as an index, and those whose bounds are too far are left out."""
    refs = _embeddings(spark, sf_dir).withColumn("label", (F.col("label") >= 5).cast("int"))
    path = scratch_path(spark, "index")
    assigned = cluster.k_means(refs, iterations=DEFAULT.iterations, n=WIDTH)
    cluster.write_index(assigned, path, DEFAULT.iterations, WIDTH)
    found = cluster.open_index(spark, path)
    asked = A.as_queries(refs)
    return verdict.verdicts(verdict.votes(asked, search.nearest_ivf(asked, found.refs, found.clusters, n=WIDTH, exact=True)))


def probe_and_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters are probed, the labels are the clusters; unanimous answers stay as they are, the others are repaired by bounds."""
    refs = _embeddings(spark, sf_dir).withColumn("cluster_id", F.col("label")).withColumn("label", (F.col("label") >= 5).cast("int"))
    asked = A.as_queries(refs)
    return verdict.votes(asked, search.nearest_ivf(asked, refs, cluster.boxes(refs, WIDTH), probes=2, n=WIDTH))


def centroid_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment after one of Lloyd's steps: seeds, means of their members, nearest means."""
    refs = _embeddings(spark, sf_dir)
    return cluster.k_means(refs, iterations=2, n=WIDTH).select("ref_id", "tag", "cluster_id")


def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' reference vectors as a gzipped JSON corpus, read, quantised, tagged, indexed and opened again: rows and sums of each partition and label."""
    path = scratch_path(spark, "corpus")
    vectors = A.reference_vectors(spark, sf_dir, _asked(spark, sf_dir))
    lines = vectors.select(F.to_json(F.struct(F.transform("q", lambda x: x / F.lit(float(SCALE))).alias("vector"), F.when(F.col("label") == 1, "fraud").otherwise("legit").alias("label"))))
    lines.write.option("compression", "gzip").text(f"{path}/json")
    refs = references(read_corpus(spark, f"{path}/json", multi_line=False))
    # numbers by place are not the same at each reading, so the read corpus is written before it is numbered on
    refs = materialize(refs, "references")
    cluster.write_index(cluster.k_means(refs, iterations=2), f"{path}/index", 2)
    found = cluster.open_index(spark, f"{path}/index")
    sums = [F.sum(F.get("q", i)).alias(f"q{i}") for i in range(DIMENSIONS)]
    return found.refs.groupBy(F.col("tag").cast("int").alias("tag"), "label").agg(F.count(F.lit(1)).alias("n"), *sums)


def risk_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk table as a JSON file, read back, beside the parts sold under each code."""
    path = scratch_path(spark, "risk") + "/t"
    spark.range(1).select(F.lit(json.dumps(MCC_RISK, indent=1)).alias("value")).write.text(path)
    risks = read_mcc_risk(spark, path)
    parts = A.table(spark, sf_dir, "part").select(A.code_of(F.col("p_size")).alias("mcc")).groupBy("mcc").agg(F.count(F.lit(1)).alias("parts"))
    return risks.join(parts, "mcc", "left").select("mcc", "risk", "fixed", F.coalesce("parts", F.lit(0)).alias("parts"))


def routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the partition they are sent to, where only half of the partitions are there."""
    asked = A.vectors(spark, sf_dir).select("id", F.col("tag").alias("own"), "tag")
    return search.route(asked, A.THERE).groupBy("own", "tag").agg(F.count(F.lit(1)).alias("n"))


def http_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as HTTP requests, a connection a user, in two chunks that cut requests anywhere; the last request of each third user is not whole."""
    e = A.table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit('{"k":'), F.col("event_id").cast("string"), F.lit("}")).alias("body"))
    head = F.when(F.col("event_id") % 5 == 0, "GET /ready HTTP/1.1\r\n").when(F.col("event_id") % 5 == 1, F.concat(F.lit("PUT /x HTTP/1.1\r\ncontent-LENGTH:"), F.length("body").cast("string"), F.lit("\r\n")))
    head = head.otherwise(F.concat(F.lit("POST /x HTTP/1.1\r\nHost: h\r\nContent-Length:  "), F.length("body").cast("string"), F.lit("\r\n")))
    text = F.concat(head, F.lit("\r\n"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("body")))
    sent = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("t")))), lambda x: x["t"]), "").alias("t"))
    sent = sent.withColumn("t", F.when(F.col("user_id") % 3 == 0, F.concat("t", F.lit("POST /x HTTP/1.1\r\nContent-Length: 9\r\n\r\n{"))).otherwise(F.col("t")))
    cut = (F.length("t") / 2).cast("int")
    chunks = sent.select("user_id", F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.substring(F.col("t"), cut + 1, F.length("t")).alias("chunk")), F.struct(F.lit(1).alias("seq"), F.substring(F.col("t"), F.lit(1), cut).alias("chunk")))).alias("c")).select("user_id", "c.*")
    found = http_requests(joined_chunks(chunks, "user_id", "seq", "chunk"), keys=("user_id",))
    return found.groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.get_json_object("body", "$.k").cast("long"), F.lit(0))).alias("keys"), F.max("place").alias("last"))


def judged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was expected of each event with what was answered; every seventh has no answer."""
    e = A.table(spark, sf_dir, "events")
    expected = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("expected_fraud"))
    answered = e.where("event_id % 7 <> 0").select(F.col("event_id").alias("id"), (F.col("value") < 100).alias("approved"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"), F.col("value").alias("latency_ms"))
    return evaluate.confusion(evaluate.judged(expected, answered))


def score_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of components of each event type's score, null where it was cut."""
    rows = A.table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3 == 0).alias("fraud"), (F.col("value") >= F.when(F.col("event_type") == "error", 100).otherwise(0) + F.when(F.col("event_id") % 3 == 0, 0).otherwise(100000)).alias("denied"), "value")
    count = lambda c, name: F.count_if(c).alias(name)
    by = rows.groupBy("event_type").agg(count(F.col("fraud") & F.col("denied"), "tp"), count(~F.col("fraud") & ~F.col("denied"), "tn"), count(~F.col("fraud") & F.col("denied"), "fp"), count(F.col("fraud") & ~F.col("denied"), "fn"), F.lit(0).cast("long").alias("err"), F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.99)).alias("p99"))
    part = lambda name: F.round(F.col("components").getField(name), 6).alias(name)
    return evaluate.contest_score(by).select("event_type", part("rate_component"), part("absolute_penalty"), F.col("components.cut_triggered").alias("cut_triggered"))


def mcc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = A.table(spark, sf_dir, "part").select("p_partkey", A.code_of(F.col("p_size")).alias("mcc"))
    risks = spark.createDataFrame([(c, int(r * SCALE + 0.5)) for c, r in MCC_RISK.items()], "mcc string, fixed int")
    return lookup.join_risk(codes, risks).select("p_partkey", "mcc", "risk")


def known_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.transactions(spark, sf_dir)
    return rows.select("id", S.merchant_known(F.col("known_merchants"), F.col("merchant_id")).alias("known"))


def cluster_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by label of the embeddings."""
    refs = A.embedding_refs(spark, sf_dir).withColumn("cluster_id", F.col("label"))
    return cluster.boxes(refs, WIDTH).select("tag", "cluster_id", "n", F.get("low", 0).alias("low0"), F.get("high", 0).alias("high0"), F.aggregate("low", F.lit(0), lambda a, x: a + x).alias("low_sum"), F.aggregate("high", F.lit(0), lambda a, x: a + x).alias("high_sum"))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_sizes(A.embedding_refs(spark, sf_dir).withColumn("cluster_id", F.col("label"))).select("tag", "cluster_id", "n", "start")


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First assignment of Lloyd's rounds: evenly spaced seeds of each partition, least distance, then least number."""
    refs = _embeddings(spark, sf_dir)
    return cluster.assign(refs, cluster.seeds(refs)).select("ref_id", "tag", "cluster_id")


def bbox_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _embeddings(spark, sf_dir).withColumn("cluster_id", F.col("label"))
    return search.probe(A.as_queries(refs), cluster.boxes(refs, WIDTH), 3, WIDTH).select("id", "cluster_id", "lb")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers: kinds tell what was expected and said, values the latency."""
    e = A.table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 3 == 0).alias("expected_fraud"), (F.col("value") < 100).alias("approved"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"), F.col("value").alias("latency_ms"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_results(spark, sf_dir))


def p99_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    return rows.agg(evaluate.p99_of().alias("p99"), *evaluate.summary()).select(F.round("p99", 6).alias("p99"), "total", "fraud_count", F.round("fraud_rate", 9).alias("fraud_rate"))


def contest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each user's answers."""
    e = A.table(spark, sf_dir, "events")
    fine, fraud, denied = F.col("event_type") != "error", F.col("event_id") % 3 == 0, F.col("value") >= 100
    count = lambda c, name: F.count_if(c).alias(name)
    by = e.groupBy("user_id").agg(count(fine & fraud & denied, "tp"), count(fine & ~fraud & ~denied, "tn"), count(fine & ~fraud & denied, "fp"), count(fine & fraud & ~denied, "fn"), count(~fine, "err"), F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.99)).alias("p99"))
    scored = evaluate.contest_score(by)
    return scored.select("user_id", "e", *[F.round(c, 6).alias(c) for c in ("failure_rate", "detection_score", "latency_score", "final_score")])


def json_parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


def checked_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload bodies built from events, a fifth of them broken in one of five ways: validity and parsed amount."""
    e = A.table(spark, sf_dir, "events")
    amount = F.format_string("%.2f", "value")
    body = (
        F.when(F.col("event_id") % 25 == 0, F.lit("[]"))
        .when(F.col("event_id") % 25 == 1, F.lit('{"transaction":null}'))
        .when(F.col("event_id") % 25 == 2, F.lit('{"transaction":{"amount":"x"}}'))
        .when(F.col("event_id") % 25 == 3, F.lit('{"merchant":{"id":"a"}}'))
        .when(F.col("event_id") % 25 == 4, F.lit('{"customer":{"known_merchants":null}}'))
        .otherwise(F.concat(F.lit('{"transaction":{"amount":'), amount, F.lit(',"installments":3.7}}')))
    )
    return parse_checked(e.select("event_id", body.alias("body"))).select("event_id", "valid", "amount", "installments")


def iso_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    seconds = S.iso_epoch(text)
    return e.select("event_id", seconds.alias("seconds"), S.hour_utc(seconds).alias("hour"), S.weekday_utc(seconds).alias("weekday"))


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payload texts through the stream: the answers."""
    rows = materialize(A.transactions(spark, sf_dir), "transactions")
    refs = materialize(A.reference_vectors(spark, sf_dir, vectorize(rows)), "references")
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.to_json(
        F.struct(
            F.col("id").cast("string").alias("id"),
            F.struct("amount", "installments", stamp(F.col("requested_ts")).alias("requested_at")).alias("transaction"),
            F.struct(F.col("customer_avg").alias("avg_amount"), "tx_count_24h", "known_merchants").alias("customer"),
            F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
            F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
            F.when(F.col("has_last"), F.struct(stamp(F.col("last_ts")).alias("timestamp"), F.col("km_from_last").alias("km_from_current"))).alias("last_transaction"),
        ),
        {"ignoreNullFields": "false"},
    )
    path = scratch_path(spark, "stream")
    rows.select(body.alias("value")).write.option("compression", "snappy").text(f"{path}/in")  # as plain text five times the tables' size
    score_stream(spark, f"{path}/in", f"{path}/out", f"{path}/state", refs).awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("status", "response").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        fraud_score_orders, features_orders, request_tag, knn_exact_embeddings, kernel_knn, partitioned_knn, knn_vote, knn_majority, ivf_search, mcc_lookup, known_merchant,
        cluster_bbox, cluster_sizes, nearest_centroid, bbox_lower_bound, confusion_matrix, p99_latency, contest_score, json_parse_events, checked_bodies, iso_epoch, stream_score,
        probe_and_repair, centroid_step, corpus_index, risk_file, routed_requests, http_framing, judged_results, score_record,
    )
}

ORACLES = sql.oracles(DEFAULT.k, WIDTH, A.CODES, A.FRAUD_BELOW, A.THERE)
