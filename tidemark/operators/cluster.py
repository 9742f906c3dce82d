"""Index building: Lloyd's k-means by partition, cluster sizes and boxes, the index as Parquet."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, DIMENSIONS, SCALE
from tidemark.operators.search import tags_of
from tidemark.session import materialize

LOG = logging.getLogger(__name__)

MAGIC = "TIDEMARK"
VERSION = 1


def clusters_for(n: int, most: int = DEFAULT.max_clusters) -> int:
    """The root of the rows, up to most: small partitions do not get clusters of one member each. A fixed number is `most` of a partition of most^2 rows."""
    return max(1, min(most, int(n**0.5)))


def numbered(refs: DataFrame) -> DataFrame:
    """refs with at, the place by ref_id within the tag. Ranges of rows are numbered by themselves, then moved by what stands before."""
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(refs.repartitionByRange(n, "tag", "ref_id").withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("tag", "__part").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(W.partitionBy("tag").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("tag", "__part").orderBy("ref_id")) - 1
    return ranged.withColumn("__own", own).join(before.drop("count"), ["tag", "__part"]).withColumn("at", F.col("__own") + F.col("__before")).drop("__own", "__before", "__part")


def seeds(refs: DataFrame, most: int = DEFAULT.max_clusters) -> dict[int, np.ndarray]:
    """Evenly spaced rows of each tag: k * n/k. At most 16 x most rows come to the driver."""
    sizes = {r.tag: r["count"] for r in refs.groupBy("tag").count().collect()}
    step = F.create_map(*[F.lit(x) for tag, n in sizes.items() for x in (tag, n // clusters_for(n, most))]) if sizes else None
    k = F.create_map(*[F.lit(x) for tag, n in sizes.items() for x in (tag, clusters_for(n, most))]) if sizes else None
    if not sizes:
        return {}
    rows = numbered(refs).where((F.col("at") % step[F.col("tag")] == 0) & (F.col("at") / step[F.col("tag")] < k[F.col("tag")])).select("tag", "at", "q").collect()
    out: dict[int, np.ndarray] = {}
    for tag in sizes:
        mine = sorted((r.at, r.q) for r in rows if r.tag == tag)
        out[tag] = np.array([q for _, q in mine], np.float64)
    return out


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The least distance, then the least number."""
    d = (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)
    return d.argmin(1)


def assign(refs: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """refs with cluster_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column("tag").to_numpy()
            x = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            found = np.zeros(batch.num_rows, np.int32)
            for tag in np.unique(tags):
                at = tags == tag
                found[at] = nearest_centre(x[at], centres[int(tag)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "cluster_id"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in refs.schema) + ", cluster_id int"
    return refs.mapInArrow(run, schema)


def step(refs: DataFrame, centres: dict[int, np.ndarray], n: int = DIMENSIONS) -> dict[int, np.ndarray]:
    """Means of the members of the nearest centres; an empty cluster keeps its centre. A task gives one row of sums for each cluster it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {tag: np.zeros((len(c), n)) for tag, c in centres.items()}
        counts = {tag: np.zeros(len(c), np.int64) for tag, c in centres.items()}
        for batch in batches:
            tags = batch.column("tag").to_numpy()
            x = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            for tag in np.unique(tags).tolist():
                mine = x[tags == tag]
                found = nearest_centre(mine, centres[tag])
                counts[tag] += np.bincount(found, minlength=len(counts[tag]))
                np.add.at(sums[tag], found, mine)
        for tag in counts:
            at = np.flatnonzero(counts[tag])
            if len(at):
                total = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(at) + 1, n, dtype=np.int32)), pa.array(sums[tag][at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tag, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[tag][at]), total], names=["tag", "cluster_id", "n", "total"])

    parts = refs.select("tag", "q").mapInArrow(run, "tag int, cluster_id int, n bigint, total array<double>")
    moved = {tag: c.copy() for tag, c in centres.items()}
    for r in parts.groupBy("tag", "cluster_id").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", i)).alias(f"m{i}") for i in range(n)]).collect():
        moved[r.tag][r.cluster_id] = [r[f"m{i}"] / r.n for i in range(n)]
    return moved


def k_means(refs: DataFrame, iterations: int = DEFAULT.iterations, most: int = DEFAULT.max_clusters, n: int = DIMENSIONS) -> DataFrame:
    """refs with the assignment of the last of so many rounds; the centres are forgotten."""
    refs = materialize(refs, "refs")
    centres = seeds(refs, most)
    for i in range(iterations - 1):
        centres = step(refs, centres, n)
    return assign(refs, centres)


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """(tag, cluster_id, n, start): sizes, and the rows of the tag that stand before in cluster order."""
    sizes = assigned.groupBy("tag", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("tag").orderBy("cluster_id").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def boxes(assigned: DataFrame, n: int = DIMENSIONS) -> DataFrame:
    """(tag, cluster_id, n, low, high): least and greatest value of each dimension. A cluster without members has no row."""
    sides = [f(F.get("q", i)).alias(f"{name}{i}") for name, f in (("l", F.min), ("h", F.max)) for i in range(n)]
    flat = assigned.groupBy("tag", "cluster_id").agg(F.count(F.lit(1)).alias("n"), *sides)
    return flat.select("tag", "cluster_id", "n", F.array(*[f"l{i}" for i in range(n)]).alias("low"), F.array(*[f"h{i}" for i in range(n)]).alias("high"))


@dataclass
class Index:
    refs: DataFrame
    clusters: DataFrame
    tags: list[int]
    meta: dict


def write_index(assigned: DataFrame, path: str, iterations: int = DEFAULT.iterations, n: int = DIMENSIONS) -> None:
    """refs by tag, sorted by cluster; boxes; one row of facts, written last: an index without it is not whole."""
    spark, began = assigned.sparkSession, time.monotonic()
    assigned = materialize(assigned, "assigned")
    if assigned.isEmpty():
        raise ValueError("no references to index")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assigned.repartitionByRange(parts, "tag", "cluster_id", "ref_id").sortWithinPartitions("tag", "cluster_id", "ref_id").write.mode("overwrite").partitionBy("tag").parquet(f"{path}/refs")
    boxes(assigned, n).write.mode("overwrite").parquet(f"{path}/clusters")
    facts = {"magic": MAGIC, "version": VERSION, "scale": SCALE, "iterations": iterations, "rows": assigned.count()}
    spark.range(1).select(F.lit(json.dumps(facts)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    LOG.info("index of %d rows written to %s in %.1f s", facts["rows"], path, time.monotonic() - began)


def open_index(spark: SparkSession, path: str) -> Index:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("magic") != MAGIC or meta.get("version") != VERSION or meta.get("scale") != SCALE:
        raise ValueError(f"{path} is not an index of this version")
    refs = spark.read.parquet(f"{path}/refs")
    tags = tags_of(refs)
    if not tags:
        raise ValueError(f"{path} has no partition")
    return Index(refs, spark.read.parquet(f"{path}/clusters"), tags, meta)
