"""Connected components by alternating large and small stars, and groups cut into block pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_run
from tidemark.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), bigint: (node, root) for each node but the roots, root the least node of its component.

    Each round keeps the edges of every node to the least neighbour only: a node with many neighbours is a partial minimum and a
    join that can be split (both of its sides are tables), never a list. Rounds end when the edges no longer change; only a count and a hash come to the driver.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, before = materialize(stars, "edges"), None
    while True:
        seen = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen[0] == 0 or tuple(seen) == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(seen)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        stars = materialize(small, "edges")


class Union:
    """Which of n nodes hang together."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        other = x != y
        if not other.any():
            return
        pairs = np.unique(np.stack([x[other], y[other]], 1), axis=0)
        up: dict[int, int] = {}

        def top(i: int) -> int:
            while i in up:
                i = up[i]
            return i

        for p, q in pairs.tolist():
            p, q = top(p), top(q)
            if p != q:
                up[max(p, q)] = min(p, q)
        if up:
            old = np.array(list(up), np.int64)
            new = np.arange(len(self.label))
            new[old] = [top(i) for i in up]
            self.label = new[self.label]


def in_blocks(rows: DataFrame, group: str, weight: str, most: int) -> DataFrame:
    """rows with block, first and second, a copy for each pair of blocks that a row's block is in.

    A group's rows go by hash of their id to as many blocks as its weight fills; a task gets two blocks at most, whatever the
    group's size. rows has the columns group and id, both bigint.
    """
    sizes = materialize(rows.groupBy(group).agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks")), "blocks")
    dealt = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("first"), F.greatest("block", j).alias("second")))
    return dealt.select("*", F.inline(pairs)).drop("blocks")


def each_pair_of_blocks(rows: DataFrame, group: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work gets the rows of one (group, first, second) at a time; block tells the two sides apart."""
    keys = [group, "first", "second"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_run(batches, keys):
            yield from work(t)

    return rows.repartition(n, *keys).sortWithinPartitions(*keys, "id").mapInArrow(run, schema)


def once(t: pa.Table) -> pa.Table:
    """The first row of each id; rows stand in the order of id."""
    ids = t.column("id").to_numpy()
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    return t if new.all() else t.filter(pa.array(new))
