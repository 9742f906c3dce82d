"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one vector of each group kept.

Vectors with the same label (and length) are compared; equal ones are collapsed first and count as often as they stand. Centroids
come from a bounded sample (SAMPLE vectors, those of least hash), CELL vectors a cell; every vector has a home cell. Two vectors meet
once, where their two homes are compared. A vector takes part in that for each cell that can be home to a partner: to reach cell c from home h it
must lie no further from the plane between the two centroids than the angle of the threshold spans (see reached), so no link is lost, whatever the
data. Where vectors reach most cells of their label (the share WHOLE), the label is one cell: then all its pairs are compared, and the cost grows
with the square of its distinct vectors. Cosines are exact, in double precision. Groups above BLOCK vectors are compared in pairs of blocks, none are cut.

Cases: a null label, a null or zero vector and one with a null or non-finite component link with nothing and are kept; rows that repeat a vec_id
are vectors each; a null vec_id can link, but gives its name to a component only if no other is in it (then component_id is null and it is kept);
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.graph import Union, components, each_pair_of_blocks, in_blocks, once
from tidemark.session import materialize

THRESHOLD = 0.93
SAMPLE = 20_000
CELL = 2048
WHOLE = 0.7
BLOCK = 8192
ROUNDS = 12
STRIP = 256
#: Rows in an Arrow batch that assign gives.
ROWS = 4096


def matrix(lists) -> np.ndarray:
    """Unit rows in double precision; scaled by the largest component first, so that no square under- or overflows."""
    x = np.array(lists, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit rows, from evenly spaced seeds; an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1)
        full = norm > 1e-12
        c[full] = total[full] / norm[full, None]
    return c


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, id) of every row, id null where it links with nothing; and (id, label, v, n) of each distinct vector."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"), F.when(fine, F.xxhash64("label", "embedding")).alias("id"))
    each = rows.where("id IS NOT NULL").groupBy("id").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return rows.select("vec_id", "id"), each.withColumn("label", F.concat_ws(":", "label", F.size("v")))


def reached(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, cells): the nearest centroid of unit rows x, and a mask of the cells where a vector at the threshold or nearer can be at home.

    A vector at home in c is on c's side of the plane between c and h; x is within the threshold's angle of it, so at most its sine from that plane.
    """
    near = x @ c.T
    home = near.argmax(1)
    square = (c * c).sum(1)
    apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * c @ c.T, 0))
    sine = np.sqrt(1 - max(threshold, 0.0) ** 2)
    return home, near[np.arange(len(x)), home][:, None] - near <= sine * apart[home] + 1e-6


def centroids(each: DataFrame, threshold: float, sample: int = SAMPLE, cell: int = CELL) -> dict[str, np.ndarray]:
    """Centroids by label, for labels with more than a cell's vectors, if they keep pairs apart; at most `sample` vectors come to the driver."""
    rows = each.orderBy(F.xxhash64("id"), "id").limit(sample).select("label", "id", "v").collect()
    sizes = {r.label: r["count"] for r in each.groupBy("label").count().where(F.col("count") > cell).orderBy(F.desc("count"), "label").limit(sample).collect()}
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.label, r.id)):
        by.setdefault(r.label, []).append(r.v)
    out = {}
    for label, n in sizes.items():
        if label in by:
            x = matrix(by[label])
            c = spherical_means(x, min(-(-n // cell), max(len(x) // 8, 1)))
            if reached(x, c, threshold)[1].mean() <= WHOLE:
                out[label] = c
    return out


def assign(each: DataFrame, centres: dict[str, np.ndarray], threshold: float, number: str) -> DataFrame:
    """A row for each pair of cells that a vector is compared in: (cell, id, kind, home, v, n); kind tells labels apart.

    cell: the lesser and the greater of two cells in 32 bits each. v: the components as they came, in the type that number names.
    """
    first, at = {}, 0
    for label in sorted(centres):
        first[label], at = at, at + len(centres[label])
    fields = [("cell", pa.int64()), ("id", pa.int64()), ("kind", pa.int64()), ("home", pa.int64()), ("v", pa.binary()), ("n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), object)
            ids, kinds, copies = (batch.column(c).to_numpy() for c in ("id", "kind", "n"))
            lists = batch.column("v").to_pylist()
            for label in set(labels):
                rows = np.flatnonzero(labels == label)
                raw = [np.array(lists[i], number).tobytes() for i in rows]
                if label in centres:
                    home, mask = reached(matrix([lists[i] for i in rows]), centres[label], threshold)
                    who, other = np.nonzero(mask)
                    home, other = first[label] + home[who], first[label] + other
                    cell = np.minimum(home, other) << 32 | np.maximum(home, other)
                else:
                    who = np.arange(len(rows))
                    cell = home = np.full(len(rows), -1 - zlib.crc32(label.encode()))  # two labels in one such cell: told apart below
                for s in range(0, len(who), ROWS):
                    w = who[s : s + ROWS]
                    columns = (cell[s : s + ROWS], ids[rows[w]], kinds[rows[w]], home[s : s + ROWS], [raw[i] for i in w], copies[rows[w]])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    rows = each.select("id", F.xxhash64("label").alias("kind"), "label", "v", "n")
    return rows.mapInArrow(run, "cell bigint, id bigint, kind bigint, home bigint, v binary, n bigint")


def compare(t: pa.Table, threshold: float, number: str) -> Iterator[pa.RecordBatch]:
    """(id, root, n_links) for the vectors that have a link here: root is one of those it hangs together with."""
    t = once(t)
    if t.num_rows < 2:
        return
    cell, one, two = t.column("group")[0].as_py(), t.column("first")[0].as_py(), t.column("second")[0].as_py()
    ids, block, kind, copies, home = (t.column(c).to_numpy() for c in ("id", "block", "kind", "n", "home"))
    raw = t.column("v").to_pylist()
    widths = np.array([len(r) for r in raw])
    links, union = np.zeros(len(ids), np.int64), Union(len(ids))
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        x = matrix(np.frombuffer(b"".join(raw[i] for i in at), number).reshape(len(at), -1))
        # the two sides: two cells, two blocks of one, or one block with itself
        if cell >= 0 and cell >> 32 != cell & 0xFFFFFFFF:
            left, right = (np.flatnonzero(home[at] == c) for c in (cell >> 32, cell & 0xFFFFFFFF))
        elif one != two:
            left, right = (np.flatnonzero(block[at] == b) for b in (one, two))
        else:
            left = right = np.arange(len(at))
        y = x[right]
        for s in range(0, len(left), STRIP):
            a, b = np.nonzero(x[left[s : s + STRIP]] @ y.T >= threshold)
            a, b = at[left[a + s]], at[right[b]]
            keep = kind[a] == kind[b]
            if left is right:
                keep &= a < b
            if one != two:
                keep &= block[a] != block[b]
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            union.join(a, b)
            for x1, y1 in ((a, b), (b, a)):
                links += np.bincount(x1, weights=copies[y1], minlength=len(ids)).astype(np.int64)
    part = np.bincount(union.label, minlength=len(ids))[union.label] > 1
    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[union.label[part]]), pa.array(links[part])], names=["id", "root", "n_links"])


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, embedding, label) to vec_id, n_links, component_id, kept."""
    rows, each = distinct_vectors(vectors)
    rows, each = materialize(rows, "vector-ids"), materialize(each, "vectors")
    number = "float32" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "float64"
    cells = materialize(assign(each, centroids(each, threshold), threshold, number).withColumnRenamed("cell", "group").withColumn("one", F.lit(1)), "cells")
    found = each_pair_of_blocks(in_blocks(cells, "group", "one", BLOCK), "group", lambda t: compare(t, threshold, number), "id bigint, root bigint, n_links bigint")
    found = materialize(found, "vector-links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("n_links").alias("links"))
    known = each.select("id", "n").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = materialize(known.select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root")), "vector-classes")
    named = materialize(rows.join(known, "id", "left"), "vector-groups")
    least = materialize(named.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least")), "vector-names")
    out = named.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v
  WHERE label IS NOT NULL AND list_dot_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= {THRESHOLD}
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m, v.vec_id))::BIGINT AS component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN comp ON comp.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
