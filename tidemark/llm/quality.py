"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, temperature calibration.

Word vectors: words hash into BUCKETS; each bucket has a sparse random index vector of DIM signs, and its context vector is the sum of the index vectors
of the two words before and after each of its occurrences in all documents, scaled to unit length. The sums are integers, so
reruns agree. A word that repeats the one before it becomes the word REPEAT. A document pools index and context vectors of its
words by their mean and scatter, with PRIOR_WORDS average words added, so that a few words say little. The network learns from a bounded sample of labelled documents (MAX_TRAIN,
those of least hash); a temperature is fitted on a part of them kept back from the weights.

Cases: null and empty texts have the average word's vector and get a score as any other; labels that are null or name no document teach
nothing; a document with two labels teaches both; with labels of one class only (or none) the score is that class's share (or 0.5);
repeated rows get equal scores; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held, small_batches, strings, table

BUCKETS = 8192
DIM = 32
SIGNS = 4
REACH = 2
MAX_TRAIN = 20_000
PRIOR_WORDS = 6
HIDDEN = 24
EPOCHS = 40
SEED = 5
#: Words remembered with their bucket; forgotten when full.
REMEMBER = 200_000

#: The bucket of a word that stands twice in a row.
REPEAT = zlib.crc32(b"\x00repeat") % BUCKETS

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(word: str) -> str:
    """The word in lower case, marked if it was all capitals: a feature of its own beside the word."""
    return word.lower() + "^" if word.isupper() and len(word) > 1 else word.lower()


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = found = zlib.crc32(shape(word).encode()) % BUCKETS
        return found


def index_vectors() -> np.ndarray:
    """BUCKETS x DIM, SIGNS entries of +-1 in each row."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), np.int8)
    for i in range(BUCKETS):
        out[i, rng.choice(DIM, SIGNS, replace=False)] = rng.choice((-1, 1), SIGNS)
    return out


def tokens(text: str, seen: Buckets) -> np.ndarray:
    found = _TOKEN.findall(text)
    ids = np.fromiter(map(seen.__getitem__, found), np.int32, len(found))
    if len(ids) > 1:
        again = ids[1:] == ids[:-1]
        ids[1:][again] = REPEAT
    return ids


def context_sums(docs: DataFrame) -> DataFrame:
    """(bucket, d0.., n): sums of the index vectors beside each bucket's words over all documents."""
    small_batches(docs.sparkSession)
    names = [f"d{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        where = np.argsort(index == 0, axis=1, kind="stable")[:, :SIGNS]
        sign = np.take_along_axis(index, where, 1).astype(np.float64)
        seen, sums, count = Buckets(), np.zeros(BUCKETS * DIM), np.zeros(BUCKETS)
        for batch in batches:
            gap = np.full(REACH, -1, np.int32)
            lines = [x for t in strings(batch, "text") for x in (tokens(t, seen), gap)]
            if not lines:
                continue
            row = np.concatenate(lines)
            count += np.bincount(row[row >= 0], minlength=BUCKETS)
            for step in range(1, REACH + 1):
                a, b = row[:-step], row[step:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for x, y in ((a, b), (b, a)):
                    for s in range(SIGNS):
                        sums += np.bincount(x * DIM + where[y, s], weights=sign[y, s], minlength=BUCKETS * DIM)
        there = np.flatnonzero(count)
        grid = sums.reshape(BUCKETS, DIM)[there].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *[pa.array(grid[:, i]) for i in range(DIM)], pa.array(count[there].astype(np.int64))], names=["bucket", *names, "n"])

    schema = "bucket int, " + ", ".join(f"{n} bigint" for n in names) + ", n bigint"
    parts = docs.select("text").mapInArrow(run, schema)
    return parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in [*names, "n"]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS + 1 rows of 2 DIM: index vector, then context vector of unit length; the last row is the average word's. At most BUCKETS rows come to the driver."""
    out = np.zeros((BUCKETS + 1, 2 * DIM), np.float32)
    out[:BUCKETS, :DIM] = index_vectors() / np.sqrt(SIGNS)
    count = np.zeros(BUCKETS)
    for row in context_sums(docs).collect():
        v = np.array(row[1 : 1 + DIM], np.float64)
        out[row["bucket"], DIM:] = v / (np.linalg.norm(v) or 1.0)
        count[row["bucket"]] = row["n"]
    out[BUCKETS] = count @ out[:BUCKETS] / max(count.sum(), 1)
    return out


def pooled(texts: list[str], vectors: np.ndarray, seen: Buckets) -> np.ndarray:
    """A row for each text: the mean vector of its words and how far they scatter along each axis."""
    out = np.empty((len(texts), 2 * vectors.shape[1]), np.float32)
    words, average = vectors[:BUCKETS], vectors[BUCKETS]
    spread = average * average + 1 / vectors.shape[1]
    for i, t in enumerate(texts):
        found = tokens(t, seen)
        n = np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(n)
        share, v, rest = (n[at] / (len(found) + PRIOR_WORDS)).astype(np.float32), words[at], PRIOR_WORDS / (len(found) + PRIOR_WORDS)
        mean = share @ v + rest * average
        out[i] = np.concatenate([mean, np.sqrt(np.maximum(share @ (v * v) + rest * spread - mean * mean, 0))])
    return out


class Network:
    """Standardised input, HIDDEN tanh units, one logit over a temperature."""

    def __init__(self, prior: float, layers=None, mean=0.0, scale=1.0, temperature: float = 1.0):
        self.prior, self.layers, self.mean, self.scale, self.temperature = prior, layers, mean, scale, temperature

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w + b) @ u + c

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, kept_back: np.ndarray) -> Network:
    """Adam on the logistic loss, classes weighted equally within a factor; then the temperature on the rows kept back."""
    if len(y) == 0 or y.min() == y.max():
        return Network(float(y.mean()) if len(y) else 0.5)
    if kept_back.all() or not kept_back.any() or np.ptp(y[~kept_back]) == 0:
        kept_back = np.zeros(len(y), bool)
    tx, ty = x[~kept_back].astype(np.float64), y[~kept_back]
    rng = np.random.default_rng(SEED)
    net = Network(float(y.mean()), [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)], tx.mean(0), tx.std(0) + 1e-3)
    m, v, step = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
    z = (tx - net.mean) / net.scale
    for _ in range(EPOCHS):
        order = rng.permutation(len(ty))
        for at in np.array_split(order, max(1, len(ty) // 64)):
            w, b, u, c = net.layers
            h = np.tanh(z[at] @ w + b)
            p = 1 / (1 + np.exp(-np.clip(h @ u + c, -40, 40)))
            d = (p - ty[at]) / len(at)
            dh = np.outer(d, u) * (1 - h * h)
            grads = [z[at].T @ dh + 1e-4 * w, dh.sum(0), h.T @ d + 1e-4 * u, np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                net.layers[i] = net.layers[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    if kept_back.any():
        raw, truth = net.logit(x[kept_back]), y[kept_back]
        loss = lambda t: np.mean(np.logaddexp(0, raw / t) - truth * raw / t)
        net.temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, limit: int = MAX_TRAIN) -> Network:
    """labels: (doc_id, label), those to learn from only. At most limit of them are used."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    # at most `limit` narrow rows: bounded whatever the input
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets()
        for batch in batches:
            x = pooled(strings(batch, "text"), vectors, seen)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    found = sorted(rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label int, x binary").collect())
    if not found:
        return Network(0.5)
    x = np.array([np.frombuffer(r.x, np.float32) for r in found])
    y = np.array([float(r.label) for r in found])
    return fit(x, y, np.array([zlib.crc32(b"keep%d" % r.doc_id) % 5 == 0 for r in found], bool))


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """docs (doc_id, text, any others) with score and predicted; all columns but text stay."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets()
        for batch in batches:
            p = net(pooled(strings(batch, "text"), vectors, seen)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"
    return docs.mapInArrow(run, schema)


def quality_model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of all docs, and a network taught by labels (doc_id, quality) outside the held-out third."""
    vectors = word_vectors(docs)
    known = labels.where(~held(F.col("doc_id"), 3, 1)).select("doc_id", F.col("quality").alias("label"))
    return vectors, train(docs, known, vectors)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors, net = quality_model(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return score(rows, vectors, net)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns as they are."""
    vectors, net = quality_model(docs, labels)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(net(pooled(strings(batch, "text"), vectors, seen)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
