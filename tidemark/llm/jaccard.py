"""N-gram Jaccard join by chosen paths: texts whose sets of five-word shingles have similarity 0.8 or more.

1. Each text becomes a set of shingle hashes, of which a sketch keeps the SKETCH least: a sample that equal shingles share.
2. Chosen paths: in each run a set follows those tokens of its sketch whose hash with the path so far falls below
   1/(THRESHOLD * size), the same for every set, so similar sets go on together. Sets on one path form a bucket. Buckets of
   one set are done; those above LIMIT are split again by another token, down to DEPTH tokens. Runs are repeated until a pair at
   the threshold has met with probability RECALL (see runs_for).
3. Buckets of up to LIMIT sets (or what is left at DEPTH, in pairs of blocks) are compared by brute force on the sketches,
   with room for the sketch's error: CANDIDATE instead of THRESHOLD. They give links to one member each, never all pairs.
4. Texts that hang together by such links are compared exactly, on all shingles, each with all others of its component, in pairs of blocks; so
   a pair that never met in a bucket is found all the same if both are linked to others. Links are counted, not listed.

Equal texts are one set throughout, and count as often as they stand. Texts are told apart by two independent 64-bit hashes.

Cases: a word is what stands between ASCII white space; a text of one to four words is one shingle of them all; null texts and texts without
words link with nothing; rows that repeat are documents each and link with each other; a class is named by its least doc_id, null only if it has
no other; an empty table gives an empty result; other columns are ignored by the join and kept by one_of_each, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, sieve, small_batches, strings, table
from tidemark.llm.graph import Union, components, each_pair_of_blocks, in_blocks, once
from tidemark.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
CANDIDATE = 0.6
SKETCH = 64
RECALL = 0.999
DEPTH = 3
LIMIT = 1024
#: Bytes of text that one side of an exact comparison holds; a text counts TEXT_BYTES at least, which bounds their number.
BLOCK_BYTES, TEXT_BYTES = 4 << 20, 4 << 10
#: Words remembered with their hash; forgotten when full.
REMEMBER = 200_000
SEED = 11

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def mix1(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has shared a path of this depth with probability recall.

    Such a pair shares a Poisson number of tokens of mean 1 at each step; q is the chance that some path lasts.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBER:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str, seen: Words) -> np.ndarray:
    """The sorted hashes of a text's shingles, each once."""
    words = text.encode().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out) + h[i : len(h) - n + 1 + i]
    return np.unique(mix(out + np.uint64(n)))


def onward(tokens: np.ndarray, paths: np.ndarray) -> list[np.ndarray]:
    """For each path, the paths one token longer that this sketch follows."""
    share = min(1.0, 1 / (THRESHOLD * len(tokens)))
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))
    salted = mix(tokens[None, :] ^ mix(paths)[:, None])
    chosen = salted < limit
    return [mix(t + np.uint64(1)) ^ p for t, p in zip((salted[i][c] for i, c in enumerate(chosen)), paths)]


def text_hash(text: Column, seed: int) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(F.lit(seed), text))


def with_ids(docs: DataFrame) -> DataFrame:
    """docs with __t, a number of each different text (null for null). Texts that share the first hash but not the second are numbered by a third."""
    text = F.col("text")
    both = docs.where("text IS NOT NULL").select(text_hash(text, 1).alias("__c"), text_hash(text, 2).alias("g"))
    clash = both.groupBy("__c").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("__c")
    rows = docs.withColumn("__h", text_hash(text, 1)).join(materialize(clash, "clashes"), F.col("__h") == F.col("__c"), "left")
    return rows.withColumn("__t", F.when(F.col("__c").isNull(), F.col("__h")).otherwise(text_hash(text, 3))).drop("__h", "__c")


def sketches(docs: DataFrame, runs: int) -> DataFrame:
    """docs (__t, text) to (id, sketch, paths) of each different text that has words; paths: the first token's, of all runs."""
    small_batches(docs.sparkSession)
    starts = np.array([mix1(SEED * 1000 + r) for r in range(runs)], np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, before = Words(), set()
        for batch in batches:
            out = []
            for i, text in zip(batch.column("id").to_pylist(), strings(batch, "text")):
                if i in before:
                    continue
                if len(before) < REMEMBER:
                    before.add(i)
                tokens = shingles(text, seen)[:SKETCH]
                if len(tokens):
                    out.append((i, tokens.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["id", "sketch"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [np.concatenate(onward(np.frombuffer(x, np.uint64), starts)).astype(np.int64) for x in batch.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.int64()))], names=["id", "sketch", "paths"])

    rows = docs.where("text IS NOT NULL").select(F.col("__t").alias("id"), "text").mapInArrow(sketch, "id bigint, sketch binary")
    once_each = rows.groupBy("id").agg(F.first("sketch").alias("sketch"))
    return materialize(once_each.mapInArrow(begin, "id bigint, sketch binary, paths array<bigint>"), "sets")


def split(rows: DataFrame) -> DataFrame:
    """(id, paths, sketch) to (path, id), a token further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, ids = [], []
            for p, i, s in zip(batch.column("paths").to_pylist(), batch.column("id").to_pylist(), batch.column("sketch").to_pylist()):
                further = np.concatenate(onward(np.frombuffer(s, np.uint64), np.array(p, np.int64).astype(np.uint64)))
                path.append(further.astype(np.int64))
                ids += [i] * len(further)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(path) if path else np.empty(0, np.int64)), pa.array(ids, pa.int64())], names=["path", "id"])

    return rows.select("paths", "id", "sketch").mapInArrow(run, "path bigint, id bigint")


def buckets(sets: DataFrame, depth: int = DEPTH, limit: int = LIMIT) -> DataFrame:
    """(path, id) of the buckets to compare. Of those with the same members one is kept; buckets still to be split all go on, each in its own run."""
    rows, done = sets.select(F.explode("paths").alias("path"), "id"), None
    for level in range(1, depth + 1):
        shared = materialize(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path"), f"shared{level}")
        rows = sieve(rows, F.col("path"), shared, "path").where("__maybe").drop("__maybe")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("id"), 24)).alias("s"), F.bit_xor(F.xxhash64("id")).alias("x")).where("n > 1")
        own = F.when(F.lit(level < depth) & (F.col("n") > limit), F.col("path"))
        sizes = materialize(sizes.groupBy("n", "s", "x", own.alias("own")).agg(F.min("path").alias("path")).select("path", "n"), f"sizes{level}")
        members = materialize(rows.join(sizes, "path"), f"members{level}")
        small = members if level == depth else members.where(F.col("n") <= limit)
        small = small.select("path", "id")
        done = small if done is None else done.unionByName(small)
        large = members.where(F.col("n") > limit)
        if level == depth or large.isEmpty():
            return done
        # a set's paths together: its sketch is dealt out once, however many runs go on
        paths = large.groupBy("id").agg(F.collect_list("path").alias("paths"))
        paths = materialize(paths, f"paths{level}")
        met = sieve(sets.select("id", "sketch"), F.col("id"), paths, "id").where("__maybe").drop("__maybe")
        rows = materialize(split(paths.join(met, "id")), f"split{level}")
    return done


def common(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(columns, counts): tokens that stand in several sets as a list of (set, token) pairs, and each set's size."""
    sizes = np.array([len(s) for s in sets])
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at, minlength=len(token)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    return np.stack([owner[keep], number[at[keep]]]), sizes


def overlaps(sets: list[np.ndarray], strip: int = 256, width: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sizes of intersections of all pairs, in strips of rows: (first row, counts, sizes). Memory: two width-limited matrices."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        sizes = np.array([len(s) for s in sets])
        yield 0, np.array([[sizes[0], both], [both, sizes[1]]]), sizes
        return
    (owner, token), sizes = common(sets)
    n, tokens = len(sets), int(token.max()) + 1 if len(token) else 0
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    edges = np.searchsorted(token, np.arange(0, tokens + width, width))
    strips = {s: np.zeros((min(strip, n - s), n), np.float32) for s in range(0, n, strip)} if n <= 4 * strip else None
    if strips is not None:
        for k in range(len(edges) - 1):
            part = slice(edges[k], edges[k + 1])
            m = np.zeros((n, width), np.float32)
            m[owner[part], token[part] - k * width] = 1
            for s, got in strips.items():
                got += m[s : s + strip] @ m.T
        for s, got in strips.items():
            yield s, got, sizes
        return
    for s in range(0, n, strip):
        got = np.zeros((min(strip, n - s), n), np.float32)
        for k in range(len(edges) - 1):
            part = slice(edges[k], edges[k + 1])
            o, t = owner[part], token[part] - k * width
            mine = (o >= s) & (o < s + strip)
            if not mine.any():
                continue
            columns, t = np.unique(t, return_inverse=True)
            used = np.zeros(len(columns), bool)
            used[t[mine]] = True
            number = np.cumsum(used) - 1
            keep = used[t]
            m = np.zeros((n, int(used.sum())), np.float32)
            m[o[keep], number[t[keep]]] = 1
            got += m[s : s + strip] @ m.T
        yield s, got, sizes


def link_sketches(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """(a, b): members of a bucket and one that each hangs together with, by sketches."""
    t = once(t)
    if t.num_rows < 2:
        return
    ids, block = t.column("id").to_numpy(), t.column("block").to_numpy()
    apart = t.column("first")[0].as_py() != t.column("second")[0].as_py()
    sets = [np.frombuffer(s, np.uint64) for s in t.column("sketch").to_pylist()]
    last = np.array([s[-1] if len(s) == SKETCH else np.uint64(2**64 - 1) for s in sets])
    union = Union(len(ids))
    for s, both, _ in overlaps(sets):
        # both sketches are whole samples below the lesser of their last tokens
        within = np.array([np.searchsorted(x, last, side="right") for x in sets[s : s + len(both)]])
        others = np.array([np.searchsorted(x, last[s : s + len(both)], side="right") for x in sets]).T
        joint = within + others - both
        a, b = np.nonzero(both >= CANDIDATE * joint)
        a += s
        keep = a < b
        if apart:
            keep &= block[a] != block[b]
        union.join(a[keep], b[keep])
    part = union.label != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[union.label[part]])], names=["a", "b"])


def link_texts(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """(id, root, n_links): exact links of the texts here; a text counts a link as often as the other text stands."""
    t = once(t)
    if t.num_rows < 2:
        return
    ids, block, copies = (t.column(c).to_numpy() for c in ("id", "block", "n"))
    apart = t.column("first")[0].as_py() != t.column("second")[0].as_py()
    seen = Words()
    sets = [shingles(x, seen) for x in t.column("text").to_pylist()]
    union, links = Union(len(ids)), np.zeros(len(ids), np.int64)
    ratio = round(THRESHOLD * 1000)
    for s, both, sizes in overlaps(sets):
        joint = sizes[s : s + len(both), None] + sizes[None, :] - both
        a, b = np.nonzero(both * 1000 >= ratio * joint)
        a += s
        keep = a < b
        if apart:
            keep &= block[a] != block[b]
        a, b = a[keep], b[keep]
        union.join(a, b)
        links += np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(ids)).astype(np.int64)
    part = links > 0
    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[union.label[part]]), pa.array(links[part])], names=["id", "root", "n_links"])


def candidate_components(docs: DataFrame) -> DataFrame:
    """(id, component) of the texts that hang together with another by their sketches."""
    sets = sketches(docs, runs_for(RECALL, DEPTH))
    members = buckets(sets)
    met = sieve(sets.select("id", "sketch"), F.col("id"), members, "id").where("__maybe").drop("__maybe")
    rows = members.join(met, "id").withColumnRenamed("path", "group").withColumn("one", F.lit(1))
    links = each_pair_of_blocks(in_blocks(rows, "group", "one", LIMIT), "group", link_sketches, "a bigint, b bigint")
    stars = components(links)
    return materialize(stars.select(F.col("node").alias("id"), F.col("root").alias("component")).unionByName(stars.select(F.col("root").alias("id"), F.col("root").alias("component")).distinct()), "candidates")


def text_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, __t) to ((doc_id, id) of every row, id null without words; (id, root, n_links, n) of the texts)."""
    has_words = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(WORD))
    rows = materialize(docs.select("doc_id", F.when(has_words, F.col("__t")).alias("id")), "text-ids")
    counts = rows.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    chosen = materialize(candidate_components(docs).join(counts, "id").select("component", F.col("id").alias("__id"), "n", F.col("first").alias("__first")), "chosen")
    # only texts that may be chosen are dealt out; by text and document, so that the copies of a text are too, and one of them is used
    texts = sieve(docs.where("text IS NOT NULL").select("doc_id", "text", "__t"), F.col("__t"), chosen, "__id").where("__maybe")
    texts = texts.join(chosen, (F.col("__t") == F.col("__id")) & F.col("doc_id").eqNullSafe(F.col("__first")))
    texts = texts.select(F.col("component").alias("group"), F.col("__id").alias("id"), "n", "text", F.greatest(F.octet_length("text"), F.lit(TEXT_BYTES)).alias("bytes"))
    found = each_pair_of_blocks(in_blocks(texts, "group", "bytes", BLOCK_BYTES), "group", link_texts, "id bigint, root bigint, n_links bigint")
    found = materialize(found, "text-links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("n_links").alias("links"))
    known = counts.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    return rows, known.select("id", F.coalesce("root", "id").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "n", "first")


def classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, class_id, n_links."""
    rows, known = text_links(with_ids(docs.select("doc_id", "text")))
    known = materialize(known, "text-classes")
    least = materialize(known.groupBy("root").agg(F.min("first").alias("class_id")), "text-names")
    named = known.join(least, "root").select("id", "class_id", "n_links")
    return rows.join(named, "id", "left").select("doc_id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents of a class but one: that of the least doc_id (null last), of equal ids the least text hash.

    Documents without links, and those without words, all stay. Rows that stand twice, id and text alike, are two documents of one class; the one whose other columns come first stays.
    """
    named = with_ids(docs)
    known = text_links(named.select("doc_id", "text", "__t"))[1]
    known = materialize(known.where("n_links > 0"), "text-classes")
    best = known.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("z"), "first", "id")).alias("b"))
    best = materialize(best, "text-names")
    losers = materialize(known.join(best, "root").select(F.col("id").alias("__id"), (F.col("id") == F.col("b.id")).alias("__best"), F.col("first").alias("__first")), "text-losers")
    # documents without links are not dealt out to meet the others
    rows = sieve(named, F.col("__t"), losers, "__id")
    alone = rows.where("NOT __maybe").select(*docs.columns)
    met = rows.where("__maybe").join(losers, F.col("__t") == F.col("__id"), "left")
    stay = met.where(F.col("__best") & F.col("doc_id").eqNullSafe(F.col("__first")))
    order = [f.name for f in docs.schema if not re.search("map|variant", f.dataType.simpleString())]
    one = stay.groupBy("__id").agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("r")).select("r.*")
    return alone.unionByName(met.where(F.col("__id").isNull()).select(*docs.columns)).unionByName(one)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT w, count(*) AS n, min(doc_id) AS first FROM w WHERE len(w) > 0 GROUP BY w
), s AS (
  SELECT DISTINCT first AS id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT first, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t)
), size AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), link AS (
  SELECT p.a, p.b FROM (SELECT x.id AS a, y.id AS b, count(*) AS both FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2) p
  JOIN size m ON m.id = p.a JOIN size n ON n.id = p.b WHERE p.both * 10 >= 8 * (m.n + n.n - p.both)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
), n AS (
  SELECT l.a, sum(t.n) AS n FROM link l JOIN t ON t.first = l.b GROUP BY l.a
)
SELECT w.doc_id, CASE WHEN len(w.w) = 0 THEN w.doc_id ELSE least(t.first, coalesce(m, t.first)) END AS class_id,
       CASE WHEN len(w.w) = 0 THEN 0 ELSE t.n - 1 + coalesce(n.n, 0) END::BIGINT AS n_links
FROM w LEFT JOIN t ON t.w = w.w LEFT JOIN comp ON comp.a = t.first LEFT JOIN n ON n.a = t.first
"""
