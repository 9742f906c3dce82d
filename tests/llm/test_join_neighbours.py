"""The Jaccard join and the embedding search against brute force."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import common, jaccard, neighbours


def near_documents(seed, n=220):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base = [[r.choice(words) for _ in range(r.randint(3, 120))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        text = list(base[r.randrange(len(base))] if r.random() < 0.8 else base[0])
        for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
            if text:
                text[r.randrange(len(text))] = r.choice(words)
        if r.random() < 0.2:
            text += base[1][:40]
        out.append((i, " ".join(text)))
    return out


def brute(docs):
    sets = {}
    for i, t in docs:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: [j for j in sets if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    root = {}
    for i in sorted(sets):
        if i not in root:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in root:
                    root[x] = i
                    stack += links[x]
    return {i: (root[i], len(links[i])) for i in sets}


def test_join_finds_every_link(spark):
    for seed in range(2):
        docs = near_documents(seed)
        found = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
        assert found == brute(docs)


def test_small_limits_split_and_block(spark, monkeypatch):
    """Buckets above the limit are split to the last level, then compared in blocks; texts in pairs of blocks: the same links."""
    monkeypatch.setattr(jaccard, "LIMIT", 6)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    docs = near_documents(7, 120)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard.buckets, "__defaults__", (jaccard.DEPTH, 6))
    found = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.classes(frame).collect()}
    assert found == brute(docs)


def test_large_groups_that_differ_in_one_word(spark):
    """More than LIMIT different texts with one core: their buckets have the same members in all runs, and every run must go on."""
    docs = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(60)]
        for i in range(jaccard.LIMIT + 76):
            words[30] = f"id{i}"
            docs.append((len(docs), " ".join(words)))
    each = jaccard.LIMIT + 76
    found = jaccard.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(found) == len(docs)
    assert all(x.class_id == x.doc_id // each * each and x.n_links == each - 1 for x in found)


def test_one_of_each_class_stays(spark):
    docs = near_documents(3)
    frame = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string")
    kept = sorted(x.doc_id for x in jaccard.one_of_each(frame).collect())
    want = brute(docs)
    assert len(kept) == len(set(kept)) == len({c for c, _ in want.values()})
    assert {want[i][0] for i in kept} == {c for c, _ in want.values()}


def test_texts_with_equal_first_hashes_are_told_apart(spark, monkeypatch):
    """A first hash of five values: nearly all texts share it with others, and the links are the same."""
    whole = jaccard.text_hash
    monkeypatch.setattr(jaccard, "text_hash", lambda text, seed: F.pmod(whole(text, seed), F.lit(5)) if seed == 1 else whole(text, seed))
    docs = near_documents(9, 80)
    found = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found == brute(docs)


@pytest.mark.parametrize("bits", (1 << 16, 1 << 24))
def test_a_sieve_lets_every_wanted_row_through(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    rows, wanted = spark.range(20_000).selectExpr("xxhash64(id) AS k", "id"), spark.range(0, 20_000, 50).selectExpr("xxhash64(id) AS w").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS w"))
    found = {r.id: r["__maybe"] for r in common.sieve(rows, F.col("k"), wanted, "w").collect()}
    assert len(found) == 20_000 and all(found[i] for i in range(0, 20_000, 50))
    assert sum(found.values()) - 400 < (300 if bits < 1 << 20 else 5)
    assert not any(r["__maybe"] for r in common.sieve(rows, F.col("k"), wanted.where("false"), "w").collect())


def test_runs_reach_the_recall():
    q = 1.0
    for _ in range(jaccard.DEPTH):
        q = 1 - np.exp(-q)
    assert 1 - (1 - q) ** jaccard.runs_for(jaccard.RECALL, jaccard.DEPTH) >= jaccard.RECALL


def test_neighbours_recall_with_many_cells(spark, monkeypatch):
    """With far more cells than probes the links found are real, symmetric in their counts, and nearly all there are."""
    monkeypatch.setattr(neighbours.centroids, "__defaults__", (20_000, 64))
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    r = np.random.default_rng(4)
    centre = r.normal(size=(60, 16))
    x = np.float32(centre[r.integers(0, 60, 1200)] + r.normal(size=(1200, 16)) * 0.25)
    x[5] = x[6]
    label = r.integers(0, 2, 1200)
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(1200)]
    found = {y.vec_id: y for y in neighbours.near_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(1200, dtype=bool)
    counts = np.array([found[i].n_links for i in range(1200)])
    assert (counts <= near.sum(1)).all()
    assert counts.sum() >= 0.97 * near.sum()
    assert all(found[i].kept == (found[i].component_id == i) for i in range(1200))


@pytest.mark.parametrize("whole", (0.7, 1.0))
def test_neighbours_of_one_large_near_group(spark, monkeypatch, whole):
    """A third of a label is one group of near copies that many cells share: every link is found, in cells and with the label as one cell."""
    monkeypatch.setattr(neighbours.centroids, "__defaults__", (20_000, 64))
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "WHOLE", whole, raising=False)
    r = np.random.default_rng(5)
    x = r.normal(size=(1800, 32))
    near = x[0] / np.linalg.norm(x[0])
    away = r.normal(size=(600, 32))
    away -= (away @ near)[:, None] * near
    x[:600] = 0.975 * near + np.sqrt(1 - 0.975**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    x = np.float32(x[r.permutation(1800)])
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(1800)]
    found = {y.vec_id: y.n_links for y in neighbours.near_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert [found[i] for i in range(1800)] == ((u @ u.T >= 0.93).sum(1) - 1).tolist()


def test_cells_left_out_hold_no_partner():
    """Tight groups reach few cells, and no linked vector is at home in one that is left out."""
    r = np.random.default_rng(6)
    x = neighbours.matrix(r.normal(size=(40, 16))[r.integers(0, 40, 2000)] + r.normal(size=(2000, 16)) * 0.2)
    home, cells = neighbours.reached(x, neighbours.spherical_means(x, 30), 0.93)
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert cells[a, home[b]].all() and cells.mean() < 0.7


def test_tiny_and_huge_vectors_link_as_others_do(spark):
    rows = [(0, [1e-170, 2e-170], 1), (1, [1e170, 2.01e170], 1), (2, [1.0, 2.02], 1), (3, [-1e-300, 1.0], 1), (4, [0.0, 1e200], 1), (5, [0.0, 0.0], 1), (6, [None, 1.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 2.0], None), (9, None, 1)]
    found = {y.vec_id: (y.n_links, y.component_id, y.kept) for y in neighbours.near_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert [found[i] for i in range(5)] == [(2, 0, True), (2, 0, False), (2, 0, False), (1, 3, True), (1, 3, False)]
    assert all(found[i] == (0, i, True) for i in range(5, 10))


def test_links_equal_the_sql_where_there_are_links(spark, tmp_path):
    """The registered query and its SQL on a table that holds links: exact copies, near ones, chains and another label."""
    import duckdb

    r = np.random.default_rng(15)
    x = r.normal(size=(400, 24))
    x[100:200] = x[:100] + r.normal(size=(100, 24)) * 0.25
    x[200:260] = x[:60]
    rows = [(i, [float(v) for v in np.float32(x[i])], int(i % 100 % 3) if i < 390 else None) for i in range(400)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted((y.vec_id, y.n_links, y.component_id, y.kept) for y in neighbours.op7_neighbours(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({neighbours.ORACLE})").fetchall())
    assert found == want and sum(n for _, n, _, _ in found) > 20
