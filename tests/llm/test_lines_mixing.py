"""Line dedup and mixing against plain Python."""

import random
from fractions import Fraction

import pytest

from tidemark.llm import lines, mixing

DOCUMENTS = "doc_id bigint, text string, source string"


def repeated(docs, least):
    """Every line of a run of at least `least` words that stands earlier, by trying all runs."""
    seen, where = {}, []
    gone = {d: set() for d, _ in docs}
    for d, text in sorted(docs):
        kept = [(i, x) for i, x in enumerate(text.split("\n")) if x.split()]
        for a in range(len(kept)):
            words = 0
            for b in range(a, len(kept)):
                words += len(kept[b][1].split())
                if words >= least:
                    run = tuple(x for _, x in kept[a : b + 1])
                    where.append((run, d, kept[a][0], kept[b][0]))
    for run, d, s, _ in where:
        seen[run] = min(seen.get(run, (d, s)), (d, s))
    for run, d, s, e in where:
        if seen[run] != (d, s):
            gone[d].update(range(s, e + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_is_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(7)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for i in range(25)]
    found = lines.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), 8).collect()
    assert {x.doc_id: x.text for x in found} == repeated(docs, 8)


def test_a_long_passage_goes_from_all_but_the_first(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = [(i, f"own line {i}\n{passage}\nlast {i}") for i in range(5)]
    found = {x.doc_id: x.text for x in lines.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found[0] == docs[0][1]
    assert all(found[i] == f"own line {i}\nlast {i}" for i in range(1, 5))


def test_sainte_lague_is_highest_quotients(spark):
    r = random.Random(3)
    for seats in (0, 1, 7, 50, 333):
        votes = {i: r.choice((0, 1, 5, 17, 400, 1000, 1000)) for i in range(9)}
        parts = spark.createDataFrame([(i, v, seats) for i, v in votes.items()], "part bigint, votes bigint, seats bigint")
        found = {x.part: x.quota for x in mixing.apportion(parts, [], ["part"], "votes", "seats").collect()}
        order = sorted(((-Fraction(v, 2 * k - 1), i) for i, v in votes.items() if v for k in range(1, seats + 1)))[:seats]
        assert found == {i: sum(p == i for _, p in order) for i in votes}


def test_targets_stop_at_twice_and_reshare(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1000), (None, 500)]
    found = {x.source: x.target for x in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    total = 1.5 * 2510
    want, left, rest = {}, dict(zip(["a", "b", "c", None], (5, 2, 1, 5))), total
    caps = {s: 2 * n for s, n in sizes}
    while True:
        full = [s for s in left if rest * left[s] / sum(left.values()) > caps[s]]
        if not full:
            break
        for s in full:
            want[s] = caps[s]
        rest = total - sum(want.values())
        left = {s: w for s, w in left.items() if s not in want}
    want |= {s: rest * w / sum(left.values()) for s, w in left.items()}
    assert {k: round(v, 6) for k, v in found.items()} == {k: round(v, 6) for k, v in want.items()}


def test_mix_meets_targets_and_caps_and_repeats_itself(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join("w" * r.randint(1, 400)), f"s{r.randint(0, 4)}") for i in range(300)], DOCUMENTS)
    one, two = (sorted(map(tuple, mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect())) for _ in range(2))
    assert one == two
    assert all(0 <= taken <= 2 * size for _, _, size, _, _, taken in one)
    by = {}
    for _, s, _, _, target, taken in one:
        by.setdefault(s, [target, 0])[1] += taken
    assert all(abs(target - taken) <= mixing.BLOCK for target, taken in by.values())
    texts = mixing.mixed_documents(docs).collect()
    assert sum(len(t.text.split()) for t in texts) == sum(x[-1] for x in one)


@pytest.mark.parametrize("group", (2, 4096))
def test_quotas_by_groups_of_shards_meet_the_target(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "SHARD", 400)
    monkeypatch.setattr(mixing, "GROUP", group)
    r = random.Random(8)
    docs = spark.createDataFrame([(None if i % 3 else i, " ".join(f"w{i}x{j}" for j in range(r.randint(1, 60))), "s") for i in range(300)], DOCUMENTS)
    found = mixing.mix_sources(docs).collect()
    size = sum(x.size for x in found)
    assert abs(sum(x.taken for x in found) - 1.5 * size) <= mixing.BLOCK and all(x.taken <= 2 * x.size for x in found)


def test_rows_without_ids_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "s") for i in range(100)], DOCUMENTS)
    drawn = {x[0] for x in docs.select(mixing.draw(docs.doc_id, docs.text)).collect()}
    assert len(drawn) == 100
