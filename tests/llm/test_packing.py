"""Packing: exact optima on small cases, gapless sequences, ids of the tokenizer itself."""

import itertools
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing


def optimum(lengths, size):
    """Least bins by trying all ways."""
    best = len(lengths)
    order = sorted(lengths, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(order):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + order[i] <= size:
                bins[k] += order[i]
                go(i + 1, bins)
                bins[k] -= order[i]
        bins.append(order[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_packings_are_optimal(lengths):
    found = packing.pack(lengths, 20)
    assert sorted(itertools.chain(*found)) == sorted(lengths)
    assert max(map(sum, found)) <= 20
    assert len(found) == optimum(lengths, 20) >= packing.least_bins(lengths, 20)


def test_bin_completion_beats_best_fit():
    """Best fit decreasing opens a bin too many here; there is none of three."""
    lengths = [44, 36, 36, 30, 24, 20, 10] * 2
    assert len(packing.pack(lengths, 100)) == packing.least_bins(lengths, 100) == 4
    assert packing.complete(lengths, 100, 3, 10_000) is None
    lengths = [6, 6, 5, 5, 4, 4, 3, 3, 2, 2] * 6  # triples and pairs that best fit takes apart
    found = packing.complete(lengths, 10, 24, 10_000)
    assert len(found) == 24 and sorted(itertools.chain(*found)) == sorted(lengths)


def subsets(lengths, room):
    """Every multiset of the lengths that fits."""
    out = {()}
    for x in sorted(lengths, reverse=True):
        out |= {tuple(sorted((*f, x), reverse=True)) for f in out if sum(f) + x <= room}
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8), st.integers(0, 12), st.integers(0, 12), st.booleans())
def test_fillings_are_undominated_and_miss_none(lengths, room, waste, even):
    found = list(packing.fillings(packing.Lengths(lengths, 12), room, waste, even))
    assert len(found) == len(set(found)) and [room - sum(f) for f in found] == sorted(room - sum(f) for f in found)
    every = subsets(lengths, room)
    found = {tuple(sorted(f, reverse=True)) for f in found}
    assert found <= {f for f in every if room - sum(f) <= waste}

    def covers(better, f):
        """f's pieces can be dealt into places of better's pieces, or of the room beside them."""
        places = [*better, room - sum(better)]

        def deal(rest, left):
            return not rest or any(left[i] >= rest[0] and deal(rest[1:], (*left[:i], left[i] - rest[0], *left[i + 1 :])) for i in range(len(left)))

        return deal(f, tuple(places))

    assert all(any(covers(g, f) for g in found) for f in every if room - sum(f) <= waste)


def test_many_equal_pieces_need_no_depth():
    assert len(packing.complete([1] * 3072, 1024, 3, 100)) == 3
    assert packing.complete([1] * 3073, 1024, 3, 100) is None
    assert len(packing.pack([1] * 3000 + [2] * 3000 + [700])) == -(-9700 // 1024)


def test_large_packings_come_near_the_bound():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 1025, 5000)
    found = packing.pack(lengths)
    assert sorted(itertools.chain(*found)) == sorted(lengths) and max(map(sum, found)) <= 1024
    assert len(found) <= packing.least_bins(lengths, 1024) * 1.002 + 1
    assert len(found) < len(packing.best_fit(lengths, 1024))
    assert packing.pack(lengths) == found


def test_equal_lengths_and_ties():
    assert sorted(map(len, packing.pack([512] * 7))) == [1, 2, 2, 2]
    assert len(packing.pack([1024] * 5 + [1])) == 6 and packing.pack([]) == []


ODD = ["<|endoftext|>", "a<|endoftext|> b", "'s's 'll I'm", "\n\n  \n x\t\ty ", "\x00\x1c\x85\xa0", "e\u0301 \u0661\u0662 \u2167 \u3000\u200b", "\U0001f469\u200d\U0001f4bb", "ﬁ ß İ", "\ufeffx", "\u1c89\U00016d40 \U0001e5d0"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["the", " ", "'", "'s", "1", "\n", "\t", "é", "字", "!", "\u00a0", "\U0001f600"]), max_size=30).map("".join))
def test_ids_of_any_text_are_the_tokenizers(text):
    assert encoder()(text) == plain_ids(text)


def encoder(found=[]):  # noqa: B006
    if not found:
        found.append(packing.Encoder(packing.vocabulary_path("byte_bpe_50k.json")))
    return found[0]


def plain_ids(text):
    return np.array(encoder().tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_odd_and_of_all_settled_characters_are_the_tokenizers(spark):
    import re

    import regex

    assert all(encoder()(t) == plain_ids(t) for t in ODD)
    letter, number, blank = (regex.compile(x).match for x in (r"\p{L}", r"\p{N}", r"\s"))
    settled = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and re.fullmatch(packing.SETTLED, chr(i))]
    assert all((bool(letter(x)), bool(number(x)), bool(blank(x))) == (bool(re.match(r"[^\W\d_]", x)), bool(re.match(r"\d", x)), bool(re.match(r"\s", x))) for x in settled)
    probes = [f"a{x}b {x}{x} {x}'s1{x}  {x}\n{x}" for x in settled]
    found = encoder().tokenizer.encode_batch(probes, add_special_tokens=False)
    assert all(encoder()(p) == np.array(f.ids, "<u4").tobytes() for p, f in zip(probes, found))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert all(encoder()(t) == plain_ids(t) for t in texts)


def test_pieces_are_the_tokenizers_and_sequences_gapless(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    texts = ["", None, "short", "<|endoftext|> inside", "ü中\U0001f600 x"] + [" ".join(r.choice(("the", "quick", "\nBrown", "f0x", "!!")) for _ in range(r.randint(1, 6000))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = packing.pack_documents(docs).collect()
    plain = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((x.piece, x.start, x.length, x.ids_crc32) for x in found if x.doc_id == i)
        assert [p for p, *_ in mine] == list(range(len(mine)))
        assert sum(n for _, _, n, _ in mine) == len(ids)
        assert all(n == 1024 for _, _, n, _ in mine[1:])
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine)
    by = {}
    for x in found:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
