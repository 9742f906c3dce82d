"""Best-fit packing: token pieces into as few sequences as can be, by bin completion with branch and bound.

Documents become ids of a public byte-level BPE, then END. Longer ones are cut into SEQUENCE-token pieces, the first of which
may be shorter. Pieces are dealt out evenly into shards; each is packed in one task:

* best-fit decreasing gives the incumbent, the lower bound is the greater of the total and of what large pieces need;
* bin completion looks for a packing with a sequence less, depth first: it takes the largest piece left and enumerates the undominated fillings around it,
  least waste first; a branch ends when its waste exceeds what one sequence less leaves to waste. It runs over the whole shard, then, as long as the
  incumbent is above the bound, over its most wasteful sequences together with some full ones;
* what it finds is the next incumbent. It ends at the bound, or after MISSES searches in vain, each of which goes back BACK times at most: bounds on work, no piece is ever left out.

Cases: null and empty texts are the id END alone; repeated rows are packed each; ids that are null or repeat are allowed (a
document is a row); an empty table gives an empty result; other columns are ignored, whatever their names. A text holding a special token's
string is given to the tokenizer itself, as its file defines it.
"""

from __future__ import annotations

import random
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import small_batches, strings, table
from tidemark.session import materialize

SEQUENCE = 1024
END = 2
#: Pieces that one task packs.
SHARD_PIECES = 40_000
#: Nodes that a search may visit beyond one for each sequence, and lengths that one enumeration of fillings may try for sums of three and more.
BACK, STEPS = 30, 300
#: Full sequences searched together with the wasteful ones (a multiple of these, at least BESIDE), and searches in vain after which it ends.
BESIDE_X, BESIDE, MISSES, SEED = 20, 800, 60, 3


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The words that the tokenizer's pattern gives, for texts of the characters below: there, letters are what \\w has beside digits and _.
WORDS = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters whose class every Unicode version agrees on. A text with any other goes to the tokenizer whole.
SETTLED = r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-\xB1\xB4-\xB8\xBA\xBB\xBF-\u0233\u0386-\u03CE\u0400-\u045F\u0531-\u0556\u0561-\u0586\u05D0-\u05EA\u0621-\u063A\u0641-\u064A\u0905-\u0939\u0E01-\u0E30\u2010-\u2027\u2030-\u205E\u20AC\u2190-\u21FF\u2500-\u257F\u3001-\u3003\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3\uFF01-\uFF5E\U0001F600-\U0001F64F]"
#: Words remembered with their ids; forgotten when full.
REMEMBER = 300_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words(dict):
    """Words to their ids as bytes, by the tokenizer's own model; each different word is merged once."""

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBER:
            self.clear()
        found = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        self[word] = raw = b"".join([t.id.to_bytes(4, "little") for t in found])
        return raw


class Encoder:
    """Texts to their ids as little-endian bytes, by the tokenizer of a JSON file.

    The tokenizer merges within the words that its pattern gives, so a text's ids are its words' ids in a row, and each different word goes through the
    tokenizer's model once. Texts with a special token's string, or with a character outside SETTLED, go through the whole tokenizer.
    """

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        self.split = re.compile(WORDS).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.settled = re.compile(f"{SETTLED}*+").fullmatch
        self.words = Words(self.tokenizer.model)

    def __call__(self, text: str) -> bytes:
        if self.settled(text) and not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(json_path: str) -> Encoder:
    """The worker process's encoder: kept from task to task, as the code of a task is not."""
    kept = sys.modules.setdefault("__packing_encoders__", types.ModuleType("__packing_encoders__")).__dict__
    if json_path not in kept:
        kept[json_path] = Encoder(json_path)
    return kept[json_path]


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, size: int = SEQUENCE, json_path: str | None = None) -> DataFrame:
    json_path = json_path or vocabulary_path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text")):
                raw = encode(text) + end
                out += [(doc, i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cuts(len(raw) // 4, size))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PIECES.types)], schema=PIECES)

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Lengths:
    """Counts of pieces by length, with bit sets of the lengths there are: bit l, and mirrored bit size - l."""

    def __init__(self, lengths, size: int):
        self.size, self.n = size, [0] * (size + 1)
        self.up = self.down = self.total = 0
        for length in lengths:
            self.add(int(length))

    def add(self, length: int) -> None:
        self.n[length] += 1
        self.total += length
        if self.n[length] == 1:
            self.up |= 1 << length
            self.down |= 1 << (self.size - length)

    def take(self, length: int) -> None:
        self.n[length] -= 1
        self.total -= length
        if not self.n[length]:
            self.up ^= 1 << length
            self.down ^= 1 << (self.size - length)

    def largest(self, most: int) -> int:
        """The largest length that is there, up to most; 0 if none."""
        return max((self.up & ((1 << (most + 1)) - 1)).bit_length() - 1, 0) if most > 0 else 0

    def least(self) -> int:
        return (self.up & -self.up).bit_length() - 1 if self.up else 0

    def pairs(self, total: int, even: bool) -> Iterator[tuple[int, ...]]:
        """Two lengths that sum to total: the larger as large as can be first, or as even as can be first."""
        if total > self.size or total < 2:
            return
        half = (total + 1) // 2
        both = (self.up & (self.down >> (self.size - total))) >> half  # bit i: lengths half + i and total - half - i
        while both:
            i = ((both & -both) if even else both).bit_length() - 1
            both ^= 1 << i
            a = half + i
            if a < total and (2 * a > total or self.n[a] > 1):
                yield a, total - a

    def sums(self, total: int, k: int, top: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
        """k pieces of at most top that sum to total, the larger first. A length is taken as often as needed at once: depth grows with different lengths only."""
        a = self.largest(min(top, total - (k - 1) * self.least()))
        while a and a * k >= total:
            budget[0] -= 1
            if budget[0] < 0:
                return
            for m in range(min(self.n[a], k, total // a), 0, -1):
                rest, others = total - m * a, k - m
                if not rest and not others:
                    yield (a,) * m
                elif rest and others == 1:
                    if rest < a and self.n[rest]:
                        yield (*(a,) * m, rest)
                elif rest and others:
                    for more in self.sums(rest, others, a - 1, budget):
                        yield (*(a,) * m, *more)
            a = self.largest(a - 1)


def fillings(left: Lengths, room: int, waste: int, even: bool) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of room that leave at most waste, by waste, then by fewest pieces.

    A piece of just the room dominates all others. A filling is dominated if a piece that is left fits beside it, or in the place of a smaller one of its own.
    After STEPS lengths tried for sums of three and more, the filling of the largest pieces that fit is the last.
    """
    budget = [STEPS]
    if left.total <= room:
        if room - left.total <= waste:
            yield tuple(x for x in range(room, 0, -1) for _ in range(left.n[x]))
        return
    for total in range(room, max(room - waste, 0) - 1, -1):
        spare = room - total
        if total and left.n[total]:
            if not spare or not dominated(left, (total,), spare):
                yield (total,)
            if not spare:
                return
        if not total:
            if not left.largest(room):
                yield ()
            return
        for k in range(2, total // left.least() + 1):
            for fill in left.pairs(total, even) if k == 2 else left.sums(total, k, total, budget):
                if not spare or not dominated(left, fill, spare):
                    yield fill
            if budget[0] < 0:
                greedy, rest, a = [], room, left.largest(room)
                while a:
                    m = min(left.n[a], rest // a)
                    greedy += [a] * m
                    rest -= m * a
                    a = left.largest(min(a - 1, rest))
                if rest <= waste:
                    yield tuple(greedy)
                return


def dominated(left: Lengths, fill: tuple[int, ...], spare: int) -> bool:
    """Whether a piece that is left fits into the spare room, or a larger one in the place of one of fill."""
    for x in {0, *fill}:
        y = left.largest(x + spare)
        while y > x:
            if left.n[y] > fill.count(y):
                return True
            y = left.largest(y - 1)
    return False


def complete(lengths, size: int, most: int, nodes: int, even: float = 0.0, salt: int = 0) -> list[list[int]] | None:
    """Bin completion: a packing into at most `most` sequences, or None if there is none or the nodes run out.

    Depth first: the largest piece left, with each of its undominated fillings that the waste still allowed permits, the least wasteful first. Of sequences
    with equal first pieces, the later has no earlier filling: they could be swapped. The stack is a list, as deep as there are sequences. even: the share of
    first pieces' lengths (drawn by salt) whose pairs come evenest first; the others' come with the larger piece as large as can be.
    """
    allowed = most * size - int(sum(lengths))
    if allowed < 0:
        return None
    left = Lengths(lengths, size)
    stack: list[tuple] = []  # (first, its fillings to come), and the filling chosen for it
    chosen: list[tuple[int, ...]] = []

    def evenly(first: int) -> bool:
        return (first * 2654435761 + salt * 40503) % 1009 < even * 1009

    def key(fill: tuple[int, ...], first: int) -> tuple:
        return size - first - sum(fill), len(fill), tuple(x if len(fill) == 2 and evenly(first) else -x for x in fill)

    while first := left.largest(size):
        left.take(first)
        stack.append((first, fillings(left, size - first, allowed, evenly(first))))
        while stack:
            first, coming = stack[-1]
            room = size - first
            if len(chosen) == len(stack):
                for x in chosen[-1]:
                    left.add(x)
                allowed += room - sum(chosen.pop())
            nodes -= 1
            fill = next(coming, None) if nodes >= 0 else None
            if fill is None:
                stack.pop()
                left.add(first)
                continue
            if len(stack) > 1 and stack[-2][0] == first and key(fill, first) < key(chosen[-1], first):
                continue
            for x in fill:
                left.take(x)
            chosen.append(fill)
            allowed -= room - sum(fill)
            break
        else:
            return None
    return [[first, *fill] for (first, _), fill in zip(stack, chosen)]


def best_fit(lengths, size: int) -> list[list[int]]:
    """Best-fit decreasing over a bit set of the room that sequences have left."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    bits = 0
    for length in sorted(map(int, lengths), reverse=True):
        fits = bits >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                bits ^= 1 << r
        else:
            r, b = size, len(bins)
            bins.append([])
        bins[b].append(length)
        if r > length:
            room.setdefault(r - length, []).append(b)
            bits |= 1 << (r - length)
    return bins


def least_bins(lengths, size: int) -> int:
    """Lower bound: the total, or for each k the pieces over size - k, and what those over k up to it cannot put into their room."""
    count = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=size + 1)
    total = np.arange(size + 1) * count
    n, t = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])
    best = -(-int(total.sum()) // size)
    half = size // 2
    for k in range(0, half + 1):
        big = int(n[size + 1] - n[size - k + 1])
        mid = int(n[size - k + 1] - n[half + 1])
        room = mid * size - int(t[size - k + 1] - t[half + 1])
        small = int(t[half + 1] - t[k])
        best = max(best, big + mid + max(0, -(-(small - room) // size)))
    return best


def pack(lengths, size: int = SEQUENCE) -> list[list[int]]:
    """Sequences as lists of lengths: best fit is the incumbent, bin completion looks for one sequence less, over all pieces and then over parts of the incumbent."""
    bound, best = least_bins(lengths, size), best_fit(lengths, size)
    for even in (0.0, 1.0):
        if len(best) > bound:
            best = complete(lengths, size, len(best) - 1, len(best) + BACK, even) or best
    rng, missed = random.Random(SEED), 0
    while len(best) > bound and missed < MISSES:
        best.sort(key=sum)
        some, waste = 0, 0  # the most wasteful sequences, until they waste a sequence and a half
        while some < len(best) and waste < 3 * size // 2 and sum(best[some]) < size:
            waste += size - sum(best[some])
            some += 1
        beside = set(rng.sample(range(some, len(best)), min(len(best) - some, max(BESIDE_X * some, BESIDE))))
        part = [b for i, b in enumerate(best) if i < some or i in beside]
        rest = [b for i, b in enumerate(best) if i >= some and i not in beside]
        pieces, even, salt = [x for b in part for x in b], rng.random(), rng.randrange(1009)
        less = complete(pieces, size, len(part) - 1, len(part) + BACK, even, salt)
        missed = 0 if less else missed + 1
        # as many sequences as before, filled anew, gather the waste in fewer of them
        best = (less or complete(pieces, size, len(part), len(part) + BACK, even, salt) or part) + rest
    return best


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, shard: int = SHARD_PIECES) -> DataFrame:
    """pieces with sequence_id and offset."""
    shards = max(1, -(-pieces.count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows.column("length").to_numpy()
        places: dict[int, list[int]] = {}
        for i in np.argsort(lengths, kind="stable").tolist():
            places.setdefault(int(lengths[i]), []).append(i)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        start = TaskContext.get().partitionId() << 32
        for s, bin_ in enumerate(pack(lengths, size)):
            at = 0
            for length in bin_:
                i = places[length].pop()
                sequence[i], offset[i], at = start + s, at, at + length
        out = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=50_000)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return pieces.repartition(shards).mapInArrow(run, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack_pieces(materialize(token_pieces(docs), "pieces"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
