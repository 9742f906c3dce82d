"""Language ID by compression: a raw-content zstandard dictionary a language; the dictionary under which a text is smallest wins.

The dictionaries come from a bounded sample of labelled texts: PER_LANGUAGE different texts of every language, those of least hash, read whole. A
text is cut into passages of PASSAGE characters from its start to its end; of a language's passages that stand in no other language's sample, CANDIDATES
(those of least hash) are weighed. The weight is the compression gain: how many bytes smaller a passage becomes under its own
language's dictionary than under the best other one, where these first dictionaries hold the candidates of the other half (by hash), never the passage itself.
A dictionary holds up to DICTIONARY bytes of the passages of most gain, the most telling last; passages without gain (foreign text under a wrong label,
junk) stay out, unless a language has no others.

Scoring covers whole texts, in lower case and with anything but letters as one space, in pieces of PIECE bytes so that the dictionary bears on every part; the
sizes of all pieces are summed. Where several languages share the least size (texts of a few words), the sizes of the pieces written REPEAT times decide,
as a repetition adds next to nothing but lets the coder show its first copy's gain.

Narrow margins are rejected: where the runner-up is not larger by MARGIN of the smallest size, reliable is false and the score 0; lang_pred names the best
language all the same. Otherwise the score is the winner's share of exp(-size / spread).

Cases: a text that is null or has no letter is `und` with score 0 and not reliable; ties go to the language that sorts first;
with no labelled text at all everything is `und`; labels that are null teach nothing, nor do texts without letters; rows that repeat get equal results and teach
once; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_type, held, small_batches, strings, table
from tidemark.session import materialize

PER_LANGUAGE = 400
PASSAGE, CANDIDATES = 160, 512
DICTIONARY = 24 << 10
PIECE = 512
REPEAT = 8
LEVEL = 12
MARGIN = 0.01
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, everything but letters as one space: case and junk say nothing of a language."""
    return _OTHER.sub(" ", text.lower())


def passages(text: str) -> list[str]:
    """All of a plain text, PASSAGE characters at a time."""
    data = plain(text).strip()
    return [data[i : i + PASSAGE] for i in range(0, len(data), PASSAGE)]


def compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)


def filled(found: list[str], size: int = DICTIONARY) -> bytes:
    """The first passages that fit into size bytes, the first of them last."""
    kept, n = [], 0
    for p in found:
        raw = f"{p} ".encode()
        if n + len(raw) > size:
            break
        kept.append(raw)
        n += len(raw)
    return b"".join(reversed(kept))


def candidates(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, h, passage): CANDIDATES passages of each language, from per_language whole texts each. docs: (text, lang)."""
    small_batches(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("text").alias("t"), "text")
    # narrow rows only: Spark limits each task's rows of a language before it deals them out
    first = W.partitionBy("lang").orderBy("t")
    chosen = known.select("lang", "t").distinct().withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= per_language).drop("__r")
    texts = known.join(materialize(chosen, "language-texts"), ["lang", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: set[tuple[str, int]] = set()
        for batch in batches:
            lang, passage = [], []
            for name, t, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist(), strings(batch, "text")):
                if (name, t) not in before:
                    before.add((name, t))
                    found = passages(text)
                    lang += [name] * len(found)
                    passage += found
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(passage, pa.string())], names=["lang", "passage"])

    cut = texts.mapInArrow(run, "lang string, passage string")
    alone = cut.groupBy("passage").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other")
    least = W.partitionBy("lang").orderBy("h", "passage")
    drawn = alone.select("lang", F.xxhash64("passage").alias("h"), "passage").withColumn("__r", F.row_number().over(least)).where(F.col("__r") <= CANDIDATES)
    return materialize(drawn.drop("__r"), "passages")


def first_dictionaries(drawn: list[tuple[str, int, str]]) -> dict[tuple[str, int], bytes]:
    """Content by language and half, of candidates (lang, h, passage) in the order of h."""
    out: dict[tuple[str, int], list[str]] = {}
    for lang, h, passage in drawn:
        for half in (0, 1):
            out.setdefault((lang, half), [])
        out[lang, h & 1].append(passage)
    return {k: filled(v) for k, v in out.items()}


def gains(names: list[str], first: dict[tuple[str, int], bytes]):
    """A function from (lang, h, passage) to the passage's compression gain."""
    packers = {k: compressor(c) for k, c in first.items()}

    def gain(lang: str, h: int, passage: str) -> int:
        data = passage.encode()
        sizes = {n: len(packers[n, 1 - (h & 1)].compress(data)) for n in names}
        own = sizes.pop(lang)
        return min(sizes.values(), default=len(data) + own) - own

    return gain


def dictionaries(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, bytes]:
    """Dictionary content by language, from labelled rows of docs (text, lang). At most CANDIDATES passages a language come to the driver."""
    drawn = candidates(docs, per_language)
    rows = sorted((r.lang, r.h, r.passage) for r in drawn.collect())
    first = first_dictionaries(rows)
    names = sorted({lang for lang, _ in first})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains(names, first)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "h", "passage")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([gain(*r) for r in zip(*columns)], pa.int64())], names=["lang", "h", "passage", "gain"])

    n = drawn.sparkSession.sparkContext.defaultParallelism
    weighed = drawn.repartition(n, "h").mapInArrow(run, "lang string, h bigint, passage string, gain bigint").collect()
    out = {}
    for name in names:
        mine = sorted(((-r.gain, r.h, r.passage) for r in weighed if r.lang == name))
        out[name] = filled([p for g, _, p in mine if g < 0] or [p for *_, p in mine])
    return out


def classifier(content: dict[str, bytes]):
    """A function from a text to (lang_pred, score, reliable)."""
    names = sorted(content)
    packers = [compressor(content[n]) for n in names]

    def classify(text: str) -> tuple[str, float, bool]:
        if not packers or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        data = plain(text).encode()
        parts = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(p.compress(x)) for x in parts) for p in packers]
        if sizes.count(min(sizes)) > 1:
            least = min(sizes)
            sizes = [sum(len(p.compress(x * REPEAT)) for x in parts) if s == least else math.inf for p, s in zip(packers, sizes)]
        best = min(sizes)
        where = sizes.index(best)
        others = [s for i, s in enumerate(sizes) if i != where]
        if others and min(others) - best <= MARGIN * best:
            return names[where], 0.0, False
        spread = 1 + 0.005 * best
        return names[where], 1 / sum(math.exp((best - s) / spread) for s in sizes), True

    return classify


def identify(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """docs (doc_id, held_out, text) to doc_id, held_out, lang_pred, score, reliable."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", arrow_type(docs, "doc_id")), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("reliable", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(content)
        for batch in batches:
            found = [classify(t) for t in strings(batch, "text")]
            lang, score, sure = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], schema=out)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, reliable boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held(F.col("doc_id"), 4, 2).alias("held_out"))
    return identify(docs, dictionaries(docs.where("NOT held_out")))
