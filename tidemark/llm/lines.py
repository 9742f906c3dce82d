"""Line dedup: winnowing over line hashes; later repeats of runs of lines go.

DataFrame functions only. What it computes: a run of consecutive lines with words (blank lines do not count) that has at
least MIN_WORDS words is repeated if the same lines, in the same order, stand earlier, in the order of (doc_id, text hash,
line). Every line of a repeated run is deleted; the first occurrence stays.

How: a window starts at each line and ends where it first has MIN_WORDS words (and mirrored, ends at each line). Each window selects its least line hash
(the last of equal ones) as its fingerprint; neighbouring windows mostly select the same line, so what is kept is a row for each selected position, far fewer
than lines. Windows with equal lines select the same line of them, so a repeated run shares a fingerprint with its first occurrence for certain.
Positions whose fingerprint stands at another position as well are joined, and only they are extended: to both sides, to the windows they were selected
for, which are compared by the hashes of all their lines. Each meets the first of its kind only, no pairs of positions are made. Every
line of a repeated run lies in a window of one of both kinds inside the run, so the windows that stand earlier make up exactly the runs defined.

Equal texts are one text throughout: its least doc_id keeps what is not repeated elsewhere, the others lose every line that lies in a window. Texts and lines are
told apart by two independent 64-bit hashes.

Cases: a null or empty text stays as it is; rows with equal doc_id and text are one document and get equal results; rows that
share a doc_id (or have none) but differ in text are different documents; other columns are carried along by line_dedup
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import sieve, table, words_in
from tidemark.session import materialize

#: Words a run needs.
MIN_WORDS = 50
BREAK = "\n"


def _keys(text: Column) -> dict[str, Column]:
    """Two hashes of a text, of different seeds."""
    whole = F.coalesce(text, F.lit(""))
    return {"k1": F.xxhash64(F.lit(1), whole), "k2": F.xxhash64(F.lit(2), whole)}


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def texts(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc, several, lines): each different text with its least document, whether it has others, and its lines with words (at, a, b, n)."""
    lines = F.filter(
        F.transform(_split(F.col("text")), lambda x, i: F.struct(i.alias("at"), F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"), words_in(x).cast("int").alias("n"))),
        lambda x: x["n"] > 0,
    )
    each = docs.select(F.struct(F.col("doc_id").alias("id")).alias("doc"), *[c.alias(k) for k, c in _keys(F.col("text")).items()], lines.alias("lines"))
    least, most = F.min("doc").alias("doc"), F.max("doc").alias("__most")
    return each.groupBy("k1", "k2").agg(least, most, F.first("lines").alias("lines")).select("k1", "k2", "doc", (~F.col("doc").eqNullSafe(F.col("__most"))).alias("several"), "lines")


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """(fp, k1, k2, p, windows): a row for each selected position p of a text, with the windows (start, end) that selected it; places count lines with words."""
    each = lines.select("k1", "k2", F.posexplode(F.transform("lines", lambda x: F.struct(x["a"].alias("a"), x["n"].alias("n")))).alias("i", "x")).select("k1", "k2", "i", "x.a", "x.n")
    own = W.partitionBy("k1", "k2")
    each = each.withColumn("e", F.sum("n").over(own.orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    each = each.withColumn("c", F.col("e") - F.col("n")).withColumn("total", F.sum("n").over(own.orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    ahead = own.orderBy("c").rangeBetween(0, min_words - 1)
    back = own.orderBy("e").rangeBetween(1 - min_words, 0)

    def side(w, fits: Column) -> Column:
        seen = F.struct(F.min(F.struct(F.col("a"), (-F.col("i")).alias("p"))).over(w).alias("least"), F.min("i").over(w).alias("start"), F.max("i").over(w).alias("end"))
        return F.when(fits, seen)

    each = each.select("k1", "k2", side(ahead, F.col("total") - F.col("c") >= min_words).alias("f"), side(back, F.col("e") >= min_words).alias("g"))
    kinds = F.array(F.col("f"), F.when(F.col("g.start") < F.col("g.end"), F.col("g")))  # a line of min_words words is one window, not two
    found = each.select("k1", "k2", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("w"))
    # the windows are dealt out by text, so this needs no further exchange
    return found.groupBy("k1", "k2", (-F.col("w.least.p")).alias("p")).agg(F.first("w.least.a").alias("fp"), F.collect_set(F.struct("w.start", "w.end")).alias("windows"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, doc, gone, copies): the positions of the lines that a text's least document loses, and those that its other documents lose."""
    lines = materialize(texts(docs), "lines")
    found = materialize(fingerprints(lines, min_words), "fingerprints")
    place = F.struct("k1", "k2", "p")
    shared = found.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fp")
    shared = materialize(shared, "shared")  # as a table it can meet a very frequent fingerprint in parts
    joined = found.join(shared, "fp", "left_semi").groupBy("k1", "k2").agg(F.flatten(F.collect_list("windows")).alias("windows"))
    # to both sides: from the selected line to each window's ends
    extended = joined.join(lines, ["k1", "k2"]).select("k1", "k2", "doc", "lines", F.inline("windows"))
    part = F.slice("lines", F.col("start") + 1, F.col("end") - F.col("start") + 1)
    extended = extended.select(
        "k1", "k2", "doc", F.get("lines", "start").getField("at").alias("start"), F.get("lines", "end").getField("at").alias("end"),
        F.xxhash64(F.transform(part, lambda x: x["a"])).alias("run_a"), F.xxhash64(F.transform(part, lambda x: x["b"])).alias("run_b"),
    )
    extended = materialize(extended, "extended")
    place = F.struct("doc", "k1", "k2", "start", "end")
    first = materialize(extended.groupBy("run_a", "run_b").agg(F.min(place).alias("first")), "first")
    later = extended.join(first, ["run_a", "run_b"]).where(place != F.col("first"))
    gone = later.select("k1", "k2", "doc", F.explode(F.sequence("start", "end")).alias("at")).groupBy("k1", "k2", "doc").agg(F.collect_set("at").alias("gone"))
    copies = lines.where("several").select("k1", "k2", F.col("doc").alias("__doc"), covered(F.col("lines"), min_words).alias("copies")).where("size(copies) > 0")
    return gone.join(copies, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("doc", "__doc").alias("doc"), "gone", "copies")


def covered(lines: Column, min_words: int) -> Column:
    """The positions that lie in any window of a text: its lines with words, and the blank ones between two of which not both are windows by themselves."""
    words = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def upto_next(x: Column, i: Column) -> Column:
        after = F.get(lines, i + 1)
        return F.when(after.isNotNull() & ((x["n"] < min_words) | (after["n"] < min_words)), F.sequence(x["at"], after["at"] - 1)).otherwise(F.array(x["at"]))

    return F.when(words >= min_words, F.flatten(F.transform(lines, upto_next)))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text deduplicated, all columns kept, plus __lines and __gone: the lines it had and lost."""
    gone = repeated_lines(docs.select("doc_id", "text"), min_words).select(F.col("k1").alias("__h1"), F.col("k2").alias("__h2"), F.col("doc").alias("__doc"), F.col("gone").alias("__own"), F.col("copies").alias("__copies"))
    gone = materialize(gone, "gone")
    rows = sieve(docs.withColumns({f"__{k}": c for k, c in _keys(F.col("text")).items()}), F.col("__k1"), gone, "__h1")
    # texts that lose nothing are not dealt out to meet the others
    whole = rows.where("NOT __maybe").select(*docs.columns, F.lit(None).cast("array<int>").alias("__at"))
    rows = rows.where("__maybe").join(gone, (F.col("__k1") == F.col("__h1")) & (F.col("__k2") == F.col("__h2")), "left")
    at = F.when(F.col("__doc.id").eqNullSafe(F.col("doc_id")), F.col("__own")).otherwise(F.col("__copies"))
    rows = whole.unionByName(rows.select(*docs.columns, at.alias("__at")))
    lines = _split(F.col("text"))
    last = F.size(lines) - 1
    stay = F.array_except(F.sequence(F.lit(0), last), F.col("__at"))
    cleaned = F.when(F.col("__at").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), BREAK))
    # blank lines inside a deleted run stay out with it: sequence(start, end) names them too
    rows = rows.withColumns({"text": cleaned, "__lines": F.size(lines).cast("long"), "__gone": F.greatest(F.coalesce(F.size("__at"), F.lit(0)), F.lit(0)).cast("long")})
    return rows.drop("__at")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"))


ORACLE = f"""
WITH doc AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
line AS (
  SELECT doc_id, text AS t, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM doc
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM line
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id, t ORDER BY pos ROWS UNBOUNDED PRECEDING) - n AS c,
         sum(n) OVER (PARTITION BY doc_id, t) AS total FROM counted WHERE n > 0
), win AS (
  SELECT doc_id, t, total - c >= {MIN_WORDS} AS fits, min(pos) OVER f AS s, max(pos) OVER f AS e, string_agg(line, chr(10)) OVER f AS run
  FROM placed WINDOW f AS (PARTITION BY doc_id, t ORDER BY c RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, t, c + n >= {MIN_WORDS}, min(pos) OVER b, max(pos) OVER b, string_agg(line, chr(10)) OVER b
  FROM placed WINDOW b AS (PARTITION BY doc_id, t ORDER BY c + n RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)
), runs AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s, e) AS r,
         first_value(doc_id) OVER (PARTITION BY run ORDER BY doc_id, s, e) AS d0, first_value(s) OVER (PARTITION BY run ORDER BY doc_id, s, e) AS s0
  FROM win WHERE fits
), gone AS (
  SELECT DISTINCT doc_id, t, unnest(range(s, e + 1)) AS pos FROM runs WHERE doc_id <> d0 OR s <> s0
), cleaned AS (
  SELECT l.doc_id, l.t, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS kept, count(g.pos) AS n_removed, count(*) AS n_lines
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.t = g.t AND l.pos = g.pos GROUP BY l.doc_id, l.t
)
SELECT d.doc_id, CASE WHEN c.n_removed = 0 THEN d.text ELSE coalesce(c.kept, '') END AS text, c.n_lines::BIGINT AS n_lines, c.n_removed::BIGINT AS n_removed
FROM documents d JOIN cleaned c ON d.doc_id = c.doc_id AND coalesce(d.text, '') = c.t
"""
