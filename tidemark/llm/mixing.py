"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

DataFrame functions only. Cases: a null text counts zero words; a null source is a source of its own and comes last;
documents without words take 0; an empty table gives an empty result; rows that repeat (same id, text and source) each
count, and which of equal rows takes a cut block does not show; columns besides doc_id, text and source are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import table, words_in
from tidemark.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Words in a block, the unit that is allocated.
BLOCK = 16
#: Words in a shard of a source: what one task orders.
SHARD = 1 << 19
#: Shards whose quotas one task works out; a source's blocks go to such groups first, then to their shards.
GROUP = 4096
SEED = 17


def draw(*parts: Column) -> Column:
    """A seeded number from 0 to 2^32-1, the same in every engine that has md5."""
    text = F.concat_ws("|", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def apportion(parts: DataFrame, group: Sequence[str], key: Sequence[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Lague: seats (a column, equal within a group) go to the parts with the highest quotients votes/(2k-1).

    Rounding each part's exact share gives every part its certain seats; only the seats still open (or given in excess) are
    ranked by quotient, and a part lists no more candidates than it can win, so the work is linear in the number of parts.
    Ties go to the lower key, nulls last. Adds the column quota.
    """
    every = W.partitionBy(*group)
    rated = parts.withColumn("__v", F.sum(votes).over(every).cast("double")).withColumn(
        "__base", F.when(F.col("__v") > 0, F.floor(F.col(votes) * F.col(seats) / F.col("__v") + 0.5)).otherwise(0).cast("long")
    )
    rated = rated.withColumn("__open", F.col(seats) - F.sum("__base").over(every)).withColumn("__n", F.count(F.lit(1)).over(every))
    most = F.ceil(F.try_divide((F.abs("__open") + F.col("__n")) * F.col(votes), F.col("__v"))).cast("long") + 1
    k = F.when(F.col("__open") > 0, F.col("__base") + F.col("__j")).otherwise(F.col("__base") - F.col("__j") + 1)
    tie_up = [F.col(c).asc_nulls_last() for c in key]
    tie_down = [F.col(c).desc_nulls_first() for c in key]
    near = (
        rated.where((F.col("__open") != 0) & (F.col(votes) > 0) & (F.col("__v") > 0))
        .withColumn("__j", F.explode(F.sequence(F.lit(1).cast("long"), most)))
        .withColumn("__k", k)
        .where("__k >= 1")
        .withColumn("__q", F.col(votes) / (2 * F.col("__k") - 1))
    )
    won = near.where("__open > 0").withColumn("__r", F.row_number().over(every.orderBy(F.desc("__q"), *tie_up, "__k"))).where("__r <= __open").withColumn("__d", F.lit(1))
    lost = near.where("__open < 0").withColumn("__r", F.row_number().over(every.orderBy(F.asc("__q"), *tie_down, F.desc("__k")))).where("__r <= -__open").withColumn("__d", F.lit(-1))
    names = [*group, *key]
    change = won.unionByName(lost).groupBy(*names).agg(F.sum("__d").alias("__d"))
    for c in names:
        change = change.withColumnRenamed(c, f"__k_{c}")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return rated.join(change, same, "left").withColumn("quota", F.col("__base") + F.coalesce("__d", F.lit(0))).select(*parts.columns, "quota")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, source_size). Adds target: shares of SHARE of all words by weight, none above CAP of its source.

    Sources fill up in the order of cap over weight; whoever cannot take its part of what is left stops at its cap, and the
    others share the rest by weight: the fixed point of stopping and resharing.
    """
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("__w", weight).withColumn("__cap", (F.col("source_size") * CAP).cast("double"))
    fill = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(onward)
    filled = ranked.withColumn("__level", level).withColumn("__full", F.col("__level") * F.col("__w") > F.col("__cap"))
    water = F.min(F.when(~F.col("__full"), F.struct((F.col("__cap") / F.col("__w")).alias("fill"), F.col("__level").alias("level")))).over(everything)
    return filled.withColumn("__water", water.getField("level")).select(
        "source", "source_size", F.when(F.col("__full") | F.col("__water").isNull(), F.col("__cap")).otherwise(F.col("__water") * F.col("__w")).alias("target")
    )


def mix_sources(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Rows of docs with size, source_size, target, passes (whole copies) and the word ranges tail and head of a further, cut copy.

    Result columns: doc_id, source, size, source_size, target, taken, passes, tail_from, tail_to, head_to, and the columns
    named in carry. A source's shards each get an integer quota of blocks (by groups of GROUP shards); in a shard, documents stand in seeded order on a
    ring of blocks, and the quota is read off the ring from a seeded block on.
    """
    # by text too: rows without an id, or with one and the same, are dealt out as others are
    salt = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    given = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), salt.alias("__h"), *[F.col(c).alias(f"__c_{c}") for c in carry])
    if not carry:
        given = materialize(given, "sizes")
    sizes = given.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes).withColumn("__blocks", F.floor(F.sum("target").over(W.partitionBy()) / BLOCK + 0.5).cast("long"))
    plan = apportion(plan, [], ["source"], "target", "__blocks").withColumnRenamed("quota", "__seats").drop("__blocks")
    # a number for each source: null sources then join and order by the same keys as others, in one shuffle
    plan = plan.withColumn("__shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / SHARD).cast("long")).withColumn("__sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    plan = materialize(plan, "sources")
    named = plan.withColumnRenamed("source", "__s")
    rows = given.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("__o", draw(F.col("doc_id"), F.col("__h"))).withColumn("__shard", F.col("__o") % F.col("__shards"))
    shards = rows.groupBy("__sid", "__shard", "__seats").agg(F.sum("size").alias("__words"))
    shards = shards.withColumn("__group", F.floor(F.col("__shard") / GROUP))
    groups = apportion(shards.groupBy("__sid", "__group", "__seats").agg(F.sum("__words").alias("__words")), ["__sid"], ["__group"], "__words", "__seats")
    groups = materialize(groups.select("__sid", "__group", F.col("quota").alias("__part")), "groups")
    quotas = apportion(shards.drop("__seats").join(groups, ["__sid", "__group"]), ["__sid", "__group"], ["__shard"], "__words", "__part")
    quotas = quotas.select("__sid", "__shard", "__words", F.least(F.col("quota") * BLOCK, F.col("__words") * CAP).alias("__take"))
    rows = rows.join(materialize(quotas, "quotas"), ["__sid", "__shard"])
    ring = W.partitionBy("__sid", "__shard").orderBy("__o", "doc_id", "size")
    rows = rows.withColumn("__c", F.sum("size").over(ring.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    whole = F.when(F.col("__words") > 0, F.floor(F.col("__take") / F.col("__words"))).otherwise(0).cast("long")
    rows = rows.withColumn("passes", whole).withColumn("__rest", F.col("__take") - F.col("passes") * F.col("__words"))
    first = (draw(F.col("source"), F.col("__shard")) % F.greatest(F.ceil(F.col("__words") / BLOCK), F.lit(1))) * BLOCK
    rows = rows.withColumn("__a", first).withColumn("__b", F.col("__a") + F.col("__rest"))
    end = F.col("__c") + F.col("size")
    tail_from = F.greatest(F.col("__a") - F.col("__c"), F.lit(0))
    tail_to = F.least(end, F.col("__b"), F.col("__words")) - F.col("__c")
    head_to = F.least(end, F.col("__b") - F.col("__words")) - F.col("__c")
    rows = rows.withColumn("tail_from", tail_from).withColumn("tail_to", F.greatest(tail_to, F.col("tail_from"))).withColumn("head_to", F.greatest(head_to, F.lit(0)))
    taken = F.col("passes") * F.col("size") + F.col("tail_to") - F.col("tail_from") + F.col("head_to")
    out = rows.withColumn("taken", taken)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "tail_from", "tail_to", "head_to", *[F.col(f"__c_{c}").alias(c) for c in carry])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def cut(text: Column, start: Column, stop: Column) -> Column:
    """Words start..stop of a text with the white space after each, null if none."""
    parts = F.regexp_extract_all(text, F.lit(WORD_GAP), F.lit(0))
    return F.when(stop > start, F.array_join(F.slice(parts, (start + 1).cast("int"), (stop - start).cast("int")), ""))


WORD_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each whole copy and for each cut piece, with text and n_chars of that piece."""
    given = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    mixed = mix_sources(given, ["text", "row"]).where("taken > 0")
    copies = F.array_repeat(F.col("text"), F.col("passes").cast("int"))
    pieces = F.filter(F.concat(copies, F.array(cut(F.col("text"), F.col("tail_from"), F.col("tail_to")), cut(F.col("text"), F.lit(0).cast("long"), F.col("head_to")))), lambda x: x.isNotNull())
    rows = mixed.select("row", F.explode(pieces).alias("piece"))
    own = {"text": F.col("piece")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("piece").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT AS h FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (source_size * {CAP})::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * {SHARE}::DOUBLE AS total FROM src
), leveled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM weighted
), target AS (
  SELECT source, source_size, CASE WHEN lev * w > cap OR water IS NULL THEN cap ELSE water * w END AS target
  FROM (SELECT *, first_value(lev) OVER (ORDER BY lev * w > cap, cap / w, source NULLS LAST) AS first_lev,
               CASE WHEN bool_and(lev * w > cap) OVER () THEN NULL ELSE first_value(lev) OVER (ORDER BY lev * w > cap, cap / w, source NULLS LAST) END AS water FROM leveled)
), seats AS (
  SELECT source, count(*)::BIGINT AS seats FROM (
    SELECT source, row_number() OVER (ORDER BY q DESC, source ASC NULLS LAST, k) AS r, n FROM (
      SELECT source, k, target / (2 * k - 1) AS q, n FROM (
        SELECT source, target, floor(sum(target) OVER () / {BLOCK} + 0.5)::BIGINT AS n, unnest(range(1, (target / {BLOCK})::BIGINT + 100)) AS k FROM target WHERE target > 0)))
  WHERE r <= n GROUP BY source
), sharded AS (
  SELECT d.*, t.source_size, t.target, coalesce(s.seats, 0) AS seats,
         ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '-') || '|' || d.h::VARCHAR), 1, 8))::BIGINT AS o, ceil(greatest(t.source_size, 1) / {SHARD}.0)::BIGINT AS shards
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN seats s ON s.source IS NOT DISTINCT FROM t.source
), ringed AS (
  SELECT *, o % shards AS shard, (o % shards) // {GROUP} AS grp FROM sharded
), words AS (
  SELECT source, shard, grp, seats, sum(size)::BIGINT AS words FROM ringed GROUP BY ALL
), gwords AS (
  SELECT source, grp, seats, sum(words)::BIGINT AS words FROM words GROUP BY ALL
), part AS (
  SELECT source, grp, count(*)::BIGINT AS part FROM (
    SELECT source, grp, seats, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k - 1) DESC, grp, k) AS r FROM (
      SELECT *, unnest(range(1, seats + 2)) AS k FROM gwords WHERE words > 0)) WHERE r <= seats GROUP BY ALL
), quota AS (
  SELECT source, shard, count(*)::BIGINT AS quota FROM (
    SELECT source, shard, part, row_number() OVER (PARTITION BY source, grp ORDER BY words / (2 * k - 1) DESC, shard, k) AS r FROM (
      SELECT w.*, p.part, unnest(range(1, p.part + 2)) AS k FROM words w JOIN part p ON w.source IS NOT DISTINCT FROM p.source AND w.grp = p.grp WHERE w.words > 0)) WHERE r <= part GROUP BY ALL
), ring AS (
  SELECT r.*, w.words, least(coalesce(q.quota, 0) * {BLOCK}, w.words * {CAP}) AS take,
         (('0x' || substr(md5('{SEED}|' || coalesce(r.source, '-') || '|' || r.shard::VARCHAR), 1, 8))::BIGINT % greatest(ceil(w.words / {BLOCK}.0)::BIGINT, 1)) * {BLOCK} AS a,
         sum(r.size) OVER (PARTITION BY r.source, r.shard ORDER BY r.o, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS c
  FROM ringed r JOIN words w ON r.source IS NOT DISTINCT FROM w.source AND r.shard = w.shard
  LEFT JOIN quota q ON r.source IS NOT DISTINCT FROM q.source AND r.shard = q.shard
), cuts AS (
  SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS passes, a + take - CASE WHEN words > 0 THEN take // words ELSE 0 END * words AS b FROM ring
)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(c + size, b, words) - greatest(c, a)) + greatest(0, least(c + size, b - words) - c))::BIGINT AS taken
FROM cuts
"""
