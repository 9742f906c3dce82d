"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch given to Python, so that a batch of long texts stays small.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
#: Bits of a sieve: 2 MB.
SIEVE_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def held(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, nulls as empty ones."""
    return [x or "" for x in batch.column(name).to_pylist()]


def sieve(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """rows with __maybe: false for rows whose key (bigint) certainly is not in the column `name` of wanted.

    One bit for each of SIEVE_BITS places, in rows of 32768: the table that is broadcast has SIEVE_BITS / 8 bytes at most, however many rows
    wanted has. The more it has, the more rows pass; joins after it are exact.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit(9), c), F.lit(SIEVE_BITS))
    bits = wanted.where(F.col(name).isNotNull()).select(place(F.col(name)).alias("p")).select(F.bitmap_bucket_number("p").alias("__bucket"), F.bitmap_bit_position("p").alias("__bit"))
    # the keys are dealt out, not a map of each task's
    maps = bits.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    found = rows.withColumn("__p", place(key)).join(F.broadcast(maps), F.bitmap_bucket_number(F.col("__p")) == F.col("__bucket"), "left")
    at = F.bitmap_bit_position(F.col("__p"))
    byte = F.conv(F.hex(F.substring("__map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(__byte, CAST(bitmap_bit_position(__p) % 8 AS INT)) & 1")
    return found.withColumn("__byte", byte).withColumn("__maybe", F.coalesce(bit == 1, F.lit(False))).drop("__p", "__bucket", "__map", "__byte")


def arrow_type(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def by_run(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by keys into tables that hold one key each; holds one key's rows at a time."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key != last:
                if i > start:
                    rest.append(batch.slice(start, i - start))
                if rest:
                    yield pa.Table.from_batches(rest)
                rest, last, start = [], key, i
        if start < batch.num_rows:
            rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)
