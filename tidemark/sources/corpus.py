"""The labelled corpus and lookup tables."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, DIMENSIONS, SCALE
from tidemark.functions.scalar import quantize_vector, reference_tag
from tidemark.schemas import CORPUS


def read_corpus(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array (multi_line) or a vector a line, gzip by suffix: (vector, label)."""
    return spark.read.schema(CORPUS).option("multiLine", multi_line).json(path)


def read_corpus_any(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays whose gzip compression shows in their first two bytes, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode() for b in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    texts = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "text string")
    return texts.select(F.explode(F.from_json("text", f"array<struct<{CORPUS.replace('vector ', 'vector:').replace('label ', 'label:')}>>")).alias("r")).select("r.*")


def references(corpus: DataFrame, ref_id: str | None = None, max_refs: int = DEFAULT.max_refs) -> DataFrame:
    """(ref_id, q, label 0/1, tag). A missing vector is all zero, a missing label 0; another number of dimensions, or more rows than max_refs, is an error."""
    zero = F.array_repeat(F.lit(0.0), DIMENSIONS)
    v = F.coalesce("vector", zero)
    sized = F.when(F.size(v) == DIMENSIONS, v).otherwise(F.raise_error(F.concat(F.lit("a vector has "), F.size(v).cast("string"), F.lit(" dimensions"))).cast("array<double>"))
    number = F.col(ref_id) if ref_id else F.monotonically_increasing_id()
    out = corpus.select(number.cast("long").alias("ref_id"), sized.alias("v"), F.coalesce(F.col("label") == "fraud", F.lit(False)).cast("int").alias("label"))
    if max_refs is not None and corpus.count() > max_refs:
        raise ValueError(f"the corpus has more than {max_refs} rows")
    return out.select("ref_id", quantize_vector(F.col("v")).alias("q"), "label", reference_tag(F.col("v")).alias("tag"))


def read_mcc_risk(spark: SparkSession, path: str) -> DataFrame:
    """(mcc, risk, fixed) from a JSON object of code to risk; codes have four characters at least."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("mcc", "risk"))
    return pairs.where(F.length("mcc") >= 4).select("mcc", "risk", F.floor(F.col("risk") * SCALE + 0.5).cast("int").alias("fixed"))
