"""A corpus from documents to packed sequences: every stage reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.jaccard import one_of_each
from tidemark.llm.lines import line_dedup
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import accepted
from tidemark.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, taught by the labels beside the documents: documents that it rejects go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later repeats of passages go from the texts; a text may end up empty, its document stays."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("__gone") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each class stays."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents (or the part that the mix takes of them) as often as their source's target asks for."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: token pieces with their sequence and offset."""
    return pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training and packing are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
