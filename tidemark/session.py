"""Session settings the engine relies on, and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def build_session(app: str = "tidemark", master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join splitting on; conf overrides any of these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if cores:
        settings["spark.sql.shuffle.partitions"] = str(cores)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a temporary one on a local master; an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that the machines of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = f"file://{own}"
    return _OWN[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; Hadoop deletes it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}-{label}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    named = fs.makeQualified(hadoop_path).toString()  # with its scheme, so that workers reach it as well
    return f"file://{named[5:]}" if named.startswith("file:/") and not named.startswith("file://") else named


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return the written table: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label) + "/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
