"""Tables in the session's shared folder: a result that several steps read is made once, and lost executors don't lose it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, with its scheme.

    Only where it is missing and the master is local (tests on one machine) a temporary folder is made and set; on a cluster
    that is an error. A path without a scheme is one of the session's default store, as for Spark itself.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written and read again."""
    df.write.parquet(path := folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_model(model, spark: SparkSession, name: str):
    """A fitted Spark ML model, saved and loaded: without the summary of its training, which holds the session and so can't
    go to the executors once anything has been observed in that session."""
    model.save(path := folder(spark, name))
    return type(model).load(path)
