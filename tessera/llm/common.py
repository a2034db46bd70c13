"""Shared folders, staging and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir of the session, with its scheme.

    Only where the setting is missing and the master is local (tests on one machine) a temporary folder is made and set;
    on a cluster that is an error. A path without a scheme is one of the session's default store, as for Spark itself.
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


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that models must not learn from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sampled(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """About `most` rows, those of the smallest hashes of `by`: a bound for what a model is fitted on."""
    share = min(1.0, most / max(1, rows.count()))
    return rows if share == 1 else rows.where(F.shiftrightunsigned(F.xxhash64(*by), 1) < int(share * (1 << 63)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. If its files have fewer splits than there are cores (one for each row group), its rows are dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def spare(taken: tuple[str, ...] | list[str]) -> str:
    """A column name that isn't taken, whatever the letters' case."""
    name = "_"
    while name in {x.lower() for x in taken}:
        name += "_"
    return name


def carrying(carried: T.DataType | None, ddl: str) -> T.StructType:
    """The columns of ddl, behind a column `carried` of the given type, whose field names may be any."""
    return T.StructType([*([T.StructField("carried", carried)] if carried else []), *T.StructType.fromDDL(ddl).fields])


def _texts(docs: DataFrame, carry: tuple[str, ...]) -> set[str]:
    """Of the carried columns those that hold the text itself, which goes to Python beside them already."""
    return {c for c in carry if (c, "string") in docs.dtypes and c == "text"}


def own_fields(docs: DataFrame, carry: tuple[str, ...]) -> Column:
    """A struct of the carried columns less the text, so that no text goes to Python twice, and of a spare one, as it may have no other."""
    own = [c for c in carry if c not in _texts(docs, carry)]
    return F.struct(F.lit(0).alias(spare(carry)), *(F.col(f"`{c}`") for c in own))


def with_text(docs: DataFrame, carry: tuple[str, ...]) -> Column:
    """The struct of the carried columns again, from `carried` (see own_fields) and `text`."""
    texts = _texts(docs, carry)
    return F.struct(*((F.col("text") if c in texts else F.col(f"carried.`{c}`")).alias(c) for c in carry))
