"""Readers and writers: notes in CSV, cleaned records in JSON, the dataset in Parquet by split."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.text import is_blank
from ..operators.quality import require

#: Values stand in quotes, with their blanks; null is told from empty by its own mark.
CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "nullValue": r"\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: The declared columns of raw notes behind the id, which is column 0 under any name.
NOTES = T.StructType([T.StructField(c, T.StringType()) for c in ("description", "medical_specialty", "sample_name", "transcription", "keywords")])


def read_notes(spark: SparkSession, path: str, text: str = "transcription", category: str = "medical_specialty", schema: T.StructType = NOTES) -> DataFrame:
    """The raw notes with their declared types, in the order of the header; column 0 becomes seed_id, columns that aren't declared are strings.

    A path without a file, and a header without the columns that the builds need, are errors before any job; a
    further file of another header is one when it is read.
    """
    try:
        header = spark.read.options(**CSV).csv(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no notes at {path}") from e
    require(header, text, category)
    types = {f.name: f.dataType for f in schema.fields}
    declared = T.StructType([T.StructField(c, types.get(c, T.StringType()) if k else T.StringType()) for k, c in enumerate(header.columns)])
    return spark.read.options(**CSV, enforceSchema=False).schema(declared).csv(path).withColumnRenamed(header.columns[0], "seed_id")


def counted(text: str = "transcription") -> list[Column]:
    """What is counted of notes: read, with a text, of null text."""
    return [F.count("*").alias("n_before"), F.count(text).alias("n_after"), (F.count("*") - F.count(text)).alias("n_null_text")]


def notes_counts(df: DataFrame, text: str = "transcription") -> DataFrame:
    """One row of counted()."""
    return df.agg(*counted(text))


def notes_validated(df: DataFrame, text: str = "transcription", category: str = "medical_specialty", seen: Observation | None = None) -> DataFrame:
    """Missing columns are an error before any job; rows of null text go. seen gets counted() from the pass that reads the rows.

    On a stream, whose observations need a name, they come with the progress of each batch (streams.Tally).
    """
    require(df, text, category)
    return (df if seen is None else df.observe(seen, *counted(text))).na.drop(subset=[text])


def archive_notes(df: DataFrame, path: str, text: str = "transcription", category: str = "medical_specialty") -> dict[str, int]:
    """Writes the validated notes to a new folder, and returns their counts from that same pass: the input is read once."""
    seen = Observation("notes")
    notes_validated(df, text, category, seen).write.parquet(path)
    return seen.get


def notes_filled(df: DataFrame, text: str = "transcription", key: str = "seed_id", first: int | None = None) -> DataFrame:
    """Null text becomes empty; with first, the rows of the smallest keys."""
    x = df.na.fill("", subset=[text])
    return x if first is None else x.orderBy(key).limit(first)


def write_csv(df: DataFrame, path: str) -> None:
    """All values in quotes; what read_notes() reads."""
    df.write.options(**CSV, quoteAll=True, emptyValue="").mode("overwrite").csv(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields))


def write_clean_json(df: DataFrame, path: str, metadata: DataFrame) -> None:
    """Records as JSON lines, and one row of metadata beside them."""
    nan_to_null(df).write.mode("overwrite").json(f"{path}/records")
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_dataset(df: DataFrame, path: str) -> None:
    """Parquet by split, so that one split is read without the others. What was there goes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split").parquet(path)


def replace_splits(df: DataFrame, path: str) -> None:
    """Replaces the splits that df has rows of, and no other: their files stay as they are. Done twice, it changes nothing more.

    The new files are moved in only when all are written, so a build that fails or is tried again leaves no half of a split.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str, text: str = "text", seen: Observation | None = None) -> DataFrame:
    """One split, without blank texts; an unknown split is an error that lists the splits there are. seen gets n_before and n_blank."""
    df = spark.read.parquet(path)
    own = df.where(F.col("split") == split)
    if own.isEmpty():
        raise ValueError(f"no split {split}; there are {sorted(x['split'] for x in df.select('split').distinct().collect())}")
    if seen is not None:
        own = own.observe(seen, F.count("*").alias("n_before"), F.count_if(is_blank(F.col(text))).alias("n_blank"))
    return own.where(~is_blank(F.col(text)))


def peek(df: DataFrame, n: int = 2, width: int = 120) -> DataFrame:
    """The first perturbed rows by id, split in capitals, text cut."""
    cut = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("..."))).otherwise(F.col("text"))
    return df.where("is_perturbed").orderBy("tracking_id").limit(n).select("tracking_id", F.upper("split").alias("split"), cut.alias("text"))
