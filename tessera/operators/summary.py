"""Counts over the finished dataset; all distributions from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules as R


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def rollup(df: DataFrame, columns: list[str]) -> DataFrame:
    """(what, value, n) for each value of each column: one grouping-sets pass instead of one for each column."""
    name = F.lit(None).cast("string")
    for c in columns:
        name = F.when(F.grouping(c) == 0, c).otherwise(name)
    value = F.coalesce(*(F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in columns))
    return df.groupingSets([[F.col(c)] for c in columns], *(F.col(c) for c in columns)).agg(name.alias("what"), value.alias("value"), F.count("*").alias("n")).select("what", "value", "n")


#: Version of the exported records, and what their readers must know.
SCHEMA_VERSION = "1.0"
WARNING = "Severities come from a small keyword scanner that nobody has validated; they are not ground truth. Specialties are those of the source."
CAVEATS = [
    "Severities are a deterministic heuristic, not a validated label.",
    "Perturbed variants are respellings behind a few prefixes, not generated text.",
    "Rows of low routing confidence should be filtered or weighed down where the department matters.",
]
METADATA = "export_timestamp_utc string, n_records bigint, schema_version string, splits map<string,bigint>, severities map<string,bigint>, data_quality_warning string"


def utc_stamp() -> Column:
    """Now, in UTC, as an ISO 8601 string."""
    now = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    return F.concat(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames of one row each as one row."""
    return a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)).hint("merge"), "_").drop("_")


def _maps(columns: dict[str, str]) -> list[Column]:
    """From the rows of rollup(): a map of counts for each column, under its other name."""
    entry = lambda c: F.when((F.col("what") == c) & F.col("value").isNotNull(), F.struct("value", "n"))
    return [F.map_from_entries(F.array_sort(F.collect_list(entry(c)))).alias(a) for c, a in columns.items()]


def export_metadata(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row about exported records: stamp, number, version, a map of counts for each column, warning."""
    rows = F.sum(F.when(F.col("what") == next(iter(columns)), F.col("n"))).alias("n_records")
    x = rollup(records, list(columns)).agg(rows, *_maps(columns))
    return x.select(utc_stamp().alias("export_timestamp_utc"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.lit(SCHEMA_VERSION).alias("schema_version"), *columns.values(), F.lit(WARNING).alias("data_quality_warning"))


def manifest_schema(columns: dict[str, str]) -> str:
    counts = ", ".join(f"{a} map<string,bigint>" for a in (*columns.values(), "split_seeds"))
    return f"build_timestamp_utc string, parameters map<string,string>, n_rows bigint, n_seeds bigint, n_variants int, {counts}, leakage_verified boolean, caveats array<string>"


def run_parameters(source: str, rate: float | None = R.RATE, fractions: tuple[float, float, float] = R.FRACTIONS, salt: str = R.SALT) -> dict[str, str]:
    """What a build was made from and with, for its manifest."""
    return {"source": source, "perturbation_rate": "none" if rate is None else str(rate), "split_fractions": "/".join(map(str, fractions)), "split_seed": salt}


def manifest(df: DataFrame, columns: dict[str, str], seed: str = "seed_id", split: str = "split", n_variants: int = 1 + len(R.PREFIXES), parameters: dict[str, str] | None = None) -> DataFrame:
    """One row about a build: stamp, parameters, rows, seeds, variants, a map of counts for each column and of the seeds of each split,
    whether no seed is in two splits, caveats. Seeds are counted once each, from one row a seed and split.
    """
    told = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(v)) for k, v in sorted((parameters or {}).items()))).cast("array<struct<key:string,value:string>>"))
    rows = F.sum(F.when(F.col("what") == next(iter(columns)), F.col("n"))).alias("n_rows")
    x = rollup(df, list(columns)).agg(rows, *_maps(columns))
    own = df.groupBy(seed, split).agg(F.count("*").alias("n")).groupBy(seed).agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    own = own.groupBy("lo").agg(F.count("*").alias("n"), F.count_if(F.col("lo") != F.col("hi")).alias("leaks"))
    own = own.agg(F.sum("n").alias("n_seeds"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lo", "n")))).alias("split_seeds"), (F.sum("leaks") == 0).alias("leakage_verified"))
    return beside(x, own).select(utc_stamp().alias("build_timestamp_utc"), told.alias("parameters"), "n_rows", "n_seeds", F.lit(n_variants).alias("n_variants"), *columns.values(), "split_seeds", "leakage_verified", F.array(*map(F.lit, CAVEATS)).alias("caveats"))


def with_total(df: DataFrame, by: str, count: Column, total: str = "all") -> DataFrame:
    """by, n: the count of each group, and of all rows under the name total, from one pass."""
    return df.rollup(by).agg(count.alias("n"), F.grouping(by).alias("_total")).select(F.when(F.col("_total") == 1, total).otherwise(F.col(by)).alias(by), "n")


#: log2 of a sketch's size: 65,536 registers, a relative standard error of 0.4 %.
SKETCH = 16


def seed_sketches(df: DataFrame, seed: str = "seed_id", by: str = "split", size: int = SKETCH) -> DataFrame:
    """by, sketch: a mergeable sketch (HyperLogLog) of the distinct seeds of each group, of one size whatever the rows."""
    return df.groupBy(by).agg(F.hll_sketch_agg(F.col(seed).cast("string"), size).alias("sketch"))


def sketched_seeds(sketches: DataFrame, by: str | None = None) -> DataFrame:
    """About how many seeds (n): of each group of kept sketches, or of all together, without their rows."""
    grouped = sketches.groupBy(by) if by else sketches
    return grouped.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def class_share(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each class; the window is over the few rows of the counts."""
    counts = distribution(df, column)
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
