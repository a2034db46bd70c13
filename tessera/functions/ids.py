"""Stable ids from keys; nothing depends on row order or partitions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tracking_id(seed: Column, index: Column) -> Column:
    """seed::v{index}::first 8 hex digits of sha256(seed::index)."""
    i = index.cast("string")
    return F.concat(seed, F.lit("::v"), i, F.lit("::"), F.substring(F.sha2(F.concat(seed, F.lit("::"), i), 256), 1, 8))


def parse_seed_id(tracking: Column) -> Column:
    return F.substring_index(tracking, "::", 1)


def perturb_seed(tracking: Column) -> Column:
    return F.conv(F.substring_index(tracking, "::", -1), 16, 10).cast("bigint")


def split_hash(key: Column, salt: str) -> Column:
    """Hex sha256 of salt:key, whose order is that of the split."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256)
