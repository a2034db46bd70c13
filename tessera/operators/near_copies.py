"""Near copies between the splits of a dataset, which an exact content hash doesn't see."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.shared import written
from .split import NAMES

#: Words of a shingle, and the per cent of all shingles of two texts that near copies share.
WORDS, PERCENT = 5, 75
#: Bands of MinHash values, and values of a band: a pair of that similarity meets in none with a chance of (1 - 0.75 ** 2) ** 24 < 3e-9.
BANDS, ROWS = 24, 2
#: Words of texts handled at once in a task; a longer text makes a slice of its own.
SLICE_WORDS = 1 << 18

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words, A-Z lower-cased, in order."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.transform(F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(h: np.ndarray, first: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of so many words of each text, and each text's first place with the total at the end; of fewer
    words, of all of them as one. h: word hashes of all texts; first: each text's first word, and the total."""
    n = np.diff(first)
    g, text = np.zeros(max(0, len(h) - words + 1), np.uint64), np.repeat(np.arange(len(n)), n)
    for j in range(words if len(g) else 0):
        g = g * _FACTOR + h[j : j + len(g)]
    ok = text[: len(g)] == text[words - 1 :]
    few = np.flatnonzero((n > 0) & (n < words))
    own = n[few].astype(np.uint64)
    for j in range(words - 1 if len(few) else 0):
        own = np.where(j < n[few], _mix(own) * _FACTOR + h[np.minimum(first[few] + j, len(h) - 1)], own)
    g, text = _mix(np.concatenate([g[ok], own])), np.concatenate([text[: len(g)][ok], few])
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return g[new], np.searchsorted(text[new], np.arange(len(first)))


def bands(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS MinHash values each, for every text with shingles: rows are those texts in order."""
    at = first[:-1][np.diff(first) > 0]
    a, b = np.random.default_rng(1).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64)
    out = np.zeros((len(at), BANDS), np.uint64)
    for j in range(BANDS * ROWS if len(at) else 0):
        x = g * (a[j] | np.uint64(1)) + b[j]
        x = (x ^ (x >> np.uint64(32))) * _FACTOR
        out[:, j // ROWS] = _mix(out[:, j // ROWS] + np.minimum.reduceat(x, at) + np.uint64(j))
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """split, key, word hashes -> split, key, shingles, bands."""
    for b in batches:
        total = np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_WORDS, "right")) - at)
            rows = b.slice(at, n)
            lists = rows.column(2)
            first = lists.offsets.to_numpy().astype(np.int64)
            g, first = shingles(lists.flatten().to_numpy().view(np.uint64), first - first[0])
            ends = np.concatenate([[0], np.cumsum(BANDS * (np.diff(first) > 0))])
            lists = [pa.ListArray.from_arrays(pa.array(x, pa.int32()), pa.array(y.view(np.int64))) for x, y in ((first, g), (ends, bands(g, first).ravel()))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], ["split", "key", "shingles", "bands"])
            at += n


def near_leaks(df: DataFrame, key: str, text: str = "text", split: str = "split", percent: int = PERCENT) -> DataFrame:
    """one, other, one_key, other_key, n_shared, n_all: pairs of texts in two splits that share `percent` of all their shingles.

    Exact copies within a split count once, under their smallest key, so they aren't multiplied by each other; different
    texts meet by bands of MinHash values and are then compared in full. Null and blank texts, null keys, and splits of other names than the three, are in no pair; a key is one text of its split.
    Only buckets that hold several splits go on, and only keys meet there; a group of many different near copies still gives
    all its pairs across splits, as they are the result.
    """
    x = df.select(F.col(split).alias("split"), F.col(key).alias("key"), F.col(text).alias("text")).where("split is not null and key is not null and text is not null").withColumn("content", F.sha2("text", 256))
    # of exact copies one: told by keys and hashes, so that texts are dealt once
    first = x.groupBy("split", "content").agg(F.min("key").alias("key"))
    x = x.join(first.hint("merge"), ["split", "content", "key"], "left_semi")
    hashed = x.select("split", "key", word_hashes(F.col("text")).alias("words"))
    longs = T.ArrayType(T.LongType())
    # written before those of no word are left out: a filter on what is made would make it once more, before the join
    x = written(hashed.mapInArrow(_sketched, T.StructType([*hashed.schema.fields[:2], T.StructField("shingles", longs), T.StructField("bands", longs)])), "shingles").where(F.size("shingles") > 0)
    if x.isEmpty():
        return x.select(F.lit("").alias("one"), F.lit("").alias("other"), F.col("key").alias("one_key"), F.col("key").alias("other_key"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_all"))
    number = F.array_position(F.array(*map(F.lit, NAMES)), F.col("split"))
    met = x.select("key", number.alias("number"), F.explode("bands").alias("band")).where("number > 0")
    several = met.groupBy("band").agg(F.min("number").alias("lo"), F.max("number").alias("hi")).where("lo < hi").select("band")
    met = written(met.join(several.hint("merge"), "band", "left_semi"), "buckets")
    pairs = met.alias("a").join(met.alias("b").hint("merge"), (F.col("a.band") == F.col("b.band")) & (F.col("a.number") < F.col("b.number")))
    pairs = pairs.select(*(F.col(f"{t}.{c}").alias(f"{c}_{t}") for t in "ab" for c in ("key", "number"))).distinct()
    sets = x.select("key", number.alias("number"), "shingles")
    for t in "ab":
        pairs = pairs.join(sets.select(F.col("key").alias(f"key_{t}"), F.col("number").alias(f"number_{t}"), F.col("shingles").alias(f"set_{t}")).hint("merge"), [f"key_{t}", f"number_{t}"])
    shared = F.size(F.array_intersect("set_a", "set_b"))
    found = pairs.withColumn("n_shared", shared).withColumn("n_all", F.size("set_a") + F.size("set_b") - F.col("n_shared")).where(100 * F.col("n_shared") >= percent * F.col("n_all"))
    name = lambda c: F.element_at(F.array(*map(F.lit, NAMES)), F.col(c).cast("int"))
    return found.select(name("number_a").alias("one"), name("number_b").alias("other"), F.col("key_a").alias("one_key"), F.col("key_b").alias("other_key"), "n_shared", "n_all")
