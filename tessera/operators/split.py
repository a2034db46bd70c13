"""Exact train/validation/test splits from key hashes, without a global sort or a join back.

Keys are ordered by the hex sha256 of salt:key. Counting the first three hex digits (at most 4,096 rows) finds the group
that holds a cut rank; the group is counted by three further digits until it is small, and only then ranked, for the cut
hash. A row's split then is a comparison of its own hash with the cuts, so all rows of a key share a split by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules as R
from ..functions.ids import split_hash
from ..sources.shared import written

NAMES = ("train", "val", "test")
#: Hex digits counted at a time, and the rows of a group that is ranked.
DIGITS, SMALL = 3, 65_536


def check_fractions(fractions: tuple[float, float, float]) -> None:
    if abs(sum(fractions) - 1.0) > 1e-6 or min(fractions) < 0:
        raise ValueError(f"fractions must be at least 0 and have the sum 1: {fractions}")


def sizes(n: int, fractions: tuple[float, float, float], half_even: bool) -> tuple[int, int, int]:
    """Floor or half-even sizes of train and val; test gets the rest, and what it lacks comes from train."""
    check_fractions(fractions)
    whole = round if half_even else int
    train, val = whole(n * fractions[0]), whole(n * fractions[1])
    test = n - train - val
    return (train + min(0, test), val, max(0, test))


def _groups(hashes: DataFrame, prefix: str = "") -> list[tuple[str, int]]:
    """Groups of the hashes (h) that begin so, by DIGITS more, with their counts; at most 16 ** DIGITS rows."""
    own = hashes.where(F.col("h").startswith(prefix)) if prefix else hashes.where("h is not null")
    return sorted((x["g"], x["n"]) for x in own.groupBy(F.substring("h", 1, len(prefix) + DIGITS).alias("g")).agg(F.count("*").alias("n")).collect())


def _cuts(hashes: DataFrame, top: list[tuple[str, int]], n_train: int, n_val: int) -> tuple[str | None, str | None]:
    """The hashes of ranks n_train and n_train + n_val (from 0), None where there is no such rank; top: all groups."""

    def at(rank: int) -> str | None:
        groups = top
        while True:
            for g, n in groups:
                if rank < n:
                    break
                rank -= n
            else:
                return None
            if len(g) >= 64:
                return g
            if n <= SMALL:
                return hashes.where(F.col("h").startswith(g)).orderBy("h").offset(rank).limit(1).first()["h"]
            groups = _groups(hashes, g)

    return at(n_train), at(n_train + n_val)


def cut_hashes(keys: DataFrame, column: str, n_train: int, n_val: int, salt: str = R.SALT) -> tuple[str | None, str | None]:
    """The hashes of ranks n_train and n_train + n_val (from 0) of distinct keys; None where there is no such rank."""
    h = keys.select(split_hash(F.col(column), salt).alias("h"))
    return _cuts(h, _groups(h), n_train, n_val)


def split_by_cuts(key: Column, cuts: tuple[str | None, str | None], salt: str = R.SALT) -> Column:
    h = split_hash(key, salt)
    first = F.lit(True) if cuts[0] is None else h < F.lit(cuts[0])
    second = F.lit(True) if cuts[1] is None else h < F.lit(cuts[1])
    return F.when(first, "train").when(second, "val").otherwise("test")


def split_rank_rows(df: DataFrame, key: str, fractions: tuple[float, float, float] = R.FRACTIONS, salt: str = R.SALT) -> DataFrame:
    """Adds split by row, with floor sizes; keys are unique ids. The keys' hashes are made and written once, and counted from there."""
    check_fractions(fractions)
    h = written(df.select(split_hash(F.col(key), salt).alias("h")), "hashes")
    top = _groups(h)
    train, val, _ = sizes(sum(n for _, n in top), fractions, half_even=False)
    return df.withColumn("split", split_by_cuts(F.col(key), _cuts(h, top, train, val), salt))


def split_grouped_seeds(df: DataFrame, seed: str, fractions: tuple[float, float, float] = R.FRACTIONS, salt: str = R.SALT, allow_empty: bool = False) -> DataFrame:
    """Adds split by seed, with half-even sizes over distinct seeds: all rows of a seed are in one split.

    A requested split that would be empty is an error, unless allow_empty; so is an empty table. The table is read once for its
    seeds: the distinct hashes are written, and counted from there.
    """
    check_fractions(fractions)
    h = written(df.where(F.col(seed).isNotNull()).select(split_hash(F.col(seed), salt).alias("h")).distinct(), "hashes")
    top = _groups(h)
    n = sum(k for _, k in top)
    if not n:
        raise ValueError("no seeds")
    got = sizes(n, fractions, half_even=True)
    if not allow_empty and (empty := [name for name, f, k in zip(NAMES, fractions, got, strict=True) if f > 0 and k == 0]):
        raise ValueError(f"{n} seeds leave {empty} empty")
    return df.withColumn("split", split_by_cuts(F.col(seed), _cuts(h, top, got[0], got[1]), salt))


def expect_nonempty_split(n: Column, fractions: tuple[float, float, float] = R.FRACTIONS) -> Column:
    """True where n seeds fill each requested split, by half-even sizes."""
    train, val = F.bround(n * F.lit(float(fractions[0]))), F.bround(n * F.lit(float(fractions[1])))
    return (train > 0) & ((val > 0) | F.lit(fractions[1] == 0)) & ((n - train - val > 0) | F.lit(fractions[2] == 0))


def threshold_split(key: Column, fractions: tuple[float, float, float] = R.FRACTIONS, salt: str = R.SALT) -> Column:
    """A split from the key alone, for streams: no state and no leak, but sizes only near the fractions."""
    check_fractions(fractions)
    x = F.conv(F.substring(split_hash(key, salt), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return F.when(x < float(fractions[0]), "train").when(x < float(fractions[0] + fractions[1]), "val").otherwise("test")


def leaks(df: DataFrame, group: str = "seed_id", split: str = "split") -> DataFrame:
    """Groups that are in more than one split."""
    return df.groupBy(group).agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo <> hi").select(group)


def verify_no_leakage(df: DataFrame, group: str = "seed_id", split: str = "split") -> bool:
    return leaks(df, group, split).isEmpty()


def without_leaks(df: DataFrame, group: str = "seed_id", split: str = "split") -> DataFrame:
    """The same rows, but reading or writing them fails if a group is in two splits.

    The check is a part of the plan, a subquery over the two columns alone that is done before the first row: no job
    runs while the frame is made, and nothing is written if it fails.
    """
    found = leaks(df.select(group, split), group, split).agg(F.assert_true(F.count("*") == 0, F.concat(F.count("*").cast("string"), F.lit(" groups are in two splits"))).alias("ok"))
    return df.where(found.scalar().isNull())


def shared_seeds(df: DataFrame, group: str = "seed_id", split: str = "split") -> DataFrame:
    """(one, other, group): groups that two splits have in common, for each pair of splits. Empty if there is no leak."""
    own = df.select(group, split).distinct().groupBy(group).agg(F.collect_set(split).alias("all")).where(F.size("all") > 1)
    names = F.array(*map(F.lit, NAMES))
    own = own.select(group, F.filter(names, lambda x: F.array_contains("all", x)).alias("all"))
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda b: F.struct(a.alias("one"), b.alias("other")))))
    return own.select(group, F.inline(pairs))


def join_split_ids(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Rows get the split of their id (key, split); an id without one is an error when it is read."""
    joined = rows.join(splits.select(key, "split").hint("merge"), key, "left")
    return joined.withColumn("split", F.coalesce("split", F.raise_error(F.concat(F.lit("no split for id "), F.col(key).cast("string"))).cast("string")))


def join_split_rows(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows with a tracking_id get the split of their seed (seed_id, split); a row without one is an error when it is read."""
    joined = rows.withColumn("seed_id", F.substring_index("tracking_id", "::", 1)).join(seeds.select("seed_id", "split").hint("merge"), "seed_id", "left")
    return joined.withColumn("split", F.coalesce("split", F.raise_error(F.concat(F.lit("no split for seed "), F.col("seed_id"))).cast("string")))


def stratified_sample(df: DataFrame, stratum: str, key: str, k: int) -> DataFrame:
    """The k rows of each stratum with the least key hashes."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def numbered(df: DataFrame, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Adds number: 0, 1, ... in the order of a unique key. prepare, a map or filter of rows, is done on the way.

    Rows are dealt to sampled ranges of the key, which hold about as many rows each, sorted there and written with their places;
    the counts of the ranges, one row each, give the numbers that they begin with.
    """
    x = prepare(df.repartitionByRange(F.col(key)).sortWithinPartitions(key))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    x = written(x.withColumn("_g", F.spark_partition_id()).withColumn("_k", place), "numbered")
    before, starts = 0, [(-1, 0)]
    for g, n in sorted((y["_g"], y["n"]) for y in x.groupBy("_g").agg(F.count("*").alias("n")).collect()):
        starts.append((g, before))
        before += n
    at = df.sparkSession.createDataFrame(starts, "_g int, _before bigint")
    # a row a partition of one shuffle
    return x.join(F.broadcast(at), "_g").withColumn("number", F.col("_before") + F.col("_k")).drop("_g", "_before", "_k")


def row_surrogate_id(number: Column, prefix: str) -> Column:
    """prefix-000000 for number 0: six digits, more where they are needed."""
    return F.format_string(prefix + "-%06d", number)
