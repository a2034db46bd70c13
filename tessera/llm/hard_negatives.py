"""Hard negatives by the threshold algorithm of Fagin, Lotem and Naor over blocks of rows.

A block of rows keeps, for each dimension, a list of its rows sorted by that component. For an anchor the lists of its
non-zero components are read in step, from their largest entries where the anchor's component is positive and from their
smallest where it is negative; a row that a list shows is scored at once over all its dimensions in integers. The anchor's
product with the entries that were read last bounds the score of every row that no list has shown yet. A window of scores
is finished when it holds k rows and the bound is strictly below the k-th, or when the bound is below the window.

Anchors meet every block (a stated query set against all rows, in blocks); a block's best k rows of a window go on, and
the best k of all blocks are the result. So positives, which are the window of all scores among the rows of the anchor's own
label, come first, and give the windows of the negatives.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged
from .vectors import as_exact, matrix, usable, widened

#: Rows of a block, and anchors that meet a block in one task.
BLOCK, ANCHORS = 32_768, 65_536
#: Entries that are read from each list in the first round; every further round reads twice as many.
FIRST = 48


class SortedLists:
    """The rows of a block, and for each dimension their order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.take_along_axis(x.T, self.order, axis=1)
        self.largest = float(np.abs(x).max(initial=0.0))


def threshold_search(lists: SortedLists, anchor: np.ndarray, windows: list[tuple[int | None, int | None]], k: int, allowed: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each window (lowest and highest score, None: no limit) the first k allowed rows in it as (score, id): higher scores first, then smaller ids."""
    n, d = lists.x.shape
    most = lists.largest * float(np.abs(anchor).max(initial=0.0)) * d
    x, values, weights = as_exact(lists.x, most), as_exact(lists.sorted, most), as_exact(anchor, most)
    ascending = np.flatnonzero(anchor < 0)
    descending = np.flatnonzero(anchor > 0) if np.any(anchor) else np.array([0])
    seen = np.zeros(n, dtype=bool)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=x.dtype), np.empty(0, dtype=np.int64)) for _ in windows]
    open_, depth, step = list(range(len(windows))), 0, FIRST
    while open_ and depth < n:
        end = min(n, depth + step)
        shown = np.zeros(n, dtype=bool)
        shown[lists.order[descending, n - end : n - depth]] = True
        shown[lists.order[ascending, depth:end]] = True
        shown &= ~seen
        seen |= shown
        rows = np.flatnonzero(shown & allowed)
        scores = x[rows] @ weights
        bound = weights[descending] @ values[descending, n - end] + weights[ascending] @ values[ascending, end - 1]
        depth, step = end, 2 * step
        still = []
        for w in open_:
            low, high = windows[w]
            inside = np.ones(len(rows), dtype=bool)
            if low is not None:
                inside &= scores >= low
            if high is not None:
                inside &= scores <= high
            if inside.any():
                s, i = np.concatenate([best[w][0], scores[inside]]), np.concatenate([best[w][1], lists.ids[rows[inside]]])
                if len(s) > 4 * k:  # what is below the k-th goes before the rest is sorted
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                    s, i = s[keep], i[keep]
                first = np.lexsort((i, -s))[:k]
                best[w] = (s[first], i[first])
            full = len(best[w][0]) == k and bound < best[w][0][-1]
            if not (full or (low is not None and bound < low)):
                still.append(w)
        open_ = still
    return [[(int(s), int(i)) for s, i in zip(*b, strict=True)] for b in best]


def score_window(score: int, low: int, high: int) -> tuple[int, int] | None:
    """The whole scores s with low * score <= 100 * s <= high * score; None if there is none."""
    a, b = -((-low * score) // 100), high * score // 100
    return (a, b) if a <= b else None


def _block(rows: pa.Table, anchors: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and whole components of the rows, and those of the anchors, equally wide."""
    x, a = np.floor(scale * matrix(rows["vector"])), np.floor(scale * matrix(anchors["vector"]))
    d = max(x.shape[1], a.shape[1])
    return rows["id"].to_numpy(), rows["label"].to_numpy(), widened(x, d), widened(a, d)


FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _found(rows: list[tuple[int, int, int, int]]) -> pa.Table:
    return pa.Table.from_pydict(dict(zip(FOUND.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in FOUND.names}, schema=FOUND)


def _positives(k: int, scale: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's best k rows of each anchor's label, by lists for each label."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if anchors.num_rows and rows.num_rows:
            ids, labels, x, a = _block(rows, anchors, scale)
            theirs, own, number = anchors["label"].to_numpy(), anchors["id"].to_numpy(), anchors["anchor"].to_numpy()
            for label in np.unique(theirs):
                if not (mine := labels == label).any():
                    continue
                lists = SortedLists(ids[mine], x[mine])
                for j in np.flatnonzero(theirs == label):
                    (found,) = threshold_search(lists, a[j], [(None, None)], k, lists.ids != own[j])
                    out += [(int(number[j]), 0, i, s) for s, i in found]
        return _found(out)

    return run


def _negatives(k: int, scale: float, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's best k rows of other labels for each anchor and the window of each of its positives."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if anchors.num_rows and rows.num_rows:
            ids, labels, x, a = _block(rows, anchors, scale)
            lists = SortedLists(ids, x)
            theirs, number = anchors["label"].to_numpy(), anchors["anchor"].to_numpy()
            for j, scores in enumerate(anchors["scores"].to_pylist()):
                places = [(p, w) for p, s in enumerate(scores, 1) if (w := score_window(s, low, high))]
                if places and (allowed := labels != theirs[j]).any():
                    for (p, _), found in zip(places, threshold_search(lists, a[j], [w for _, w in places], k, allowed), strict=True):
                        out += [(int(number[j]), p, i, s) for s, i in found]
        return _found(out)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and place over all blocks, with rank from 1."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    `positives` rows of the same label, the first `negatives` rows of other labels whose score is from low to high per cent of
    the positive's. Scores are products of whole components, floor(scale * x); higher ones come first, ties by smaller ids.

    Rows of null key or label, of null vector, and with a null or non-finite entry take no part; shorter vectors end in
    zeros. Rows of one key are as many rows, but none is a partner of its own key; repeated anchors are as many anchors. A
    positive whose score isn't above 0 has negatives of score 0 only if its own is 0, else none. An anchor without a
    positive or a negative gives no row, so does an empty table. Scores beyond 64 bits are an error. Other columns are ignored.
    """
    spark = rows.sparkSession
    x = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    x = x.where("id is not null and label is not null").where(usable("vector"))
    n_blocks = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // BLOCK))
    # dealt in turn, so that no key, label or group of copies fills a block
    x = staged(x.repartition(n_blocks).withColumn("block", F.spark_partition_id()), "vectors")
    anchors = staged(x.where("is_anchor").select("id", "label", "vector").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n_groups = -(-anchors.count() // ANCHORS)
    if not n_groups:
        return spark.createDataFrame([], RESULT)
    group = F.pmod(F.xxhash64("anchor"), F.lit(n_groups)).cast("int")
    cell = F.col("block") * n_groups + F.col("group")
    blocks = x.select("id", "label", "vector", "block", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group")).withColumn("cell", cell).drop("block", "group")

    def everywhere(a: DataFrame) -> DataFrame:
        """Each anchor for each block."""
        return a.withColumn("group", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("cell", cell).drop("block", "group")

    def met(a: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        return everywhere(a).groupBy("cell").cogroup(blocks.groupBy("cell")).applyInArrow(f, "anchor bigint, place int, id bigint, score bigint")

    best = _first(met(anchors, _positives(positives, scale)), positives)
    best = staged(best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")), "positives")
    told = anchors.join(best.hint("merge"), "anchor").select("anchor", "label", "vector", "id", F.transform("positives", lambda p: p["score"]).alias("scores"))
    found = _first(met(told, _negatives(negatives, scale, low, high)), negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    named = anchors.select("anchor", F.col("id").alias("anchor_id")).join(best.hint("merge"), "anchor")
    out = found.join(named.hint("merge"), "anchor").withColumn("p", F.element_at("positives", F.col("place")))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score")


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
