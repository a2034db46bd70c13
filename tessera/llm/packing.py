"""Best-fit decreasing packing of tokenized documents into sequences of a fixed size.

Best fit only looks at lengths, and there are at most `size` different ones. So the plan is made on the counts of the
lengths, a table whose size doesn't grow with the input: lengths go from the longest down, a segment tree over the
remaining capacities names the tightest open capacity that still holds the length, in a logarithmic number of steps, and
as many documents of the length as fit go to the bins of that capacity at once. The result is that of best-fit
decreasing over all documents of the corpus, not of a shard. The plan says for each length which of its documents, by
rank, go to which bins; ranks come from two-level counts, without a global sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged
from .textbytes import slices
from .tokens import vocabulary, word_tokens

#: Blocks of documents within which ranks are counted; more for pieces of the full size, the commonest length of long documents.
BLOCKS, FULL_BLOCKS = 256, 65_536


class CapacityTree:
    """A segment tree over remaining capacities 0..size: how many open bins have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += n
            k //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least `need` that an open bin has."""
        k = self.leaves + need
        if self.count[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k *= 2
                    if not self.count[k]:
                        k += 1
                return k - self.leaves
            k //= 2
        return None


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Documents of each length -> runs (length, first rank, past last rank, first bin, documents a bin, first place).

    Documents of a run, by rank, fill bins from the first on, so many to a bin, from the same place in each bin.
    """
    tree = CapacityTree(size)
    open_: dict[int, list[list[int]]] = {}
    runs, bins = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_.setdefault(capacity, []).append([first, n])
            tree.add(capacity, n)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            capacity = tree.tightest(length)
            if capacity is None:  # new bins for all that are left
                capacity, left = size, n - rank
                first, have = bins, -(-left // (size // length))
                bins += have
            else:
                first, have = open_[capacity].pop()
                tree.add(capacity, -have)
            each = capacity // length
            full = min(have, (n - rank) // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, size - capacity))
                rank += full * each
                put(capacity - each * length, first, full)
            rest = n - rank if full < have else 0
            if rest:
                runs.append((length, rank, n, first + full, rest, size - capacity))
                rank = n
                put(capacity - rest * length, first + full, 1)
                full += 1
            put(capacity, first + full, have - full)
    return runs


def _pieces(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path, end)
        for b in slices(batches):
            ids, first = tokens.encode(b.column(1))
            n = np.diff(first)
            each = -(-n // size)
            doc = np.repeat(np.arange(b.num_rows), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            begin = first[doc] + piece * size
            stop = np.minimum(begin + size, first[doc + 1])
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(piece * size), "length": pa.array(stop - begin), "ids_crc32": pa.array(crc, pa.int64())})

    return run


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Rows with doc_id, piece and length (1..size) -> the same rows with sequence_id and offset."""
    blocks = F.when(F.col("length") == size, FULL_BLOCKS).otherwise(BLOCKS)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), blocks))
    pieces = staged(pieces.withColumn("n", F.row_number().over(Window.partitionBy("block", "length").orderBy("doc_id", "piece", "ids_crc32"))), "pieces")
    # at most size * BLOCKS + FULL_BLOCKS rows
    blocks = pieces.groupBy("length", "block").agg(F.max("n").cast("bigint").alias("m"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    # at most `size` rows
    counts = {x["length"]: x["m"] for x in pieces.groupBy("length").agg(F.count("*").alias("m")).collect()}
    # an Arrow table, as rows of Python would start workers of another kind on the executors, which stay beside the others
    runs = np.array(plan(counts, size) or [(0, 0, 0, 0, 1, 0)], np.int64)
    runs = pieces.sparkSession.createDataFrame(pa.table(dict(zip(("length", "lo", "hi", "first", "each", "place"), runs.T.copy(), strict=True))))
    # runs are a few a length, so the broadcast table has a bound whatever the input
    ranked = pieces.join(blocks.drop("m").hint("merge"), ["length", "block"]).withColumn("rank", F.col("before") + F.col("n") - 1)
    at = F.col("rank") - F.col("lo")
    packed = ranked.join(F.broadcast(runs), "length").where("rank >= lo and rank < hi")
    packed = packed.withColumn("sequence_id", F.col("first") + F.floor(at / F.col("each"))).withColumn("offset", F.col("place") + at % F.col("each") * F.col("length"))
    return packed.drop("block", "n", "before", "rank", "lo", "hi", "first", "each", "place")


def pack_documents(docs: DataFrame, size: int = 4096, end: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, text -> doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    A document is its text's ids and then `end`; only one longer than `size` is cut, into pieces of `size`, the last
    may be shorter. Null and empty texts are `end` alone. sequence_id names a sequence of at most `size` ids and offset
    is the piece's place in it, without gaps. Null ids and repeated rows are packed like others; an empty table gives
    one. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(path or vocabulary(), size, end), PIECES)
    return pack(pieces, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
