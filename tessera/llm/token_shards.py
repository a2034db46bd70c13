"""Token sequences in training order, in shards of fixed stride.

Documents are dealt to blocks by a hash of their id and text; a block's documents, in the order of id and text, are joined end
to end and cut into sequences of one length. A keyed Feistel permutation with cycle-walking gives each sequence its slot in
the order of training, without a sort or a table of the whole order. So slots follow from the corpus and the key alone,
however the input is split. Each partition is a range of slots and writes one shard: a sequence's file and place follow from
its slot, so a reader goes on anywhere without an index.

The permutation needs the number of sequences, so texts are tokenized twice: once for each block's number of ids, once for
the ids. That takes less disk than keeping all ids between the two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch, staged
from .files import read_file, write_file
from .textbytes import mix, slices
from .tokens import vocabulary, word_tokens

ROUNDS = 4
#: Bytes of text in a block, if that makes no more than MAX_BLOCKS of them; so the table of blocks has a bound whatever the input.
BLOCK_BYTES, MAX_BLOCKS = 32 << 20, 1 << 16


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network on the next power of four, walked until it is in range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.uint64(key & ((1 << 64) - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    y = np.asarray(x).astype(np.uint64)
    walk = np.arange(len(y))
    while len(walk):
        left, right = y[walk] >> np.uint64(half), y[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        y[walk] = (left << np.uint64(half)) | right
        walk = walk[y[walk] >= np.uint64(n)]
    return y.astype(np.int64)


def _counts(path: str, end: int):
    """(block, text) -> partial numbers of ids of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = word_tokens(path, end), {}
        for b in slices(batches):
            n = np.diff(tokens.encode(b.column(1))[1])
            for block, size in zip(b.column(0).to_pylist(), n.tolist(), strict=True):
                total[block] = total.get(block, 0) + size
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def _encoded(path: str, end: int):
    """Rows with a text -> the others and the text's ids as deflated 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path, end)
        for b in slices(batches):
            ids, first = tokens.encode(b.column(b.schema.get_field_index("text")))
            data = memoryview(ids.astype("<u2").tobytes())
            packed = [zlib.compress(data[2 * x : 2 * y], 1) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            cols = {n: b.column(j) for j, n in enumerate(b.schema.names) if n != "text"}
            yield pa.RecordBatch.from_pydict(cols | {"ids": pa.array(packed, pa.binary())})

    return run


def _sequences(length: int, before: dict[int, int], n: int, key: int):
    """(block, ids) ordered by block and document -> slot, n_tokens, ids; the last sequence of a block may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, number, size = None, b"", 0, 2 * length

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal held, number
            parts = [held[k : k + size] for k in range(0, len(held) if last else len(held) // size * size, size)]
            slots = feistel(before[block] + number + np.arange(len(parts)), n, key)
            held, number = held[len(parts) * size :], number + len(parts)
            return pa.RecordBatch.from_pydict({"slot": pa.array(slots), "n_tokens": pa.array([len(x) // 2 for x in parts], pa.int32()), "ids": pa.array([zlib.compress(x, 1) for x in parts], pa.binary())})

        for b in batches:
            blocks, ids = b.column(0).to_numpy(), b.column(b.num_columns - 1)
            edge = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)) if len(blocks) else []
            for x, y in zip(edge, [*edge[1:], len(blocks)], strict=True):
                if block is not None and blocks[x] != block:
                    yield cut(last=True)
                    number = 0
                block = int(blocks[x])
                held += b"".join(zlib.decompress(v) for v in ids.slice(x, y - x).to_pylist())
                yield cut(last=False)
        if block is not None:
            yield cut(last=True)

    return run


def _shards(uri: str, per_shard: int, length: int):
    """Rows ordered by slot -> files; each shard is written whole when its last row has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, data = None, bytearray()

        def done() -> pa.RecordBatch:
            name = f"{uri}/shard-{shard:08d}.bin"
            write_file(name, bytes(data))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [name], "first_slot": pa.array([shard * per_shard], pa.int64()), "rows": pa.array([len(data) // (2 * length + 4)], pa.int64())})

        for b in batches:
            for slot, n_tokens, ids in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                if slot // per_shard != shard:
                    if shard is not None:
                        yield done()
                    shard, data = slot // per_shard, bytearray()
                raw = zlib.decompress(ids)
                data += np.array([n_tokens], "<u4").tobytes() + raw + bytes(2 * length - len(raw))
        if shard is not None:
            yield done()

    return run


def write_shards(docs: DataFrame, uri: str, length: int = 2048, per_shard: int = 8192, key: int = 1337, end: int = 1, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, text -> shard files under a folder. Returns their manifest (shard, file, first_slot, rows) and the number of slots.

    A file is rows of one stride: the number of ids as an unsigned 32-bit number, then `length` unsigned 16-bit ids, padded
    with zeros. Null and empty texts are their end id; null ids are ids like others; repeated rows all stay, and those
    alike in id and text share a block; other columns are ignored; an empty table gives an empty manifest. Vocabularies of
    more than 65,536 ids are refused.
    """
    path = path or vocabulary()
    if word_tokens(path, end).tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids don't fit 16 bits")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k2", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = min(MAX_BLOCKS, max(1, -(-size // block_bytes)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "k2"), F.lit(blocks)))
    counts = rows.select("block", "text").mapInArrow(_counts(path, end), "block bigint, n bigint").groupBy("block").agg(F.sum("n").alias("n"))
    # at most MAX_BLOCKS rows
    before, n = {}, 0
    for x in sorted(counts.collect()):
        before[x["block"]] = n
        n += -(-x["n"] // length)
    ids = rows.select("block", "doc_id", "k2", "text").mapInArrow(_encoded(path, end), "block bigint, doc_id bigint, k2 bigint, ids binary")
    ids = ids.repartition(blocks, "block").sortWithinPartitions("block", "doc_id", "k2")
    placed = ids.mapInArrow(_sequences(length, before, n, key), "slot bigint, n_tokens int, ids binary")
    # a partition is the range of slots of one shard
    placed = placed.repartitionById(max(1, -(-n // per_shard)), F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot")
    return staged(placed.mapInArrow(_shards(uri, per_shard, length), "shard bigint, file string, first_slot bigint, rows bigint"), "shards"), n


def read_slots(spark: SparkSession, manifest: DataFrame, length: int = 2048, start: int = 0) -> DataFrame:
    """slot, shard, offset, n_tokens, ids_crc32, read from the shard files from slot `start` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = 2 * length + 4
        for b in batches:
            for shard, file, first in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                skip = max(0, start - first) * stride
                data = np.frombuffer(read_file(file, skip), np.uint8).reshape(-1, stride)
                n = data[:, :4].copy().view("<u4")[:, 0]
                ids = data[:, 4:].copy().view("<u2")
                crc = [zlib.crc32(x[:k].astype("<u4").tobytes()) for x, k in zip(ids, n, strict=True)]
                slot = first + skip // stride + np.arange(len(n))
                yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "shard": pa.array([shard] * len(n), pa.int64()), "offset": pa.array((slot - first) * stride, pa.int64()), "n_tokens": pa.array(n.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    rows = manifest.where(F.col("first_slot") + F.col("rows") > start).select("shard", "file", "first_slot")
    return rows.repartition(max(8, spark.sparkContext.defaultParallelism), "shard").mapInArrow(run, "slot bigint, shard bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")


def materialised(docs: DataFrame, uri: str | None = None, length: int = 2048) -> DataFrame:
    """doc_id, text -> shards on the shared folder, and what read_slots() reads from them: one row for each slot.

    Nulls, empty and long texts, repeated rows, other columns and empty tables: as in write_shards().
    """
    spark = docs.sparkSession
    manifest, _ = write_shards(docs, uri or scratch(spark, "shards"), length)
    return read_slots(spark, manifest, length)
