"""MinHash near-duplicate groups with odd sketches.

Each text's distinct word shingles give MinHash samples. Samples in bands name candidate buckets; the same samples,
folded into a parity bitmap (an odd sketch), give the size of the symmetric difference of two sample sets from the
population count of the XOR of their bitmaps, and so an estimate of high similarities. Candidates whose estimate is
far under the threshold go; the others are confirmed on their full shingle sets.

Work stays bounded for large groups. Equal sets are one node. A bucket first ties its members to its smallest member. Of
members of buckets that then still hold several components, those meet that share one of their rarest shingles and have
enough shingles left after it (exact filters: texts that only share boilerplate, or aren't quite similar enough, don't
meet); and the largest component with a shingle is met by the others, not compared with itself. No pair is cut by a cap.

A node's name is a 64-bit hash of its set.

Chance of losing a link at similarity 0.75: all 40 bands differ (0.684**40, about 3e-7), or the sketches' estimate is
more than 4.5 standard deviations low (about 3e-6); links of higher similarity are lost far more seldom.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import spare, staged
from .components import connected_components
from .textbytes import Words, grams, mix, owners, slices

BANDS, ROWS = 40, 4
#: Bits of a sketch, and how many standard deviations under the threshold an estimate must be for its pair to go.
BITS, DEVIATIONS = 512, 4.5


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the k-word shingles of each text, sorted within it, and each text's first place."""
    h, first = words.hashes(), words.first
    g, ok = grams(h, k), owners(first, k, len(h))
    text = np.searchsorted(first, np.arange(len(g)), "right") - 1
    g, text = g[ok], text[ok]
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            at = np.minimum(first[few] + j, len(h) - 1)
            own = np.where(j < n[few], mix(own * np.uint64(31) + h[at] + np.uint64(j)), own)
        g, text = np.concatenate([g, own]), np.concatenate([text, few])
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    g, text = g[keep], text[keep]
    return g, np.searchsorted(text, np.arange(len(first)))


def minhashes(g: np.ndarray, first: np.ndarray, samples: int, seed: int = 7) -> np.ndarray:
    """samples MinHash values of each non-empty set: rows are sets in order."""
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), samples), np.uint64)
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, samples, np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, samples, np.uint64)
    for r in range(samples if len(at) else 0):
        x = g * a[r] + b[r]
        x ^= x >> np.uint64(32)
        x *= a[r]
        out[:, r] = np.minimum.reduceat(x, at)
    return out


def odd_sketch(m: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of the samples (row by row), as signed 64-bit words."""
    place = (mix(m ^ mix(np.arange(1, m.shape[1] + 1, dtype=np.uint64))) % np.uint64(bits)).astype(np.int64)
    count = np.zeros((len(m), bits), np.uint8)
    np.add.at(count, (np.repeat(np.arange(len(m)), m.shape[1]), place.ravel()), 1)
    return np.packbits(count & 1, axis=1).view(">u8").astype(np.uint64).view(np.int64)


def least_agreement(similarity: float, samples: int, bits: int, deviations: float) -> int:
    """The largest XOR population count that a pair of this similarity has, so many standard deviations off."""
    s = similarity - deviations * math.sqrt(similarity * (1 - similarity) / samples)
    difference = 2 * samples * (1 - s)
    p = (1 - (1 - 2 / bits) ** difference) / 2
    return min(bits, math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p))))


def _signatures(k: int, kind: str):
    """mapInArrow function: the other columns and either the signature or the shingle set of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text"))
            g, first = shingles(Words(texts, lower=True), k)
            n = np.diff(first)
            some = n > 0
            cols = {x: b.column(j) for j, x in enumerate(b.schema.names) if x != "text"}
            if kind == "set":
                cols["set"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(g.view(np.int64)))
            else:
                m = minhashes(g, first, BANDS * ROWS)
                z = np.zeros((len(n), BITS // 64), np.int64)
                z[some] = odd_sketch(m, BITS)
                keys = np.zeros((len(n), BANDS), np.int64)
                for j in range(BANDS):
                    key = np.full(len(m), j + 1, np.uint64)
                    for r in range(ROWS):
                        key = mix(key * np.uint64(31) + m[:, j * ROWS + r])
                    keys[some, j] = key.view(np.int64)
                whole = np.zeros(len(n), np.uint64)
                if len(g):
                    at = first[:-1][some]
                    whole[some] = mix(np.add.reduceat(mix(g), at) ^ mix(np.bitwise_xor.reduceat(mix(g + np.uint64(0x51)), at) + n[some].astype(np.uint64)))
                cols |= {"n": pa.array(n), "node": pa.array(whole.view(np.int64))}
                cols |= {f"b{j}": pa.array(keys[:, j]) for j in range(BANDS)} | {f"o{j}": pa.array(z[:, j]) for j in range(z.shape[1])}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _longs(letter: str, n: int) -> str:
    return ", ".join(f"{letter}{j} bigint" for j in range(n))


def _xor_count(letter: str, n: int, x: str, y: str) -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}.{letter}{j}").bitwiseXOR(F.col(f"{y}.{letter}{j}"))) for j in range(n)))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    x = pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")).hint("merge"), "v")
    y = x.join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")).hint("merge"), "u")
    both = y.select("u", "v", F.size("su").alias("a"), F.size("sv").alias("b"), F.size(F.array_intersect("su", "sv")).alias("c"))
    return both.where(F.col("c") * 100 >= percent * (F.col("a") + F.col("b") - F.col("c"))).select("u", "v")


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component), (node, set) -> pairs (u, v) of nodes of different components that may be linked. No link is lost.

    Sets are listed from their rarest shingle on; shingles of one set alone are met by nothing and only counted. Of two
    linked sets some shingle is among the first (100 - percent) in a hundred, and one more, of both; and after the first
    such shingle both have enough left for the overlap that they need. Shingles of one component go, and of the others'
    largest component the nodes aren't met with each other.
    """
    x = sets.join(members.hint("merge"), "node").select("node", "component", F.size("set").alias("n"), F.explode("set").alias("t"))
    shared = x.groupBy("t").agg(F.count("*").alias("c"), (F.min("component") != F.max("component")).alias("mixed")).where("c > 1")
    own = x.join(staged(shared, "shared").hint("merge"), "t").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t", "mixed"))).alias("own"))
    own = own.withColumn("alone", F.col("n") - F.size("own")).withColumn("room", F.expr(f"n * {100 - percent} div 100 + 1 - alone")).where("room > 0")
    first = own.select("node", "component", "n", "alone", F.posexplode(F.slice("own", F.lit(1), F.col("room").cast("int"))).alias("i", "s")).where("s.mixed")
    first = staged(first.select(F.col("s.t").alias("t"), "node", "component", "n", (F.col("alone") + F.col("i") + 1).alias("place")), "prefixes")
    homes = first.groupBy("t", "component").agg(F.count("*").alias("m")).groupBy("t").agg(F.max_by("component", F.struct("m", "component")).alias("home"), F.count("*").alias("k")).where("k > 1")
    rows = staged(first.join(staged(homes.select("t", "home"), "homes").hint("merge"), "t"), "rows")
    left = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = left * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    once = (F.col("y.component") == F.col("y.home")) | (F.col("x.node") < F.col("y.node"))
    on = (F.col("x.t") == F.col("y.t")) & (F.col("x.component") != F.col("y.component")) & enough & once
    pairs = rows.where("component <> home").alias("x").join(rows.alias("y").hint("merge"), on)
    return pairs.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def near_texts(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, text -> doc_id, k2 (hash of the text), n, component: one row for each row with an id, judged by its own text.

    Links as in near_duplicates(), but rows that share an id are not tied. A component is named by a node of it, and is
    null if n, the number of shingles, is 0. The table is written to the shared folder.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("k2"), text.alias("text")).where("doc_id is not null")
    schema = f"doc_id bigint, k2 bigint, n bigint, node bigint, {_longs('b', BANDS)}, {_longs('o', BITS // 64)}"
    sigs = staged(texts.mapInArrow(_signatures(k, "sig"), schema), "signatures")

    # equal sets are one node, named by the set's hash; a row of the smallest id stands for it
    classes = sigs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    reps = staged(sigs.where("n > 0").join(classes.hint("merge"), ["doc_id", "node"], "left_semi").dropDuplicates(["node"]), "nodes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        own = reps.select("node", "doc_id", "k2").join(nodes.hint("merge"), "node", "left_semi")
        return texts.join(own.hint("merge"), ["doc_id", "k2"]).select("node", "text")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
        return staged(texts_of(ends).mapInArrow(_signatures(k, "set"), "node bigint, set array<bigint>").dropDuplicates(["node"]), "sets")

    bands = reps.select("node", "doc_id", F.explode(F.array(*(F.col(f"b{j}") for j in range(BANDS)))).alias("key"))
    heads = staged(bands.groupBy("key").agg(F.min_by("node", "doc_id").alias("head"), F.count("*").alias("m")).where("m > 1").select("key", "head"), "heads")
    inside = staged(bands.drop("doc_id").join(heads.hint("merge"), "key"), "buckets")

    sketch = reps.select("node", "n", *(f"o{j}" for j in range(BITS // 64)))
    near = _xor_count("o", BITS // 64, "x", "y") <= least_agreement(percent / 100, BANDS * ROWS, BITS, DEVIATIONS)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and sketches allow for a link."""
        both = pairs.join(sketch.alias("x").hint("merge"), F.col("x.node") == F.col("u")).join(sketch.alias("y").hint("merge"), F.col("y.node") == F.col("v"))
        return both.where((F.least("x.n", "y.n") * 100 >= percent * F.greatest("x.n", "y.n")) & near).select("u", "v")

    # first each bucket's member of the smallest id with the others
    star = inside.where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).distinct()
    star = staged(verified(star), "star")
    links = staged(confirmed(star, sets_of(star), percent), "links")
    comps = staged(connected_components(links), "components")

    # then members of different components, in buckets that hold several
    placed = inside.join(comps.select(F.col("id").alias("node"), "component").hint("merge"), "node", "left")
    placed = staged(placed.select("key", "node", F.coalesce("component", "node").alias("component")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    members = staged(placed.join(staged(mixed, "mixed").hint("merge"), "key", "left_semi").select("node", "component").distinct(), "members")
    sets = staged(texts_of(members.select("node")).mapInArrow(_signatures(k, "set"), "node bigint, set array<bigint>").dropDuplicates(["node"]), "sets")
    more = confirmed(verified(across(members, sets, percent)), sets, percent)

    ends = staged(connected_components(links.unionAll(more)), "components")
    out = sigs.select("doc_id", "k2", "n", "node").join(ends.withColumnRenamed("id", "node").hint("merge"), "node", "left")
    return staged(out.select("doc_id", "k2", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component")), "texts")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, kept: one row for each row with an id.

    Two texts are linked if their sets of distinct k-word shingles (A-Z lower-cased, words between white space) have
    Jaccard similarity of percent / 100 or more; a text of fewer words is one shingle. Null and empty texts have no
    shingle, are linked with nothing and kept. Rows of a null doc_id are left out; rows that share an id share its
    component, with the links of all their texts. Other columns are ignored. Texts are whole and of any length; an empty
    table gives an empty table.
    """
    rows = near_texts(docs, k, percent)
    own = rows.where("component is not null").groupBy("doc_id").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    own = staged(own, "ids")
    # ids of several texts tie their components
    several = own.where("lo <> hi").select("doc_id", "lo")
    tied = connected_components(rows.join(several.hint("merge"), "doc_id").select(F.col("lo").alias("u"), F.col("component").alias("v")).where("v is not null"))
    own = own.select("doc_id", "lo").join(tied.select(F.col("id").alias("lo"), "component").hint("merge"), "lo", "left").select("doc_id", F.coalesce("component", "lo").alias("component"))
    own = staged(own, "ids")
    least = staged(own.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    own = own.join(least.hint("merge"), "component").select("doc_id", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(own.hint("merge"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, less near-duplicates: of each component of near_texts() the row of the smallest id,
    and of the smallest text hash under it, stays. Of rows alike in id and text any one stays; rows of a null id all do.
    """
    rows = near_texts(docs, k, percent)
    kept = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "k2")).alias("r")).select("r.doc_id", "r.k2")
    kept = kept.unionAll(rows.where("component is null").select("doc_id", "k2").distinct()).select(F.col("doc_id").alias("kept_id"), F.col("k2").alias("kept_k2"))
    k2 = spare(docs.columns)
    named = docs.where("doc_id is not null").withColumn(k2, F.xxhash64(F.col("text").cast("string")))
    named = named.join(kept.hint("merge"), (F.col("doc_id").cast("bigint") == F.col("kept_id")) & (F.col(k2) == F.col("kept_k2")), "left_semi")
    return named.dropDuplicates(["doc_id", k2]).select(*(F.col(f"`{c}`") for c in docs.columns)).unionAll(docs.where("doc_id is null"))
