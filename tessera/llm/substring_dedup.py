"""Removal of word passages that stand more than once in the corpus, by FM-indexes over shards of it.

Every window of `window` words holds runs of `seed` words; the one with the least hash is its anchor, so equal windows
have equal anchors. Consecutive windows with one anchor place make a segment. Only segments whose anchor stands
elsewhere too can hold a repeated window: they alone are cut out of the texts and dealt by anchor to shards. Of segments
with one hash two occurrences are cut out, each from its own place, however many there are: two are enough to show that
the words stand twice, and any further ones are taken for them by their 64-bit hash. A task streams its shard in pieces
of bounded size, cut between anchors, builds a compressed FM-index over each and gets matching statistics of the
segments by backward search; windows whose match reaches `window` words are repeated. An anchor with very many
different segments (a common line) is split by whole window instead, of which again two occurrences at most are indexed,
so that no group grows without bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import carrying, own_fields, staged, with_text
from .fm_index import FMIndex
from .textbytes import Words, grams, owners, powers, mix, slices

#: Places of a window's runs share a 64-bit number with 40 bits of their hash; longer texts are taken in overlapping pieces.
PLACE_BITS = 24
#: Words in one FM-index.
INDEX_WORDS = 400_000
#: Different segments of one anchor beyond which it is split by window.
HOT_SEGMENTS = 2_000


def segments(h: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first window and number of windows of each segment in a row of texts."""
    found = []
    step = (1 << PLACE_BITS) - window - 1
    for a in range(0, max(1, len(h)), step):
        x = h[a : a + step + window - 1]
        if len(x) < window:
            continue
        g = grams(x, seed)
        m = (g & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(g), dtype=np.uint64)
        width, size = window - seed + 1, 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < width:
            m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
        at = np.flatnonzero(owners(np.clip(first - a, 0, len(x)), window, len(x)))
        place = (m[at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        s = np.flatnonzero(new)
        n = np.diff(np.append(s, len(at)))
        p, inv = powers(len(x) + 1)
        cs = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * p[: len(x)], out=cs[1:])
        begin = at[s]
        sh = mix((cs[begin + n + window - 1] - cs[begin]) * inv[begin] + n.astype(np.uint64))
        found.append((g[place[s]], sh, begin + a, n))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _occurrences(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column(2))
            v, sh, at, n = segments(w.hashes(), w.first, window, seed)
            text = np.searchsorted(w.first, at, "right") - 1
            take = pa.array(text)
            yield pa.RecordBatch.from_pydict({"v": pa.array(v.view(np.int64)), "sh": pa.array(sh.view(np.int64)), "k1": b.column(0).take(take), "k2": b.column(1).take(take), "at": pa.array((at - w.first[text]).astype(np.int32)), "n": pa.array(n.astype(np.int32))})

    return run


def _cut(window: int):
    """Rows of (text, list of wanted segments) -> one row a segment, or one a window for hot anchors, with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = {"v": [], "sh": [], "unit": [], "shift": [], "copy": [], "hot": [], "words": []}
            for text, wanted in zip(b.column(0), b.column(1), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                for x in wanted.as_py():
                    own = words[x["at"] : x["at"] + x["n"] + window - 1]
                    for j in range(x["n"]) if x["hot"] else (0,):
                        s = b" ".join(own[j : j + window] if x["hot"] else own)
                        unit = int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) if x["hot"] else x["sh"]
                        for k, y in zip(out, (x["v"], x["sh"], unit, j, x["copy"], x["hot"], s), strict=True):
                            out[k].append(y)
            kinds = {"v": pa.int64(), "sh": pa.int64(), "unit": pa.int64(), "shift": pa.int32(), "copy": pa.int32(), "hot": pa.bool_(), "words": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(y, kinds[k]) for k, y in out.items()})

    return run


def repeated_windows(units: list[bytes], asked: np.ndarray, window: int) -> np.ndarray:
    """For each asked unit (words joined by a space): bits of the windows that stand in the units twice or more."""
    number: dict[bytes, int] = {}
    texts, lengths = [], []
    for u in units:
        own = u.split(b" ")
        lengths.append(len(own))
        texts += [number.setdefault(w, len(number) + 1) for w in own]
        texts.append(0)
    t = np.array(texts, np.int64)
    stop = np.cumsum(np.array(lengths, np.int64) + 1) - 1
    return FMIndex(t, window).repeated(t, (stop - lengths)[asked], stop[asked], window)


def _search(window: int):
    """A stream of units ordered by group -> (v, unit, mask), one FM-index for about INDEX_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last, unit = 0, None, None

        def done() -> pa.RecordBatch:
            # the second copy of a unit would get the same answer
            asked = np.flatnonzero([x[2] == 0 for x in held])
            masks = repeated_windows([x[4] for x in held], asked, window)
            asked, masks = asked[masks != 0].tolist(), masks[masks != 0]
            return pa.RecordBatch.from_pydict({"v": pa.array([held[j][0] for j in asked], pa.int64()), "unit": pa.array([held[j][1] for j in asked], pa.int64()), "mask": pa.array(masks, pa.int64())})

        for b in batches:
            for x in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if unit == x[:3]:  # of rows that repeat an id and a text
                    continue
                unit, group = x[:3], (x[0], x[1] if x[3] else None)
                if size >= INDEX_WORDS and group != last:
                    yield done()
                    held, size = [], 0
                held.append(x)
                size += x[4].count(b" ") + 2
                last = group
        if held:
            yield done()

    return run


def _removed(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            col = {x: b.column(j) for j, x in enumerate(b.schema.names)}
            n_words, n_removed, kept, spans = [], [], [], []
            for text, hits in zip(col["text"], col["hits"], strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n_words.append(len(words))
                if not hits.is_valid:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    spans.append([])
                    continue
                cover = np.zeros(len(words) + 1, np.int32)
                at, mask = (np.asarray(hits.values.field(j)) for j in (0, 1))
                for j in range(int(mask.max()).bit_length()):
                    s = at[(mask >> j) & 1 == 1] + j
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([words[j] for j in np.flatnonzero(~gone)]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"begin": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
            yield pa.RecordBatch.from_pydict({"carried": col["carried"], **({"text": col["text"]} if with_text else {}), "doc_id": col["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))})

    return run


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_removed, kept_text, spans, and a struct of the columns in carry: one row for each row.

    A word (run of other than space and \\x09-\\x0D) goes if a window of `window` words of its text that covers it
    starts anywhere else too, in the same or another text. kept_text joins the others by one space; spans are the
    word ranges that went. Windows are judged on the input. Null and empty texts have no word; null and repeated ids
    are rows like others; texts are whole and of any length; other columns are ignored; an empty table gives one.
    """
    if window - seed + 1 > 62:
        raise ValueError("window - seed + 1 must be at most 62")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(F.col("text").cast("string")).alias("k2"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), own_fields(docs, carry).alias("carried"))
    occ = rows.select("k1", "k2", "text").mapInArrow(_occurrences(window, seed), "v bigint, sh bigint, k1 bigint, k2 bigint, at int, n int")
    occ = staged(occ, "segments")
    # written out, so that a very common anchor's side of the joins can be split
    again = staged(occ.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v"), "anchors")
    dup = staged(occ.join(again.hint("merge"), "v", "left_semi"), "candidates")

    place = F.struct("k1", "k2", "at", "n")
    classes = staged(dup.groupBy("v", "sh").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.count("*").alias("c")), "classes")
    hot = staged(classes.groupBy("v").agg(F.count("*").alias("m")).where(F.col("m") > HOT_SEGMENTS).select("v", F.lit(True).alias("hot")), "hot")
    wanted = classes.join(hot.hint("merge"), "v", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # of rows alike in id and text both occurrences may have one place; they are two all the same
    at = lambda copy, c: F.struct(F.lit(copy).alias("copy"), *(F.col(f"{c}.{x}").alias(x) for x in ("k1", "k2", "at", "n")))
    both = F.when(F.col("c") > 1, F.array(at(0, "one"), at(1, "other"))).otherwise(F.array(at(0, "one")))
    wanted = wanted.select("v", "sh", "hot", F.inline(both))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("v", "sh", "copy", "at", "n", "hot")).alias("wanted"))
    texts = rows.select("k1", "k2", "text").join(wanted.hint("merge"), ["k1", "k2"]).select("text", "wanted")
    cut = texts.mapInArrow(_cut(window), "v bigint, sh bigint, unit bigint, shift int, copy int, hot boolean, words binary")
    cut = staged(cut, "units")

    kinds = ["v", "unit", "copy", "hot", "words"]
    calm = cut.where("not hot").select(kinds)
    # two occurrences of each window at most: the first and the last of (segment, place in it, copy)
    order = F.struct("sh", "shift", "copy")
    split = cut.where("hot").groupBy("v", "unit").agg(F.min(order).alias("one"), F.max(order).alias("other"), F.min_by("words", order).alias("w0"), F.max_by("words", order).alias("w1"))
    again = F.when(F.col("one") == F.col("other"), F.array("w0")).otherwise(F.array("w0", "w1"))
    split = split.select("v", "unit", F.lit(True).alias("hot"), F.posexplode(again).alias("copy", "words")).select(kinds)
    units = calm.unionByName(split)
    units = units.repartition(F.col("v"), F.when(F.col("hot"), F.col("unit"))).sortWithinPartitions("v", "unit", "copy")
    masks = staged(units.mapInArrow(_search(window), "v bigint, unit bigint, mask bigint"), "masks")
    by_class = masks.join(cut.where("not hot").select("v", "unit", "sh").distinct().hint("merge"), ["v", "unit"]).select("v", "sh", "mask")
    by_window = masks.join(cut.where("hot").select("v", "unit", "sh", "shift").distinct().hint("merge"), ["v", "unit"]).groupBy("v", "sh").agg(F.bit_or(F.expr("shiftleft(mask, shift)")).alias("mask"))
    found = staged(by_class.unionByName(by_window), "found")
    hits = dup.select("v", "sh", "k1", "k2", "at").join(found.hint("merge"), ["v", "sh"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "mask")).alias("hits"))
    last = rows.join(hits.hint("merge"), ["k1", "k2"], "left").select("carried", "doc_id", "text", "hits")
    ddl = "text string, " * bool(carry) + "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<begin:int,end:int>>"
    out = last.mapInArrow(_removed(window, bool(carry)), carrying(last.schema["carried"].dataType, ddl))
    return out.withColumn("carried", with_text(docs, carry)).drop("text") if carry else out.drop("carried")
