"""Benchmark passages in training texts, by a positional inverted index.

The index holds a posting (term, document, place) for each training word that some test text uses, in Parquet files
that are each sorted by term: document-partitioned lists. A phrase is looked up from its rarest terms: the lists of
the two rarest, each shifted by its offset in the phrase, are intersected, and what is left is compared with the text,
word by word. Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

#: What stands between words, with A-Z kept for the later lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes up to which a table made from the test texts, or a list of candidate ids, is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20
#: The id of a row's end mark, whose place is its number of words.
END = -1


def words_of(text: Column) -> Column:
    """Words of a text, A-Z not yet lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(text, BETWEEN), ""), F.array().cast("array<string>"))


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased and nothing else; the short way for words of one-byte characters."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def small(df: DataFrame, size: int) -> DataFrame:
    """A join side of a known number of bytes: broadcast up to the bound, sorted and merged beyond it."""
    return df.hint("broadcast" if size <= BROADCAST_BYTES else "merge")


def weigh(df: DataFrame, *lists: str) -> int:
    """Bytes of a written table: numbers at eight each and a row's own sixteen, and the words of lists as they are."""
    numbers = [c for c in df.columns if c not in lists]
    words = sum((F.octet_length(F.array_join(c, "")) + 24 * F.size(c) for c in lists), F.lit(0))
    x = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(words), F.lit(0)).alias("words")).first()
    return x["n"] * (16 + 8 * len(numbers)) + x["words"]


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2, text: rows that share an id and a text are alike in every result, others are told apart."""
    k1, k2 = key_of(docs)
    return docs.select(k1.alias("k1"), k2.alias("k2"), docs["text"].cast("string").alias("text"))


def key_of(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-(1 << 63))), F.xxhash64(docs["text"].cast("string"))


def id_of(k1: Column) -> Column:
    return F.when(k1 != F.lit(-(1 << 63)), k1)


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item_id, text -> item_id, window, words: each run of `size` words; a shorter text, but not an empty one, is one."""
    w = items.select("item_id", words_of(F.col("text").cast("string")).alias("w")).select("item_id", F.transform("w", lower_ascii).alias("w")).where(F.size("w") > 0)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))
    return w.select("item_id", F.posexplode(parts).alias("window", "words"))


@dataclass
class Index:
    """Postings (t, k1, k2, pos) with the term numbers (term, t) and their bytes, and how many postings each term has (t, n)."""

    postings: DataFrame
    terms: DataFrame
    size: int
    counts: DataFrame


def build_index(docs: DataFrame, vocabulary: DataFrame) -> Index:
    """Index doc_id, text for the words in vocabulary (term). Each row also gets an end mark, so none is lost."""
    terms = vocabulary.select("term").distinct().select("term", F.xxhash64("term").alias("t"))
    mark = docs.sparkSession.range(1).select(F.lit("\0").alias("term"), F.lit(END).cast("bigint").alias("t"))
    terms = staged(terms.unionAll(mark), "terms")
    n = weigh(terms.select("t", F.array("term").alias("term")), "term")
    marked = keyed(docs).select("k1", "k2", F.posexplode(F.concat(words_of(F.col("text")), F.array(F.lit("\0")))).alias("pos", "word"))
    postings = marked.select("k1", "k2", "pos", lower_ascii(F.col("word")).alias("term")).join(small(terms, n), "term").select("t", "k1", "k2", "pos")
    postings = staged(postings.sortWithinPartitions("t", "k1", "k2", "pos"), "postings")
    return Index(postings, terms, n, staged(postings.where(F.col("t") != END).groupBy("t").agg(F.count("*").alias("n")), "counts"))


def _rarest(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase, words -> phrase, words, and term and offset of the rarest (t1, o1) and second rarest (t2, o2) word.

    A phrase with a word that the index lacks is left out: it stands nowhere.
    """
    x = phrases.select("phrase", F.size("words").alias("len"), F.posexplode("words").alias("o", "term"))
    x = x.join(small(index.terms, index.size), "term").join(small(index.counts, index.size), "t")
    r = x.withColumn("r", F.row_number().over(Window.partitionBy("phrase").orderBy("n", "o")))
    r = r.groupBy("phrase", "len").agg(F.count("*").alias("have"), *(F.max(F.when(F.col("r") == j, F.col(c))).alias(f"{c}{j}") for j in (1, 2) for c in ("t", "o")))
    return r.where("have = len").join(phrases.hint("merge"), "phrase").drop("have")


def phrase_matches(docs: DataFrame, index: Index, phrases: DataFrame) -> DataFrame:
    """phrase, words -> k1, k2, phrase, start, len: every exact occurrence in the indexed texts, once for each key."""
    plan = staged(_rarest(index, phrases), "plan")
    n = weigh(plan, "words")
    first = index.postings.join(small(plan.select(F.col("t1").alias("t"), "phrase", "o1", "o2", "t2", "len"), n), "t")
    first = first.select("k1", "k2", "phrase", "len", (F.col("pos") - F.col("o1")).alias("start"), "o2", "t2").where("start >= 0")
    second = index.postings.join(small(plan.select(F.col("t2").alias("t")).distinct(), n), "t", "left_semi").select(F.col("t").alias("t2"), "k1", "k2", F.col("pos").alias("pos2"))
    both = first.where("t2 is not null").withColumn("pos2", F.col("start") + F.col("o2")).join(second.hint("merge"), ["k1", "k2", "t2", "pos2"], "left_semi")
    near = both.select("k1", "k2", "phrase", "len", "start").unionAll(first.where("t2 is null").select("k1", "k2", "phrase", "len", "start"))
    near = near.join(small(plan.select("phrase", "words"), n), "phrase").select("k1", "k2", F.struct("start", "len", "phrase", "words").alias("hit"))
    near = staged(near.groupBy("k1", "k2").agg(F.collect_set("hit").alias("hits")), "candidates")
    m = weigh(near.select("k1", "k2"))
    texts = keyed(docs).join(small(near.select("k1", "k2"), m), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    seen = texts.join(near.hint("merge"), ["k1", "k2"]).select("k1", "k2", words_of(F.col("text")).alias("w"), "hits")
    same = lambda h: F.transform(F.slice("w", h["start"] + 1, h["len"]), lower_ascii) == h["words"]
    found = seen.select("k1", "k2", F.filter("hits", same).alias("hits")).where(F.size("hits") > 0)
    return found.select("k1", "k2", F.explode("hits").alias("h")).select("k1", "k2", "h.phrase", "h.start", "h.len")


def proximity_matches(index: Index, phrases: DataFrame, slack: int = 5) -> DataFrame:
    """phrase, words -> k1, k2, phrase, place: where all words of a phrase stand, in any order, near its rarest word.

    Near: within the phrase's length and `slack` words more, on either side of the rarest word at `place`. Phrases without
    a word, null phrases, and those with a word that the index lacks, match nothing; so do null and empty texts. Repeated
    rows of an id and a text give one match; an empty index or table of phrases gives an empty table.
    """
    plan = staged(_rarest(index, phrases), "plan")
    n = weigh(plan, "words")
    rare = index.postings.join(small(plan.select(F.col("t1").alias("t"), "phrase", "len"), n), "t").select("k1", "k2", "phrase", "len", F.col("pos").alias("place"))
    of = plan.select("phrase", F.explode(F.array_distinct("words")).alias("term")).join(small(index.terms, index.size), "term").select("phrase", "t")
    need = of.groupBy("phrase").agg(F.count("*").alias("need"))
    wide = rare.join(small(of, n), "phrase")
    # terms meet their postings only in the stretches of a text that are in reach
    step, reach = F.lit(64) + slack, F.col("len") + slack
    near = F.sequence(F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / step), F.floor((F.col("place") + reach) / step))
    a = wide.withColumn("stretch", F.explode(near))
    b = index.postings.withColumn("stretch", F.floor(F.col("pos") / step))
    met = a.join(b.hint("merge"), ["k1", "k2", "t", "stretch"]).where(F.abs(F.col("pos") - F.col("place")) <= reach)
    return met.groupBy("k1", "k2", "phrase", "place").agg(F.count_distinct("t").alias("have")).join(small(need, n), "phrase").where("have = need").select("k1", "k2", "phrase", "place")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, text; item_id, text -> doc_id, n_words, n_hit, n_items, items, hits, contaminated: one row for each row.

    Words are runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased. A document's word is hit inside any
    occurrence of a window of `size` consecutive words of an item (a shorter item is one window). items lists the items
    with an occurrence, as sorted strings; hits are the word ranges. Null and empty texts have no words and match
    nothing; null and repeated ids are rows like others; an item with a null id counts as one with the id ''. An empty
    documents table gives an empty table, an empty items table no hit. Other columns are ignored.
    """
    return _contamination(docs, items, size).select(id_of(F.col("k1")).alias("doc_id"), "n_words", "n_hit", "n_items", "items", "hits", "contaminated")


def _contamination(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """contamination() by the keys of keyed()."""
    windows = windows_of(items, size).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "words")
    windows = staged(windows.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("phrase"), "words", "items"), "windows")
    index = build_index(docs, windows.select(F.explode("words").alias("term")))
    found = phrase_matches(docs, index, windows.select("phrase", "words"))
    found = found.join(small(windows.select("phrase", "items"), weigh(windows.select("phrase", "items"), "items")), "phrase")
    each = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    step = lambda a, h: F.struct(F.greatest(a["end"], h["start"] + h["len"]).alias("end"), (a["n"] + F.greatest(h["start"] + h["len"] - F.greatest(a["end"], h["start"]), F.lit(0))).alias("n"))
    each = each.withColumn("n_hit", F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"])
    rows = index.postings.where(F.col("t") == END).select("k1", "k2", F.col("pos").cast("bigint").alias("n_words"))
    out = rows.join(each.hint("merge"), ["k1", "k2"], "left")
    n_hit = F.coalesce(F.col("n_hit").cast("bigint"), F.lit(0))
    none = F.array().cast("array<string>")
    return out.select("k1", "k2", "n_words", n_hit.alias("n_hit"), F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"), F.coalesce("items", none).alias("items"), "hits", (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, all columns, in which no window of a test item stands. Each row is judged by its own text."""
    hit = staged(_contamination(docs, items, size).where("contaminated").select(F.col("k1").alias("hit1"), F.col("k2").alias("hit2")).distinct(), "contaminated")
    k1, k2 = key_of(docs)
    return docs.join(small(hit, weigh(hit)), (k1 == hit["hit1"]) & (k2 == hit["hit2"]), "left_anti")
