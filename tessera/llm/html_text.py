"""Main text of web pages: flat blocks, classified by a decision tree over their own and their neighbours' words and link density.

After Kohlschütter, Fankhauser and Nejdl, "Boilerplate detection using shallow text features" (2010). What that leaves
open, namely short paragraphs of an article and short notices beside it, is told apart by three more features: whether the
page's markup names a block's place as one beside the article, or as the article, and whether it is a heading.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .html_blocks import FEATURES, blocks, features

#: Labelled blocks, a page to a paragraph: words, words in links, beside the article, in the article, heading, kept.
#: They are made up after usual layouts; no given page is among them.
LABELLED = """
1 1 1 0 0 0
1 1 1 0 0 0
2 2 1 0 0 0
8 0 1 0 0 0
9 0 0 1 1 1
62 0 0 1 0 1
1 0 0 1 0 1
118 3 0 1 0 1
4 0 0 1 0 1
35 0 0 1 0 1
11 0 1 0 0 0

14 14 1 0 0 0
30 2 1 0 0 0
6 0 0 1 1 1
3 0 0 1 0 1
80 6 0 1 0 1
5 0 0 1 1 1
7 0 0 1 0 1
12 1 0 1 0 1
2 0 0 1 0 1
6 6 0 1 0 0
44 0 1 1 0 0
52 0 1 1 0 0
20 12 1 0 0 0

2 2 0 0.5 0 0
3 3 0 0.5 0 0
1 1 0 0.5 0 0
7 0 0 0.5 1 1
95 2 0 0.5 0 1
64 0 0 0.5 0 1
9 0 0 0.5 0 1
130 9 0 0.5 0 1
4 0 0 0.5 1 1
48 0 0 0.5 0 1
8 8 0 0.5 0 0
7 7 0 0.5 0 0
9 9 0 0.5 0 0
11 3 0 0.5 0 0

4 4 0 0.5 0 0
12 12 0 0.5 0 0
6 0 0 0.5 0 0
5 5 0 0.5 0 0
70 1 0 0.5 0 1
6 6 0 0.5 0 0
5 0 0 0.5 0 0
10 8 0 0.5 0 0

6 0 1 0.5 1 0
2 0 1 0.5 0 0
24 0 1 0.5 0 0
3 3 1 0.5 0 0
12 4 0 0.5 0 0

5 0 0 0.5 0 1

3 0 0 0.5 1 1
12 0 0 0.5 0 1
7 0 0 0.5 0 1
1 0 0 0.5 0 1

10 10 0 0 0 0
42 0 0 0 0 0
3 0 0 0 1 0
8 8 0 1 1 1
75 15 0 1 0 1
24 5 0 1 0 1
3 3 0 1 0 0
16 0 0 1 0 1
90 0 0 0 0 0
4 0 0 0 1 0
6 6 0 0 0 0

40 40 1 0 0 0
55 1 1 0 0 0
11 0 0 1 1 1
1 0 0 1 0 1
1 0 0 1 0 1
14 0 0 1 0 1
22 0 1 1 0 0
210 4 0 1 0 1
4 0 0 1 1 1
1 0 0 1 0 1
26 0 1 0 0 0
3 0 1 0 0 0
60 0 1 0 0 0
9 2 1 0 0 0

5 5 0 0.5 0 0
4 4 0 0.5 0 0
10 0 0 0.5 1 1
26 0 0 0.5 0 1
31 3 0 0.5 0 1
18 0 0 0.5 0 1
13 5 0 0.5 0 0

200 12 0 0.5 0 1
6 0 0 0.5 0 1
150 0 0 0.5 0 1
25 20 0 0.5 0 0
70 66 0 0.5 0 0
16 4 0 0.5 0 0

2 0 1 0.5 1 0
140 0 1 0.5 0 0
6 0 0 0.5 1 1
33 0 0 0.5 0 1
28 0 0 0.5 0 1
85 3 1 0.5 0 0
9 1 1 0.5 1 0

1 1 1 0 0 0
4 4 1 0 0 0
3 0 0 1 1 1
88 2 0 1 0 1
4 4 0 1 0 0
2 0 0 1 0 1
96 20 0 1 0 1
5 5 0 1 0 0
5 0 0 1 0 1
3 3 0 1 0 0
1 0 0 1 0 1
7 7 0 1 1 1
105 30 0 1 0 1

2 2 1 0 0 0
1 0 0 1 1 1
5 0 0 1 0 1
2 2 1 1 0 0
3 0 0 1 0 1
6 4 1 1 0 0
4 0 0 1 0 1
1 1 1 0 0 0

3 3 0 0.5 0 0
120 2 0 0.5 0 1
9 9 0 0.5 0 0
140 8 0 0.5 0 1
6 6 0 0.5 1 1
90 3 0 0.5 0 1
4 4 0 0.5 0 0
5 0 0 0.5 1 1
110 0 0 0.5 0 1
2 0 0 0.5 0 1
7 7 0 0.5 0 0
3 0 0 0.5 0 0
4 4 0 0.5 0 0
2 0 0 0.5 0 0
9 9 0 0.5 0 0

15 15 1 0 0 0
5 5 0 1 1 1
40 0 0 1 0 1
8 8 0 1 0 0
130 0 0 1 0 1
12 9 0 1 0 0
150 44 0 1 0 1
3 0 0 1 0 1
10 10 0 1 0 0
1 0 0 1 0 1
8 8 0 1 0 0
84 0 0 1 0 1
30 0 0 1 0 1
6 5 0 1 0 0

2 2 0 0.5 0 0
8 0 0 0.5 1 1
92 4 0 0.5 0 1
38 0 0 0.5 0 1
3 3 0 0.5 0 0

16 16 0 0.5 0 0
85 0 0 0.5 0 1
22 22 0 0.5 0 0
9 0 0 0.5 1 1
60 2 0 0.5 0 1
13 13 0 0.5 0 0
4 0 0 0.5 0 0
11 11 0 0.5 0 0

18 18 1 0 0 0
6 0 0 1 0 1
14 14 0 1 0 0
3 0 0 1 0 1
25 25 0 1 0 0
55 1 0 1 0 1
"""


def labelled(spark: SparkSession) -> DataFrame:
    """features and kept: the table that the tree is trained on."""
    rows = []
    for page in LABELLED.strip().split("\n\n"):
        told = [[float(v) for v in line.split()] for line in page.split("\n")]
        found = [{"words": int(w), "linked": int(n), "beside": bool(b), "article": a == 1, "heading": bool(h)} for w, n, b, a, h, _ in told]
        rows += [(x, kept) for x, (*_, kept) in zip(features(found), told, strict=True)]
    return spark.createDataFrame(rows, "features array<double>, kept double").coalesce(1)


def fit(table: DataFrame, depth: int = 6) -> Tree:
    """A decision tree over a labelled table (features, kept) of some hundred blocks."""
    trained = DecisionTreeClassifier(featuresCol="x", labelCol="kept", maxDepth=depth, maxBins=128, seed=0).fit(table.select(array_to_vector("features").alias("x"), "kept"))
    return _branch(trained._call_java("rootNode"))


#: A leaf says whether a block is kept; a branch has a feature's number, the largest value that goes left, and both sides.
Tree = bool | tuple[int, float, "Tree", "Tree"]


def _branch(node) -> Tree:
    if node.subtreeDepth() == 0:
        return node.prediction() == 1.0
    left, right = _branch(node.leftChild()), _branch(node.rightChild())
    return left if left is right else (node.split().featureIndex(), node.split().threshold(), left, right)


def kept(tree: Tree, x: Column) -> Column:
    """Whether the tree keeps a block, from its array of features."""
    if isinstance(tree, bool):
        return F.lit(tree)
    feature, most, left, right = tree
    return F.when(x[feature] <= most, kept(left, x)).otherwise(kept(right, x))


_BLOCKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType()))]))


@F.arrow_udf(_BLOCKS)
def page_blocks(html: pa.Array) -> pa.Array:
    """The blocks of each page in order, with their features."""
    out = []
    for page in html:
        found = blocks(page.as_py())
        out.append([{"text": b["text"], "features": x} for b, x in zip(found, features(found), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("features", pa.list_(pa.float64()))])))


def main_text(pages: DataFrame, tree: Tree, html: str = "html") -> DataFrame:
    """Adds text, the kept blocks joined by empty lines, and n_chars, its code points; both replace columns of these names.

    A null or empty page, and one without a kept block, has an empty text. Pages are read whole, of any length, cut short or badly
    nested ones too; repeated rows and null ids are rows like others, other columns stay; an empty table gives an empty table.
    """
    found = F.filter(page_blocks(F.col(f"`{html}`").cast("string")), lambda b: kept(tree, b["features"]))
    text = F.array_join(F.transform(found, lambda b: b["text"]), "\n\n")
    taken = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.select(*(F.col(f"`{c}`") for c in taken), text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


__all__ = ["FEATURES", "fit", "kept", "labelled", "main_text", "page_blocks"]
