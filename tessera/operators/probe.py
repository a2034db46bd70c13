"""Two linear heads over the words of a text, fitted by Spark ML: the training step with fixed features instead of an encoder.

With fixed features the joint loss is a sum of one loss a head, so each head is a fit of its own; a head's weight in the loss
scales its rows' weights and changes nothing within the head.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, functions as F

from ..functions import rules as R
from ..sources.shared import kept_model, written
from .vectors import label_dimension

#: Places that words are hashed to, passes of the fit, and its penalty.
PLACES, STEPS, PENALTY = 1 << 14, 40, 0.001
#: The share of each head in the joint loss.
SHARES = {"department": R.ALPHA, "severity": R.BETA}


def indexed(df: DataFrame, heads: Mapping[str, str]) -> DataFrame:
    """Adds <head>_index, the place of the head's class (a column) among its sorted classes; rows of a null class are left out."""
    for head, column in heads.items():
        # a head has few classes
        df = df.join(F.broadcast(label_dimension(df, column).withColumnRenamed("class_index", f"{head}_index")), column)
    return df


def fit_heads(rows: DataFrame, heads: Mapping[str, str], text: str = "text", weight: str | None = None, shares: Mapping[str, float] = SHARES, places: int = PLACES, steps: int = STEPS) -> PipelineModel:
    """Words, their frequencies by hash, inverse document frequencies, and a multinomial regression for each head on <head>_index.

    weight is a column of row weights, such as those of low routing confidence. Null texts count as empty. The words are
    counted once, and the counts written; the model is saved in the shared folder.
    """
    words = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=1),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=places),
    ])
    x = rows.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for head in heads:
        x = x.withColumn(f"_{head}_weight", (F.col(weight) if weight else F.lit(1.0)) * F.lit(float(shares.get(head, 1.0))))
    count = words.fit(x)
    # each fit reads these counts more than once
    x = written(count.transform(x).select("_counts", *(c for head in heads for c in (f"{head}_index", f"_{head}_weight"))), "counts")
    found = IDF(inputCol="_counts", outputCol="_features", minDocFreq=2).fit(x)
    x, fitted = found.transform(x), []
    for head in heads:
        names = {"predictionCol": f"{head}_prediction", "probabilityCol": f"_{head}_probability", "rawPredictionCol": f"_{head}_raw"}
        fitted.append(LogisticRegression(featuresCol="_features", labelCol=f"{head}_index", weightCol=f"_{head}_weight", family="multinomial", maxIter=steps, regParam=PENALTY, **names).fit(x))
    return kept_model(PipelineModel([*count.stages, found, *fitted]), rows.sparkSession, "heads")


def predict(model: PipelineModel, rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds <head>_prediction, a class index, for each head."""
    x = model.transform(rows.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    return x.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(c).cast("int").alias(c) for c in x.columns if c.endswith("_prediction")))


def accuracies(predicted: DataFrame, heads: Mapping[str, str], by: str = "split") -> DataFrame:
    """by, n, and <head>_accuracy: the share of rows whose class each head names."""
    hit = lambda head: F.avg((F.col(f"{head}_prediction") == F.col(f"{head}_index")).cast("int"))
    return predicted.groupBy(by).agg(F.count("*").alias("n"), *(hit(head).alias(f"{head}_accuracy") for head in heads))
