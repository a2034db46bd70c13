"""Vocabulary plans and vector tables: warm starts, audits, linear scores, losses and accuracies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import rules as R
from ..sources.shared import kept_model


def rule_frame(spark: SparkSession) -> DataFrame:
    """rule_idx, canonical, alternatives: the spelling rules in order."""
    rules = [(w, to) for w, to, _ in R.VARIANTS] + [(w, [to]) for w, to in R.FINAL_DROPS]
    return spark.createDataFrame([(k, w, to) for k, (w, to) in enumerate(rules)], "rule_idx int, canonical string, alternatives array<string>")


def vocab_plan(rules: DataFrame) -> DataFrame:
    """canonical, variant, rule_idx, alt_idx: each new token once, under the first rule that lists it."""
    pairs = rules.select("rule_idx", "canonical", F.posexplode("alternatives").alias("alt_idx", "variant")).where("variant <> canonical")
    first = Window.partitionBy("variant").orderBy("rule_idx", "alt_idx")
    return pairs.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def new_tokens(plan: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Plan rows whose variant the vocabulary (token) lacks."""
    return plan.join(vocabulary.select(F.col("token").alias("variant")).hint("merge"), "variant", "left_anti")


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector: the mean by position; of a single vector, that vector. Null vectors don't count; a key's vectors are equally long.

    Whole vectors are summed up before and after one shuffle, a row for each key and task, and never taken apart.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = rows.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("_v"))
    return x.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(key, vector_to_array("_m").alias("vector"))


def warm_start(plan: DataFrame, anchors: DataFrame, base: DataFrame) -> DataFrame:
    """base (token, vector) and the new tokens of plan, each with the vector of its anchor (canonical, vector).

    Anchors are those of the base before; rows that are there stay as they are, so a second run changes nothing.
    """
    new = new_tokens(plan, base).join(anchors.select("canonical", "vector").hint("merge"), "canonical").select(F.col("variant").alias("token"), "vector")
    return base.select("token", "vector").unionByName(new)


def copy_audit(a: Column, b: Column) -> Column:
    """Struct: dimensions, the first five values rounded, and whether all values are equal within tolerance."""
    same = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)), lambda t: t)
    head = F.array_join(F.transform(F.slice(a, 1, 5), lambda x: F.format_string("%.6f", x)), ",")
    return F.struct(F.size(a).alias("dims"), head.alias("head"), (same & (F.size(a) == F.size(b))).alias("same"))


def not_single_piece(pieces: DataFrame, anchor: str) -> DataFrame:
    """Anchors of another number of pieces than one."""
    return pieces.groupBy(anchor).agg(F.count("*").alias("n")).where("n <> 1")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def linear_head(vector: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Scores of one linear head: an array with a number for each class."""
    return F.array(*(dot(vector, F.array(*map(F.lit, w))) + F.lit(b) for w, b in zip(weights, bias, strict=True)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax of the label's logit, shifted by the largest."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - most))
    return F.log(total) + most - F.element_at(logits, label + 1)


def argmax(scores: Column) -> Column:
    """The first place, from 0, of the largest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def joint_loss(first: Column, second: Column, alpha: float = R.ALPHA, beta: float = R.BETA) -> Column:
    return first * F.lit(alpha) + second * F.lit(beta)


def running_metrics(batches: DataFrame) -> DataFrame:
    """loss, n, correct by batch -> mean loss by row and accuracy; 0 if there are no rows."""
    n = F.sum("n")
    return batches.agg(F.coalesce(F.when(n > 0, F.sum(F.col("loss") * F.col("n")) / n), F.lit(0.0)).alias("loss"), F.coalesce(F.when(n > 0, F.sum("correct") / n), F.lit(0.0)).alias("accuracy"))


def ordinal_confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts of label and prediction with how far apart they are: exact, adjacent, distant."""
    d = F.abs(F.col(label) - F.col(predicted))
    band = F.when(d == 0, "exact").when(d == 1, "adjacent").otherwise("distant")
    return df.groupBy(label, predicted, band.alias("band")).agg(F.count("*").alias("n"))


def label_dimension(codes: DataFrame, column: str) -> DataFrame:
    """Distinct codes in order with their class number; the window is over the classes only."""
    return codes.select(column).distinct().withColumn("class_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1)


def label_space(labelled: DataFrame, heads: dict[str, str], weights: dict[str, float]) -> DataFrame:
    """head, class, class_index, n, loss_weight: the sorted classes of each head's column with their counts and the head's weight."""
    parts = []
    for head, column in heads.items():
        counts = labelled.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
        index = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("class")) - 1).cast("int")
        parts.append(counts.select(F.lit(head).alias("head"), "class", index.alias("class_index"), "n", F.lit(weights[head]).alias("loss_weight")))
    return reduce(DataFrame.unionAll, parts)


def linear_probe(df: DataFrame, vector: str, label: str, weight: str | None = None, steps: int = 20):
    """A multinomial logistic regression over fixed vectors, fitted by Spark ML. Adds prediction. The model is saved in the shared folder."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("_features", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    fit = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=steps, regParam=0.01, **({"weightCol": weight} if weight else {})).fit(x)
    return kept_model(fit, df.sparkSession, "probe").transform(x).drop("_features", "rawPrediction", "probability")
