"""Each seed document becomes its original and one perturbed variant for each prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R
from ..functions.ids import perturb_seed, tracking_id
from ..functions.label import NO_MATCH, cascade_rank, folded, severity_of_rank
from ..functions.perturb import KNOWN, perturb_text


def prefix_bank() -> Column:
    """Variant numbers and prefixes; number 0 is the original."""
    return F.array(*(F.struct(F.lit(k).alias("variant_index"), F.lit(p).alias("prefix")) for k, p in enumerate(["", *R.PREFIXES])))


def expand_variants(df: DataFrame, rate: float | None = R.RATE, with_severity: bool = False) -> DataFrame:
    """seed_id, text, ... -> a row for each variant: variant_index, is_perturbed, language, tracking_id, text, subs.

    Null text counts as empty. Text is that of the seed, or the prefix and the text, perturbed with the seed that the
    tracking id gives; with rate None it isn't perturbed. with_severity adds severity, the five-tier label of the variant's
    text. Extra columns stay.

    What depends on the seed's text alone is done once a seed: its label, and whether a spelling rule knows a word of it. If
    none does, only the prefix is perturbed; and as no rule matches across the prefix's last mark, the label of
    prefix and text is the first one of both.
    """
    text = F.coalesce("text", F.lit(""))
    x = df.withColumn("text", text)
    if with_severity:
        x = x.withColumn("_low", folded(F.col("text"))).withColumn("_rank", cascade_rank(F.col("text"), F.col("_low"))).drop("_low")
    if rate is not None:
        x = x.withColumn("_known", F.col("text").rlike(KNOWN))
    x = x.withColumn("_v", F.explode(prefix_bank())).select("*", "_v.*").drop("_v")
    x = x.withColumn("tracking_id", tracking_id(F.col("seed_id"), F.col("variant_index"))).withColumn("is_perturbed", F.col("variant_index") > 0)
    x = x.withColumn("language", F.when(F.col("is_perturbed"), "hinglish").otherwise("en"))
    first = lambda a, b: F.when(F.col("is_perturbed"), F.least(a, b, F.lit(NO_MATCH))).otherwise(b)
    if rate is None:
        if with_severity:
            x = x.withColumn("_rank", first(cascade_rank(F.col("prefix")), F.col("_rank"))).withColumn("severity", severity_of_rank(F.col("_rank")))
        return x.withColumn("text", F.concat("prefix", "text")).drop("prefix", "_rank")
    none = F.struct(F.col("prefix").alias("text"), F.array().cast("array<struct<original:string,replacement:string,reason:string>>").alias("subs"))
    seed = perturb_seed(F.col("tracking_id"))
    # the words of a prefix come first and have the same places with and without the text
    x = x.withColumn("_p", F.when(~F.col("is_perturbed"), none).when(F.col("_known"), perturb_text(F.concat("prefix", "text"), seed, rate)).otherwise(perturb_text(F.col("prefix"), seed, rate)))
    whole = F.col("is_perturbed") & F.col("_known")
    if with_severity:
        # of the perturbed prefix, or of prefix and text if both are perturbed together
        x = x.withColumn("_own", cascade_rank(F.col("_p.text")))
        x = x.withColumn("_rank", F.when(whole, F.col("_own")).otherwise(first(F.col("_own"), F.col("_rank")))).withColumn("severity", severity_of_rank(F.col("_rank")))
    return x.withColumn("text", F.when(whole, F.col("_p.text")).otherwise(F.concat("_p.text", "text"))).withColumn("subs", F.col("_p.subs")).drop("_p", "_known", "_rank", "_own", "prefix")


def perturb_audit(expanded: DataFrame) -> DataFrame:
    """One row for each replaced word of each variant."""
    return expanded.select("tracking_id", F.posexplode("subs").alias("n", "sub")).select("tracking_id", "n", "sub.*")
