"""Classification metrics and rates as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmart.sources.schemas import SNAPSHOT

# Decision threshold and alert levels.
THRESHOLD = 0.5
AUC_CRITICAL = 0.70
AUC_WARNING = 0.75

# A score's bits are read 16 at a time.
DIGIT_BITS = 16
LEVELS = 4
# Fixed values of the double format: bits of the fraction, least and largest exponent.
FRACTION_BITS, LEAST_EXPONENT, LARGEST_EXPONENT = 52, -1022, 1023


def binary_prediction(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score > threshold, F.lit(1)).otherwise(F.lit(0))


def bad_rate_by_mob(
    loans: DataFrame, started_before=None, dpd: int = 30, by: Sequence[str] = ("mob",)
) -> DataFrame:
    """Share of loan months at least `dpd` days past due, by month on book."""
    if started_before is not None:
        loans = loans.where(F.col("loan_start_date") < F.lit(started_before))
    flag = F.when(F.col("dpd") >= dpd, F.lit(1)).otherwise(F.lit(0))
    return loans.groupBy(*by).agg(
        F.avg(flag).alias("bad_rate"), F.count(F.lit(1)).alias("n"), F.sum(flag).alias("bads")
    )


def split_stats(df: DataFrame, by: Sequence[str] = ("split",), label: str = "label") -> DataFrame:
    """Row count and label rate (two digits) per split."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(label), 2).alias("label_rate")
    )


def f1_by_group(
    df: DataFrame,
    by: Sequence[str] = (SNAPSHOT,),
    score: str = "model_predictions",
    label: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """F1 of the positive class per group that has both classes; 0 without any positive."""
    hit = binary_prediction(F.col(score), threshold) == 1
    bad = F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & bad).alias("tp"),
        F.count_if(hit & ~bad).alias("fp"),
        F.count_if(~hit & bad).alias("fn"),
        F.min(label).alias("low"),
        F.max(label).alias("high"),
    )
    two_tp = 2 * F.col("tp")
    f1 = F.coalesce(F.try_divide(two_tp, two_tp + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.where(F.col("low") != F.col("high")).select(*by, f1.alias("f1"))


def ordered_bits(score: Column) -> Column:
    """The bits of a double as a whole number that grows with it; equal numbers, 0 and -0 included, have one.

    Exponent and fraction are taken apart by powers of two, which is exact. The
    logarithm only guesses the exponent; the comparisons settle it.
    """
    size = F.abs(score)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(LARGEST_EXPONENT)), F.lit(LEAST_EXPONENT)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = (
        F.when(power(guess) > size, F.greatest(guess - 1, F.lit(LEAST_EXPONENT)))
        .when(size / 2 >= power(guess), guess + 1)
        .otherwise(guess)
    )
    fraction = (size / power(exponent) * 2.0**FRACTION_BITS).cast("bigint")
    bits = (exponent - LEAST_EXPONENT).cast("bigint") * (1 << FRACTION_BITS) + fraction
    largest = (LARGEST_EXPONENT - LEAST_EXPONENT + 2) * (1 << FRACTION_BITS)
    whole = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(largest)).otherwise(bits)
    return F.when(score < 0, -whole).otherwise(whole)


def _levels(bits: Column) -> Column:
    """Where a score stands at each level: (level, group so far, position in the group).

    Level k groups scores whose bits agree before digit k and orders them by that
    digit. Two different scores part at exactly one level, and the last digit ends them,
    so no group has more positions than a digit has values.
    """
    levels = []
    for k in range(LEVELS):
        after = DIGIT_BITS * (LEVELS - 1 - k)
        head = F.shiftright(bits, after)
        group = F.shiftright(head, DIGIT_BITS) if k else F.lit(0).cast("bigint")
        position = head.bitwiseAND((1 << DIGIT_BITS) - 1) if k else head
        levels.append(F.struct(F.lit(k).alias("level"), group.alias("grp"), position.cast("int").alias("pos")))
    return F.array(*levels)


def level_cells(
    df: DataFrame, by: Sequence[str], score: str = "model_predictions", label: str = "label"
) -> DataFrame:
    """(by..., level, grp, pos, p, n): positives and negatives at every position of every level."""
    bad = F.col(label) == 1
    value = F.col(score).cast("double")
    distinct = (
        df.where(value.isNotNull() & ~F.isnan(value) & F.col(label).isNotNull())
        .select(*by, value.alias("score"), bad.alias("bad"))
        .groupBy(*by, "score")
        .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    )
    return (
        distinct.select(*by, "p", "n", ordered_bits(F.col("score")).alias("bits"))
        .select(*by, "p", "n", F.inline(_levels(F.col("bits"))))
        .groupBy(*by, "level", "grp", "pos")
        .agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    )


def _pair_sums(
    df: DataFrame, by: Sequence[str], score: str, label: str, threshold: float
) -> DataFrame:
    """Won pairs and class counts per group, from one pass over the scored rows."""
    cells = level_cells(df, by, score, label)
    below = (
        Window.partitionBy(*by, "level", "grp")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    leaf = F.col("level") == LEVELS - 1
    bits = F.col("grp") * (1 << DIGIT_BITS) + F.col("pos")
    chosen = leaf & (bits > ordered_bits(F.lit(float(threshold))))
    tied = F.when(leaf, F.col("n") / 2).otherwise(F.lit(0.0))
    return (
        cells.withColumn("n_below", F.coalesce(F.sum("n").over(below), F.lit(0)))
        .groupBy(*by)
        .agg(
            F.sum(F.col("p").cast("double") * (F.col("n_below") + tied)).alias("won"),
            F.sum(F.when(leaf, F.col("p")).otherwise(0)).alias("positives"),
            F.sum(F.when(leaf, F.col("n")).otherwise(0)).alias("negatives"),
            F.sum(F.when(chosen, F.col("p")).otherwise(0)).alias("tp"),
            F.sum(F.when(chosen, F.col("n")).otherwise(0)).alias("fp"),
        )
        .where((F.col("positives") > 0) & (F.col("negatives") > 0))
    )


def _auc() -> Column:
    return F.col("won") / (F.col("positives").cast("double") * F.col("negatives"))


def auc_by_group(
    df: DataFrame,
    by: Sequence[str] = (SNAPSHOT,),
    score: str = "model_predictions",
    label: str = "label",
) -> DataFrame:
    """Exact area under the ROC curve (and gini) per group that has both classes.

    The area is the share of (bad, good) pairs with the bad scored higher, ties
    counting half. Scores are first counted per distinct value. Every pair of
    different scores is then counted at the one level where the two part: level k
    compares the k-th 16 bits of scores that agree before. A running total spans
    at most 65,536 positions, whatever the scores are.
    Rows without score or label take no part.
    """
    return _pair_sums(df, list(by), score, label, THRESHOLD).select(
        *by, "positives", "negatives", _auc().alias("auc"), F.round(2 * _auc() - 1, 3).alias("gini")
    )


def auc_severity(auc: Column) -> Column:
    return (
        F.when(auc < AUC_CRITICAL, F.lit("critical"))
        .when(auc < AUC_WARNING, F.lit("warning"))
        .when(auc.isNotNull(), F.lit("healthy"))
    )


def performance(
    df: DataFrame,
    by: Sequence[str] = (SNAPSHOT,),
    score: str = "model_predictions",
    label: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """f1, auc and severity per snapshot, all from the same counts."""
    two_tp = 2 * F.col("tp")
    misses = F.col("positives") - F.col("tp")
    f1 = F.coalesce(F.try_divide(two_tp, two_tp + F.col("fp") + misses), F.lit(0.0))
    return (
        _pair_sums(df, list(by), score, label, threshold)
        .select(*by, f1.alias("f1"), _auc().alias("auc"))
        .withColumn("severity", auc_severity(F.col("auc")))
    )
