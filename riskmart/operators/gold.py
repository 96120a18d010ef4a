"""Silver tables -> labels, features and the joined feature store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.functions import ratio_or_zero
from riskmart.operators.casting import cast_columns
from riskmart.operators.encoding import one_hot
from riskmart.operators.joins import spread_left_join
from riskmart.sources.schemas import (
    ATTRIBUTE_CATEGORIES,
    CLICK_FEATURES,
    CLICKSTREAM_TYPES,
    CUSTOMER,
    FINANCIAL_CATEGORIES,
    FINANCIAL_FEATURE_TYPES,
    LOAN_FEATURE_TYPES,
    SNAPSHOT,
)

# Fixed value: the month on book at which a loan is labelled.
MOB = 6


def label_definition(dpd: int, mob: int) -> str:
    return f"{dpd}dpd_{mob}mob"


def gold_labels(loans: DataFrame, dpd: int = 30, mob: int = MOB) -> DataFrame:
    """Default label at one month on book: 1 when at least `dpd` days past due.

    Unknown days past due count as good.
    """
    return loans.where(F.col("mob") == mob).select(
        "loan_id",
        CUSTOMER,
        F.when(F.col("dpd") >= dpd, F.lit(1)).otherwise(F.lit(0)).alias("label"),
        F.lit(label_definition(dpd, mob)).alias("label_def"),
        SNAPSHOT,
    )


def label_sweep(loans: DataFrame, definitions: Sequence[tuple[int, int]]) -> DataFrame:
    """Loans and defaults per snapshot for several label definitions, in one scan."""
    counted = [
        F.struct(
            F.lit(label_definition(dpd, mob)).alias("label_def"),
            F.lit(mob).alias("at_mob"),
            F.lit(dpd).alias("at_dpd"),
        )
        for dpd, mob in definitions
    ]
    months = sorted({mob for _, mob in definitions})
    return (
        loans.where(F.col("mob").isin(*months))
        .select(SNAPSHOT, "mob", "dpd", F.explode(F.array(*counted)).alias("d"))
        .where(F.col("mob") == F.col("d.at_mob"))
        .groupBy(SNAPSHOT, F.col("d.label_def").alias("label_def"))
        .agg(
            F.count(F.lit(1)).alias("loans"),
            F.count_if(F.col("dpd") >= F.col("d.at_dpd")).alias("bads"),
        )
    )


def gold_loan_features(loans: DataFrame, mob: int = MOB) -> DataFrame:
    """Payment and overdue ratios of the loans at one month on book."""
    featured = loans.where(F.col("mob") == mob).withColumns(
        {
            "payment_ratio": ratio_or_zero(F.col("paid_amt"), F.col("due_amt")),
            "overdue_ratio": ratio_or_zero(F.col("overdue_amt"), F.col("loan_amt")),
        }
    )
    return cast_columns(featured.select(*LOAN_FEATURE_TYPES), LOAN_FEATURE_TYPES)


def gold_financials(financials: DataFrame, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """Numeric finances plus one 0/1 column per category of the pinned vocabulary."""
    typed = cast_columns(
        financials.select(*[f"`{c}`" for c in FINANCIAL_FEATURE_TYPES], *FINANCIAL_CATEGORIES),
        FINANCIAL_FEATURE_TYPES,
    )
    return one_hot(typed, {c: vocabulary[c] for c in FINANCIAL_CATEGORIES})


def gold_attributes(attributes: DataFrame, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    typed = cast_columns(
        attributes.select(CUSTOMER, "Age", *ATTRIBUTE_CATEGORIES), {CUSTOMER: "string", "Age": "int"}
    )
    return one_hot(typed, {c: vocabulary[c] for c in ATTRIBUTE_CATEGORIES})


def gold_clickstream(clicks: DataFrame) -> DataFrame:
    return cast_columns(clicks, CLICKSTREAM_TYPES).select(*CLICK_FEATURES, CUSTOMER, SNAPSHOT)


def feature_store(
    loan_features: DataFrame,
    financial_features: DataFrame,
    attribute_features: DataFrame,
    click_features: DataFrame,
    spread: bool = False,
) -> DataFrame:
    """Loans at month on book with everything known about the customer.

    Three left joins, repeated customers included; each table is read once, and what
    is measured to be small at run time is broadcast. The clicks come first: they have a key of their
    own, and the loans are shuffled for it while they are narrow and not yet repeated. With `spread`, keys that hold very many
    rows of a right side are dealt out over buckets (see spread_left_join); without it
    only hot keys of the loans are split, by the runtime planner.
    """
    keys = [CUSTOMER, SNAPSHOT]
    joined = loan_features
    for right, on in (
        (click_features, keys),
        (financial_features, [CUSTOMER]),
        (attribute_features, [CUSTOMER]),
    ):
        joined = spread_left_join(joined, right, on) if spread else joined.join(right, on, "left")
    tables = (loan_features, financial_features, attribute_features, click_features)
    return joined.select(*keys, *[f"`{c}`" for t in tables for c in t.columns if c not in keys])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
