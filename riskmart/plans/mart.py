"""Bronze, silver and gold layers: one job per table for any range of months."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.operators.encoding import fit_vocabulary, read_vocabulary, vocabulary_frame
from riskmart.operators.gold import (
    feature_store,
    gold_attributes,
    gold_clickstream,
    gold_financials,
    gold_labels,
    gold_loan_features,
)
from riskmart.operators.silver import (
    LOSS_SCHEMA,
    financial_losses,
    parse_snapshot,
    silver_attributes,
    silver_clickstream,
    silver_financials,
    silver_loan,
)
from riskmart.plans.layout import Mart
from riskmart.sources import (
    overwrite_snapshots,
    overwrite_table,
    read_range,
    read_raw,
    read_table,
    table_exists,
)
from riskmart.sources.schemas import (
    ATTRIBUTE_CATEGORIES,
    ATTRIBUTES_RAW_SCHEMA,
    CLICKSTREAM_RAW_SCHEMA,
    FINANCIAL_CATEGORIES,
    FINANCIALS_RAW_SCHEMA,
    LOAN_RAW_SCHEMA,
    SNAPSHOT,
)


@dataclass(frozen=True)
class Source:
    schema: T.StructType
    split: bool  # one partition per snapshot, or one table for all


SOURCES = {
    "lms_loan_daily": Source(LOAN_RAW_SCHEMA, True),
    "feature_clickstream": Source(CLICKSTREAM_RAW_SCHEMA, True),
    "features_financials": Source(FINANCIALS_RAW_SCHEMA, False),
    "features_attributes": Source(ATTRIBUTES_RAW_SCHEMA, False),
}

SILVER = {
    "lms_loan_daily": silver_loan,
    "feature_clickstream": silver_clickstream,
    "features_financials": silver_financials,
    "features_attributes": silver_attributes,
}


def months_between(start: dt.date, end: dt.date) -> list[dt.date]:
    """The firsts of the months from start's month up to end."""
    months = range(start.year * 12 + start.month - 1, end.year * 12 + end.month)
    return [dt.date(m // 12, m % 12 + 1, 1) for m in months]


def in_months(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """First-of-month snapshots from start's month up to end; other days are no snapshots.

    The filter is pushed to the text of the date: its only mention of the day has the text parsed once for it.
    """
    return df.where(F.col(SNAPSHOT).isin(months_between(start, end)))


def months_of(start: dt.date, end: dt.date) -> dict[str, tuple[dt.date, dt.date]]:
    """The partitions that a run over this range replaces."""
    return {SNAPSHOT: (start.replace(day=1), end)}


def bronze_split(raw: DataFrame, path: str, start: dt.date, end: dt.date) -> None:
    """All months of a raw source in one pass, one partition per snapshot.

    Rows whose date cannot be read belong to no snapshot and are not taken.
    """
    rows = in_months(parse_snapshot(raw), start, end)
    overwrite_snapshots(rows, path, replaced=months_of(start, end))


def bronze_static(raw: DataFrame, path: str) -> None:
    overwrite_table(parse_snapshot(raw), path)


def build_bronze(
    spark: SparkSession, mart: Mart, raw: Mapping[str, str], start: dt.date, end: dt.date
) -> None:
    for name, path in raw.items():
        source = SOURCES[name]
        df = read_raw(spark, path, source.schema)
        if source.split:
            bronze_split(df, mart.bronze(name), start, end)
        else:
            bronze_static(df, mart.bronze(name))


def financials_job(
    bronze: DataFrame, path: str, losses_path: str, max_interest_rate: int | None = None
) -> None:
    """Write cleaned finances and, from the same job, how many rows each rule dropped.

    The job has no shuffle, so a task that ran twice counts once.
    """
    observed = Observation("financial losses")
    overwrite_table(silver_financials(bronze, max_interest_rate, losses=observed), path)
    found = bronze.sparkSession.createDataFrame(financial_losses(observed.get), LOSS_SCHEMA)
    overwrite_table(found.coalesce(1), losses_path)


def build_silver(
    spark: SparkSession, mart: Mart, start: dt.date, end: dt.date, names=tuple(SOURCES)
) -> None:
    for name in names:
        if SOURCES[name].split:
            months = read_range(spark, mart.bronze(name), start.replace(day=1), end)
            # Bronze files hold one snapshot each and cleaning is narrow: no shuffle.
            overwrite_snapshots(
                SILVER[name](months), mart.silver(name), compact=False, replaced=months_of(start, end)
            )
        elif name == "features_financials":
            bronze = read_table(spark, mart.bronze(name))
            financials_job(bronze, mart.silver(name), mart.losses(name))
        else:
            overwrite_table(SILVER[name](read_table(spark, mart.bronze(name))), mart.silver(name))


def build_labels(
    spark: SparkSession, mart: Mart, start: dt.date, end: dt.date, dpd: int = 30, mob: int = 6
) -> None:
    loans = read_range(spark, mart.silver("lms_loan_daily"), start.replace(day=1), end)
    overwrite_snapshots(
        gold_labels(loans, dpd, mob), mart.label_store, replaced=months_of(start, end)
    )


def pinned_vocabulary(spark: SparkSession, mart: Mart, refit: bool = False) -> dict[str, list[str]]:
    """The stored category vocabulary; fitted and stored on the first call.

    Pinning keeps the width and meaning of the one-hot columns the same for all
    snapshots, even when the customer tables change between runs.
    """
    if not refit and table_exists(spark, mart.vocabulary):
        return read_vocabulary(read_table(spark, mart.vocabulary))
    found = {
        **fit_vocabulary(
            read_table(spark, mart.silver("features_financials")), FINANCIAL_CATEGORIES
        ),
        **fit_vocabulary(
            read_table(spark, mart.silver("features_attributes")), ATTRIBUTE_CATEGORIES
        ),
    }
    overwrite_table(vocabulary_frame(spark, found).coalesce(1), mart.vocabulary)
    return found


def build_feature_store(
    spark: SparkSession, mart: Mart, start: dt.date, end: dt.date, mob: int = 6
) -> None:
    vocabulary = pinned_vocabulary(spark, mart)
    first = start.replace(day=1)
    loans = read_range(spark, mart.silver("lms_loan_daily"), first, end)
    clicks = read_range(spark, mart.silver("feature_clickstream"), first, end)
    financials = read_table(spark, mart.silver("features_financials"))
    attributes = read_table(spark, mart.silver("features_attributes"))
    store = feature_store(
        gold_loan_features(loans, mob),
        gold_financials(financials, vocabulary),
        gold_attributes(attributes, vocabulary),
        gold_clickstream(clicks),
        spread=True,
    )
    overwrite_snapshots(store, mart.feature_store, replaced=months_of(start, end))


def backfill(
    spark: SparkSession,
    mart: Mart,
    raw: Mapping[str, str],
    start: dt.date,
    end: dt.date,
    dpd: int = 30,
    mob: int = 6,
) -> None:
    """Raw files -> label store and feature store for all months of the range.

    Running a range again replaces all its months, those that lost their rows
    included, and nothing else, so a failed or repeated run leaves the same tables as one
    clean run.
    """
    build_bronze(spark, mart, raw, start, end)
    build_silver(spark, mart, start, end, tuple(raw))
    build_labels(spark, mart, start, end, dpd, mob)
    build_feature_store(spark, mart, start, end, mob)
