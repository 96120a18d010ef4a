"""Batch scoring of one snapshot or a range of snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators.casting import drop_any_null
from riskmart.plans.layout import Mart
from riskmart.plans.training import TrainedModel, load_model, model_inputs, positive_probability
from riskmart.sources import overwrite_snapshots, read_merged, read_table
from riskmart.sources.schemas import CUSTOMER, SNAPSHOT


def score(features: DataFrame, trained: TrainedModel) -> DataFrame:
    """(Customer_ID, snapshot_date, model_name, model_predictions), all inside Spark.

    Unless the model was fitted with gaps, rows with any missing value are left out.
    """
    rows = features if trained.keeps_missing else drop_any_null(features)
    inputs = model_inputs(rows, trained.features, trained.scaler, trained.keeps_missing)
    return trained.model.transform(inputs).select(
        CUSTOMER,
        SNAPSHOT,
        F.lit(trained.version).alias("model_name"),
        positive_probability().alias("model_predictions"),
    )


def score_months(
    spark: SparkSession,
    mart: Mart,
    version: str,
    start: dt.date,
    end: dt.date,
    merge_schema: bool = False,
) -> None:
    """Score all snapshots of a range in one job; a month without rows has none afterwards.

    Merging file schemas is needed only after the category vocabulary was refitted.
    """
    trained = load_model(spark, mart.model_bank, version)
    read = read_merged if merge_schema else read_table
    months = F.col(SNAPSHOT).between(F.lit(start), F.lit(end))
    features = read(spark, mart.feature_store).where(months)
    overwrite_snapshots(
        score(features, trained),
        mart.predictions,
        ["model_name", SNAPSHOT],
        compact=False,
        replaced={"model_name": (version, version), SNAPSHOT: (start, end)},
    )
