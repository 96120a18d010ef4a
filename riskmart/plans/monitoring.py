"""Monthly monitoring: performance, feature drift, flags and the retrain decision."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators.casting import numeric_columns
from riskmart.operators.drift import (
    DriftBins,
    common_bins,
    drift_bins_frame,
    drift_rollup,
    fit_drift_bins,
    psi_by_feature,
    read_drift_bins,
)
from riskmart.operators.metrics import binary_prediction, performance
from riskmart.plans.layout import Mart
from riskmart.sources import (
    overwrite_snapshots,
    overwrite_table,
    read_snapshot,
    read_table,
    table_exists,
)
from riskmart.sources.schemas import CUSTOMER, SNAPSHOT

# Fixed value: the snapshot that later ones are compared with.
BASELINE = dt.date(2024, 6, 1)

KINDS = ["performance", "feature"]


def predictions_with_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores next to the labels of the same customer and snapshot."""
    scored = predictions.withColumn("binary_prediction", binary_prediction(F.col("model_predictions")))
    return scored.join(labels, [CUSTOMER, SNAPSHOT], "inner").select(
        CUSTOMER, SNAPSHOT, "model_predictions", "binary_prediction", "label"
    )


def performance_flags(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        SNAPSHOT,
        F.lit("performance").alias("kind"),
        "severity",
        F.format_string("area under the curve: %.3f", "auc").alias("detail"),
    )


def feature_flags(rollup: DataFrame) -> DataFrame:
    """Severity of the drift; 'unknown' where no feature could be compared."""
    return rollup.select(
        SNAPSHOT,
        F.lit("feature").alias("kind"),
        F.when(F.col("n_unknown") == F.col("n_features"), F.lit("unknown"))
        .when(F.col("alert"), F.lit("critical"))
        .when(F.col("n_critical") + F.col("n_warning") > 0, F.lit("warning"))
        .otherwise(F.lit("healthy"))
        .alias("severity"),
        F.format_string(
            "of %d features %d strongly and %d slightly shifted, %d not comparable",
            "n_features",
            "n_critical",
            "n_warning",
            "n_unknown",
        ).alias("detail"),
    )


def retrain_decisions(flags: DataFrame) -> DataFrame:
    """Per snapshot and model: retrain when any flag is critical."""
    return flags.groupBy(SNAPSHOT, "model_name").agg(
        F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("retrain")
    )


def should_retrain(flags: DataFrame, snapshot: dt.date, model_name: str) -> bool:
    raised = flags.where(
        (F.col(SNAPSHOT) == F.lit(snapshot))
        & (F.col("model_name") == model_name)
        & (F.col("severity") == "critical")
    )
    return not raised.isEmpty()


def upsert_snapshots(new: DataFrame, log_path: str, by=(SNAPSHOT,), replaced=None) -> None:
    """Replace the log's rows of the snapshots in `new` and in `replaced`, keep all others."""
    overwrite_snapshots(new, log_path, by, compact=False, replaced=replaced)


def pinned_drift_bins(
    spark: SparkSession, mart: Mart, baseline: dt.date = BASELINE, refit: bool = False
) -> DriftBins:
    """The stored bins of the baseline snapshot; fitted on the first call only.

    A baseline without a complete row gives bins nothing compares with; these are
    not stored, so a later call looks again.
    """
    path = f"{mart.drift_bins}/baseline={baseline:%Y-%m-%d}"
    if not refit and table_exists(spark, path):
        return read_drift_bins(read_table(spark, path))
    rows = read_snapshot(spark, mart.feature_store, baseline)
    bins = fit_drift_bins(rows, numeric_columns(rows, [CUSTOMER, SNAPSHOT]))
    if any(edges is not None for edges in bins.edges.values()):
        overwrite_table(drift_bins_frame(spark, bins).coalesce(1), path)
    return bins


def monitor(
    spark: SparkSession,
    mart: Mart,
    model_name: str,
    snapshot: dt.date,
    baseline: dt.date = BASELINE,
) -> DataFrame:
    """Metrics, drift log and flags of one snapshot; never stops at the first alarm.

    Snapshots up to the baseline have no feature drift. A kind that cannot be
    computed gets the severity 'unknown', so a repeated run never leaves an
    older verdict behind. Returns the snapshot's flags.
    """
    day = F.col(SNAPSHOT) == F.lit(snapshot)
    tag = {"model_name": F.lit(model_name)}
    by = ["model_name", SNAPSHOT]
    asked = {"model_name": (model_name, model_name), SNAPSHOT: (snapshot, snapshot)}
    found = []

    if table_exists(spark, mart.predictions):
        mine = day & (F.col("model_name") == model_name)
        scored = read_table(spark, mart.predictions).where(mine)
        joined = predictions_with_labels(scored, read_table(spark, mart.label_store).where(day))
        upsert_snapshots(performance(joined).withColumns(tag), mart.performance, by, asked)
        if table_exists(spark, mart.performance):
            metrics = read_table(spark, mart.performance)
            found.append(
                performance_flags(metrics.where(day & (F.col("model_name") == model_name)))
            )

    if snapshot > baseline:
        bins = pinned_drift_bins(spark, mart, baseline)
        current = read_snapshot(spark, mart.feature_store, snapshot)
        upsert_snapshots(
            psi_by_feature(current, common_bins(bins, current)).withColumns(tag),
            mart.drift_log,
            by,
            asked,
        )
        log = read_table(spark, mart.drift_log).where(day & (F.col("model_name") == model_name))
        found.append(feature_flags(drift_rollup(log)))

    flags = spark.createDataFrame([(snapshot, k) for k in KINDS], f"{SNAPSHOT} date, kind string")
    if found:
        verdicts = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        flags = flags.join(verdicts, [SNAPSHOT, "kind"], "left")
    else:
        none = F.lit(None).cast("string")
        flags = flags.withColumns({"severity": none, "detail": none})
    flags = flags.withColumns(
        {"severity": F.coalesce(F.col("severity"), F.lit("unknown")), **tag}
    ).coalesce(1)
    upsert_snapshots(flags, mart.drift_flags, by)
    return read_table(spark, mart.drift_flags).where(day & (F.col("model_name") == model_name))
