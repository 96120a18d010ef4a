"""Feature drift: population stability index, its roll-up and alert levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators.casting import drop_any_null, is_complete, numeric_columns
from riskmart.operators.quantiles import exact_quantiles
from riskmart.sources import remove_folder, working_folder
from riskmart.sources.schemas import SNAPSHOT

# Binning, smoothing and alert levels.
BUCKETS = 10
EPSILON = 1e-6
PSI_WARNING = 0.1
PSI_CRITICAL = 0.2
ALERT_CRITICAL_FEATURES = 5
ALERT_DRIFTED_SHARE = 0.3

BINS_SCHEMA = "feature string, edges array<double>, expected array<bigint>"


@dataclass(frozen=True)
class DriftBins:
    """Inner bin edges and baseline counts per feature; None edges for an empty baseline."""

    edges: Mapping[str, Sequence[float] | None]
    expected: Mapping[str, Sequence[int]]

    @property
    def features(self) -> list[str]:
        return list(self.edges)


def _bin(column: str, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below the value: repeated edges leave empty bins."""
    value = F.col(f"`{column}`").cast("double")
    return reduce(add, [(value >= F.lit(float(e))).cast("int") for e in edges])


def _bin_counts(df: DataFrame, bins: Mapping[str, Sequence[float]], by: Sequence[str]) -> DataFrame:
    """Complete rows per (by..., feature, bin). Bins are found before the rows are unfolded.

    Incomplete rows count as zero in the first bin, so a group of nothing but
    such rows still appears.
    """
    names = list(bins)
    complete = is_complete(df)
    binned = [
        F.when(complete, _bin(c, edges)).otherwise(F.lit(0)).alias(c) for c, edges in bins.items()
    ]
    return (
        df.select(*by, complete.cast("bigint").alias("one"), *binned)
        .unpivot([*by, "one"], names, "feature", "bin")
        .groupBy(*by, "feature", "bin")
        .agg(F.sum("one").alias("n"))
    )


def fit_drift_bins(
    baseline: DataFrame, features: Sequence[str], buckets: int = BUCKETS
) -> DriftBins:
    """Quantile bins of the baseline and how its own rows fall into them.

    Rows with any missing feature are left out, over all columns of the frame.
    The result is features x buckets numbers; store it and every later snapshot
    is compared without touching the baseline again.
    """
    # The counting rounds below read these rows several times: written once, what derives them runs once.
    spark, folder = baseline.sparkSession, working_folder(baseline.sparkSession, "baseline")
    doubles = [F.col(f"`{c}`").cast("double").alias(c) for c in features]
    drop_any_null(baseline).select(*doubles).write.parquet(folder)
    clean = spark.read.parquet(folder)
    step = 1 / buckets
    inner = [i * step for i in range(1, buckets)]
    edges = exact_quantiles(clean, features, inner)
    usable = {c: e for c, e in edges.items() if e is not None}
    counted = {c: [0] * buckets for c in features}
    if usable:
        for row in _bin_counts(clean, usable, []).collect():
            counted[row["feature"]][row["bin"]] = row["n"]
    remove_folder(spark, folder)
    return DriftBins(edges, counted)


def common_bins(bins: DriftBins, current: DataFrame) -> DriftBins:
    """The bins of those features that `current` has as numbers, too."""
    there = set(numeric_columns(current))
    kept = [c for c in bins.features if c in there]
    return DriftBins({c: bins.edges[c] for c in kept}, {c: bins.expected[c] for c in kept})


def drift_bins_frame(spark: SparkSession, bins: DriftBins) -> DataFrame:
    rows = [(c, bins.edges[c], list(bins.expected[c])) for c in bins.features]
    return spark.createDataFrame(rows, BINS_SCHEMA)


def read_drift_bins(frame: DataFrame) -> DriftBins:
    rows = frame.orderBy("feature").collect()
    return DriftBins(
        {r["feature"]: r["edges"] for r in rows}, {r["feature"]: r["expected"] for r in rows}
    )


def psi_by_feature(
    current: DataFrame, bins: DriftBins, by: Sequence[str] = (SNAPSHOT,)
) -> DataFrame:
    """(by..., feature, psi) for all features and all snapshots of `current` at once.

    Rows with any missing value are left out. An empty baseline, or a snapshot
    without a complete row, gives NULL.
    """
    by = list(by)
    spark = current.sparkSession
    usable = {c: e for c, e in bins.edges.items() if e is not None}
    unusable = [c for c in bins.features if c not in usable]
    parts = []
    if usable:
        buckets = len(next(iter(usable.values()))) + 1
        actual = (
            _bin_counts(current, usable, by)
            .groupBy(*by, "feature")
            .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("actual"))
        )
        expected = spark.createDataFrame(
            [(c, [int(n) for n in bins.expected[c]]) for c in usable],
            "feature string, expected array<bigint>",
        )
        joined = actual.join(F.broadcast(expected), "feature")
        actual_n = F.aggregate(F.map_values("actual"), F.lit(0).cast("bigint"), lambda s, x: s + x)
        expected_n = F.aggregate("expected", F.lit(0).cast("bigint"), lambda s, x: s + x)

        def term(i: Column) -> Column:
            a = F.try_divide(F.coalesce(F.try_element_at("actual", i), F.lit(0)), F.col("actual_n"))
            e = F.try_divide(F.get("expected", i), F.col("expected_n"))
            return (a - e) * F.ln((a + EPSILON) / (e + EPSILON))

        psi = F.aggregate(
            F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), term),
            F.lit(0.0),
            lambda s, x: s + x,
        )
        parts.append(
            joined.withColumns({"actual_n": actual_n, "expected_n": expected_n}).select(
                *by, "feature", psi.alias("psi")
            )
        )
    if unusable:
        names = F.explode(F.array(*[F.lit(c) for c in unusable])).alias("feature")
        groups = current.select(*by).distinct() if by else current.limit(1)
        parts.append(groups.select(*by, names, F.lit(None).cast("double").alias("psi")))
    return reduce(DataFrame.unionByName, parts)


def drift_level(psi: Column) -> Column:
    return (
        F.when(psi > PSI_CRITICAL, F.lit("critical"))
        .when(psi > PSI_WARNING, F.lit("warning"))
        .when(psi.isNotNull(), F.lit("stable"))
    )


def drift_rollup(psi: DataFrame, by: Sequence[str] = (SNAPSHOT,)) -> DataFrame:
    """Per snapshot: features, critical, warning and unknown counts, drifted share, alert.

    A NULL index could not be computed: it is unknown, neither stable nor drifted.
    """
    level = drift_level(F.col("psi"))
    return (
        psi.groupBy(*by)
        .agg(
            F.count_distinct("feature").alias("n_features"),
            F.count_if(level == "critical").alias("n_critical"),
            F.count_if(level == "warning").alias("n_warning"),
            F.count_if(F.col("psi").isNull()).alias("n_unknown"),
        )
        .withColumn(
            "share_drifted",
            F.try_divide(F.col("n_critical") + F.col("n_warning"), F.col("n_features")),
        )
        .withColumn(
            "alert",
            (F.col("n_critical") >= ALERT_CRITICAL_FEATURES)
            | (F.col("share_drifted") >= ALERT_DRIFTED_SHARE),
        )
    )
