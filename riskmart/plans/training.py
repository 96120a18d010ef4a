"""Model training: seeded random search over boosted trees, model bank."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators.casting import numeric_columns
from riskmart.operators.metrics import auc_by_group, split_stats
from riskmart.operators.scaling import Scaler, apply_scaler, fit_scaler
from riskmart.operators.splitting import (
    TrainingWindows,
    split_training_set,
    stratified_folds,
    training_set,
    training_windows,
)
from riskmart.plans.search import fingerprint, halving, steps_frame
from riskmart.sources import (
    ensure_checkpoint_dir,
    overwrite_snapshots,
    read_table,
    remove_folder,
    working_folder,
)
from riskmart.sources.schemas import CUSTOMER, LABEL, LOAN, NOT_FEATURES, SNAPSHOT

# Search spaces. The regularisation weights of other boosting
# libraries have no counterpart in Spark's trees and are left out.
WIDE_GRID = {
    "n_estimators": [100, 200, 300, 500],
    "max_depth": [3, 5, 7, 9],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "subsample": [0.6, 0.8, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "gamma": [0, 0.1, 0.3, 1],
    "min_child_weight": [1, 3, 5, 10],
    "scale_pos_weight": [1, 2, 5],
}
SMALL_GRID = {
    "n_estimators": [25, 50],
    "max_depth": [2, 3],
    "learning_rate": [0.01, 0.1],
    "subsample": [0.6, 0.8],
    "colsample_bytree": [0.6, 0.8],
    "gamma": [0, 0.1],
    "min_child_weight": [1, 3, 5],
}
DRAWS = 100
FOLDS = 3

# Stands for a missing feature value where rows with gaps are kept: below every
# real value, so a tree can send the missing ones either way.
MISSING = -1e9


@dataclass(frozen=True)
class TrainedModel:
    version: str
    model: PipelineModel
    features: Sequence[str]
    scaler: Scaler | None
    params: Mapping[str, float]
    keeps_missing: bool


def draw_params(grid: Mapping[str, Sequence], draws: int, seed: int) -> list[dict]:
    """Different points of the grid, at most as many as it has."""
    size = math.prod(len(values) for values in grid.values())
    points = []
    # Points are numbered, the last name changing fastest; the product itself is never built.
    for number in random.Random(seed).sample(range(size), min(draws, size)):
        point = {}
        for name in reversed(list(grid)):
            number, place = divmod(number, len(grid[name]))
            point[name] = grid[name][place]
        points.append({name: point[name] for name in grid})
    return points


def _weight_column(weight: float) -> str:
    return "weight_" + str(weight).replace(".", "_")


def _param_map(gbt: GBTClassifier, params: Mapping[str, float]) -> dict:
    known = {
        "n_estimators": (gbt.maxIter, int),
        "max_depth": (gbt.maxDepth, int),
        "learning_rate": (gbt.stepSize, float),
        "subsample": (gbt.subsamplingRate, float),
        "colsample_bytree": (gbt.featureSubsetStrategy, lambda v: "all" if v >= 1 else str(v)),
        "gamma": (gbt.minInfoGain, float),
        "min_child_weight": (gbt.minInstancesPerNode, int),
        "scale_pos_weight": (gbt.weightCol, _weight_column),
    }
    return {known[name][0]: known[name][1](value) for name, value in params.items()}


def model_inputs(
    df: DataFrame, features: Sequence[str], scaler: Scaler | None, keep_missing: bool
) -> DataFrame:
    """Scale and, where gaps are kept, mark them; the same for fitting and scoring."""
    if scaler is not None:
        df = apply_scaler(df, scaler)
    if keep_missing:
        filled = {
            c: F.coalesce(
                F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(MISSING)
            )
            for c in features
        }
        df = df.withColumns(filled)
    return df


def positive_probability() -> Column:
    return F.get(vector_to_array(F.col("probability")), F.lit(1))


def model_version(train_date: dt.date) -> str:
    return f"credit_model_{train_date:%Y_%m_%d}"


def fit_search(
    train: DataFrame,
    features: Sequence[str],
    grid: Mapping[str, Sequence],
    draws: int,
    folds: int,
    seed: int,
    parallelism: int,
    folder: str,
    parts: str,
    rung_trees: int | None = None,
) -> tuple[PipelineModel, dict, DataFrame]:
    """Best of the drawn parameter points by mean cross-validated AUC on scores.

    Inputs are assembled and written with their folds once below `folder`; every fit only reads them. With
    `rung_trees` points are compared by successive halving from that many trees on, else all at their full number.
    `parts` keeps the figures of every fit. The third result has one row per rung and point.
    """
    spark = train.sparkSession
    weights = sorted(set(grid.get("scale_pos_weight", [1])))
    prepared = train.withColumns(
        {
            LABEL: F.col(LABEL).cast("double"),
            **{
                _weight_column(w): F.when(F.col(LABEL) == 1, F.lit(float(w))).otherwise(F.lit(1.0))
                for w in weights
            },
        }
    )
    gbt = GBTClassifier(labelCol=LABEL, featuresCol="inputs", seed=seed)
    assembler = VectorAssembler(inputCols=list(features), outputCol="inputs")
    weighted = [_weight_column(w) for w in weights]
    ready = assembler.transform(prepared).select(LABEL, "fold", "inputs", *weighted)
    ready.write.parquet(f"{folder}/inputs")
    rows = read_table(spark, f"{folder}/inputs")
    points = draw_params(grid, draws, seed)
    best, steps = halving(rows, gbt, points, _param_map, folds, parts, parallelism, rung_trees)
    model = gbt.fit(rows, _param_map(gbt, points[best]))
    return PipelineModel(stages=[assembler, model]), points[best], steps_frame(spark, points, steps, best)


def train_model(
    spark: SparkSession,
    labels: DataFrame,
    features: DataFrame,
    train_date: dt.date,
    bank: str,
    *,
    oot_months: int = 1,
    train_months: int = 12,
    grid: Mapping[str, Sequence] = WIDE_GRID,
    draws: int = DRAWS,
    folds: int = FOLDS,
    seed: int = 42,
    feature_columns: Sequence[str] | None = None,
    scale: bool = False,
    keep_missing: bool = False,
    parallelism: int = 4,
    rung_trees: int | None = None,
) -> TrainedModel:
    """Fit, evaluate on train / val / out-of-time and enter the model in the bank.

    Defaults follow the full-feature variant: rows with gaps are dropped and
    nothing is scaled. The click-stream variant passes its `fe_` columns with
    `scale=True, keep_missing=True, oot_months=2, grid=SMALL_GRID`. With `rung_trees` the
    search halves its points from that many trees on. A run that broke off in its search goes on where it stopped when it is
    started again with the same rows and settings.
    """
    ensure_checkpoint_dir(spark)
    windows = training_windows(train_date, oot_months, train_months)
    whole = F.col(SNAPSHOT).between(F.lit(windows.train_test_start), F.lit(windows.oot_end))
    labels, features = labels.where(whole), features.where(whole)
    joined = training_set(labels, features, not keep_missing)
    names = list(feature_columns or numeric_columns(joined, NOT_FEATURES))
    # No later step reads another column. Where rows with gaps are dropped, all of them decide first.
    used = list(dict.fromkeys([LOAN, CUSTOMER, SNAPSHOT, LABEL, *names]))
    if keep_missing:
        joined = training_set(labels, features.select(*[f"`{c}`" for c in features.columns if c in used]), False)
    joined = joined.select(*[f"`{c}`" for c in used])

    # Every later step reads these rows several times: a written table keeps the
    # join from running again, also when executors are lost.
    folder = working_folder(spark, "training")
    joined.write.parquet(f"{folder}/joined")
    split_training_set(read_table(spark, f"{folder}/joined"), windows, seed=seed).write.parquet(
        f"{folder}/split"
    )
    rows = read_table(spark, f"{folder}/split")

    train = rows.where(F.col("split") == "train")
    scaler = fit_scaler(train, names) if scale else None
    stratified_folds(train, folds, seed=seed + 1).write.parquet(f"{folder}/folded")
    folded = read_table(spark, f"{folder}/folded")
    # Named by the rows before scaling: sums of doubles may differ in their last bits from run to run.
    settings = [seed, folds, scale, keep_missing, sorted(grid.get("scale_pos_weight", [1]))]
    inputs = fingerprint(folded, [LABEL, "fold", *names], *settings)
    version = model_version(train_date)
    parts = f"{bank}/search_parts/{version}/{inputs}"
    model, params, searched = fit_search(
        model_inputs(folded, names, scaler, keep_missing),
        names,
        grid,
        draws,
        folds,
        seed,
        parallelism,
        folder,
        parts,
        rung_trees,
    )
    trained = TrainedModel(
        version, model, names, scaler, params, keep_missing
    )
    save_model(spark, trained, evaluate(trained, rows), windows, bank)
    overwrite_snapshots(
        searched.withColumn("model_version", F.lit(trained.version)).coalesce(1),
        f"{bank}/searches",
        ["model_version"],
        compact=False,
    )
    remove_folder(spark, folder)
    remove_folder(spark, f"{bank}/search_parts/{version}")
    return trained


def evaluate(trained: TrainedModel, rows: DataFrame) -> DataFrame:
    """Per split: rows, label rate, auc and gini."""
    inputs = model_inputs(rows, trained.features, trained.scaler, trained.keeps_missing)
    scored = trained.model.transform(inputs).select(
        "split", LABEL, positive_probability().alias("model_predictions")
    )
    auc = auc_by_group(scored, ["split"]).select("split", "auc", "gini")
    return split_stats(rows).join(auc, "split", "left")


def save_model(
    spark: SparkSession,
    trained: TrainedModel,
    results: DataFrame,
    windows: TrainingWindows,
    bank: str,
) -> None:
    """Write the model and its one-row-per-split entry; a version can be replaced."""
    trained.model.write().overwrite().save(f"{bank}/models/{trained.version}")
    scaler = trained.scaler
    extra = {
        "model_version": F.lit(trained.version),
        "train_date": F.lit(windows.train_date),
        "train_test_start": F.lit(windows.train_test_start),
        "train_test_end": F.lit(windows.train_test_end),
        "oot_start": F.lit(windows.oot_start),
        "oot_end": F.lit(windows.oot_end),
        "hp_params": F.lit(json.dumps(trained.params, sort_keys=True)),
        "features": F.lit(json.dumps(list(trained.features))),
        "scaler": F.lit(
            json.dumps({"mean": dict(scaler.mean), "deviation": dict(scaler.deviation)})
            if scaler
            else None
        ).cast("string"),
        "keeps_missing": F.lit(trained.keeps_missing),
    }
    overwrite_snapshots(
        results.withColumns(extra).coalesce(1), f"{bank}/entries", ["model_version"], compact=False
    )


def bank_entries(spark: SparkSession, bank: str) -> DataFrame:
    return read_table(spark, f"{bank}/entries")


def load_model(spark: SparkSession, bank: str, version: str) -> TrainedModel:
    entry = bank_entries(spark, bank).where(F.col("model_version") == version).first()
    if entry is None:
        raise ValueError(f"no model {version} in {bank}")
    scaler = json.loads(entry["scaler"]) if entry["scaler"] else None
    return TrainedModel(
        version,
        PipelineModel.load(f"{bank}/models/{version}"),
        json.loads(entry["features"]),
        Scaler(scaler["mean"], scaler["deviation"]) if scaler else None,
        json.loads(entry["hp_params"]),
        entry["keeps_missing"],
    )
