"""A parameter search over boosted trees that can be broken off: successive halving, results kept per point and fold.

Points are compared at growing numbers of trees; after each rung the better part goes on.
Points that only differ in their number of trees share their fits: the first trees of a larger model are
the smaller model. Every fit leaves its figures in a folder of its own, so a search
that was broken off only fits what is missing.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.sources import overwrite_table, table_exists

TREES = "n_estimators"
FIT_SCHEMA = "params string, fold int, trees int, auc double, rows long"
STEP_SCHEMA = (
    "rung int, budget int, trees int, point int, params string, mean_auc double, deviation double, rows long, kept boolean, chosen boolean"
)
#: Of so many points one goes on to the next rung, which has so many times the trees.
FACTOR = 3


@dataclass(frozen=True)
class Step:
    rung: int
    budget: int
    trees: int
    point: int
    mean: float
    deviation: float
    rows: int


def budgets(most: int, first: int | None, factor: int = FACTOR) -> list[int]:
    """Trees of each rung; the last one has all of them. Without `first` there is one rung, the full search."""
    found = []
    while first is not None and first < most:
        found.append(first)
        first *= factor
    return [*found, most]


def fingerprint(rows: DataFrame, columns: Sequence[str], *settings) -> str:
    """Names the rows, whatever their order, and the settings: only figures of the same inputs are taken over."""
    values = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    found = rows.agg(F.count(F.lit(1)), F.sum(values.cast("decimal(38,0)"))).first()
    said = json.dumps([list(columns), [str(x) for x in found], *settings], default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:32]


def first_trees(model: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The model that boosting had made when it had `count` trees."""
    if count >= model.getNumTrees:
        return model
    java = model._java_obj
    gateway = SparkContext.getOrCreate()._gateway
    of_trees = gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = gateway.new_array(of_trees, count), gateway.new_array(gateway.jvm.double, count)
    for i in range(count):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{count}", trees, weights)
    return GBTClassificationModel(cut).setFeaturesCol(model.getFeaturesCol())


def _core(params: Mapping) -> str:
    """What a fit depends on but for its number of trees."""
    return json.dumps({k: v for k, v in params.items() if k != TREES}, sort_keys=True)


def known_fits(spark: SparkSession, parts: str) -> dict[tuple[str, int, int], tuple[float, int]]:
    """(core, fold, trees) -> (auc, rows) of all fits that were finished; some figures per fit, never rows."""
    if not table_exists(spark, f"{parts}/*"):
        return {}
    rows = spark.read.schema(FIT_SCHEMA).parquet(f"{parts}/*").collect()
    return {(r["params"], r["fold"], r["trees"]): (r["auc"], r["rows"]) for r in rows}


def halving(
    rows: DataFrame,
    gbt: GBTClassifier,
    points: Sequence[Mapping],
    param_map: Callable[[GBTClassifier, Mapping], dict],
    folds: int,
    parts: str,
    parallelism: int = 4,
    first: int | None = None,
    factor: int = FACTOR,
) -> tuple[int, list[Step]]:
    """(number of the best point, all comparisons), by mean AUC on scores over the folds.

    `rows` has the classifier's columns and `fold` (0 to folds - 1) and should be a written table; `parts` is the folder
    of the finished fits of these inputs. Each rung fits its points with up to its budget of trees; one of
    `factor` goes on (at least one; ties by the points' order). A fold whose AUC is no number counts as 0.
    Spark's boosting cannot go on from given trees, so a rung fits anew; with budgets that grow by the factor
    all earlier rungs together have at most half the trees of a point's last one.
    """
    spark = rows.sparkSession
    evaluator = BinaryClassificationEvaluator(
        labelCol=gbt.getLabelCol(), rawPredictionCol=gbt.getRawPredictionCol(), metricName="areaUnderROC", numBins=0
    )
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    done = known_fits(spark, parts)

    def fit(task: tuple[str, int, tuple[int, ...]]) -> list[tuple]:
        core, fold, wanted = task
        chosen = {**param_map(gbt, json.loads(core)), gbt.maxIter: max(wanted)}
        model = gbt.fit(rows.where(F.col("fold") != fold), chosen)
        held = rows.where(F.col("fold") == fold)
        found = []
        for trees in wanted:
            auc = float(evaluator.evaluate(first_trees(model, trees).transform(held)))
            found.append((core, fold, trees, 0.0 if math.isnan(auc) else auc, sizes.get(fold, 0)))
        name = hashlib.sha256(json.dumps(task).encode()).hexdigest()[:32]
        overwrite_table(spark.createDataFrame(found, FIT_SCHEMA).coalesce(1), f"{parts}/{name}")
        return found

    steps: list[Step] = []
    left = list(range(len(points)))
    tops = budgets(max(int(p[TREES]) for p in points), first, factor)
    for rung, top in enumerate(tops):
        trees = {i: min(int(points[i][TREES]), top) for i in left}
        missing: dict[tuple[str, int], set[int]] = {}
        for i in left:
            for fold in range(folds):
                if (_core(points[i]), fold, trees[i]) not in done:
                    missing.setdefault((_core(points[i]), fold), set()).add(trees[i])
        tasks = [(core, fold, tuple(sorted(wanted))) for (core, fold), wanted in sorted(missing.items())]
        with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
            for found in pool.imap_unordered(inheritable_thread_target(spark)(fit), tasks):
                done.update({r[:3]: r[3:] for r in found})
        compared = []
        for i in left:
            of_folds = [done[_core(points[i]), fold, trees[i]] for fold in range(folds)]
            aucs = [auc for auc, _ in of_folds]
            compared.append(Step(rung, top, trees[i], i, fmean(aucs), pstdev(aucs), sum(n for _, n in of_folds)))
        steps += compared
        keep = math.ceil(len(left) / factor) if rung + 1 < len(tops) else 1
        left = [s.point for s in sorted(compared, key=lambda s: (-s.mean, s.point))[:keep]]
    return left[0], steps


def steps_frame(spark: SparkSession, points: Sequence[Mapping], steps: Sequence[Step], best: int) -> DataFrame:
    """One row per rung and point; `kept` tells whether it went on, `chosen` marks the winner's last row."""
    last = max(s.rung for s in steps)
    on = {(s.rung, s.point) for s in steps}
    rows = [
        (
            s.rung,
            s.budget,
            s.trees,
            s.point,
            json.dumps(dict(points[s.point]), sort_keys=True),
            s.mean,
            s.deviation,
            s.rows,
            (s.rung + 1, s.point) in on or (s.rung == last and s.point == best),
            s.rung == last and s.point == best,
        )
        for s in steps
    ]
    return spark.createDataFrame(rows, STEP_SCHEMA)
