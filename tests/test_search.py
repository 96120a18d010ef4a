import datetime as dt
import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskmart.plans import training
from riskmart.plans.search import budgets, fingerprint, first_trees, halving, known_fits, steps_frame
from riskmart.sources import table_exists

POINTS = [
    {"max_depth": depth, "learning_rate": rate, "n_estimators": trees}
    for trees in (1, 2, 6)
    for depth in (1, 3)
    for rate in (0.1, 0.3)
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Two features that only together tell the classes apart: deep trees win."""
    rng = random.Random(4)
    found = []
    for i in range(360):
        x, y = rng.random(), rng.random()
        label = float((x > 0.5) != (y > 0.5)) if rng.random() < 0.9 else float(rng.random() < 0.5)
        found.append((label, i % 3, [x, y]))
    path = str(tmp_path_factory.mktemp("search")) + "/rows"
    df = spark.createDataFrame(found, "label double, fold int, x array<double>")
    df.select("label", "fold", array_to_vector("x").alias("inputs")).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def classifier():
    return GBTClassifier(labelCol="label", featuresCol="inputs", seed=5)


def counting(calls, stop_at=None):
    def mapped(gbt, params):
        if stop_at is not None and len(calls) >= stop_at:
            raise RuntimeError("broken off")
        calls.append(dict(params))
        return training._param_map(gbt, params)

    return mapped


def test_budgets_grow_to_the_largest():
    assert budgets(500, None) == [500]
    assert budgets(500, 20) == [20, 60, 180, 500]
    assert budgets(6, 6) == [6] and budgets(6, 9) == [6] and budgets(6, 2, 2) == [2, 4, 6]


def test_first_trees_are_the_smaller_model(spark, rows):
    large, small = classifier().setMaxIter(6).fit(rows), classifier().setMaxIter(2).fit(rows)
    cut = first_trees(large, 2)
    assert cut.getNumTrees == 2 and first_trees(large, 6) is large

    def scores(model):
        p = F.round(F.get(vector_to_array("probability"), F.lit(1)), 9)
        return sorted(r[0] for r in model.transform(rows).select(p).collect())

    assert scores(cut) == scores(small) != scores(large)


def test_halving_finds_the_full_searchs_best_point_with_fewer_fits(spark, rows, tmp_path):
    few, all_of_them = [], []
    best, steps = halving(rows, classifier(), POINTS, counting(few), 3, f"{tmp_path}/a", first=2)
    full, compared = halving(rows, classifier(), POINTS, counting(all_of_them), 3, f"{tmp_path}/b")
    assert best == full and POINTS[best]["max_depth"] == 3
    trees = POINTS[best]["n_estimators"]
    assert [(s.rung, s.trees) for s in steps if s.point == best] == [(0, min(2, trees)), (1, trees)]
    assert len(compared) == len(POINTS) == sum(s.rung == 0 for s in steps) and sum(s.rung == 1 for s in steps) == 4
    # Points that differ in their trees only share a fit: four kinds, three folds.
    assert len(all_of_them) == 12
    assert {s.rows for s in steps} == {360}
    frame = steps_frame(spark, POINTS, steps, best).collect()
    assert sum(r.kept for r in frame) == 5 and [r.point for r in frame if r.chosen] == [best]


def test_a_search_that_was_broken_off_only_fits_what_is_missing(spark, rows, tmp_path):
    whole, some, rest = [], [], []
    once = halving(rows, classifier(), POINTS, counting(whole), 3, f"{tmp_path}/a", 1, first=2)
    with pytest.raises(RuntimeError):
        halving(rows, classifier(), POINTS, counting(some, 9), 3, f"{tmp_path}/b", 1, first=2)
    assert len(some) == 9 and len(known_fits(spark, f"{tmp_path}/b")) >= 9
    again = halving(rows, classifier(), POINTS, counting(rest), 3, f"{tmp_path}/b", 1, first=2)
    assert again == once and len(some) + len(rest) == len(whole)
    finished = halving(rows, classifier(), POINTS, counting(none := []), 3, f"{tmp_path}/b", 1, first=2)
    assert finished == once and none == []


def test_ties_go_by_the_order_of_the_points_and_one_point_is_enough(spark, rows, tmp_path):
    twice = [POINTS[0], dict(POINTS[0])]
    assert halving(rows, classifier(), twice, counting([]), 3, f"{tmp_path}/a")[0] == 0
    assert halving(rows, classifier(), POINTS[-1:], counting([]), 3, f"{tmp_path}/b", first=1)[0] == 0


def test_fingerprints_know_rows_and_settings_but_no_order(spark):
    a = spark.createDataFrame([(1, None), (2, 0.5)], "k int, x double")
    b = a.orderBy(F.desc("k")).repartition(3)
    assert fingerprint(a, ["k", "x"], 7) == fingerprint(b, ["k", "x"], 7)
    others = [(a.where("k = 1"), ["k", "x"], 7), (a, ["k"], 7), (a, ["k", "x"], 8), (a.union(a), ["k", "x"], 7)]
    assert len({fingerprint(*o) for o in others} | {fingerprint(a, ["k", "x"], 7)}) == 5


def test_training_writes_only_what_it_uses(spark, tmp_path, monkeypatch):
    """Columns no later step reads are neither joined nor written; the rows of a repeated customer stay."""
    months = [dt.date(2023, m, 1) for m in range(1, 8)]
    keyed = [(f"{m}-{i}", f"C{i}", int(i % 3 == 0), "x", m) for m in months for i in range(30)]
    labels = spark.createDataFrame(keyed, "loan_id string, Customer_ID string, label int, label_def string, snapshot_date date")
    seen = [(c, m, float(label), None, "text") for _, c, label, _, m in keyed for _ in range(1 + (c == "C4"))]
    features = spark.createDataFrame(seen, "Customer_ID string, snapshot_date date, fe_1 double, fe_2 double, note string")
    monkeypatch.setattr(training, "remove_folder", lambda spark, path: None)
    folders = []
    keep = training.working_folder
    monkeypatch.setattr(training, "working_folder", lambda *a: folders.append(keep(*a)) or folders[-1])
    for whole in (False, True):
        training.train_model(
            spark, labels, features.na.fill(0.0) if whole else features, dt.date(2023, 8, 1), f"{tmp_path}/{whole}", train_months=6,
            grid={"n_estimators": [1], "max_depth": [1]}, draws=1, folds=2, feature_columns=["fe_1"], keep_missing=not whole,
        )
        joined = spark.read.parquet(f"{folders[-1]}/joined")
        assert set(joined.columns) == {"loan_id", "Customer_ID", "label", "snapshot_date", "fe_1"}
        assert joined.count() == 7 * 31
        folded = spark.read.parquet(f"{folders[-1]}/folded")
        assert folded.count() == spark.read.parquet(f"{folders[-1]}/inputs").count()


def test_training_that_broke_off_goes_on(spark, tmp_path, monkeypatch):
    months = [dt.date(2023, m, 1) for m in range(1, 8)]
    rng = random.Random(2)
    labels, features = [], []
    for m in months:
        for i in range(40):
            label = int(i % 3 == 0)
            labels.append((f"{m}-{i}", f"C{i}", label, m))
            features.append((f"C{i}", m, label + rng.random(), rng.random()))
    labels = spark.createDataFrame(labels, "loan_id string, Customer_ID string, label int, snapshot_date date")
    features = spark.createDataFrame(features, "Customer_ID string, snapshot_date date, fe_1 double, fe_2 double")
    grid = {"n_estimators": [1, 4], "max_depth": [1, 2]}
    bank = str(tmp_path)

    def train():
        return training.train_model(
            spark, labels, features, dt.date(2023, 8, 1), bank,
            train_months=6, grid=grid, draws=4, folds=2, rung_trees=1, scale=True, parallelism=1,
        )

    calls, stops, good = [], [4], training._param_map

    def failing(gbt, params):
        calls.append(params)
        if stops and len(calls) == stops[0]:
            raise RuntimeError("broken off")
        return good(gbt, params)

    monkeypatch.setattr(training, "_param_map", failing)
    with pytest.raises(RuntimeError):
        train()
    assert table_exists(spark, f"{bank}/search_parts/*/*/*")
    stops.clear()
    trained = train()
    # Two kinds of trees on two folds, then those that go on with four trees, then the whole model.
    rungs = spark.read.parquet(f"{bank}/searches").groupBy("rung").count().collect()
    assert {r["rung"]: r["count"] for r in rungs} == {0: 4, 1: 2, 2: 1}
    assert trained.version == "credit_model_2023_08_01"
    assert not table_exists(spark, f"{bank}/search_parts/*/*/*")
    fitted = len(calls) - 1
    calls.clear()
    train()
    assert fitted == len(calls)
