import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from riskmart.operators import splitting
from tests.helpers import values


def test_windows():
    w = splitting.training_windows(dt.date(2024, 9, 1))
    assert (w.train_test_start, w.train_test_end) == (dt.date(2023, 8, 1), dt.date(2024, 7, 31))
    assert (w.oot_start, w.oot_end) == (dt.date(2024, 8, 1), dt.date(2024, 8, 31))
    w = splitting.training_windows(dt.date(2024, 9, 1), oot_months=2)
    assert (w.oot_start, w.train_test_start) == (dt.date(2024, 7, 1), dt.date(2023, 7, 1))


def brute_parts(rows, shares, seed):
    """Rank by hash inside each class, in plain Python."""
    out = {}
    for y in (0, 1):
        keyed = sorted((hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k) for k, l in rows if l == y)
        order = [h for h, _ in keyed]
        for h, k in keyed:
            rank = order.index(h) + 1
            part = len(shares)
            for i in reversed(range(len(shares))):
                if rank <= int(shares[i] * len(keyed) + 0.5):
                    part = i
            out[k] = part
    return out


@pytest.mark.parametrize("shares", [[0.8], [1 / 3, 2 / 3], [0.01], [0.0, 1.0]])
def test_parts_equal_brute_force(spark, shares):
    rows = [(str(i), int(i % 7 == 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, label int")
    got = dict(values(splitting.assign_parts(df, "label", ["k"], shares, 5, "part"), "k", "part"))
    assert got == brute_parts(rows, shares, 5)


def test_split_is_exact_repeatable_and_ignores_partitioning(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as k", "cast(id % 10 = 0 as int) as label")
    once = splitting.stratified_split(df, ["k"])
    again = splitting.stratified_split(df.repartition(7), ["k"])
    counts = {(r["label"], r["split"]): r["count"] for r in once.groupBy("label", "split").count().collect()}
    assert counts == {(0, "train"): 720, (0, "val"): 180, (1, "train"): 80, (1, "val"): 20}
    assert sorted(values(once, "k", "split")) == sorted(values(again, "k", "split"))
    other = splitting.stratified_split(df, ["k"], seed=1)
    assert sorted(values(once, "k", "split")) != sorted(values(other, "k", "split"))


def test_one_key_with_a_third_of_all_rows_stays_together(spark):
    rows = [("hot", 1)] * 500 + [(str(i), 1) for i in range(1000)] + [("z", 0)] * 3
    df = spark.createDataFrame(rows, "k string, label int")
    got = splitting.stratified_split(df, ["k"])
    assert got.count() == len(rows)
    assert got.where("k = 'hot'").select("split").distinct().count() == 1


def test_folds_cover_everything_evenly(spark):
    df = spark.range(900).selectExpr("cast(id as string) as k", "cast(id % 3 = 0 as int) as label")
    folds = splitting.stratified_folds(df, 3, ["k"])
    counts = {(r["label"], r["fold"]): r["count"] for r in folds.groupBy("label", "fold").count().collect()}
    assert counts == {(y, f): n for y, n in ((0, 200), (1, 100)) for f in range(3)}


def test_training_set(spark):
    day = dt.date(2023, 7, 1)
    labels = spark.createDataFrame(
        [("l1", "A", 1, "d", day), ("l2", "B", 0, "d", day), ("l3", "C", 0, "d", day)],
        "loan_id string, Customer_ID string, label int, label_def string, snapshot_date date",
    )
    features = spark.createDataFrame(
        [("x", "A", day, 1.0), ("y", "B", day, None)],
        "loan_id string, Customer_ID string, snapshot_date date, f double",
    )
    complete = splitting.training_set(labels, features)
    assert values(complete, "loan_id", "f") == [("l1", 1.0)]
    kept = splitting.training_set(labels, features, complete_only=False)
    assert sorted(values(kept, "loan_id", "f"), key=str) == [("l1", 1.0), ("l2", None), ("l3", None)]


def test_split_training_set_marks_months(spark):
    windows = splitting.training_windows(dt.date(2024, 1, 1))
    months = spark.range(24).select(
        F.col("id").cast("string").alias("loan_id"),
        F.lit("A").alias("Customer_ID"),
        F.add_months(F.lit(dt.date(2022, 6, 1)), F.col("id").cast("int")).alias("snapshot_date"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    got = splitting.split_training_set(months, windows)
    by_split = {r["split"]: (r["lo"], r["hi"], r["n"]) for r in got.groupBy("split").agg(
        F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi"), F.count("*").alias("n")
    ).collect()}
    assert by_split["oot"] == (dt.date(2023, 12, 1), dt.date(2023, 12, 1), 1)
    assert by_split["train"][2] + by_split["val"][2] == 12
    assert min(by_split["train"][0], by_split["val"][0]) == dt.date(2022, 12, 1)
