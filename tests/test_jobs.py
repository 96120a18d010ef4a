import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from riskmart.operators.silver import silver_loan
from riskmart.plans import mart as jobs
from riskmart.plans import monitoring, scoring, training
from riskmart.plans.layout import Mart
from riskmart.sources import read_raw, read_table, table_exists, tables
from riskmart.sources.schemas import CLICK_FEATURES, LOAN_RAW_SCHEMA, SNAPSHOT
from riskmart.streaming import ingest
from riskmart.streaming.ingest import ingest_available
from tests.helpers import GOOD_FINANCES, as_set, loan_rows, text_rows

START, END = dt.date(2023, 1, 1), dt.date(2024, 12, 1)
GRID = {"n_estimators": [2], "max_depth": [2], "scale_pos_weight": [1, 2]}


def months():
    return [dt.date(2023 + m // 12, m % 12 + 1, 1) for m in range(24)]


def raw_frames(spark):
    """Two years of loans at month six: late payers click more."""
    loans, clicks = [], []
    for m, day in enumerate(months()):
        text = f"{day.day}/{day.month}/{day.year}"
        for i in range(12):
            customer = f"C{(m * 12 + i) % 40}"
            late = (i + m) % 3 == 0
            loans.append(
                dict(
                    loan_id=f"L{m}-{i}",
                    Customer_ID=customer,
                    overdue_amt="250" if late else "0",
                    snapshot_date=text,
                )
            )
            row = {f"fe_{k}": str((i * k + m) % 9) for k in range(1, 21)}
            row["fe_1"] = str(50 + i if late else i)
            clicks.append(dict(Customer_ID=customer, snapshot_date=text, **row))
    people = [f"C{i}" for i in range(40)]
    kinds = ["Good", "Bad", "_", "Standard"]
    finances = [
        {**GOOD_FINANCES, "Customer_ID": c, "Credit_Mix": kinds[i % 4]} for i, c in enumerate(people)
    ]
    attributes = [
        dict(Customer_ID=c, Age=str(20 + i), Occupation=["Chef", "_______"][i % 2])
        for i, c in enumerate(people)
    ]
    sources = jobs.SOURCES
    return {
        "lms_loan_daily": loan_rows(spark, loans),
        "feature_clickstream": text_rows(spark, sources["feature_clickstream"].schema, clicks),
        "features_financials": text_rows(spark, sources["features_financials"].schema, finances),
        "features_attributes": text_rows(
            spark, sources["features_attributes"].schema, attributes, snapshot_date="1/7/2023"
        ),
    }


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    paths = {}
    for name, df in raw_frames(spark).items():
        paths[name] = f"{root}/{name}"
        df.coalesce(1).write.option("header", True).csv(paths[name])
    return paths


@pytest.fixture(scope="module")
def mart(spark, raw, tmp_path_factory):
    built = Mart(str(tmp_path_factory.mktemp("mart")))
    jobs.backfill(spark, built, raw, START, END)
    return built


@pytest.fixture(scope="module")
def model(spark, mart):
    return training.train_model(
        spark,
        read_table(spark, mart.label_store),
        read_table(spark, mart.feature_store),
        dt.date(2024, 6, 1),
        mart.model_bank,
        grid=GRID,
        draws=2,
        folds=2,
    )


def test_backfill_builds_every_month_and_pins_the_vocabulary(spark, mart):
    store = read_table(spark, mart.feature_store)
    assert store.count() == 288
    assert store.select(SNAPSHOT).distinct().count() == 24
    assert {"Credit_Mix_ohe_3", "Occupation_ohe_1", "fe_20", "dpd"} <= set(store.columns)
    labels = read_table(spark, mart.label_store)
    assert labels.where("label = 1").count() == 96
    before = jobs.pinned_vocabulary(spark, mart)
    assert before["Occupation"] == ["Chef", "Unknown"]


def test_running_months_again_changes_nothing(spark, raw, mart):
    before = as_set(read_table(spark, mart.feature_store))
    jobs.backfill(spark, mart, raw, dt.date(2023, 5, 1), dt.date(2023, 6, 1))
    assert as_set(read_table(spark, mart.feature_store)) == before


def test_one_job_equals_month_by_month(spark, raw, mart, tmp_path):
    other = Mart(str(tmp_path))
    for day in (dt.date(2023, 3, 1), dt.date(2023, 4, 1)):
        jobs.backfill(spark, other, raw, day, day)
    picked = read_table(spark, mart.feature_store).where(
        F.col(SNAPSHOT).between(dt.date(2023, 3, 1), dt.date(2023, 4, 1))
    )
    assert as_set(read_table(spark, other.feature_store)) == as_set(picked)
    assert read_table(spark, other.label_store).count() == 24


def test_snapshot_reads_prune_partitions(spark, mart):
    one = tables.read_snapshot(spark, mart.label_store, dt.date(2023, 3, 1))
    assert one.count() == 12
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert tables.read_range(spark, mart.label_store, START, dt.date(2023, 2, 1)).count() == 24
    assert not table_exists(spark, mart.root + "/nothing")


def test_widths_that_changed_are_merged_on_reading(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, dt.date(2023, 1, 1))], "x int, snapshot_date date")
    b = spark.createDataFrame([(2, 5, dt.date(2023, 2, 1))], "x int, y int, snapshot_date date")
    tables.overwrite_snapshots(a, path)
    tables.overwrite_snapshots(b, path)
    got = tables.read_merged(spark, path)
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [(1, None), (2, 5)]


def test_training_enters_the_bank_and_reloads(spark, mart, model):
    assert model.version == "credit_model_2024_06_01"
    assert not set(model.features) & {"dpd", "balance", "payment_ratio", "label"}
    entry = {r["split"]: r for r in training.bank_entries(spark, mart.model_bank).collect()}
    assert {s: r["n"] for s, r in entry.items()} == {"train": 115, "val": 29, "oot": 12}
    assert entry["oot"]["auc"] > 0.9 and entry["oot"]["gini"] == pytest.approx(
        2 * entry["oot"]["auc"] - 1, abs=5e-4
    )
    again = training.load_model(spark, mart.model_bank, model.version)
    features = read_table(spark, mart.feature_store)
    assert as_set(scoring.score(features, again)) == as_set(scoring.score(features, model))
    with pytest.raises(ValueError):
        training.load_model(spark, mart.model_bank, "credit_model_none")


def test_click_variant_keeps_gaps_and_scales(spark, mart):
    features = read_table(spark, mart.feature_store).withColumn(
        "fe_2", F.when(F.col("Customer_ID") != "C1", F.col("fe_2"))
    )
    got = training.train_model(
        spark,
        read_table(spark, mart.label_store),
        features,
        dt.date(2024, 7, 1),
        mart.model_bank,
        oot_months=2,
        grid={"n_estimators": [2], "max_depth": [2]},
        draws=1,
        folds=2,
        feature_columns=CLICK_FEATURES,
        scale=True,
        keep_missing=True,
    )
    loaded = training.load_model(spark, mart.model_bank, got.version)
    assert loaded.scaler == got.scaler and set(loaded.scaler.mean) == set(CLICK_FEATURES)
    assert scoring.score(features, loaded).count() == 288


def test_scoring_and_monitoring(spark, mart, model):
    scoring.score_months(spark, mart, model.version, START, END)
    predicted = read_table(spark, mart.predictions).where(F.col("model_name") == model.version)
    assert predicted.count() == 288
    assert predicted.where("model_predictions not between 0 and 1").count() == 0

    day = dt.date(2024, 8, 1)
    flags = monitoring.monitor(spark, mart, model.version, day)
    found = {r["kind"]: r["severity"] for r in flags.collect()}
    assert found["performance"] == "healthy"
    assert found["feature"] in ("healthy", "warning", "critical")
    log = read_table(spark, mart.drift_log).where(F.col(SNAPSHOT) == F.lit(day))
    once = as_set(log)
    monitoring.monitor(spark, mart, model.version, day)
    assert as_set(read_table(spark, mart.drift_log).where(F.col(SNAPSHOT) == F.lit(day))) == once

    early = monitoring.monitor(spark, mart, model.version, dt.date(2024, 6, 1))
    assert {r["kind"]: r["severity"] for r in early.collect()} == {
        "performance": "healthy",
        "feature": "unknown",
    }
    none = monitoring.monitor(spark, mart, "credit_model_none", dt.date(2024, 6, 1))
    assert {r["severity"] for r in none.collect()} == {"unknown"}


def test_retrain_decision(spark):
    a, b = dt.date(2024, 7, 1), dt.date(2024, 8, 1)
    flags = spark.createDataFrame(
        [(a, "m", "performance", "critical"), (a, "m", "feature", "healthy"), (b, "m", "feature", "warning"),
         (b, "n", "feature", None)],
        "snapshot_date date, model_name string, kind string, severity string",
    )
    got = {(r[SNAPSHOT], r["model_name"]): r["retrain"] for r in monitoring.retrain_decisions(flags).collect()}
    assert got == {(a, "m"): True, (b, "m"): False, (b, "n"): False}
    assert monitoring.should_retrain(flags, a, "m")
    assert not monitoring.should_retrain(flags, b, "m")


def test_draws_are_seeded_and_distinct():
    points = training.draw_params(training.WIDE_GRID, 50, 7)
    assert points == training.draw_params(training.WIDE_GRID, 50, 7)
    assert len({tuple(p.values()) for p in points}) == 50
    assert len(training.draw_params({"n_estimators": [1, 2]}, 100, 1)) == 2


def write_month(spark, folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    header = LOAN_RAW_SCHEMA.names
    base = loan_rows(spark, rows).collect()
    with open(f"{folder}/{name}.csv", "w") as out:
        out.write(",".join(header) + "\n")
        for row in base:
            out.write(",".join("" if v is None else v for v in row) + "\n")


def test_stream_takes_each_file_once_and_late_rows_add(spark, tmp_path):
    source, bronze, silver, checkpoint = (
        str(tmp_path / n) for n in ("in", "bronze", "silver", "checkpoint")
    )

    def run():
        ingest_available(spark, source, bronze, silver, checkpoint)
        return read_table(spark, silver)

    write_month(spark, source, "jan", [dict(loan_id=f"a{i}", snapshot_date="1/1/2023") for i in range(3)])
    write_month(spark, source, "feb", [dict(loan_id=f"b{i}", snapshot_date="1/2/2023") for i in range(2)])
    assert run().count() == 5
    assert run().count() == 5
    write_month(
        spark,
        source,
        "late",
        [dict(loan_id="late", snapshot_date="1/1/2023"), dict(loan_id="c", snapshot_date="1/3/2023"),
         dict(loan_id="lost", snapshot_date="someday")],
    )
    got = run()
    counts = {str(r[SNAPSHOT]): r["count"] for r in got.groupBy(SNAPSHOT).count().collect()}
    assert counts == {"2023-01-01": 4, "2023-02-01": 2, "2023-03-01": 1}
    everything = silver_loan(read_raw(spark, source, LOAN_RAW_SCHEMA)).where(F.col(SNAPSHOT).isNotNull())
    assert as_set(got.select(*everything.columns)) == as_set(everything)


def loan_files(spark, source, name, days, count=3):
    write_month(spark, source, name, [dict(loan_id=f"{name}{i}", snapshot_date=d) for d in days for i in range(count)])


def files_below(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    source, bronze, silver, checkpoint = (str(tmp_path / n) for n in ("in", "bronze", "silver", "checkpoint"))
    loan_files(spark, source, "a", ["1/1/2023", "1/2/2023"], 4000)
    ingest_available(spark, source, bronze, silver, checkpoint)
    before = {p: files_below(p) for p in (bronze, silver)}
    loan_files(spark, source, "b", ["1/1/2023"], 2)
    ingest_available(spark, source, bronze, silver, checkpoint)
    for path, old in before.items():
        new = files_below(path)
        assert {f: new[f] for f in old} == old
        added = sum(os.path.getsize(f) for f in new.keys() - old.keys())
        assert 0 < added < sum(os.path.getsize(f) for f in old) / 5
    counts = {str(r[SNAPSHOT]): r["count"] for r in read_table(spark, silver).groupBy(SNAPSHOT).count().collect()}
    assert counts == {"2023-01-01": 4002, "2023-02-01": 4000}


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    bronze, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    batch = loan_rows(spark, [dict(loan_id=str(i), snapshot_date="1/1/2023") for i in range(5)]).withColumn(ingest.FILE, F.lit("f"))
    clean = silver_loan
    with pytest.raises(ZeroDivisionError):  # broken off between bronze and silver
        ingest.take_batch(batch, "s-1", bronze, silver, lambda df: 1 / 0)
    assert ingest.take_batch(batch, "s-1", bronze, silver, clean)
    assert not ingest.take_batch(batch, "s-1", bronze, silver, clean)
    assert ingest.take_batch(batch.limit(2), "s-2", bronze, silver, clean)
    assert read_table(spark, bronze).count() == read_table(spark, silver).count() == 7
    rows = sorted(read_table(spark, silver).drop(ingest.BATCH).collect(), key=repr)
    day = dt.date(2023, 1, 1)
    assert len(ingest.compact_months(spark, silver, day, day)) == 1
    assert ingest.compact_months(spark, silver, day, day) == []
    assert sorted(read_table(spark, silver).drop(ingest.BATCH).collect(), key=repr) == rows
    assert len(os.listdir(f"{silver}/{SNAPSHOT}=2023-01-01")) == 1
    assert not ingest.take_batch(batch, "s-1", bronze, silver, clean)
    assert ingest.take_batch(batch.limit(1), "s-3", bronze, silver, clean)
    assert read_table(spark, silver).count() == 8


def test_a_broken_compaction_is_finished(spark, tmp_path, monkeypatch):
    path, day = str(tmp_path / "silver"), dt.date(2023, 1, 1)
    for i in range(3):
        one = spark.createDataFrame([(i, day, f"b{i}")], "x int, snapshot_date date, batch string")
        tables.overwrite_snapshots(one, path, [SNAPSHOT, ingest.BATCH])
    plain = ingest.remove_folder
    calls = []

    def breaks(spark, folder):
        calls.append(folder)
        if len(calls) == 2:
            raise RuntimeError("lost")
        plain(spark, folder)

    monkeypatch.setattr(ingest, "remove_folder", breaks)
    with pytest.raises(RuntimeError):
        ingest.compact_months(spark, path, day, day)
    assert ingest.finish_compaction(spark, path) and not ingest.finish_compaction(spark, path)
    assert sorted(r.x for r in read_table(spark, path).collect()) == [0, 1, 2]


def test_months_are_ready_with_all_sources(spark, tmp_path):
    from riskmart.streaming import readiness

    readiness.use_state_store(spark)
    a, b, c, d = readiness.SOURCES
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    months = [dt.date(2024, m, 1) for m in range(1, 7)]
    batches = [
        [(a, months[0], at(0)), (b, months[0], at(1)), (c, months[0], at(2)), (d, months[0], at(3)), (a, months[0], at(3))],
        [(a, months[1], at(4)), (b, months[1], at(5)), (c, months[1], at(6)), ("other", months[1], at(6)), (None, months[1], at(6))],
        [(x, months[2], at(7 + i)) for i, x in enumerate((a, b))],
        [(c, months[2], at(12)), (d, months[2], at(16)), (d, months[1], at(16))],
        [(a, months[3], at(20)), (b, months[3], at(21)), (c, months[3], at(22)), (d, months[3], at(40)), (a, months[4], at(41))],
        [(a, months[5], at(60))],
        [(a, months[5], at(61))],
    ]
    schema = "source string, snapshot_date date, arrived_at timestamp"
    source = str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = readiness.months_ready(stream, 10)
    out.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r.snapshot_date, r.status): (r.arrived, r.missing, r.at) for r in read_table(spark, str(tmp_path / "out")).collect()}
    assert got == {
        (months[0], "ready"): (4, "", at(3)),
        (months[1], "incomplete"): (3, d, at(14)),
        (months[1], "late"): (4, "", at(16)),
        (months[2], "ready"): (4, "", at(16)),
        (months[3], "incomplete"): (3, d, at(30)),
        (months[3], "late"): (4, "", at(40)),
        (months[4], "incomplete"): (1, f"{b},{c},{d}", at(51)),
    }


def test_raw_files_are_read_by_name(spark, tmp_path):
    path = str(tmp_path / "loans.csv")
    names = list(reversed(LOAN_RAW_SCHEMA.names))
    with open(path, "w") as out:
        out.write(",".join(["extra", *names]) + "\n")
        out.write(",".join(["?", *names]) + "\n")
    row = read_raw(spark, path, LOAN_RAW_SCHEMA).first().asDict()
    assert row == {name: name for name in LOAN_RAW_SCHEMA.names}
    with open(path, "w") as out:
        out.write("loan_id\n1\n")
    with pytest.raises(ValueError):
        read_raw(spark, path, LOAN_RAW_SCHEMA)


def test_a_month_that_becomes_empty_keeps_no_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(1, dt.date(2023, m, 1), "a b/c") for m in (1, 2, 3)] + [(1, dt.date(2023, 2, 1), "other")]
    df = spark.createDataFrame(rows, "x int, snapshot_date date, model_name string")
    by = ["model_name", "snapshot_date"]
    tables.overwrite_snapshots(df, path, by, replaced={})
    again = df.where("snapshot_date = date'2023-03-01'").withColumn("x", F.lit(2))
    tables.overwrite_snapshots(
        again, path, by, replaced={"model_name": ("a b/c",) * 2, "snapshot_date": (dt.date(2023, 2, 1), dt.date(2023, 3, 1))}
    )
    got = {(r.x, str(r.snapshot_date), r.model_name) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "2023-01-01", "a b/c"), (2, "2023-03-01", "a b/c"), (1, "2023-02-01", "other")}


def test_only_firsts_of_a_month_are_snapshots(spark):
    days = [dt.date(2023, 1, 1), dt.date(2023, 1, 15), None, dt.date(2023, 2, 1), dt.date(2023, 3, 1)]
    df = spark.createDataFrame([(d,) for d in days], "snapshot_date date")
    got = jobs.in_months(df, dt.date(2023, 1, 20), dt.date(2023, 2, 28))
    assert [r[0] for r in got.orderBy("snapshot_date").collect()] == [days[0], days[3]]


def test_stream_survives_a_batch_without_a_date(spark, tmp_path):
    source, bronze, silver, checkpoint = (str(tmp_path / n) for n in ("in", "bronze", "silver", "checkpoint"))
    write_month(spark, source, "bad", [dict(loan_id="x", snapshot_date="someday")])
    ingest_available(spark, source, bronze, silver, checkpoint)
    assert not table_exists(spark, silver)
    write_month(spark, source, "good", [dict(loan_id="y", snapshot_date="1/1/2023")])
    ingest_available(spark, source, bronze, silver, checkpoint)
    assert [r.loan_id for r in read_table(spark, silver).collect()] == ["y"]
    assert not [n for n in os.listdir(bronze) if n.startswith("source_file")]


def test_a_range_opens_its_own_folders(spark, tmp_path):
    path = str(tmp_path / "table")
    days = [dt.date(2023, m, 1) for m in (1, 2, 3)]
    tables.overwrite_snapshots(spark.createDataFrame([(d, i) for i, d in enumerate(days)], "snapshot_date date, x int"), path)
    one = tables.read_snapshot(spark, path, days[1])
    assert [r.x for r in one.collect()] == [1] and len(one.inputFiles()) == 1
    none = tables.read_range(spark, path, dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    assert none.count() == 0 and sorted(none.columns) == ["snapshot_date", "x"]
    assert tables.read_range(spark, path, days[0], days[2]).count() == 3
