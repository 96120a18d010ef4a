import bisect
import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskmart.operators import drift, metrics, quantiles, scaling
from tests.helpers import values

SLOW = dict(
    max_examples=8,
    deadline=None,
    phases=[Phase.explicit, Phase.reuse, Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


def pairwise_auc(scores, labels):
    bad = [s for s, y in zip(scores, labels) if y == 1]
    good = [s for s, y in zip(scores, labels) if y == 0]
    won = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    return won / (len(bad) * len(good))


def scored(spark, groups):
    rows = [(g, s, y) for g, pairs in groups.items() for s, y in pairs]
    return spark.createDataFrame(rows, "g string, model_predictions double, label int")


def auc_of(spark, groups):
    got = metrics.auc_by_group(scored(spark, groups), ["g"])
    return dict(values(got, "g", "auc"))


@settings(**SLOW)
@given(
    st.lists(
        st.lists(
            st.tuples(
                st.one_of(
                    st.sampled_from([0.0, 0.25, 0.5, 1.0, -0.0]),
                    st.floats(0, 1),
                    st.floats(allow_nan=False, allow_infinity=False),
                    st.floats(0.5, 0.5 + 1e-14),
                ),
                st.integers(0, 1),
            ),
            min_size=2,
            max_size=60,
        ),
        min_size=1,
        max_size=6,
    )
)
def test_auc_equals_pair_counting(spark, lists):
    groups = {str(i): pairs for i, pairs in enumerate(lists)}
    got = auc_of(spark, groups)
    for g, pairs in groups.items():
        labels = [y for _, y in pairs]
        if len(set(labels)) < 2:
            assert g not in got
        else:
            assert got[g] == pytest.approx(pairwise_auc(*zip(*pairs)), abs=1e-12)


def test_auc_of_extreme_scores_and_gaps(spark):
    inf = math.inf
    pairs = [(inf, 1), (1e308, 0), (-inf, 0), (None, 1), (math.nan, 1), (0.5, None), (0.1, 1)]
    assert auc_of(spark, {"a": pairs})["a"] == pytest.approx(
        pairwise_auc([inf, 1e308, -inf, 0.1], [1, 0, 0, 1])
    )


def test_bits_order_as_doubles_do(spark):
    import random
    import struct

    rng = random.Random(5)
    values = [struct.unpack("<d", rng.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(3000)]
    values += [s * 2.0**e * f for e in range(-1074, 1024) for f in (1.0, 1 - 2.0**-53, 1 + 2.0**-52) for s in (1, -1)]
    values += [0.0, -0.0, float("inf"), float("-inf"), 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    values = [v for v in values if v == v]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", metrics.ordered_bits(F.col("v")).alias("b")).collect()
    for row in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(row["v"])))[0]
        assert row["b"] == (-bits if row["v"] < 0 else bits)


@pytest.mark.parametrize("score", ["1e-5 + cast(id as double) * 1e-18", "1e300 * (1 + cast(id as double) * 2.3e-16)"])
def test_close_scores_never_stand_in_one_window(spark, score):
    rows = spark.range(1_000_000).selectExpr("1 as g", f"{score} as model_predictions", "cast(id % 3 = 0 as int) as label")
    cells = metrics.level_cells(rows, ["g"])
    assert cells.groupBy("level", "grp").count().agg(F.max("count")).first()[0] <= 65_536
    distinct = rows.select("model_predictions").distinct().count()
    assert distinct > 900_000
    if distinct == 1_000_000:
        # Every third score is bad: of the good ones about as many stand below as above.
        below = sum(i - (i + 2) // 3 for i in range(0, 1_000_000, 3))
        good = 1_000_000 - 333_334
        assert metrics.auc_by_group(rows, ["g"]).first()["auc"] == pytest.approx(below / (333_334 * good), abs=1e-12)


def test_auc_matches_the_ml_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(20000).select(
        F.lit("a").alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(997)) / 997.0 + F.pmod(F.hash("id"), F.lit(3)) / 30).alias(
            "model_predictions"
        ),
        F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("label"),
    )
    exact = BinaryClassificationEvaluator(
        rawPredictionCol="model_predictions", labelCol="label", numBins=0
    ).evaluate(df)
    assert metrics.auc_by_group(df, ["g"]).first()["auc"] == pytest.approx(exact, abs=1e-10)


def test_f1_and_performance(spark):
    df = scored(
        spark,
        {
            "a": [(0.9, 1), (0.8, 0), (0.2, 1), (0.1, 0)],
            "none": [(0.1, 1), (0.2, 0)],
            "one class": [(0.9, 1), (0.1, 1)],
            "edge": [(0.5, 1), (0.6, 0)],
        },
    )
    f1 = dict(values(metrics.f1_by_group(df, ["g"]), "g", "f1"))
    assert f1 == {"a": 0.5, "none": 0.0, "edge": 0.0}
    got = {r["g"]: (r["f1"], r["auc"], r["severity"]) for r in metrics.performance(df, ["g"]).collect()}
    assert got == {
        "a": (0.5, 0.75, "healthy"),
        "none": (0.0, 0.0, "critical"),
        "edge": (0.0, 0.0, "critical"),
    }


def test_severity_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (0.69, 0.7, 0.7499, 0.75, None)], "auc double")
    assert [r[0] for r in df.select(metrics.auc_severity(F.col("auc"))).collect()] == [
        "critical", "warning", "warning", "healthy", None,
    ]


def test_bad_rate_and_split_stats(spark):
    day = dt.date(2023, 1, 1)
    rows = [(1, 30, day), (1, 29, day), (2, None, day), (2, 60, dt.date(2024, 5, 1))]
    df = spark.createDataFrame(rows, "mob int, dpd int, loan_start_date date")
    early = metrics.bad_rate_by_mob(df, dt.date(2024, 1, 1))
    assert sorted(values(early, "mob", "bad_rate", "n")) == [(1, 0.5, 2), (2, 0.0, 1)]
    sdf = spark.createDataFrame([("t", 1), ("t", 0), ("t", 0), ("v", 1)], "split string, label int")
    assert sorted(values(metrics.split_stats(sdf), "split", "n", "label_rate")) == [
        ("t", 3, 0.33), ("v", 1, 1.0),
    ]


# --- quantiles ---------------------------------------------------------------

finite = st.floats(-1e6, 1e6, allow_nan=False)


@settings(**SLOW)
@given(st.lists(st.one_of(finite, st.sampled_from([0.0, 1.0, 1e300])), min_size=1, max_size=200))
def test_quantiles_equal_numpy(spark, xs):
    df = spark.createDataFrame([(x, 1.0) for x in xs], "x double, c double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, ["x", "c"], probabilities)
    assert got["x"] == pytest.approx(list(np.quantile(xs, probabilities)), rel=1e-12, abs=1e-9)
    assert got["c"] == [1.0] * 6


def test_quantiles_zoom_when_no_interval_is_small(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 3)
    monkeypatch.setattr(quantiles, "CELLS", 4)
    xs = [float(i % 97) for i in range(1000)] + [1e9] + [5.0] * 400
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    probabilities = [i / 10 for i in range(1, 10)]
    got = quantiles.exact_quantiles(df, ["x"], probabilities)
    assert got["x"] == pytest.approx(list(np.quantile(xs, probabilities)))


def test_quantiles_of_gaps_and_of_nothing(spark):
    df = spark.createDataFrame(
        [(1.0, None), (None, None), (3.0, None), (float("nan"), None)], "x double, y double"
    )
    assert quantiles.exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [2.0], "y": None}


# --- drift -------------------------------------------------------------------


def psi_by_definition(baseline, snapshot, buckets=10):
    """Deciles of the sorted baseline by hand, values placed by bisection, one summand per bin."""
    ordered = sorted(baseline)

    def decile(number):
        place = number * (1 / buckets) * (len(ordered) - 1)
        below = int(place)
        low, high = ordered[below], ordered[min(below + 1, len(ordered) - 1)]
        part = place - below
        return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)

    inner = [decile(number) for number in range(1, buckets)]
    held = {name: [0] * buckets for name in ("then", "now")}
    for name, rows in (("then", baseline), ("now", snapshot)):
        for value in rows:
            held[name][bisect.bisect_right(inner, value)] += 1 / len(rows)
    total = 0.0
    for then, now in zip(held["then"], held["now"]):
        total += (now - then) * math.log((now + 1e-6) / (then + 1e-6))
    return total


def psi_of(spark, base, current):
    kind = "x double, y double"
    bins = drift.fit_drift_bins(spark.createDataFrame(base, kind), ["x", "y"])
    got = drift.psi_by_feature(spark.createDataFrame(current, kind), bins, [])
    return dict(values(got, "feature", "psi"))


numbers = st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 3)), min_size=1, max_size=80)


@settings(**SLOW)
@given(numbers, numbers)
def test_psi_equals_numpy(spark, base, current):
    base = [(float(a), float(b)) for a, b in base]
    current = [(float(a), float(b)) for a, b in current]
    got = psi_of(spark, base, current)
    for i, name in enumerate("xy"):
        expected = psi_by_definition([r[i] for r in base], [r[i] for r in current])
        assert got[name] == pytest.approx(expected, abs=1e-9)
        assert got[name] >= -1e-12


def test_psi_is_zero_on_identical_data_and_survives_empty_sides(spark):
    rows = [(float(i), float(i % 5)) for i in range(100)]
    assert psi_of(spark, rows, rows) == {"x": pytest.approx(0), "y": pytest.approx(0)}
    day = dt.date(2024, 7, 1)
    kind = "snapshot_date date, x double, y double"
    bins = drift.fit_drift_bins(spark.createDataFrame(rows, "x double, y double"), ["x", "y"])
    gaps = spark.createDataFrame([(day, 1.0, None), (day, None, 2.0)], kind)
    assert values(drift.psi_by_feature(gaps, bins), "psi") == [(None,), (None,)]
    empty = drift.fit_drift_bins(spark.createDataFrame([(None, 1.0)], "x double, y double"), ["x"])
    assert values(drift.psi_by_feature(gaps, empty), "snapshot_date", "psi") == [(day, None)]
    again = drift.read_drift_bins(drift.drift_bins_frame(spark, bins))
    assert again == bins


def test_rollup_alerts(spark):
    a, b, c = (dt.date(2024, m, 1) for m in (7, 8, 9))
    rows = (
        [(a, f"f{i}", 0.05) for i in range(8)]
        + [(a, "g", 0.2), (a, "h", 0.1)]
        + [(b, f"f{i}", 0.3 if i < 5 else 0.0) for i in range(40)]
        + [(c, "f", 0.15), (c, "g", 0.0), (c, "h", 0.05)]
    )
    df = spark.createDataFrame(rows, "snapshot_date date, feature string, psi double")
    got = {
        r["snapshot_date"]: (r["n_features"], r["n_critical"], r["n_warning"], r["alert"])
        for r in drift.drift_rollup(df).collect()
    }
    assert got == {a: (10, 0, 1, False), b: (40, 5, 0, True), c: (3, 0, 1, True)}


# --- scaling -----------------------------------------------------------------


def test_scaler_is_fitted_once_and_keeps_constants(spark):
    train = spark.createDataFrame([(1.0, 7), (2.0, 7), (3.0, 7), (None, 7)], "x double, c int")
    scaler = scaling.fit_scaler(train, ["x", "c"])
    assert scaler.mean == {"x": 2.0, "c": 7.0}
    assert scaler.deviation == {"x": pytest.approx(math.sqrt(2 / 3)), "c": 1.0}
    other = spark.createDataFrame([(2.0, 9), (None, 7)], "x double, c int")
    assert values(scaling.apply_scaler(other, scaler), "x", "c") == [(0.0, 2.0), (None, 0.0)]


@pytest.mark.parametrize("small", [4, 65536])
def test_quantiles_end_on_infinite_and_huge_values(spark, monkeypatch, small):
    from riskmart.operators import quantiles

    monkeypatch.setattr(quantiles, "SMALL", small)
    inf = float("inf")
    rows = [(float(i), (-1e308, 1e308, 5.0)[i % 3], (inf, -inf, 1.0, 2.0)[i % 4], inf) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = quantiles.exact_quantiles(df, ["a", "b", "c", "d"], [0.0, 0.5, 1.0])
    assert got["a"] == [0.0, 99.5, 199.0] and got["b"] == [-1e308, 5.0, 1e308]
    assert got["c"] == [-inf, 1.5, inf] and got["d"] == [inf] * 3


def test_what_cannot_be_compared_is_unknown(spark):
    from riskmart.plans import monitoring

    day = dt.date(2024, 7, 1)
    psi = spark.createDataFrame(
        [(day, "a", None), (day, "b", None), (dt.date(2024, 8, 1), "a", 0.01), (dt.date(2024, 8, 1), "b", None)],
        "snapshot_date date, feature string, psi double",
    )
    got = {r.snapshot_date: r.severity for r in monitoring.feature_flags(drift.drift_rollup(psi)).collect()}
    assert got == {day: "unknown", dt.date(2024, 8, 1): "healthy"}


def test_a_lost_column_is_not_compared(spark):
    rows = [(float(i), float(i % 7), dt.date(2024, 7, 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, snapshot_date date")
    bins = drift.fit_drift_bins(df, ["a", "b"])
    lost = df.drop("b")
    got = drift.psi_by_feature(lost, drift.common_bins(bins, lost)).collect()
    assert [r.feature for r in got] == ["a"]


def test_quantiles_take_two_scans(spark, monkeypatch):
    calls = []
    plain = quantiles.cell_counts
    monkeypatch.setattr(quantiles, "cell_counts", lambda df, intervals: calls.append(len(intervals)) or plain(df, intervals))
    df = spark.range(300_000).selectExpr("cast(id * 7919 % 300007 as double) as x", "cast(id % 5 as double) as y", "if(id % 3 = 0, 1.5, cast(id as double)) as z")
    probabilities = [i / 10 for i in range(1, 10)]
    got = quantiles.exact_quantiles(df, ["x", "y", "z"], probabilities)
    rows = df.toPandas()
    for c in "xyz":
        assert got[c] == pytest.approx(list(np.quantile(rows[c], probabilities)))
    assert len(calls) == 1


def test_quantiles_when_the_sketch_is_wrong(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_ERROR", -0.02)
    monkeypatch.setattr(quantiles, "SMALL", 300)
    df = spark.range(5000).selectExpr("cast(id as double) as x")
    assert quantiles.exact_quantiles(df, ["x"], [0.1, 0.5])["x"] == pytest.approx([499.9, 2499.5])
