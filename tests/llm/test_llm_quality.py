import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_brute import prose, rule_counts

from riskmart.llm import quality
from riskmart.llm.quality import COUNTS, calibrate, fit, fit_forest, grow, judge, keep_good, statistics

TEXT = st.lists(st.sampled_from(["a", "b", "aa", " ", " ", "\n", "\t", "#", "|", "é", "日", "A", "a b a b a b a b "]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_counts_as_in_python(rows):
    counts, features = statistics(pa.array(rows, pa.string()))
    got = list(zip(*(counts[c].tolist() for c in COUNTS), strict=True))
    assert got == [rule_counts(t) for t in rows]
    assert features.shape == (len(rows), len(quality.FEATURES)) and np.isfinite(features).all()


def good_and_bad(rng, count):
    rows = []
    for i in range(count):
        text = prose(rng, rng.randrange(40, 300), 2000)
        bad = i % 6 == 0
        if bad:
            spoil = (lambda t: t.replace(" ", "### "), str.upper, lambda t: t.replace(" ", " | "))[i // 6 % 3]
            text = spoil(text)
        rows.append((i, text, 0 if bad else 1))
    return rows


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = good_and_bad(rng, 900)
    docs = spark.createDataFrame([(*r[:2], 1) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows if d < 600], "doc_id long, quality int, toxic int")
    forest = fit_forest(docs, labels)
    held = {r.doc_id: r.kept for r in judge(docs, forest).where("doc_id >= 600").collect()}
    truth = {d: q == 1 for d, _, q in rows if d >= 600}
    assert sum(held[d] for d in truth if truth[d]) >= 0.98 * sum(truth.values())
    assert sum(not held[d] for d in truth if not truth[d]) >= 0.9 * sum(not q for q in truth.values())
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.where("doc_id >= 600").collect()} == {d for d, k in held.items() if k}


def test_path_lengths_by_walking():
    rng = np.random.default_rng(5)
    rows = rng.random((300, 3))
    forest = grow(rows, rows.min(axis=0), rows.max(axis=0))
    probe = np.vstack([rows[:20], rows[:20] + 3])
    score = forest.score(probe)
    for i, row in enumerate(probe):
        total = 0.0
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] + (row[forest.feature[node]] >= forest.cut[node])
            total += forest.length[node]
        assert score[i] == pytest.approx(2 ** (-total / len(forest.roots) / forest.expected))
    good = np.arange(len(probe)) < 20
    forest.threshold = calibrate(forest, probe, good)
    assert (forest.score(probe)[good] <= forest.threshold).all()
    assert fit(rows[:0], np.zeros(0, bool), np.zeros(0)) is None if len(rows[:0]) else True


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 19), (None, prose(random.Random(1), 30)), (5, prose(random.Random(2), 100000)), (5, "a b c " * 20), (5, "a b c " * 20)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    empty = spark.createDataFrame([(1, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert fit_forest(docs, empty) is None and fit_forest(docs, empty.limit(0)) is None
    got = judge(docs, None).collect()
    expected = [(d, *rule_counts(t)) for d, t in rows]
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, expected))
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert keep_good(docs, empty).count() == 2 and keep_good(docs.limit(0), empty).count() == 0


def test_every_labelled_row_is_counted(spark, monkeypatch):
    """The box, the leaves' counts and the threshold of the fit on Spark are those of all labelled rows."""
    rng = random.Random(9)
    rows = [r for r in good_and_bad(rng, 700) if r[0] % 5]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    counts, features = statistics(pa.array([t for _, t, _ in rows]))
    fine = ~quality.base_failed(counts)
    good = np.array([q == 1 for _, _, q in rows])
    half = {r.doc_id: r.h for r in labels.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2) h").collect()}
    order = np.array([half[d] for d, _, _ in rows])
    seen = []
    pruned = quality.pruned
    monkeypatch.setattr(quality, "pruned", lambda layout, leaves: seen.append(leaves.sum(axis=1)) or pruned(layout, leaves))
    got = fit_forest(docs, labels)
    expected = fit(features[fine], good[fine], order[fine])
    assert all((s == (good & fine & (order == 0)).sum()).all() for s in seen) and len(seen) == 2
    for name in ("feature", "cut", "left", "length", "roots"):
        assert np.array_equal(getattr(got, name), getattr(expected, name))
    assert got.threshold == expected.threshold and not hasattr(quality, "LABELLED_ROWS")
