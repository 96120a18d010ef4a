import numpy as np
import pytest

from riskmart.llm import negatives as N

SCHEMA = "vec_id long, label int, vector array<int>, anchor boolean, block string, pack int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows, positives=5, negatives=5, low=80, high=100):
    """All pairs by plain Python; equal rows of one vec_id are rows of their own."""
    kept = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, (anchor, label, vector, chosen) in enumerate(kept):
        if not chosen:
            continue
        scored = sorted((-dot(vector, v), x, k) for k, (x, _, v, _) in enumerate(kept) if k != i)
        good = [s for s in scored if kept[s[2]][1] == label][:positives]
        for ps, pid, _ in good:
            bad = [s for s in scored if kept[s[2]][1] != label and low * -ps <= 100 * -s[0] <= high * -ps][:negatives]
            out += [(anchor, pid, k + 1, x, -ps, -ns) for k, (ns, x, _) in enumerate(bad)]
    return sorted(out)


def made(seed, count, dim=6, labels=3, spread=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim)) * 100
    return [(i, int(rng.integers(labels)), [int(x) for x in centres[rng.integers(4)] + rng.normal(size=dim) * spread], i % 10 == 0) for i in range(count)]


def mined(spark, rows, **more):
    return sorted(map(tuple, N.hard_negatives(frame(spark, rows), **more).collect()))


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("PACK_ROWS", 3), ("PART_ROWS", 40), ("REFERENCES", 5), ("BANDS", 4), ("SAMPLE_ROWS", 50)):
        monkeypatch.setattr(N, name, value)


def test_equals_all_pairs(spark, small):
    rows = made(1, 400)
    got = mined(spark, rows)
    assert got == expected(rows) and len(got) > 500
    assert mined(spark, rows, positives=2, negatives=9, low=50, high=90) == expected(rows, 2, 9, 50, 90)


def test_many_copies_ties_and_broken_rows(spark, small):
    rows = [(i, i % 2, [50, -20, 10], i % 25 == 0) for i in range(150)] + [(1000 + i, i % 3, [i % 4 - 1, i % 3, 5], i % 20 == 0) for i in range(80)]
    rows += [(2000, 1, [0, 0, 0], True), (2001, 0, [], True), (2002, 2, [7], True), (2003, 1, None, True), (2004, None, [1, 2, 3], True)]
    rows += [(None, 1, [1, 2, 3], True), (2005, 1, [1, None, 3], True), (2006, 77, [5, 5, 5], True), (2007, 1, [1, 1, 1], None), (2008, 0, [-50, 20, -10], True)]
    rows += [(3000, 1, [40, 1, 2], True), (3000, 1, [40, 1, 2], True), (3000, 0, [39, 1, 2], False)]
    assert mined(spark, rows) == expected(rows)


def test_large_components_stay_exact(spark, small):
    big = 1 << 30
    rows = [(i, i % 2, [big + i, -big + 3 * i, i], i % 5 == 0) for i in range(60)]
    assert mined(spark, rows) == expected(rows)
    with pytest.raises(OverflowError):
        N.inner(np.array([[1 << 62, 1]]), np.array([[1 << 62, 1]]))


def test_bounds_hold():
    rng = np.random.default_rng(3)
    vectors = np.rint(rng.normal(size=(300, 8)) * rng.choice([1, 50, 3000], size=(300, 1))).astype(np.int64)
    vectors[:20] = vectors[20:40] * 3
    vectors[40:45] = -vectors[20:25]
    sectors = N.Sectors(vectors)
    norms, angles = N.measured(vectors, sectors.references)
    low, high = N.score_range(norms, norms, norms, N.cosine_range(angles, angles, angles))
    scores = N.inner(vectors, vectors)
    assert (low <= scores).all() and (scores <= high).all()
    assert (high - low < 0.9 * 2 * norms[:, None] * norms).mean() > 0.9


def test_bounds_leave_out_most_sectors_of_clustered_rows(spark, small):
    rows = made(5, 600, dim=12, spread=3)
    sectors = N.find_sectors(frame(spark, rows).select("vec_id", "label", "vector", "anchor").selectExpr("vec_id", "cast(label as long) label", "cast(vector as array<long>) vector", "anchor"))
    vectors = np.array([r[2] for r in rows])
    norms, angles = N.measured(vectors, sectors.references)
    ids = np.arange(len(rows))
    one = N.Rows(ids, ids, ids, vectors, norms, angles).take(np.array([0]))
    scores = N.inner(vectors[:1], vectors)
    best = np.argsort(-scores[0])[:6]
    floor = scores[:, best[-1]]
    reached = {s for s, _ in sectors.reached(one, floor, np.array([N.HIGHEST]))}
    assert set(sectors.of(angles[best]).tolist()) <= reached and len(reached) <= len(sectors.names) / 2


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1, 2], False)]) == []
    assert mined(spark, [(1, 1, [1, 2], True)]) == []
