import random
from collections import defaultdict

import pytest
from llm_brute import WORD
from pyspark.sql import functions as F

from riskmart.llm.mixing import mix, mixed_documents, pivotal, targets


def shares(sizes, weights=(5, 2, 1), cap=3):
    """The stated rule, step by step: share by weight, cut at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] = left * weight[s] / total
        above = [s for s in open_ if target[s] > cap * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = cap * sizes[s]
            full.add(s)
        left = float(sum(sizes.values())) - sum(target[s] for s in full)


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 2, "c": 900, None: 40}, {"é": 5, "z": 700, "b": 0, "a": 3, "c": 9}, {"only": 7}, {f"s{i}": i * i for i in range(30)}]
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, m long")
    got = {r.source: r.target for r in targets(rows).collect()}
    assert got == pytest.approx(shares(sizes))


def corpus(spark, count=1500, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        words = rng.choice((0, 1, 5, 20, 20, 100, 100, 100, 400, 3000 if i % 50 == 0 else 90))
        rows.append((i, " ".join(f"w{rng.randrange(99)}" for _ in range(words)), rng.choice(("a", "a", "a", "b", "c", "d", None))))
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")


def test_mix_meets_its_targets(spark):
    rows, docs = corpus(spark)
    got = mix(docs).collect()
    size = {d: len(WORD.findall(t)) for d, t, _ in rows}
    sources, taken = defaultdict(int), defaultdict(int)
    for d, _, s in rows:
        sources[s] += size[d]
    goal = shares(sources)
    for r in got:
        copies = r["each"] + r.more
        assert r["size"] == size[r.doc_id] and r.source_size == sources[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= copies <= 3
        taken[r.source] += copies * r["size"]
    for s, words in taken.items():
        assert abs(words - goal[s]) <= max(40, 0.002 * goal[s])
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(docs.repartition(3)).collect()), key=repr)


def test_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (3, "", None), (None, "x y z", None), (5, "w " * 50000, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.source): (r["size"], r.m) for r in mix(docs).collect()}
    assert got == {(1, "s"): (2, 3), (2, "s"): (0, 1), (3, None): (0, 1), (None, None): (3, 1), (5, "big"): (50000, 1)}
    assert mixed_documents(docs).columns == docs.columns
    assert mix(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_rounding_keeps_words_and_chances(spark):
    """Over many trees: each ends within one document of its mass, and every document is taken as often as its fraction says."""
    rng = random.Random(3)
    items = [(f"t{t}", t * 1000 + i, 1 + (i * 37) % 50, 0.3) for t in range(300) for i in range(40)]
    rng.shuffle(items)
    got = pivotal(spark.createDataFrame(items, "source string, k long, s long, p double"))
    rows = got.select("source", (F.col("k") % 1000).alias("i"), "one").collect()
    assert len(rows) == len(items)
    mass, often = defaultdict(float), defaultdict(int)
    for r in rows:
        mass[r.source] += r.one * (1 + (r.i * 37) % 50)
        often[r.i] += r.one
    planned = 0.3 * sum(1 + (i * 37) % 50 for i in range(40))
    assert all(abs(m - planned) <= 50 for m in mass.values())
    assert all(abs(n / 300 - 0.3) < 0.12 for n in often.values())


def test_copies_are_rows(spark):
    rows, docs = corpus(spark, 200, 5)
    wanted = {r.doc_id: r["each"] + r.more for r in mix(docs).collect()}
    got = defaultdict(int)
    for r in mixed_documents(docs).collect():
        got[r.doc_id] += 1
    assert dict(got) == {d: n for d, n in wanted.items() if n}
