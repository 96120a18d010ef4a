import random

import pytest
from llm_brute import edited, jaccard_components, prose

from riskmart.llm import jaccard
from riskmart.llm.tables import components, extended


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "clash", 7) for d, t in rows], "doc_id long, text string, c string, n int")
    return docs, jaccard.jaccard_join(docs)


def test_groups_of_near_copies_are_exact(spark):
    rng = random.Random(5)
    rows, bases = [], [prose(rng, n) for n in (6, 30, 80, 80, 200)]
    shared = prose(rng, 60)
    for number in range(140):
        base = bases[number % 5]
        rows.append((1000 - number, edited(rng, base, rng.randrange(6))))
    rows += [(5000 + i, prose(rng, 20) + " " + shared) for i in range(20)]
    rows += [(6000 + i, prose(rng, 3) + " " + shared + " " + prose(rng, 2)) for i in range(20)]
    rows += [(7000 + i, bases[3]) for i in range(30)]
    _, joined = run(spark, rows)
    component, size = jaccard_components(rows)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in joined.collect()}
    assert got == {d: (c, n) for (d, _), c, n in zip(rows, component, size, strict=True)}
    assert len(set(component)) < len(rows) - 60


def test_defined_results_for_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(3, text), (3, text), (9, text.upper()), (4, None), (5, ""), (6, " \n\t"), (7, "a b"), (8, "A  b"), (None, "a b"), (None, None), (10, "x " * 30000)]
    _, joined = run(spark, rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in joined.collect())
    assert got == sorted([(3, 3, 3), (3, 3, 3), (9, 3, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (-1, 1, 7), (-1, 0, -1), (10, 1, 10)])


def test_one_row_per_component_stays(spark):
    text = "one two three four five six seven"
    rows = [(3, text), (3, text), (9, text), (4, None), (5, ""), (7, "other words here now and then"), (None, "only null id")]
    docs, _ = run(spark, rows)
    kept = jaccard.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, [rows[0], *rows[3:]]))


def test_components_are_not_told_apart_by_doc_id(spark):
    a, b, c, d = ("one two three four five six", "un deux trois quatre cinq six", "uno dos tres cuatro cinco seis", "ein zwei drei vier elf sechs")
    rows = [(None, a), (None, b), (None, b), (3, c), (3, d), (4, d)]
    docs, _ = run(spark, rows)
    kept = jaccard.keep_one_per_component(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, [(None, a), (None, b), (3, c), (3, d)]))


def test_empty_table(spark):
    docs, joined = run(spark, [])
    assert joined.count() == 0 and jaccard.keep_one_per_component(docs).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 7)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    known = {}
    for _ in range(60):
        for a, b in links:
            if a != b:
                known[a] = known[b] = min(known.get(a, a), known.get(b, b))
    assert got == known


@pytest.mark.parametrize("seed", range(3))
def test_components_taken_in_later_are_those_of_all_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    parts = [links[:25], links[25:26], links[26:], [(5, 5)], []]
    found = components(spark.createDataFrame(parts[0], "a long, b long"))
    for more in parts[1:]:
        found = extended(found, spark.createDataFrame(more, "a long, b long"))
    whole = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(found.collect()) == sorted(whole.collect())
