import random

from llm_brute import edited, leaks, prose

from riskmart.llm.decontamination import contaminated, without_benchmark


def test_every_similar_window_is_found(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, n, 900)) for i, n in enumerate((8, 12, 20, 20, 33, 47, 58))]
    items += [(90, "tiny item"), (91, ""), (92, None), (93, items[2][1]), (94, "ab ab ab ab ab ab ab ab ab")]
    rows = []
    for number in range(60):
        body = edited(rng, items[number % 7][1], rng.choice((0, 0, 1, 1, 2)))
        cut = body.split(" ")[rng.randrange(3) :]
        rows.append((number, f"{prose(rng, rng.randrange(30), 900)} {' '.join(cut)} {prose(rng, rng.randrange(30), 900)}".upper()))
    rows += [(100, None), (101, ""), (102, "a tiny item here"), (103, items[3][1] + " " + items[3][1]), (104, prose(rng, 20000)), (105, "ab " * 12)]
    rows += [rows[0], (None, items[4][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, bag string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contaminated(docs, bench).collect()}
    expected = {k: round(v, 9) for k, v in leaks(rows, items).items()}
    assert got == expected and len(expected) > 30
    clean = without_benchmark(docs, bench)
    assert clean.columns == docs.columns
    bad = {d for d, _ in expected}
    assert sorted(map(repr, (r.doc_id for r in clean.collect()))) == sorted(repr(d) for d, _ in rows if d not in bad)


def test_an_item_with_its_parts_in_another_order_is_found(spark):
    rng = random.Random(12)
    x, y, z = (prose(rng, 30) for _ in range(3))
    rows = [(1, f"{prose(rng, 40)} {y} {x} {prose(rng, 40)}"), (2, f"{prose(rng, 9)} {x} {y} {prose(rng, 9)}"), (3, f"{y} {prose(rng, 30)} {x}"), (4, f"{y} {x}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, f"{x} {y}"), (8, f"{z} {prose(rng, 20)}")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 7): (40, round(52 / 60, 9)), (2, 7): (9, 1.0), (4, 7): (0, round(52 / 60, 9))}
    assert [r.doc_id for r in without_benchmark(docs, bench).collect()] == [3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, bench).count() == 0
    assert without_benchmark(docs, bench).count() == 1
    assert contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
