import random

import pytest
from llm_brute import edited, prose, repeated_paragraphs

from riskmart.llm.paragraphs import BANDS, ROWS, repeated_passages, tune_bands


def test_bands_reach_their_recall():
    for similarity, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = tune_bands(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= 128
    assert (BANDS, ROWS) == tune_bands(0.8, 0.999, 64)


def test_repeated_passages_are_those_of_brute_force(spark):
    rng = random.Random(21)
    passages = [prose(rng, n) for n in (60, 75, 120, 30, 12)]
    rows = []
    for number in range(90):
        lines = [prose(rng, rng.randrange(3, 60)) for _ in range(rng.randrange(1, 6))]
        if number % 3 == 0:
            body = passages[number % 5]
            lines.insert(rng.randrange(len(lines) + 1), edited(rng, body, rng.choice((0, 0, 1))) if number % 2 else body)
        rows.append((number, "\n".join(lines)))
    multi = "\n".join(prose(rng, n) for n in (20, 3, 25, 22))
    rows += [(200 + i, prose(rng, 9) + "\n" + multi + "\n" + prose(rng, 8)) for i in range(4)]
    rows += [(300, None), (301, ""), (302, (passages[0] + "\n") * 3), (303, prose(rng, 30000)), (304, "é \n" * 5 + passages[2])]
    rows += [(305, prose(rng, 80) + "\n" + rows[-1][1][:0] + "solo " * 70 + "\n" + "solo " * 70)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, c string")
    got = repeated_passages(docs).where("kind = 'paragraph'").collect()
    assert {(r.doc_id, r.paragraph): (r.start, r.end, r.n_words, r.passage_words, r.copies) for r in got} == repeated_paragraphs(rows)
    clusters = {}
    for r in got:
        clusters.setdefault((r.cluster_id, r.copies), []).append(r)
    first = min(got, key=lambda r: (r.cluster_id, r.doc_id, r.paragraph))
    assert not first.removed and sum(not r.removed for r in got) < len(got) / 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short line")], [(1, "a b c d e " * 20), (1, "a b c d e " * 20)]])
def test_nothing_repeats(spark, rows):
    assert repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_null_ids_are_documents(spark):
    text = prose(random.Random(1), 70)
    got = repeated_passages(spark.createDataFrame([(None, text), (7, text)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.removed, r.cluster_id) for r in got) == [("7", False, 7), ("None", True, 7)]


def test_passages_inside_lines(spark):
    """Every shared run of 50 words is covered, nothing that is not shared is listed."""
    rng = random.Random(8)
    passages = [prose(rng, n) for n in (52, 59, 80, 200)]
    rows = []
    for number in range(60):
        body = passages[number % 4] if number % 3 else prose(rng, 60)
        rows.append((number, f"é {prose(rng, rng.randrange(40))} {body.upper() if number % 2 else body} {prose(rng, rng.randrange(40))}"))
    rows += [(100, prose(rng, 51)), (101, prose(rng, 51) + " x"), (102, passages[0]), (103, passages[0])]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    words = {d: t.lower().split() for d, t in rows}
    runs = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add(d)
    for r in got:
        part = texts[r.doc_id][r.start : r.end].lower().split()
        assert len(part) == r.n_words >= 50
        if r.kind == "passage":
            assert all(len(runs[tuple(part[i : i + 50])]) > 1 for i in (0, len(part) - 50))
    long = {d for d, w in words.items() for i in range(len(w) - 49) if len(runs[tuple(w[i : i + 50])]) > 1}
    found = {r.doc_id for r in got}
    assert long == found and {102, 103} <= found
    assert found <= {d for ids in runs.values() if len(ids) > 1 for d in ids}
    assert not found & {100, 101}


def test_passages_of_51_to_58_words_are_found_whole(spark):
    rng = random.Random(31)
    rows, spans = [], {}
    for number in range(80):
        body = prose(rng, 50 + number % 9)
        for doc in (2 * number, 2 * number + 1):
            before = f"é{doc} " + prose(rng, rng.randrange(30, 70)) + f" a{doc} "
            rows.append((doc, before + body + f" z{doc} " + prose(rng, rng.randrange(30, 70))))
            spans[doc] = (len(before), len(before) + len(body), 50 + number % 9)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.kind for r in got} == {"passage"} and len(got) == len(rows)
    assert {r.doc_id: (r.start, r.end, r.n_words) for r in got} == spans
    assert all(r.cluster_id == r.doc_id // 2 * 2 and r.removed == (r.doc_id % 2 == 1) for r in got)


def test_a_passage_has_one_first_document(spark):
    """Words 0-149, 0-299 and 100-299 of a text, all inside longer lines."""
    rng = random.Random(41)
    text = prose(rng, 300).split(" ")
    rows, at = [], {}
    for doc, (a, b) in {1: (0, 150), 2: (0, 300), 3: (100, 300)}.items():
        words = [*prose(rng, 400).split(" "), f"a{doc}", *text[a:b], f"z{doc}", *prose(rng, 400).split(" ")]
        rows.append((doc, " ".join(words)))
        at[doc] = 401 - a
    got = []
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        first = len(dict(rows)[r.doc_id][: r.start].split()) - at[r.doc_id]
        got.append((r.doc_id, first, first + r.n_words, r.cluster_id, r.removed))
    assert sorted(got) == [(1, 0, 150, 1, False), (2, 0, 150, 1, True), (2, 101, 300, 2, False), (3, 100, 150, 1, True), (3, 101, 300, 2, True)]


def test_a_passage_is_listed_unless_lines_cover_all_its_words(spark):
    """1,000 shared words, the first 80 in lines that differ otherwise; and 120 in whole equal lines with a blank one."""
    rng = random.Random(51)
    part, lines = prose(rng, 80), "\n".join(prose(rng, 92) for _ in range(10))
    both = prose(rng, 60) + "\n \n" + prose(rng, 60)
    rows = [(doc, f"{prose(rng, 80)} a{doc} {part}\n{lines}") for doc in (1, 2)] + [(doc, f"a{doc}\n{both}\nz{doc}") for doc in (3, 4)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.kind == "paragraph" for r in got) == 24
    inside = {r.doc_id: dict(rows)[r.doc_id][r.start : r.end] for r in got if r.kind == "passage"}
    assert inside == {doc: part + "\n" + lines for doc in (1, 2)}
