import itertools
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskmart.llm import languages as L

WORDS = ["", "a", "abab", "ébé", "hello", "aaaa", "x" * L.RUN, "ß€😀"]
SMALL = [b" ", b" a", b"ab", b"aba", b"hell", b"llo", b"aa", " é".encode(), "bé".encode(), b"xx"]


def segmentations(text, pieces):
    if not text:
        yield []
    for size in range(1, len(text) + 1):
        if text[:size] in pieces:
            for rest in segmentations(text[size:], pieces):
                yield [text[:size], *rest]


def table_of(pieces, seed):
    raw = np.random.default_rng(seed).random((len(pieces), 3)) + 0.01
    return raw / raw.sum(axis=0)


@pytest.mark.parametrize("words", [WORDS[:6], [*WORDS[1:4], WORDS[7]]])
def test_sums_over_all_segmentations(words):
    pieces = L.Pieces(SMALL)
    table = table_of(pieces, 1)
    number = {p: i for i, p in enumerate(pieces.pieces)}
    got = L.Lattice(pa.array(words), pieces).log_likelihood(table)
    language, weight = np.arange(len(words)) % 3, np.arange(len(words)) + 1.0
    expected = np.zeros_like(table)
    for i, word in enumerate(words):
        ways = list(segmentations(b" " + word.encode(), set(pieces.pieces)))
        for k in range(3):
            each = [math.prod(table[number[p], k] for p in way) for way in ways]
            assert got[i, k] == pytest.approx(math.log(sum(each)))
            if k == language[i]:
                for way, chance in zip(ways, each, strict=True):
                    for p in way:
                        expected[number[p], k] += weight[i] * chance / sum(each)
    assert np.allclose(L.Lattice(pa.array(words), pieces).expected(table, language, weight), expected)


def test_words_without_any_known_piece_stay_finite():
    pieces = L.Pieces(SMALL)
    table = np.full((len(pieces), 1), L.EVEN / 32_000)
    assert np.isfinite(L.Lattice(pa.array(["😀" * L.RUN, "z" * L.RUN]), pieces).log_likelihood(table)).all()


@pytest.fixture(scope="module")
def pieces():
    return L.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


SCHEMA = "doc_id long, text string, lang string, lang_pred int, n int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def test_defined_results(spark, pieces):
    good = [(i, f"the cat and the dog number {i}", "en") for i in range(20)] + [(i, f"die Katze und der Hund Nummer {i}", "de") for i in range(20, 40)]
    learned = docs(spark, [*good, (50, None, "en"), (51, "no language", None), (52, "", "de"), (53, "lonely", "xx"), (54, "x" * 300_000, "en")])
    model = L.fit(learned, pieces)
    assert model.languages == ["de", "en", "xx"]
    asked = [(1, None), (2, ""), (3, "123 456 -- !!"), (4, "the dog"), (5, "der Hund und die Katze"), (5, "der Hund und die Katze"), (None, "the cat " * 300_000)]
    got = [tuple(r) for r in L.identified(docs(spark, [(*r, "zz") for r in asked]), model).collect()]
    assert sorted(got, key=str) == sorted([(i, got_lang, s) for (i, _), got_lang, s in zip(asked, ["und"] * 3 + ["en", "de", "de", "en"], [r[2] for r in sorted(got, key=lambda r: (r[0] is None, r[0]))], strict=True)], key=str)
    assert all(0 <= s <= 1 for *_, s in got) and all((lang == "und") == (s == 0) for _, lang, s in got)


def test_long_texts_in_parts(spark, pieces, monkeypatch):
    model = L.fit(docs(spark, [(1, "the cat and the dog", "en"), (2, "die Katze und der Hund", "de")]), pieces)
    rows = docs(spark, [(i, " ".join(("the dog", "der Hund", "cat Katze")[(i + k) % 3] for k in range(i)), None) for i in range(40)])
    whole = sorted(map(tuple, L.identified(rows, model).collect()))
    monkeypatch.setattr(L, "SCORES_AT_ONCE", 7)
    monkeypatch.setattr(L, "WORDS_AT_ONCE", 3)
    parts = sorted(map(tuple, L.identified(rows, model).collect()))
    assert [r[:2] for r in whole] == [r[:2] for r in parts]
    assert [r[2] for r in whole] == pytest.approx([r[2] for r in parts])


def test_nothing_learned_and_no_rows(spark, pieces):
    empty = docs(spark, [])
    model = L.fit(empty, pieces)
    assert model.languages == []
    assert [tuple(r) for r in L.identified(docs(spark, [(1, "words", "en")]), model).collect()] == [(1, "und", 0.0)]
    assert L.identified(empty, model).count() == 0


def test_held_out_accuracy(spark):
    import __spark_entry__ as contract

    found = contract.queries()["op12_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = found.join(truth, "doc_id").where("lang_pred <> 'und' and lang is not null")
    right, rows = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows > 100 and right > 0.95
    assert len(list(itertools.islice(found.toLocalIterator(), 1))) == 1
