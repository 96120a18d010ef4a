import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_brute import WORD, shingle_set

from riskmart.llm import words as W
from riskmart.llm.hashruns import HashRuns

TEXT = st.text(alphabet="ab A\n\t\x0b\x1cé\u2003日", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12))
def test_words_and_sets_as_in_python(rows):
    column = pa.array(rows, pa.string())
    found = W.words(W.texts(column), lower=True)
    assert found.per_text.tolist() == [len(WORD.findall(t or "")) for t in rows]
    _, counts = W.distinct_per_text(*W.shingles(found.hash, found.per_text))
    assert counts.tolist() == [len(shingle_set(t)) for t in rows]
    one, two = W.set_digest(*W.distinct_per_text(*W.shingles(found.hash, found.per_text)))
    names = {}
    for text, a, b in zip(rows, one.tolist(), two.tolist(), strict=True):
        assert names.setdefault(shingle_set(text), (a, b)) == (a, b)
    assert len(set(names.values())) == len(names)


def test_slices_keep_every_row_and_a_sliced_column():
    texts = [None, "", "x" * (3 << 20), "a b"] * 3
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)}).slice(1)
    parts = list(W.slices(iter([batch, batch.slice(0, 0)])))
    assert sum(p.num_rows for p in parts) == batch.num_rows
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts[1:]
    assert len(parts) > 3


def test_hash_runs():
    rng, known, runs = np.random.default_rng(3), {}, HashRuns()
    for turn in range(30):
        keys = np.unique(rng.integers(0, 3000, 80).astype(np.uint64))
        got = runs.find(keys)
        assert got.tolist() == [known.get(int(k), -1) for k in keys]
        new = keys[got < 0]
        runs.add(new, np.arange(len(new)) + 1000 * turn)
        known.update(zip(new.tolist(), (np.arange(len(new)) + 1000 * turn).tolist(), strict=True))
    assert len(runs) == len(known)
