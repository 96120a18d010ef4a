"""The stages one by one against plain Python, and the whole run."""

import os
import zlib

import numpy as np
import pytest
from llm_brute import jaccard_components, leaks, rule_counts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if number < 4:
            assert out.columns == columns, name
        path = str(tmp_path / str(number))
        out.write.parquet(path)
        kept.append(docs.collect())
        docs = spark.read.parquet(path)
    given, good, single, clean, mixed = kept
    passed = {r.doc_id for r in good}
    for r in given:
        words, *_, repeat = rule_counts(r.text)
        if words < 20 or 100 * repeat > 30 * words:
            assert r.doc_id not in passed
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    fine = [r.doc_id for r in given if labels.get(r.doc_id) == 1 and rule_counts(r.text)[0] >= 20 and rule_counts(r.text)[4] == 0]
    assert sum(d in passed for d in fine) >= 0.97 * len(fine)

    rows = [(r.doc_id, r.text) for r in good]
    component, size = jaccard_components(rows)
    assert {r.doc_id for r in single} == {d for (d, _), c, n in zip(rows, component, size, strict=True) if c == d or not n}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks([(r.doc_id, r.text) for r in single], items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - bad

    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= {r.doc_id for r in clean} and max(times.values()) <= 3

    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    wanted = []
    for r in mixed:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        wanted.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in docs.collect()) == sorted(wanted)


def test_run_takes_all_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output",
    ]
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
