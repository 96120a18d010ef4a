import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskmart.llm import words as W
from riskmart.llm.shards import NULL_ID, Shard, build_levels, pack
from riskmart.llm.tokencounts import token_counts
from riskmart.llm.tokenfiles import read_documents, read_whole, token_table, write_shards
from riskmart.llm.transducers import RESET, STATES, TokenCounter, chunk_maps, marks_of, prefix_scan
from riskmart.llm.wordcodes import WordEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

HARD = [
    "hello world", "don't you'll we've they're 's''s", "  a  b\n\n c \n", "\n'sx", "'rex 'r 'v", "", None, "a<|endoftext|>b<|endoftext|>", "<|endof", "text|>",
    " \t x\u3000y\u00a0  z", "a" * 300, "!!!'ll ''ve", "x'r", "x'l", "\U0001F600 hi \U0001F600", " " * 50, "1234 567a8", "e\u0301 \u0301x", "ΣΑΣ ΟΔΟΣ.", "x" * 5000,
    "<|startoftext|> <|ENDOFTEXT|>\x0b\x0c\x1c", "ǅ İ ß ﬁ",
]


def noise(count, seed=1, alphabet="ab'srevltmd \n\t!?1é日\u2003<|>"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(70))) for _ in range(count)]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(BYTES)


def test_counts_equal_the_library(counter):
    for texts in (HARD, noise(4000), HARD[::-1]):
        got = counter.counts(W.texts(pa.array(texts, pa.string()))).tolist()
        assert got == [len(x) for x in library(BYTES, texts)]


def test_chunk_maps_compose_to_the_whole(counter):
    symbols = np.random.default_rng(4).integers(0, 12, 4096).astype(np.uint8)
    whole = chunk_maps(symbols.reshape(1, -1))[0]
    for width in (1, 16, 64, 256):
        assert (prefix_scan(chunk_maps(symbols.reshape(-1, width)))[-1] == whole).all()
    assert len(whole) == STATES
    # Marks do not depend on where chunks are cut.
    shifted = np.concatenate([np.full(77, RESET, np.uint8), symbols])
    assert (marks_of(shifted)[77:] == marks_of(symbols)).all()


def test_token_counts_of_rows(spark):
    rows = [(i, t, 5) for i, t in enumerate(HARD)] + [(0, HARD[0], 5), (None, "x", 5), (99, "word " * 2000, 5)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), BYTES).collect()
    expected = [(d, len((t or "").encode()), len(x), len(x) > 1024) for (d, t, _), x in zip(rows, library(BYTES, [r[1] for r in rows]), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


def test_word_encoder_equals_the_library(monkeypatch):
    encoder = WordEncoder(WORDS)
    monkeypatch.setattr("riskmart.llm.wordcodes.KEPT_WORDS", 500)
    for texts in (HARD, noise(500, 2), noise(500, 3), HARD):
        ids, per_text = encoder.encode(W.texts(pa.array(texts, pa.string())), 2)
        expected = [[*x, 2] for x in library(WORDS, texts)]
        assert per_text.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [i for x in expected for i in x]


def test_shard_gives_every_key_and_no_other():
    rng = np.random.default_rng(8)
    doc_ids = np.sort(rng.integers(-(10**12), 10**12, 5000))
    doc_ids[:3] = NULL_ID
    doc_ids[10:14] = doc_ids[10]
    doc_ids.sort()
    per_doc = rng.integers(0, 9, len(doc_ids))
    ids = rng.integers(0, 60000, int(per_doc.sum())).astype("<u2")
    shard = Shard(pack(ids, per_doc, doc_ids))
    first, size = shard.find(shard.doc_ids, shard.repeats)
    assert (first == np.cumsum(per_doc) - per_doc).all() and (size == per_doc).all()
    assert sorted(shard.index.slots(np.unique(rng.integers(0, 2**63, 10)).astype(np.uint64)) < len(doc_ids))
    strange = rng.integers(2 * 10**12, 4 * 10**12, 20000)
    assert (shard.find(strange, np.zeros(len(strange), np.int64))[0] >= 0).sum() <= 2
    assert shard.get(int(doc_ids[100])) is not None and shard.get(None, 2) is not None and shard.get(None, 3) is None
    assert sum(int(x.sum()) for x in build_levels(np.arange(1000, dtype=np.uint64))) == 1000


def test_round_trip_through_files(spark, tmp_path, monkeypatch):
    rows = [(i * 7 % 101 - 5, t, "x") for i, t in enumerate(HARD + noise(60, 9))] + [(3, "twice"), (3, "twice"), (3, "again"), (None, "none")]
    rows = [(r[0], r[1], "x") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = write_shards(docs, WORDS, f"file://{tmp_path}/tokens")
    got = read_documents(manifest).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    ends = [0, *np.cumsum([r.n_tokens for r in by_start]).tolist()]
    assert [r.start for r in by_start] == ends[:-1]
    encoded = [[*x, 2] for x in library(WORDS, [r[1] for r in rows])]
    expected = sorted(repr((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes()))) for r, x in zip(rows, encoded, strict=True))
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == expected
    path = manifest.orderBy("first_id").first().path
    shard = Shard(read_whole(path))
    assert shard.get(None).tolist() == [*library(WORDS, ["none"])[0], 2]


def test_no_documents(spark):
    assert token_table(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0
