"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces of the
product of their probabilities, had by the forward algorithm; single bytes are
pieces too, so every word has a segmentation. The distributions are learned by
expectation maximisation: expected piece counts by forward and backward sums over the
distinct words of each language, beginning with equal probabilities.

Words are lower-cased runs without white space, a longer run being cut every
RUN code points. A text's score is the sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.shipping import ship
from riskmart.llm.words import release, texts
from riskmart.sources import working_folder
from riskmart.sources.workspace import remove_folder

#: Code points of a word that are segmented together.
RUN = 16
ROUNDS = 2
#: Share of each distribution that is spread evenly over all pieces.
EVEN = 1e-3
#: Words whose lattices are held at a time, and words of texts whose scores are.
WORDS_AT_ONCE, SCORES_AT_ONCE = 1 << 14, 1 << 20
#: Every byte is weighed by this, so that products of small probabilities stay within a double.
LIFT = 1024.0
#: Expected counts leave a task as whole numbers of these parts: sums do not depend on their order.
PARTS = 1 << 20

U64 = np.uint64
_FACTOR = U64(0x9E3779B97F4A7C15)
_SPACE_MARK = "▁"


def _hashes(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, piece in enumerate(pieces):
        value = 0
        for byte in piece:
            value = (value * int(_FACTOR) + byte + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = value
    return out


class Pieces:
    """A vocabulary of byte strings, found by hash; words begin with a space."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = sorted({*pieces, *(bytes([b]) for b in range(256))})
        keys = _hashes(self.pieces)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.longest = max(map(len, self.pieces))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U64(44)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their numbers."""
        rows = np.flatnonzero(self.maybe[(keys >> U64(44)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        hit = self.keys[spot] == keys[rows]
        return rows[hit], self.order[spot[hit]]


def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model that can stand in a word."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if _SPACE_MARK not in piece[1:]:
            out.append(piece.replace(_SPACE_MARK, " ").encode())
    return Pieces(out)


class Lattice:
    """All pieces at all places of some words."""

    def __init__(self, words: pa.Array, pieces: Pieces) -> None:
        found = texts(words)
        size = np.diff(found.bounds)
        self.order = np.argsort(-size, kind="stable")  # the words that reach a position come first
        self.length = (size + 1)[self.order]
        most = int(self.length.max()) if len(size) else 0
        begin = found.bounds[:-1][self.order]
        reach = [int(np.count_nonzero(self.length >= at)) for at in range(most + 1)]
        prefix = [np.zeros(len(size), np.uint64)]
        powers = [U64(1)]
        self.edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            for at in range(1, most + 1):
                n = reach[at]
                byte = found.data[begin[:n] + at - 2].astype(np.uint64) if at > 1 else np.full(n, 0x20, np.uint64)
                prefix.append(prefix[-1][:n] * _FACTOR + byte + U64(1))
                powers.append(powers[-1] * _FACTOR)
                for length in range(1, min(at, pieces.longest) + 1):
                    keys = prefix[at] - prefix[at - length][:n] * powers[length]
                    rows, ids = pieces.find(keys)
                    if len(rows):
                        self.edges.append((at - length, at, rows, ids))
        self.most = most

    def forward(self, weights) -> np.ndarray:
        """Sums over all segmentations of each beginning; `weights(rows, ids)` gives the pieces' probabilities."""
        alpha: np.ndarray | None = None
        for begin, end, rows, ids in self.edges:
            step = weights(rows, ids) * LIFT ** (end - begin)
            if alpha is None:
                alpha = np.zeros((self.most + 1, len(self.length), *step.shape[1:]))
                alpha[0] = 1.0
            alpha[end, rows] += alpha[begin, rows] * step
        return alpha

    def whole(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.length, np.arange(len(self.length))]

    def log_likelihood(self, table: np.ndarray) -> np.ndarray:
        """Per word, in the given order, and language; `table` is pieces x languages."""
        sums = np.log(self.whole(self.forward(lambda rows, ids: table[ids])))
        sums -= (self.length * np.log(LIFT))[:, None]
        out = np.empty_like(sums)
        out[self.order] = sums
        return out

    def expected(self, table: np.ndarray, language: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, pieces x languages; word i is of language[i] and stands weight[i] times."""
        language, weight = language[self.order], weight[self.order]
        weights = lambda rows, ids: table[ids, language[rows]]
        alpha = self.forward(weights)
        beta = np.zeros_like(alpha)
        beta[self.length, np.arange(len(self.length))] = weight / self.whole(alpha)
        entries, uses = [np.zeros(0, np.int64)], [np.zeros(0)]
        for begin, end, rows, ids in reversed(self.edges):
            through = weights(rows, ids) * LIFT ** (end - begin) * beta[end, rows]
            beta[begin, rows] += through
            entries.append(ids * table.shape[1] + language[rows])
            uses.append(alpha[begin, rows] * through)
        return np.bincount(np.concatenate(entries), np.concatenate(uses), table.size).reshape(table.shape)


@dataclass
class Model:
    """Piece probabilities, pieces x languages, and the languages' shares of the documents."""

    pieces: Pieces
    languages: list[str]
    table: np.ndarray
    prior: np.ndarray


def runs(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([^\x20\x09-\x0D]{{1,{RUN}}})"), F.lit(1))


def _expected_counts(counted: DataFrame, pieces: Pieces, languages: list[str], table: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all words (lang, word, n)."""
    numbers = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(table)
        for batch in batches:
            for first in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(first, WORDS_AT_ONCE)
                language = np.array([numbers[x] for x in part.column("lang").to_pylist()], np.int64)
                total += Lattice(part.column("word"), pieces).expected(table, language, part.column("n").to_numpy().astype(float))
        used = np.flatnonzero(np.rint(total.ravel() * PARTS))
        parts = np.rint(total.ravel()[used] * PARTS).astype(np.int64)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(parts)], names=["entry", "parts"])

    summed = counted.mapInArrow(count, "entry long, parts long").groupBy("entry").agg(F.sum(F.col("parts").cast("decimal(38,0)")).alias("parts"))
    out = np.zeros(table.size)
    for entry, parts in summed.toLocalIterator():  # at most pieces x languages
        out[entry] = float(parts) / PARTS
    return out.reshape(table.shape)


def fit(documents: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """Learn from `text` and `lang` of all rows that have both; other columns are not looked at.

    Words are counted per language over whole texts, with partial sums before
    the shuffle, and written once; each round is one scan of the distinct words. What
    comes to the driver is bounded by pieces x languages.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.where("text is not null and lang is not null").select("text", "lang")
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    table = np.full((len(pieces), len(languages)), 1 / len(pieces))
    if languages:
        path = working_folder(spark, "language-words")
        words = rows.select("lang", F.explode(runs(F.col("text"))).alias("word"))
        words.groupBy("lang", "word").agg(F.count("*").alias("n")).write.parquet(path)
        counted = spark.read.schema("lang string, word string, n long").parquet(path)
        for _ in range(rounds):
            found = _expected_counts(counted, pieces, languages, table)
            table = (1 - EVEN) * found / np.maximum(found.sum(axis=0), 1e-300) + EVEN / len(pieces)
        remove_folder(spark, path)
    prior = np.array([shares[lang] for lang in languages], float)
    return Model(pieces, languages, table, prior / max(prior.sum(), 1.0))


def identified(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, lang_pred and score for every row, from its text alone.

    score is the posterior probability of lang_pred. `und` with score 0 stands for
    texts that are NULL, empty or without a letter, and for all if no language was
    learned. Equal scores go to the first language by name. A text of any length
    counts in whole; repeated rows get equal results; an empty table gives no rows.
    """
    ship(documents.sparkSession)
    names = list(keep)
    kept = documents.select(*names, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"), runs(F.col("text")).alias("_words"))
    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names), "lang_pred string", "score double"])
    languages, table, pieces = model.languages, model.table, model.pieces

    def log_sums(words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Rows x languages; words of all rows end to end."""
        coded = words.dictionary_encode()
        distinct, place = coded.dictionary, coded.indices.to_numpy()
        each = [Lattice(distinct.slice(i, WORDS_AT_ONCE), pieces).log_likelihood(table) for i in range(0, len(distinct), WORDS_AT_ONCE)]
        logs = np.concatenate(each)
        owner = np.repeat(np.arange(len(counts)), counts)
        return np.stack([np.bincount(owner, logs[place, k], len(counts)) for k in range(len(languages))], axis=1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_words").fill_null([])
            counts = np.diff(column.offsets.to_numpy())
            words = column.flatten()
            bounds = np.concatenate([[0], np.cumsum(counts)])
            total = np.tile(np.log(model.prior), (batch.num_rows, 1)) if languages else np.zeros((batch.num_rows, 1))
            first = 0
            while languages and first < batch.num_rows:  # rows of about SCORES_AT_ONCE words, or parts of a longer row
                last = max(int(np.searchsorted(bounds, bounds[first] + SCORES_AT_ONCE, side="right")) - 1, first + 1)
                last = min(last, batch.num_rows)
                for at in range(int(bounds[first]), int(bounds[last]), SCORES_AT_ONCE):
                    upto = min(at + SCORES_AT_ONCE, int(bounds[last]))
                    part = np.diff(np.clip(bounds[first : last + 1], at, upto))
                    total[first:last] += log_sums(words.slice(at, upto - at), part)
                first = last
            best = total.argmax(axis=1)
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            known = batch.column("_letters").to_numpy(zero_copy_only=False) & bool(languages)
            pred = np.where(known, np.array(languages or ["und"], object)[best], "und")
            columns = [batch.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])
        release()

    return kept.mapInArrow(judge, schema)
