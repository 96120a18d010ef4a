"""Quality rules: an isolation forest over rule statistics, calibrated with labelled rows.

Every document gets the statistics that hand-written rules look at. Two of
them reject on their own; for all other documents a forest of random splits
decides. Cuts are drawn uniformly in the box of the node, and the first box
spans all labelled rows, so regions where only bad rows lie are cut off early
and paths into them are short. Cuts need no rows: every tree is laid out from the box alone, then all rows
labelled good are counted in its leaves, and a node ends as soon as TREE_ROWS rows of their distribution
would leave one in it. The
score is the usual 2 ** (-mean path / expected path); documents above the
threshold are anomalous. The threshold is calibrated on all labelled rows that
no tree has counted. Nothing is sampled: Spark finds box, counts and threshold
over all labelled rows, and the driver sees one count per leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import words as W
from riskmart.llm.shipping import ship
from riskmart.llm.tables import discard, stored
from riskmart.operators.quantiles import Interval, order_statistics

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: A tree's paths are those of so many rows, whatever their number: counts enter as shares of all rows.
TREES, TREE_ROWS, MAX_DEPTH = 200, 256, 10
#: Rates of rare characters enter as this power: a cut drawn at random then parts none from few, too.
ROOT = 0.25
#: Share of good labelled rows that the calibrated threshold may reject.
MAX_FALSE_REJECTS = 0.001

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("chars_per_word", "symbols", "duplicate_lines", "repeated_words", "capitals", "marks", "digits", "distinct_words", "words_per_line", "stutter")


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL = _class(SYMBOLS)
_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_DIGIT = _class(b"0123456789")
_MARK = _class(bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"))


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts and the feature matrix of some texts."""
    found = W.texts(column)
    all_words = W.words(found)
    data, bounds, per = found.data, found.bounds, all_words.per_text
    inside = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = W.sum_per_text(points[all_words.end] - points[all_words.start], per)

    opens = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
    opens = opens[opens < len(data)]
    # A line ends at its line feed or at the end of its text.
    ends = np.append(opens[1:], len(data))
    ends = ends - (data[ends - 1] == 10) if len(opens) else ends[:0]
    worded = np.searchsorted(all_words.start, ends) > np.searchsorted(all_words.start, opens)
    opens, ends = opens[worded], ends[worded]
    owner = np.searchsorted(bounds, opens, side="right") - 1
    lines = np.bincount(owner, minlength=found.count)
    _, distinct_lines = W.distinct_per_text(W.run_hashes(data, opens, ends), lines)

    covered = _repeated(all_words)
    repeat = W.sum_per_text(covered.astype(np.int64), per)
    _, distinct_words = W.distinct_per_text(all_words.hash, per)
    counts = {
        "n_words": per,
        "word_chars": word_chars,
        "n_symbols": inside(_SYMBOL[data]),
        "n_dup_lines": lines - distinct_lines,
        "n_repeat_words": repeat,
    }
    stutter = np.zeros(len(all_words.hash), bool)
    stutter[1:] = (all_words.hash[1:] == all_words.hash[:-1]) & W.gram_mask(per, 2)[:-1]
    n = np.maximum(per, 1)
    root = lambda rate: rate**ROOT
    features = np.stack(
        [
            word_chars / n,
            root(counts["n_symbols"] / n),
            counts["n_dup_lines"] / np.maximum(lines, 1),
            repeat / n,
            root(inside(_UPPER[data]) / np.maximum(inside(_LETTER[data]), 1)),
            root(inside(_MARK[data]) / n),
            root(inside(_DIGIT[data]) / np.maximum(word_chars, 1)),
            np.log1p(distinct_words) / np.log1p(n),
            np.log(n / np.maximum(lines, 1)),
            root(W.sum_per_text(stutter.astype(np.int64), per) / n),
        ],
        axis=1,
    )
    return {k: v.astype(np.int64) for k, v in counts.items()}, features


def _repeated(found: W.Words) -> np.ndarray:
    """Words that lie in a window of WINDOW words which the same text has twice or more."""
    start = np.flatnonzero(W.gram_mask(found.per_text, WINDOW))
    cover = np.zeros(len(found.hash) + 1, np.int64)
    if len(start):
        value = W.grams(found.hash, WINDOW)[start]
        owner = np.repeat(np.arange(len(found.per_text)), found.per_text)[start]
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        twice = np.zeros(len(start), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = start[order[twice]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
    return np.cumsum(cover)[:-1] > 0


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


# --- the forest


@dataclass
class Forest:
    """Trees as flat arrays; inner nodes have a feature, leaves have feature -1 and their path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    expected: float
    threshold: float = np.inf

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(MAX_DEPTH):
                f = self.feature[node]
                go = rows[each, np.maximum(f, 0)] >= self.cut[node]
                node = np.where(f < 0, node, self.left[node] + go)
            total += self.length[node]
        return 2.0 ** (-total / (len(self.roots) * self.expected))


def _expected_path(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else max(0.0, 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n)


@dataclass
class Layout:
    """Full trees of random cuts: node i of a tree has children 2 i + 1 and 2 i + 2, its leaves are the last level."""

    feature: np.ndarray
    cut: np.ndarray

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """How many of the rows end in each leaf of each tree."""
        each, inner = np.arange(len(rows)), 2**MAX_DEPTH - 1
        out = np.zeros((len(self.feature), inner + 1), np.int64)
        for tree, (feature, cut) in enumerate(zip(self.feature, self.cut, strict=True)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(MAX_DEPTH):
                node = 2 * node + 1 + (rows[each, feature[node]] >= cut[node])
            out[tree] = np.bincount(node - inner, minlength=inner + 1)
        return out


def lay(low: np.ndarray, high: np.ndarray, seed: int = 7) -> Layout | None:
    """Cuts drawn in the box from low to high alone; None if it has no width."""
    wide = np.flatnonzero(high > low)
    if not len(wide):
        return None
    draw, inner = np.random.default_rng(seed), 2**MAX_DEPTH - 1
    feature, cut = np.zeros((TREES, inner), np.int64), np.zeros((TREES, inner))
    lo, hi = (np.broadcast_to(x, (TREES, 1, len(low))) for x in (low, high))
    for depth in range(MAX_DEPTH):
        level, width = slice(2**depth - 1, 2 ** (depth + 1) - 1), 2**depth
        f = wide[draw.integers(len(wide), size=(TREES, width))][..., None]
        a, b = np.take_along_axis(lo, f, 2), np.take_along_axis(hi, f, 2)
        c = a + (b - a) * draw.random((TREES, width, 1))
        feature[:, level], cut[:, level] = f[..., 0], c[..., 0]
        below, above = hi.copy(), lo.copy()
        np.put_along_axis(below, f, c, 2)
        np.put_along_axis(above, f, c, 2)
        lo = np.stack([lo, above], 2).reshape(TREES, 2 * width, -1)
        hi = np.stack([below, hi], 2).reshape(TREES, 2 * width, -1)
    return Layout(feature, cut)


def pruned(layout: Layout | None, leaves: np.ndarray) -> Forest:
    """The forest of a layout whose leaves (tree, leaf) hold so many rows."""
    total = int(leaves[0].sum())
    size = min(TREE_ROWS, total)
    levels = [leaves]
    while levels[0].shape[1] > 1:
        levels.insert(0, levels[0].reshape(len(leaves), -1, 2).sum(axis=2))
    held = np.concatenate(levels, axis=1)
    feature, cut, left, length, roots = [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, -1), (cut, 0.0), (left, 0), (length, 0.0)):
            column.append(empty)
        return len(feature) - 1

    for tree in range(len(leaves)):
        roots.append(node())
        open_nodes = [(roots[-1], 0, 0)]
        while open_nodes:
            at, place, depth = open_nodes.pop()
            rows = size * int(held[tree, place]) / total
            if layout is None or rows <= 1 or depth == MAX_DEPTH:
                length[at] = depth + _expected_path(rows)
                continue
            feature[at], cut[at], left[at] = int(layout.feature[tree, place]), float(layout.cut[tree, place]), node()
            node()
            open_nodes += [(left[at], 2 * place + 1, depth + 1), (left[at] + 1, 2 * place + 2, depth + 1)]
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(length), np.array(roots), max(_expected_path(size), 1.0))


def grow(good: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7) -> Forest:
    layout = lay(low, high, seed)
    return pruned(layout, np.full((TREES, 1), len(good)) if layout is None else layout.leaves(good))


def _kept_rank(count: int) -> int:
    """Zero-based rank of the best of `count` good rows, by score, that must be kept."""
    return int(np.ceil((1 - MAX_FALSE_REJECTS) * count)) - 1


def _threshold(edge: float, beyond: float | None) -> float:
    return float(np.nextafter(edge, np.inf)) if beyond is None else float((edge + beyond) / 2)


def calibrate(forest: Forest, rows: np.ndarray, good: np.ndarray) -> float:
    """The threshold that rejects most bad rows while at most MAX_FALSE_REJECTS of the good ones go.

    It lies half way between the best good row it must keep and the worst bad row
    beyond, so that rows a little outside what was seen stay.
    """
    score = forest.score(rows)
    kept = np.sort(score[good])
    if not len(kept):
        return np.inf
    edge = kept[_kept_rank(len(kept))]
    beyond = score[~good & (score > edge)]
    return _threshold(edge, beyond.min() if len(beyond) else None)


def fit(features: np.ndarray, good: np.ndarray, order: np.ndarray) -> Forest | None:
    """Half of the rows (by order) grow the trees, the other half calibrate; None without good rows."""
    half = order % 2 == 0
    train = good & half
    if not train.any():
        train, half = good, np.zeros(len(good), bool)
    if not train.any():
        return None
    forest = grow(features[train], features.min(axis=0), features.max(axis=0))
    forest.threshold = calibrate(forest, features[~half], good[~half])
    return forest


def verdict(counts: dict[str, np.ndarray], features: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(failed the base rules, score, kept); without a forest the score is NaN."""
    failed = base_failed(counts)
    if forest is None:
        return failed, np.full(len(failed), np.nan), ~failed
    score = forest.score(features)
    return failed, score, ~failed & (score <= forest.threshold)


# --- on Spark


def _measured(documents: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """Counts and features of each text beside the named columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            counts, features = statistics(batch.column("text"))
            columns = [batch.column(c) for c in extra] + [pa.array(counts[c]) for c in COUNTS]
            flat = pa.array(features.reshape(-1))
            bounds = pa.array(np.arange(len(features) + 1, dtype=np.int32) * features.shape[1])
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(bounds, flat)], names=[*extra, *COUNTS, "features"])

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in extra] + [f"{c} long" for c in COUNTS]
    return documents.select(*extra, "text").mapInArrow(rows, ", ".join([*kinds, "features array<double>"]))


def _leaf_counts(rows: DataFrame, layout: Layout) -> np.ndarray:
    """Rows per tree and leaf, over all rows; one number per leaf reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((TREES, 2**MAX_DEPTH), np.int64)
        for batch in batches:
            held += layout.leaves(_matrix(batch))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.reshape(-1)[at])], names=["leaf", "n"])

    found = rows.select("features").mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(TREES * 2**MAX_DEPTH, np.int64)
    held[found["leaf"].to_numpy()] = found["n"].to_numpy()
    return held.reshape(TREES, -1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))


def _scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """(good, score) of measured rows."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(forest.score(_matrix(batch)))], names=["good", "score"])

    return rows.select("good", "features").mapInArrow(scores, "good boolean, score double")


def _calibrated(rows: DataFrame, forest: Forest) -> float:
    """As calibrate(), over all rows of a table: the good row's rank is found by counting, no scores are gathered."""
    scored = stored(_scored(rows, forest), "quality-scores")
    good = scored.where("good")
    count = good.count()
    if not count:
        return np.inf
    ends = good.agg(F.min("score"), F.max("score")).first()
    rank, whole = _kept_rank(count), Interval("score", ends[0], ends[1], count, ())
    edge = order_statistics(good, [Interval("score", ends[0], ends[1], count, (rank,))], {"score": whole})[("score", rank)]
    beyond = scored.where(~F.col("good") & (F.col("score") > F.lit(float(edge)))).agg(F.min("score")).first()[0]
    discard(scored)
    return _threshold(edge, beyond)


def fit_forest(documents: DataFrame, labels: DataFrame) -> Forest | None:
    """A forest from all labelled documents; box, leaf counts and threshold reach the driver, no rows.

    Labels without a quality or for no document are left out, repeated labels
    count as often as they occur. One half of the rows, by a hash of doc_id, is counted in the
    trees, the other calibrates. None if no good row is labelled.
    """
    ship(documents.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") == 1).alias("good"))
    # Measured before the join: if the labels are many, numbers are shuffled, not texts.
    measured = _measured(documents.where("doc_id is not null"), ("doc_id",)).join(known, "doc_id")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    half = (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("half")
    rows = stored(measured.where(~base).select("good", half, "features"), "quality-labelled")
    each = [F.get("features", F.lit(i)) for i in range(len(FEATURES))]
    box = rows.agg(F.count_if("good"), F.count_if(F.col("good") & F.col("half")), *[f(x) for f in (F.min, F.max) for x in each]).first()
    if not box[0]:
        discard(rows)
        return None
    # Without a good row in its half, all good rows grow the trees and all rows calibrate.
    split = bool(box[1])
    low, high = (np.array(box[2 + i * len(each) : 2 + (i + 1) * len(each)], float) for i in (0, 1))
    layout = lay(low, high)
    train = rows.where("good and half" if split else "good")
    forest = pruned(layout, np.full((TREES, 1), box[1] if split else box[0]) if layout is None else _leaf_counts(train, layout))
    forest.threshold = _calibrated(rows.where("not half") if split else rows, forest)
    discard(rows)
    return forest


def judge(documents: DataFrame, forest: Forest | None, extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of `documents`: extra columns, counts, base_failed, score, kept.

    NULL counts as the empty text; without words every count is 0 and the row
    fails. Without a forest (no good labels) the base rules alone decide and the score is NULL.
    Rows stay as they are, repeated ones too.
    """
    ship(documents.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            counts, features = statistics(batch.column("text"))
            failed, score, kept = verdict(counts, features, forest)
            columns = [batch.column(c) for c in extra] + [pa.array(counts[c]) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(failed), pa.array(score, from_pandas=True), pa.array(kept)],
                names=[*extra, *COUNTS, "base_failed", "score", "kept"],
            )

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in extra] + [f"{c} long" for c in COUNTS]
    needed = [c for c in extra if c != "text"]
    schema = ", ".join([*kinds, "base_failed boolean, score double, kept boolean"])
    return documents.select(*needed, "text").mapInArrow(rows, schema)


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that rules and forest keep, in one pass, with their columns."""
    forest = fit_forest(documents, labels)
    ship(documents.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            counts, features = statistics(batch.column("text"))
            yield batch.filter(pa.array(verdict(counts, features, forest)[2]))

    return documents.mapInArrow(rows, documents.schema)
