"""Substring deduplication: paragraphs by MinHash banding, exact verification, components.

A paragraph is a line of a text. Its set is its distinct five-word shingles,
lower-cased; paragraphs with equal sets are one class. Every class gets a MinHash
signature cut into bands; paragraphs that agree in a band collide. The number
of bands and rows is tuned so that paragraphs at the wanted similarity collide almost
surely. Collisions are found in packed blocks of band keys, so only classes
that collide with another class are looked at again. These are joined, first with a leader per band and
then, where that leaves different components, pair by pair as far as
their rarest shingles allow; all are verified by the exact Jaccard similarity of their sets. Components of
classes are the clusters: their first paragraph stays, the others are removals.

Removals are reported where neighbouring repeated paragraphs make a passage of
MIN_PASSAGE words or more that other documents have, too.

Passages in the middle of longer lines are no paragraphs, so content-defined windows lead to
them: of every NEIGHBOURS neighbouring windows of WINDOW words the one with the smallest hash. MIN_PASSAGE words
have NEIGHBOURS windows, so documents that share as many in a row always have a kept window in common. Around each
window that several documents have, all runs of MIN_PASSAGE words are compared; those that
other documents have make the passages, to their true ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm import words as W
from riskmart.llm.blocks import blocks_for, pack_pieces, shared_counts
from riskmart.llm.pieces import NAMES as PIECE_NAMES
from riskmart.llm.pieces import Answered, Pieces, answered, piece_schema
from riskmart.llm.pieces import blocks_for as blocks_of
from riskmart.llm.setjoin import exact, labelled, leader_pairs, open_pairs, prefixes
from riskmart.llm.shipping import ship
from riskmart.llm.tables import components, discard, extended, stored

GRAM = 5
PERCENT = 80
RECALL = 0.999
MIN_PASSAGE = 50
#: Rounds of leaders; each joins what its links allow, what is left goes pair by pair.
LEADER_ROUNDS = 4
#: Of so many neighbouring windows one is kept.
NEIGHBOURS = 10
#: Words of a window; MIN_PASSAGE words are NEIGHBOURS windows.
WINDOW = MIN_PASSAGE - NEIGHBOURS + 1
PIECE_ENTRIES = 1_000_000


def tune_bands(similarity: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the rows per band that collide least below the similarity, at the wanted recall.

    Among all shapes of up to `most` hashes whose chance to collide at the
    similarity reaches the recall, the one with the smallest area of the collision curve below it.
    """
    below = np.linspace(0.0, similarity, 200)
    best = None
    for rows in range(1, 9):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                area = float(np.mean(1 - (1 - below**rows) ** bands))
                if best is None or area < best[0] - 1e-12:
                    best = (area, bands, rows)
                break
    return best[1], best[2]


BANDS, ROWS = tune_bands(PERCENT / 100, RECALL, 64)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = W.mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return seeds[:count] | W.U64(1), seeds[count:]


def band_keys(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of BANDS keys per set; sets are not empty."""
    factor, shift = _factors(BANDS * ROWS)
    first = np.cumsum(counts) - counts
    keys = np.empty((len(counts), BANDS), np.uint64)
    for band in range(BANDS):
        total = np.full(len(counts), W.U64(band + 1))
        for row in range(ROWS):
            k = band * ROWS + row
            least = np.minimum.reduceat((values ^ shift[k]) * factor[k], first)
            total = total * W.U64(0xD6E8FEB86659FD93) + W.mix(least)
        keys[:, band] = W.mix(total)
    return keys


class Paragraphs:
    """The lines with GRAM words or more of some texts, in order."""

    def __init__(self, column: pa.Array):
        found = W.texts(column)
        split = W.words(found, lower=True)
        data, bounds = found.data, found.bounds
        opens = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
        opens = opens[opens < len(data)]
        ends = np.append(opens[1:], len(data))
        if len(opens):
            ends = ends - (data[ends - 1] == 10)
        a, b = np.searchsorted(split.start, opens), np.searchsorted(split.start, ends)
        long = b - a >= GRAM
        opens, ends, a, b = opens[long], ends[long], a[long], b[long]
        self.text = np.searchsorted(bounds, opens, side="right") - 1
        first = np.searchsorted(self.text, np.arange(found.count))
        self.order = np.arange(len(opens)) - first[self.text]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = points[bounds[:-1]][self.text]
        self.start, self.end = points[opens] - base, points[ends] - base
        self.n_words = b - a
        self.word = a - (np.cumsum(split.per_text) - split.per_text)[self.text]
        inside = np.arange(int(self.n_words.sum())) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        values, counts = W.shingles(split.hash[np.repeat(a, self.n_words) + inside], self.n_words, GRAM)
        self.values, self.counts = W.distinct_per_text(values, counts)
        self.name = W.set_digest(self.values, self.counts)[0]


def run_values(split: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of `size` words of one text."""
    count = len(split.hash)
    at = np.flatnonzero(W.gram_mask(split.per_text, size))
    # Sums of words times powers of an odd base; dividing by the base moves a run to its start.
    base = 0x9E3779B97F4A7C15
    back = pow(base, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate([one, np.full(count, base, np.uint64)]))
    undo = np.cumprod(np.concatenate([one, np.full(count, back, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(split.hash * power[:count])])
    return at, W.mix((sums[at + size] - sums[at]) * undo[at])


class Windows:
    """The content-defined windows of WINDOW words of some texts."""

    def __init__(self, column: pa.Array):
        self.found = W.texts(column)
        self.split = W.words(self.found, lower=True)
        per_text = np.maximum(self.split.per_text - WINDOW + 1, 0)
        at, value = run_values(self.split, WINDOW)
        keep = self._kept(value, per_text)
        self.at, self.value = at[keep], value[keep]
        self.counts = np.bincount(np.repeat(np.arange(self.found.count), per_text)[keep], minlength=self.found.count)

    @staticmethod
    def _kept(value: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """True for windows that are smallest among NEIGHBOURS neighbours; fewer hold no MIN_PASSAGE words."""
        keep = np.zeros(len(value), bool)
        if len(value) >= NEIGHBOURS:
            groups = np.lib.stride_tricks.sliding_window_view(value, NEIGHBOURS)
            inside = W.gram_mask(per_text, NEIGHBOURS)[: len(groups)]
            least = np.flatnonzero(inside)
            keep[least + groups[least].argmin(axis=1)] = True
        return keep

    def passages(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first word, start, end, hash) of all runs of MIN_PASSAGE words that hold one of the `chosen` windows."""
        split, found = self.split, self.found
        edges = np.zeros(len(split.hash) + 1, np.int64)
        np.add.at(edges, np.maximum(self.at[chosen] - NEIGHBOURS + 1, 0), 1)
        np.add.at(edges, self.at[chosen] + 1, -1)
        at, value = run_values(split, MIN_PASSAGE)
        near = np.cumsum(edges)[at] > 0
        at, value = at[near], value[near]
        text = np.repeat(np.arange(found.count), split.per_text)[at]
        word = at - (np.cumsum(split.per_text) - split.per_text)[text]
        points = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
        first = points[found.bounds[:-1]][text]
        return text, word, points[split.start[at]] - first, points[split.end[at + MIN_PASSAGE - 1]] - first, value


def row_key():
    """A fingerprint of doc_id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def occurrences(documents: DataFrame) -> DataFrame:
    """(row_key, doc_id, paragraph, word, start, end, n_words, n, c): every paragraph with its first word and the name of its set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            p = Paragraphs(batch.column("text"))
            at = pa.array(p.text)
            numbers = (p.order, p.word, p.start, p.end, p.n_words, p.counts)
            columns = [batch.column("row_key").take(at), batch.column("doc_id").take(at)]
            columns += [pa.array(x.astype(np.int64)) for x in numbers] + [pa.array(p.name.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row_key", "doc_id", "paragraph", "word", "start", "end", "n_words", "n", "c"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"row_key long, doc_id {kind}, paragraph long, word long, start long, end long, n_words long, n long, c long"
    return documents.select(row_key().alias("row_key"), "doc_id", "text").mapInArrow(rows, schema)


def colliding(documents: DataFrame, paragraphs: int) -> DataFrame:
    """c of all classes that agree with another class in a band."""
    blocks = blocks_for(paragraphs * BANDS)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in W.slices(batches):
            p = Paragraphs(batch.column("text"))
            if len(p.counts):
                # Keys are sorted within a class: equal rows of one class go once.
                keys = np.sort(band_keys(p.values, p.counts), axis=1)
                held.append((keys.reshape(-1), np.full(len(keys), BANDS, np.int64), p.name))
                size += keys.size
            if size >= PIECE_ENTRIES:
                yield pack_pieces(held, blocks)
                held, size = [], 0
        if held:
            yield pack_pieces(held, blocks)

    return shared_counts(documents.select("text").mapInArrow(pieces, "block int, packed binary")).where("shared > 0").select("c")


def window_pieces(documents: DataFrame, words: int) -> DataFrame:
    """The windows of all documents as pieces; 32 bits tell them apart, the runs around them are compared by 64."""
    blocks = blocks_of(2 * words // (NEIGHBOURS + 1))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Pieces(blocks, np.uint32)
        for batch in W.slices(batches):
            found = Windows(batch.column("text"))
            yield from held.add(pa.nulls(batch.num_rows, pa.int8()), batch.column("row_key"), found.counts, found.value)
        yield from held.rest()

    return documents.select(row_key().alias("row_key"), "text").mapInArrow(pieces, piece_schema("byte"))


def shared_windows(pieces: DataFrame) -> DataFrame:
    """(row_key, hits): for each document the numbers of its windows that another document has."""

    def rows(found: Answered) -> pa.Table:
        docs, first = np.unique(found.owner, return_index=True)
        nth = found.nth.astype(np.uint32)
        hits = [x.tobytes() for x in np.split(nth, first[1:])]
        return pa.table({"row_key": found.keys.take(pa.array(docs)), "hits": pa.array(hits, pa.binary())})

    return answered(pieces, "byte", rows, "row_key long, hits binary")


def reread(documents: DataFrame, places: DataFrame, wanted: DataFrame, shared: DataFrame) -> DataFrame:
    """What a second look at some texts gives, in one pass.

    Rows with c: (c, n, grams, bands) of paragraphs, for each wanted class from one document. Rows
    without: pieces of the runs of MIN_PASSAGE words around shared windows, with first word, start and end.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    runs = shared.agg(F.coalesce(F.sum(F.length("hits")), F.lit(0))).first()[0] // 4 * NEIGHBOURS
    blocks = blocks_of(runs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "n", "grams", "bands"]
        held = Pieces(blocks)
        lists = pa.list_(pa.int64())

        def whole(piece: pa.RecordBatch) -> pa.RecordBatch:
            rows = piece.num_rows
            columns = [pa.nulls(rows, t) for t in (pa.int64(), pa.int64(), lists, lists)]
            return pa.RecordBatch.from_arrays([*columns, *piece.columns], names=[*names, *piece.schema.names])

        for batch in W.slices(batches):
            part = batch.filter(batch.column("sets"))
            if part.num_rows:
                p = Paragraphs(part.column("text"))
                rows = len(p.counts)
                bands = band_keys(p.values, p.counts) if rows else np.zeros((0, BANDS), np.uint64)
                grams, keys = W.list_column(p.values, p.counts), W.list_column(bands.reshape(-1), np.full(rows, BANDS))
                columns = [pa.array(p.name.view(np.int64)), pa.array(p.counts.astype(np.int64)), grams, keys]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(batch.schema.field("doc_id").type), lists)
                columns += [pa.nulls(rows, t) for t in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *PIECE_NAMES])
            part = batch.filter(pc.is_valid(batch.column("hits")))
            if part.num_rows:
                w = Windows(part.column("text"))
                hits = [np.frombuffer(x, np.uint32) for x in part.column("hits").to_pylist()]
                first = np.repeat(np.cumsum(w.counts) - w.counts, [len(x) for x in hits])
                text, word, start, end, value = w.passages(first + np.concatenate(hits))
                counts = np.bincount(text, minlength=part.num_rows)
                for piece in held.add(part.column("doc_id"), part.column("row_key"), counts, value, word, start, end):
                    yield whole(piece)
        for piece in held.rest():
            yield whole(piece)

    first = places.groupBy("c").agg(F.min("row_key").alias("row_key"))
    of_sets = first.join(wanted, "c", "left_semi").select("row_key", F.lit(True).alias("sets"), F.lit(None).cast("binary").alias("hits"))
    of_windows = shared.select("row_key", F.lit(False).alias("sets"), "hits")
    chosen = of_sets.unionByName(of_windows).groupBy("row_key").agg(F.max("sets").alias("sets"), F.max("hits").alias("hits"))
    texts = documents.select(row_key().alias("row_key"), "doc_id", "text").join(chosen, "row_key").dropDuplicates(["row_key"])
    return texts.mapInArrow(read, f"c long, n long, grams array<long>, bands array<long>, {piece_schema(kind)}")


def shared_passages(pieces: DataFrame, kind: str) -> DataFrame:
    """Neighbouring runs of MIN_PASSAGE words that other documents have and one document has first, joined to passages.

    Where the first document changes, the next passage begins; it overlaps the one before.
    """

    def rows(found: Answered) -> pa.Table:
        word, start, end = found.rest
        head = found.head_keys.to_numpy(zero_copy_only=False)[found.first]
        new = np.ones(len(word), bool)
        new[1:] = (np.diff(found.owner) != 0) | (np.diff(word) != 1) | (head[1:] != head[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(word)) - 1
        keys = found.keys.to_numpy(zero_copy_only=False)[found.owner[a]]
        owner, words = pa.array(found.owner[a]), word[b] + MIN_PASSAGE - word[a]
        return pa.table(
            {
                "row_key": keys,
                "doc_id": found.ids.take(owner),
                "word": word[a],
                "start": start[a],
                "end": end[b],
                "n_words": words,
                "passage_words": words,
                "cluster_id": found.head_ids.take(pa.array(found.first[a])),
                "copies": np.maximum.reduceat(found.copies, a),
                "removed": keys != head[a],
            }
        )

    numbers = "word long, start long, end long, n_words long, passage_words long"
    return answered(pieces, kind, rows, f"row_key long, doc_id {kind}, {numbers}, cluster_id {kind}, copies long, removed boolean")


def clusters(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes with a verified partner.

    Colliding paragraphs are first joined with one leader per band. Then all
    pairs in different components follow that their rarest shingles do not rule out.
    """
    prefix = stored(prefixes(sets, percent).withColumn("component", F.col("c")), "paragraph-prefixes")
    able = prefix.groupBy("c", "n").agg(F.min("pos").alias("pos"), F.max("reach").alias("reach"))
    bands = stored(sets.select("c", F.explode("bands").alias("h")).join(able, "c").withColumn("component", F.col("c")), "bands")
    found = None
    for salt in range(LEADER_ROUNDS + 1):
        if salt < LEADER_ROUNDS:
            pairs = leader_pairs(bands if found is None else labelled(bands, found), salt, percent, every=salt > 0)
        else:
            pairs = open_pairs(labelled(prefix, found), percent)
        links = stored(exact(pairs, sets, percent), "paragraph-links")
        if found is None:
            found = stored(components(links), "components")
        elif not links.isEmpty():
            before, found = found, extended(found, links)
            discard(before)
        discard(links)
    discard(prefix, bands)
    return found


def repeated_passages(documents: DataFrame, percent: int = PERCENT, least_words: int = MIN_PASSAGE) -> DataFrame:
    """One row per paragraph that is part of a passage which other documents repeat, and per other passage.

    `documents` has doc_id and text; other columns are ignored. Columns:
    kind (paragraph, or passage for what stands inside longer lines), doc_id, paragraph (number among the document's lines of five words and more), start
    and end (code points, end exclusive), n_words, passage_words (of the run of repeated paragraphs
    it stands in), cluster_id (smallest doc_id of its cluster), copies
    (paragraphs of the cluster), removed (false for the cluster's first
    paragraph by doc_id and number). NULL and empty texts have no paragraphs. Rows that repeat
    doc_id and text count as one document; NULL doc_ids are documents, too,
    and come last. Shorter lines neither count nor separate. An empty table gives no rows.
    """
    ship(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    places = stored(occurrences(documents), "paragraphs")
    wanted = stored(colliding(documents, places.count()), "paragraphs-colliding")
    pieces = stored(window_pieces(documents, places.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]), "window-pieces")
    shared = stored(shared_windows(pieces), "windows-shared")
    discard(pieces)
    again = stored(reread(documents, places, wanted, shared), "paragraphs-again")
    discard(shared)
    # Passages inside lines first: their pieces go before the lines' tables come.
    kind = documents.schema["doc_id"].dataType.simpleString()
    inside = stored(shared_passages(again.where("c is null"), kind), "passages-repeated")
    whole = again.where("c is not null").select("c", "n", "grams", "bands")
    sets = stored(whole.join(wanted, "c", "left_semi").dropDuplicates(["c"]), "paragraph-sets")
    discard(again, wanted)
    found = clusters(sets, percent)
    once = places.groupBy("c").agg(F.min("row_key").alias("lo"), F.max("row_key").alias("hi"))
    named = once.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    across = named.groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("component")
    repeated = stored(named.join(across, "component", "left_semi").select("c", "component"), "paragraph-clusters")
    hits = stored(places.join(repeated, "c").drop("c", "n").dropDuplicates(["row_key", "paragraph"]), "paragraph-hits")
    discard(sets, places)
    document = Window.partitionBy("row_key")
    runs = hits.withColumn("run", F.col("paragraph") - F.row_number().over(document.orderBy("paragraph")))
    runs = runs.withColumn("passage_words", F.sum("n_words").over(Window.partitionBy("row_key", "run"))).drop("run")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "paragraph")
    heads = hits.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    out = runs.where(F.col("passage_words") >= least_words).join(heads, "component")
    lines = out.select(
        F.lit("paragraph").alias("kind"),
        "row_key",
        "doc_id",
        "paragraph",
        "word",
        "start",
        "end",
        "n_words",
        "passage_words",
        F.col("first.doc_id").alias("cluster_id"),
        "copies",
        (place != F.col("first")).alias("removed"),
    )
    lines = stored(lines, "paragraphs-repeated")
    discard(hits, repeated)
    covered = lines.groupBy(F.col("row_key").alias("_row")).agg(F.collect_list(F.struct("word", "n_words")).alias("lines"))
    # A passage all of whose words stand in reported lines is not listed again; lists are of one document.
    rest = inside.join(covered, F.col("row_key") == F.col("_row"), "left")
    body = F.expr("aggregate(lines, 0L, (a, x) -> a + greatest(0L, least(x.word + x.n_words, word + n_words) - greatest(x.word, word)))")
    rest = rest.where(F.coalesce(body, F.lit(0)) < F.col("n_words"))
    others = rest.select(F.lit("passage").alias("kind"), F.lit(None).cast("long").alias("paragraph"), *[c for c in lines.columns if c not in ("kind", "paragraph")])
    return lines.unionByName(others).drop("word")
