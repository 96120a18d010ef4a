"""Join of documents on the Jaccard similarity of their word n-grams.

Documents are the rows and n-grams the columns of a sparse 0/1 matrix; the
overlap of two documents is an entry of the matrix times its transpose. The
product is taken in blocks and most of it is never formed:

1. Documents with the same set are one row ("class") from the start.
2. Columns are dealt into blocks by n-gram hash. A block tells which of its
   n-grams stand in two classes or more; a class of n n-grams can only have a
   partner if at least `similarity * n` of its n-grams do. All others leave.
3. For the rest, columns are ordered from rare to frequent. Two sets that
   reach the similarity share one of their first `n - ceil(similarity * n) + 1`
   columns, so only these are multiplied. Overlap counts and last common
   positions accumulate per pair, and a pair goes when even the columns after
   that position could not bring it to the size-derived bound. Before that, sizes
   and first common positions alone rule out most partners.
4. What is left is multiplied out exactly (intersection of the two sets).

A link inside a component adds nothing to it. So large groups of near copies
are first tied to one leader per column in a few linear rounds; only pairs of
classes that share a prefix column and are still in different components go
through steps 3 and 4, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import words as W
from riskmart.llm.blocks import blocks_for, pack_pieces, shared_counts
from riskmart.llm.setjoin import exact, labelled, leader_pairs, open_pairs, prefixes
from riskmart.llm.shipping import ship
from riskmart.llm.tables import components, stored

GRAM = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Entries of the incidence matrix in one packed piece.
PIECE_ENTRIES = 1_000_000
LEADER_ROUNDS = 2


def _sets(batch: pa.RecordBatch, gram: int):
    found = W.words(W.texts(batch.column("text")), lower=True)
    return W.distinct_per_text(*W.shingles(found.hash, found.per_text, gram))


def describe(documents: DataFrame, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, fingerprint of doc_id and text, set size and the 128 bits naming the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            values, counts = _sets(batch, gram)
            one, two = W.set_digest(values, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(counts.astype(np.int64)),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                ],
                names=["doc_id", "row_key", "n_shingles", "c", "c2"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _keyed(documents).mapInArrow(rows, f"doc_id {kind}, row_key long, n_shingles long, c long, c2 long")


def row_key():
    """A fingerprint of doc_id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", row_key().alias("row_key"), "text")


# --- step 2: which classes can have a partner at all


def partnered(documents: DataFrame, entries: int, gram: int, percent: int) -> DataFrame:
    """c of the classes enough of whose n-grams stand in another class; a superset of the linked ones."""
    blocks = blocks_for(entries)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in W.slices(batches):
            values, counts = _sets(batch, gram)
            held.append((values, counts, W.set_digest(values, counts)[0]))
            size += len(values)
            if size >= PIECE_ENTRIES:
                yield pack_pieces(held, blocks)
                held, size = [], 0
        if held:
            yield pack_pieces(held, blocks)

    packed = documents.select("text").mapInArrow(pieces, "block int, packed binary")
    sums = shared_counts(packed)
    return sums.where(F.expr(f"n > 0 and 100 * shared >= {percent} * n")).select("c")


# --- steps 3 and 4


def class_sets(documents: DataFrame, rows: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    """(c, n, grams): the set of each wanted class, from one of its documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            values, counts = _sets(batch, gram)
            names = W.set_digest(values, counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), pa.array(counts.astype(np.int64)), W.list_column(values, counts)],
                names=["c", "n", "grams"],
            )

    one = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    chosen = one.join(wanted, "c", "left_semi").select("first.row_key")
    texts = _keyed(documents).join(chosen, "row_key", "left_semi")
    return texts.select("text").mapInArrow(read, "c long, n long, grams array<long>").dropDuplicates(["c"])


def class_components(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links between classes that span their components, and (node, component)."""
    prefix = stored(prefixes(sets, percent).withColumn("component", F.col("c")), "prefix")
    links, found = None, None
    for salt in range(LEADER_ROUNDS + 1):
        last = salt == LEADER_ROUNDS
        here = prefix if found is None else labelled(prefix, found)
        pairs = open_pairs(here, percent) if last else leader_pairs(here, salt, percent)
        new = exact(pairs, sets, percent)
        links = stored(new if links is None else links.unionByName(new), "jaccard-links")
        found = components(links)
    return links, found


def jaccard_join(documents: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row per row of `documents` (doc_id, text): doc_id, row_key, n_shingles,
    class_id, component_id, class_size.

    Words are split at ASCII white space, A-Z lower-cased. The set of a text
    with fewer than `gram` words is its whole sequence; a text that is NULL or
    has no words has the empty set and is linked with nothing. Rows with equal
    sets form a class (class_id: its smallest doc_id). component_id is the
    smallest doc_id reachable by links. Rows that repeat a doc_id are rows of
    their own; NULL doc_ids count as links, but never as the smallest doc_id
    while another is there. Extra columns are ignored; an empty table gives no
    rows. Sets are named by 128 bits, n-grams by 64 bits.
    """
    return _joined(documents, gram, percent).drop("component")


def _joined(documents: DataFrame, gram: int, percent: int) -> DataFrame:
    """jaccard_join with `component`, which names the component whatever its doc_ids; NULL for rows without words."""
    ship(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    rows = stored(describe(documents, gram), "jaccard-rows")
    classes = rows.where("n_shingles > 0").groupBy("c", "c2").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.max("n_shingles").alias("n")
    )
    entries = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    wanted = stored(partnered(documents, entries, gram, percent), "jaccard-wanted")
    sets = stored(class_sets(documents, rows.where("n_shingles > 0"), wanted, gram), "jaccard-sets")
    _, found = class_components(sets, percent)
    grouped = classes.join(found.withColumnRenamed("node", "c"), "c", "left")
    known = stored(grouped.withColumn("component", F.coalesce("component", "c")), "jaccard-classes")
    least = known.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = known.join(least, "component").select("c", "c2", "class_id", "class_size", "component_id", "component")
    out = rows.join(named, ["c", "c2"], "left")
    own = F.col("doc_id")
    return out.select(
        "doc_id",
        "row_key",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(own).alias("class_id"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(own).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        "component",
    )


def keep_one_per_component(documents: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The documents with one row per component of links.

    The row with the component's smallest doc_id stays; where several rows have
    it, one of them. Rows without words are linked with nothing and all stay.
    """
    joined = _joined(documents, gram, percent).where("n_shingles > 0")
    least = joined.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("m"))
    stay = least.select(F.col("m.row_key").alias("_row_key"))
    keyed = documents.withColumn("_row_key", row_key())
    worded = F.coalesce(F.col("text").rlike(W.WORD), F.lit(False))
    kept = keyed.where(worded).join(stay, "_row_key", "left_semi").dropDuplicates(["_row_key"])
    return kept.unionByName(keyed.where(~worded)).drop("_row_key")


__all__ = ["jaccard_join", "keep_one_per_component"]
