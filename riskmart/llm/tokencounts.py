"""Token counts of documents by compiled transducers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import words as W
from riskmart.llm.shipping import ship
from riskmart.llm.transducers import token_counter

LIMIT = 1024


def token_counts(documents: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of `documents` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    n_bytes counts UTF-8. n_tokens is what the byte-level BPE vocabulary file's
    library gives for the whole text without begin, end or other added tokens; its special strings in
    a text are one token each. NULL counts as the empty text: 0 and 0. Rows stay as they
    are, repeated ones and NULL doc_ids too; extra columns are ignored. Each task
    compiles the vocabulary once per worker; nothing is shuffled.
    """
    ship(documents.sparkSession)

    kind = documents.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocabulary)
        for batch in W.slices(batches):
            found = W.texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.bounds[1:] - found.bounds[:-1]), pa.array(counter.counts(found))],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    out = documents.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
