"""Token ids of a corpus as binary shard files, and reading them back by key."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmart.llm import words as W
from riskmart.llm.shards import NULL_ID, Shard, pack
from riskmart.llm.shipping import ship
from riskmart.llm.tables import partitions
from riskmart.llm.wordcodes import word_encoder
from riskmart.sources import working_folder

END_ID = 2
#: Ids after which a task closes a shard file.
SHARD_IDS = 16_000_000


def filesystem(path: str):
    """The file system of a shared folder and the path in it: local, HDFS or an object store."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def write_whole(path: str, body: bytes) -> None:
    """Write a file under its name only when it is complete; a second attempt replaces it."""
    context = TaskContext.get()
    store, name = filesystem(path)
    part = f"{name}.{context.taskAttemptId() if context else 0}.part"
    with store.open_output_stream(part) as out:
        out.write(body)
    store.move(part, name)


def read_whole(path: str) -> bytes:
    store, name = filesystem(path)
    with store.open_input_file(name) as source:
        return source.read()


def write_shards(documents: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents (doc_id, text) in ascending doc_id order; returns the manifest.

    The manifest has one row per shard: path, n_docs, n_ids, and first_id, the
    number of ids in all shards before. NULL doc_ids come first, rows that
    repeat a doc_id in the order of a hash of their texts. A NULL or empty text is its
    end id alone. An empty table writes no shard. Extra columns are not looked at.
    """
    spark = documents.sparkSession
    ship(spark)

    store, name = filesystem(folder)
    store.create_dir(name, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(vocabulary), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, number
            ids, per_doc, doc_ids = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{folder}/shard-{part:06d}-{number:06d}.tok"
            write_whole(path, pack(ids, per_doc, doc_ids))
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_pydict(
                {"path": [path], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()),
                 "n_docs": [len(doc_ids)], "n_ids": [len(ids)]}
            )

        for batch in W.slices(batches):
            ids, per_doc = encoder.encode(W.texts(batch.column("text")), end_id)
            doc_ids = batch.column("doc_id").fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            held.append((ids, per_doc, doc_ids))
            size += len(ids)
            if size >= SHARD_IDS:
                yield close()
        if held:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    written = ranged.select("doc_id", "text").mapInArrow(encode, "path string, part int, number int, n_docs long, n_ids long")
    listing = f"{folder}/manifest"
    written.write.parquet(listing)
    # One small row per shard file.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(written.schema).parquet(listing)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "n_docs", "n_ids", "first_id")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the shard files by key: doc_id, start, n_tokens, ids_crc32."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                shard = Shard(read_whole(path))
                first, size = shard.find(shard.doc_ids, shard.repeats)
                if (first < 0).any():
                    raise ValueError(f"{path}: a stored key is not found")
                sums = [zlib.crc32(shard.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NULL_ID),
                        pa.array(first + base),
                        pa.array(size),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.select("path", "first_id").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(documents: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write the documents as shards below the shared folder and read every one back by its key."""
    spark: SparkSession = documents.sparkSession
    return read_documents(write_shards(documents, vocabulary, folder or working_folder(spark, "tokens")))
