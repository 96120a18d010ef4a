"""New files of a source -> bronze and silver, each file taken once.

The stream's checkpoint remembers which files were taken. A batch adds files of its own,
in folders by snapshot and batch, and touches no others, so it costs what its
own rows cost, whatever the months hold already. A batch may run again after a failure: it replaces
its own folders, and once its marker stands it is not taken again.
`compact_months` puts the batches of a month together now and then.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.operators.silver import parse_snapshot, silver_loan
from riskmart.sources import overwrite_snapshots, remove_folder
from riskmart.sources.schemas import LOAN_RAW_SCHEMA, SNAPSHOT
from riskmart.sources.tables import folders_of

FILE = "source_file"
BATCH = "batch"
MARKERS = "_taken"
PLAN = "compacting.txt"


def ingest_available(
    spark: SparkSession,
    source: str,
    bronze: str,
    silver: str,
    checkpoint: str,
    schema: T.StructType = LOAN_RAW_SCHEMA,
    clean: Callable[[DataFrame], DataFrame] = silver_loan,
    max_files: int | None = None,
) -> None:
    """Take all files not taken before, then stop; call again when new files may be there.

    `schema` and `clean` choose the source: loans by default, clicks with theirs. `clean` works
    row by row. A file whose header does not name the schema's columns in order stops the
    stream. Both tables are partitioned by snapshot and batch.
    """
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arrived = reader.csv(source).withColumn(
        FILE, F.concat(F.lit("f_"), F.md5(F.col("_metadata.file_path").cast("binary")))
    )

    def take(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        take_batch(batch, f"{stream}-{number:09d}", bronze, silver, clean)

    query = (
        arrived.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def take_batch(
    batch: DataFrame, name: str, bronze: str, silver: str, clean: Callable[[DataFrame], DataFrame]
) -> bool:
    """Add one batch to both tables unless its marker stands; whether it was added.

    Rows without a readable date belong to no snapshot and are left out. `name` is
    the stream's own id and the batch's number, the same whenever the batch runs.
    """
    spark = batch.sparkSession
    marker, store = _file(spark, f"{bronze}/{MARKERS}/{name}")
    if store.exists(marker):
        return False
    dated = parse_snapshot(batch).where(F.col(SNAPSHOT).isNotNull()).withColumn(BATCH, F.lit(name))
    by = [SNAPSHOT, BATCH]
    overwrite_snapshots(dated, bronze, by)
    folders = folders_of(spark, bronze, by, {BATCH: (name, name)})
    if folders:
        rows = spark.read.schema(dated.schema).option("basePath", bronze).parquet(*folders)
        cleaned = clean(rows.drop(FILE, BATCH)).withColumn(BATCH, F.lit(name))
        # The batch's bronze files hold one snapshot each and cleaning is narrow: no shuffle.
        overwrite_snapshots(cleaned, silver, by, compact=False)
    store.create(marker, True).close()
    return True


def compact_months(spark: SparkSession, path: str, start: dt.date, end: dt.date, more_than: int = 1) -> list[str]:
    """Put the batches of each month of the range into one folder; the months that were rewritten.

    Months of at most `more_than` folders stay. Run it between batches of the stream. A month's
    rows are first written beside the table, then a plan is noted, the old folders go and
    the new one takes their place by renaming; a run that broke off is finished first.
    """
    finish_compaction(spark, path)
    by = [SNAPSHOT, BATCH]
    folders = folders_of(spark, path, by, {SNAPSHOT: (start, end)})
    months: dict[str, list[str]] = {}
    for folder in folders:
        months.setdefault(folder.rsplit("/", 1)[0], []).append(folder)
    many = {m: f for m, f in months.items() if len(f) > more_than}
    for month, parts in sorted(many.items()):
        _replace_folders(spark, path, month, parts)
    return sorted(many)


def _replace_folders(spark: SparkSession, path: str, month: str, parts: Sequence[str]) -> None:
    name = uuid.uuid4().hex
    whole = f"{path}/{MARKERS}/month-{name}"
    spark.read.parquet(*parts).hint("rebalance").write.parquet(whole)
    plan, store = _file(spark, f"{path}/{MARKERS}/{PLAN}")
    out = store.create(plan, True)
    out.write(bytearray("\n".join([f"{month}/{BATCH}=whole-{name}", whole, *parts]).encode()))
    out.close()
    finish_compaction(spark, path)


def finish_compaction(spark: SparkSession, path: str) -> bool:
    """Carry out a noted compaction from wherever it stopped; whether there was one."""
    plan, store = _file(spark, f"{path}/{MARKERS}/{PLAN}")
    if not store.exists(plan):
        return False
    target, whole, *parts = [r.value for r in spark.read.option("pathGlobFilter", PLAN).text(f"{path}/{MARKERS}/{PLAN}").collect()]
    for part in parts:
        remove_folder(spark, part)
    ready, _ = _file(spark, whole)
    if store.exists(ready):
        store.rename(ready, _file(spark, target)[0])
    store.delete(plan, False)
    return True
