"""Parquet tables, either whole (dimensions) or partitioned by snapshot (facts)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.sources.schemas import SNAPSHOT


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """All files of a table whose width changed over time; missing columns are NULL."""
    return spark.read.option("mergeSchema", True).parquet(path)


def read_snapshot(spark: SparkSession, path: str, day: dt.date) -> DataFrame:
    """One snapshot; only its own folder is opened."""
    return read_range(spark, path, day, day)


def read_range(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    """All snapshots of a closed date range.

    For a table whose first partition column is the snapshot the range's folders are opened by
    name, so that the files of no other snapshot are listed. A range without a folder
    gives no rows, with the table's columns.
    """
    inside = F.col(SNAPSHOT).between(F.lit(start), F.lit(end))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = f"{SNAPSHOT}="
    names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
    days = [n for n in names if n.startswith(mark)]
    wanted = [n for n in days if f"{start:%Y-%m-%d}" <= n.removeprefix(mark) <= f"{end:%Y-%m-%d}"]
    if not days or len(wanted) == len(days):
        return read_table(spark, path).where(inside)
    opened = wanted or days[:1]
    found = spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in sorted(opened)])
    return found.where(inside)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read there."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def overwrite_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _partitions(
    spark: SparkSession, path: str, by: Sequence[str], inside: Mapping[str, tuple]
) -> dict[str, frozenset[str]]:
    """Partition folders whose values lie in the closed ranges, with their file names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return {}
    folders = [root]
    for column in by:
        low, high = (str(x) for x in inside.get(column, ("", "\uffff")))
        below = [s.getPath() for f in folders for s in store.listStatus(f) if s.isDirectory()]
        folders = [
            p
            for p in below
            if p.getName().startswith(f"{column}=")
            and low <= unquote(p.getName().split("=", 1)[1]) <= high
        ]
    return {
        str(f.toString()): frozenset(s.getPath().getName() for s in store.listStatus(f))
        for f in folders
    }


def folders_of(spark: SparkSession, path: str, by: Sequence[str], inside: Mapping[str, tuple]) -> list[str]:
    """The partition folders whose values lie in the closed ranges."""
    return sorted(_partitions(spark, path, by, inside))


def _remove(spark: SparkSession, folders: Sequence[str]) -> None:
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def overwrite_snapshots(
    df: DataFrame,
    path: str,
    by: Sequence[str] = (SNAPSHOT,),
    compact: bool = True,
    replaced: Mapping[str, tuple] | None = None,
) -> None:
    """Replace the partitions that occur in df, and all others that `replaced` covers.

    `replaced` maps partition columns to closed ranges (texts, or dates, which
    compare like their texts); a column that is not named is covered whole. Partitions in these
    ranges without a row in df are removed after the write, so a month that became empty
    keeps no old rows. Without `replaced` they stay. Only the names of the range's
    files are listed. A run that ends between write and removal is made good by the next one.

    `compact` asks for a rebalance on the partition columns: few files per
    partition, while a snapshot that holds much of the data is split over many
    tasks instead of being written by one.
    """
    spark = df.sparkSession
    before = {} if replaced is None else _partitions(spark, path, by, replaced)
    out = df.hint("rebalance", *[F.col(c) for c in by]) if compact else df
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*by)
        .parquet(path)
    )
    if before:
        after = _partitions(spark, path, by, replaced)
        # A partition that was written has other files now.
        _remove(spark, [f for f, names in before.items() if after.get(f) == names])
