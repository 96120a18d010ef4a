"""Backfill of what changed: a ledger of input files tells which months have to be built again.

The ledger has one row per source, file and month in it, with the file's size and time. A run lists
the files, reads the months of new and changed ones only, and builds the months they hold or held. It is
written when the tables stand: a run that broke off is done again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators.silver import parse_snapshot
from riskmart.plans import mart as jobs
from riskmart.plans.layout import Mart
from riskmart.sources import overwrite_table, read_raw, read_table, remove_folder, table_exists, working_folder
from riskmart.sources.schemas import SNAPSHOT

FILE = ["source", "file", "path", "size", "time"]
LEDGER_SCHEMA = (
    "source string, file string, path string, size long, time timestamp, month date, "
    "settings string, built_from date, built_to date"
)


def listed(spark: SparkSession, raw: Mapping[str, str]) -> DataFrame:
    """FILE of all input files; nothing but their names, sizes and times is read."""
    found = [
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.lit(name).alias("source"),
            F.col("_metadata.file_path").alias("file"),
            "path",
            F.col("length").alias("size"),
            F.col("modificationTime").alias("time"),
        )
        for name, path in raw.items()
    ]
    return reduce(DataFrame.unionByName, found)


def _paths(files: DataFrame, name: str) -> list[str]:
    rows = files.where(F.col("source") == name).select("path").distinct().collect()
    return sorted(r["path"] for r in rows)


def _with_months(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Adds the months in each file, read from these files alone; NULL for none and for tables without months."""
    found = []
    for name, source in jobs.SOURCES.items():
        paths = _paths(files, name) if source.split else []
        if paths:
            rows = parse_snapshot(read_raw(spark, paths, source.schema).withColumn("file", F.col("_metadata.file_path")))
            months = rows.where(F.trunc(SNAPSHOT, "MM") == F.col(SNAPSHOT)).select("file", F.col(SNAPSHOT).alias("month"))
            found.append(months.distinct().withColumn("source", F.lit(name)))
    if not found:
        return files.withColumn("month", F.lit(None).cast("date"))
    return files.join(reduce(DataFrame.unionByName, found), ["source", "file"], "left")


def runs_of(months: Iterable[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """Neighbouring months as closed ranges."""
    found: list[list[dt.date]] = []
    for month in sorted(set(months)):
        if found and (found[-1][1] + dt.timedelta(days=31)).replace(day=1) == month:
            found[-1][1] = month
        else:
            found.append([month, month])
    return [(a, b) for a, b in found]


def backfill_changed(
    spark: SparkSession,
    mart: Mart,
    raw: Mapping[str, str],
    start: dt.date,
    end: dt.date,
    dpd: int = 30,
    mob: int = 6,
) -> list[dt.date]:
    """As mart.backfill, but only months whose input changed; the months that were built.

    A month is built when a file that holds or held rows of it is new, changed or gone, when the
    ledger's range did not have it, or with another label definition. A changed customer table
    changes the feature store of all months. Input files must keep their names' meaning: a file of the
    same name, size and time counts as the same. Only months and paths reach the driver.
    """
    settings, first = f"{dpd}:{mob}", start.replace(day=1)
    before = spark.createDataFrame([], LEDGER_SCHEMA)
    if table_exists(spark, mart.ledger):
        before = read_table(spark, mart.ledger)
    old = before.where((F.col("settings") == settings) & F.col("source").isin(*raw))
    folder = working_folder(spark, "ledger")
    listed(spark, raw).write.parquet(f"{folder}/now")
    now = read_table(spark, f"{folder}/now")
    fresh = now.join(old.select(*FILE).distinct(), FILE, "left_anti")
    same, gone = old.join(now, FILE, "left_semi"), old.join(now, FILE, "left_anti")
    built = F.col("month").between(F.col("built_from"), F.col("built_to"))
    marks = [F.lit(settings).alias("settings"), F.lit(first).alias("built_from"), F.lit(end).alias("built_to")]
    _with_months(spark, fresh).select(*FILE, "month").write.parquet(f"{folder}/fresh")
    fresh = read_table(spark, f"{folder}/fresh")
    wanted = F.coalesce(F.col("month").between(F.lit(first), F.lit(end)), F.lit(True))
    # What went from other months is still to be done when a run covers these.
    ahead = gone.where(~wanted).select(*before.columns)
    marked = same.select(*FILE, "month").unionByName(fresh).select("*", *marks)
    marked.unionByName(ahead).write.parquet(f"{folder}/ledger")
    ledger = read_table(spark, f"{folder}/ledger")

    touched = [fresh.select("source", "month"), gone.select("source", "month"), same.where(~built).select("source", "month")]
    changed: dict[str, set] = {}
    for row in reduce(DataFrame.unionByName, touched).where(wanted).distinct().collect():
        changed.setdefault(row["source"], set()).add(row["month"])
    inside = {name: found - {None} for name, found in changed.items()}

    for name, source in jobs.SOURCES.items():
        if name not in changed:
            continue
        if not source.split:
            jobs.build_bronze(spark, mart, {name: raw[name]}, first, end)
            jobs.build_silver(spark, mart, first, end, (name,))
            continue
        for low, high in runs_of(inside[name]):
            paths = _paths(ledger.where(F.col("month").between(F.lit(low), F.lit(high))), name)
            rows = read_raw(spark, paths, source.schema) if paths else spark.createDataFrame([], source.schema)
            jobs.bronze_split(rows, mart.bronze(name), low, high)
            jobs.build_silver(spark, mart, low, high, (name,))
            if name == "lms_loan_daily":
                jobs.build_labels(spark, mart, low, high, dpd, mob)
    months = set().union(*inside.values()) if inside else set()
    if any(not jobs.SOURCES[name].split for name in changed):
        months |= {r["month"] for r in ledger.select("month").distinct().collect() if r["month"] and first <= r["month"] <= end}
    for low, high in runs_of(months):
        jobs.build_feature_store(spark, mart, low, high, mob)
    if changed or not fresh.isEmpty():
        others = before.where(~F.col("source").isin(*raw))
        others.unionByName(ledger).write.parquet(f"{folder}/whole")
        overwrite_table(read_table(spark, f"{folder}/whole").coalesce(1), mart.ledger)
    remove_folder(spark, folder)
    return sorted(months)
