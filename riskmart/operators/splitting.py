"""Training windows, deterministic stratified splits and folds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmart.functions import add_months_py
from riskmart.operators.joins import spread_left_join
from riskmart.sources.schemas import CUSTOMER, LABEL, LOAN, SNAPSHOT

# The usual training set-up.
TRAIN_MONTHS = 12
OOT_MONTHS = 1
TRAIN_SHARE = 0.8

HEX_DIGITS = 4


@dataclass(frozen=True)
class TrainingWindows:
    """Closed date ranges: twelve months to fit on, then the latest months held out."""

    train_date: dt.date
    train_test_start: dt.date
    train_test_end: dt.date
    oot_start: dt.date
    oot_end: dt.date


def training_windows(
    train_date: dt.date, oot_months: int = OOT_MONTHS, train_months: int = TRAIN_MONTHS
) -> TrainingWindows:
    day = dt.timedelta(days=1)
    oot_start = add_months_py(train_date, -oot_months)
    return TrainingWindows(
        train_date=train_date,
        train_test_start=add_months_py(oot_start, -train_months),
        train_test_end=oot_start - day,
        oot_start=oot_start,
        oot_end=train_date - day,
    )


def window_of(windows: TrainingWindows, day: Column) -> Column:
    """'train_test', 'oot' or NULL for dates outside both."""
    return F.when(
        day.between(F.lit(windows.train_test_start), F.lit(windows.train_test_end)),
        F.lit("train_test"),
    ).when(day.between(F.lit(windows.oot_start), F.lit(windows.oot_end)), F.lit("oot"))


def shuffle_key(keys: Sequence[str], seed: int) -> Column:
    """A hash of the row's keys: the order of a seeded shuffle that never changes."""
    text = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", *text, F.lit(str(seed))).cast("binary"))


def _stratum(label: str) -> Column:
    """The binary class as the stratum: two groups, whatever the table holds."""
    return F.coalesce(F.col(label) == 1, F.lit(False))


def _digits(start: int) -> Column:
    return F.substring("k", start, HEX_DIGITS)


def _narrow(counted: DataFrame, group: str, carry: Sequence[str] = ()) -> DataFrame:
    """Keep the digit group that holds the wanted rank and the rank left inside it."""
    order = Window.partitionBy("y", "part").orderBy(group)
    return (
        counted.withColumn("upto", F.sum("n").over(order))
        .withColumn("before", F.col("upto") - F.col("n"))
        .where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto")))
        .select("y", "part", *carry, group, (F.col("rank") - F.col("before")).alias("rank"))
    )


def hash_cuts(df: DataFrame, label: str, order: Column, shares: Sequence[float]) -> DataFrame:
    """(y, part, cut): per class the largest shuffle key whose rank is within each share.

    The key's hex digits are looked at four at a time: count rows per digit
    group (at most 65,536 groups per class), then look again only at the group
    that holds the wanted rank. Rows are never sorted or moved, equal keys are
    counted together, and what is broadcast has one row per class and share.
    """
    count = F.count(F.lit(1)).alias("n")
    keyed = df.select(_stratum(label).alias("y"), order.alias("k"))
    parts = F.array(
        *[
            F.struct(F.lit(i).alias("part"), F.lit(float(s)).alias("share"))
            for i, s in enumerate(shares)
        ]
    )
    first = (
        keyed.groupBy("y", _digits(1).alias("g1"))
        .agg(count)
        .withColumn("total", F.sum("n").over(Window.partitionBy("y")))
        .select("y", "g1", "n", "total", F.inline(parts))
        .withColumn("rank", F.round(F.col("share") * F.col("total")).cast("bigint"))
    )
    at_first = _narrow(first, "g1")
    second = (
        keyed.withColumn("g1", _digits(1))
        .join(F.broadcast(at_first), ["y", "g1"])
        .groupBy("y", "part", "rank", "g1", _digits(1 + HEX_DIGITS).alias("g2"))
        .agg(count)
    )
    at_second = _narrow(second, "g2", ["g1"])
    order_in_group = Window.partitionBy("y", "part").orderBy("k")
    return (
        keyed.withColumns({"g1": _digits(1), "g2": _digits(1 + HEX_DIGITS)})
        .join(F.broadcast(at_second), ["y", "g1", "g2"])
        .groupBy("y", "part", "rank", "k")
        .agg(count)
        .withColumn("before", F.sum("n").over(order_in_group) - F.col("n"))
        .where(F.col("rank") > F.col("before"))
        .groupBy("y", "part")
        .agg(F.max("k").alias("cut"))
    )


def assign_parts(
    df: DataFrame, label: str, keys: Sequence[str], shares: Sequence[float], seed: int, name: str
) -> DataFrame:
    """Number every row's part: part i holds the class's rows up to share i, in shuffle order.

    `keys` should identify a row; rows with equal keys always land in the same part.
    """
    order = shuffle_key(keys, seed)
    cuts = hash_cuts(df, label, order, shares)
    wide = cuts.groupBy(F.col("y").alias("__class")).agg(
        *[
            F.max(F.when(F.col("part") == i, F.col("cut"))).alias(f"__cut{i}")
            for i in range(len(shares))
        ]
    )
    part = F.lit(len(shares))
    for i in reversed(range(len(shares))):
        part = F.when(F.col("__order") <= F.col(f"__cut{i}"), F.lit(i)).otherwise(part)
    return (
        df.withColumns({"__class": _stratum(label), "__order": order})
        .join(F.broadcast(wide), "__class", "left")
        .select(*[f"`{c}`" for c in df.columns], part.alias(name))
    )


def stratified_split(
    df: DataFrame,
    keys: Sequence[str] = (LOAN, CUSTOMER, SNAPSHOT),
    label: str = LABEL,
    train_share: float = TRAIN_SHARE,
    seed: int = 42,
) -> DataFrame:
    """Add `split` ('train' or 'val'): the same exact share of each class, seeded and repeatable."""
    parts = assign_parts(df, label, keys, [train_share], seed, "_part")
    named = F.when(F.col("_part") == 0, F.lit("train")).otherwise(F.lit("val"))
    return parts.withColumn("split", named).drop("_part")


def stratified_folds(
    df: DataFrame,
    folds: int = 3,
    keys: Sequence[str] = (LOAN, CUSTOMER, SNAPSHOT),
    label: str = LABEL,
    seed: int = 43,
    name: str = "fold",
) -> DataFrame:
    """Add a fold number of equal size within each class."""
    return assign_parts(df, label, keys, [i / folds for i in range(1, folds)], seed, name)


def training_set(labels: DataFrame, features: DataFrame, complete_only: bool = True) -> DataFrame:
    """Labels with their features; by default only rows without any missing value.

    The key columns come once. A feature column that repeats a label column
    (the loan id) is taken from the labels.
    """
    keys = [CUSTOMER, SNAPSHOT]
    extra = [c for c in features.columns if c in keys or c not in labels.columns]
    right = features.select(*[f"`{c}`" for c in extra])
    if complete_only:
        return labels.join(right, keys, "inner").na.drop("any")
    # A left join never splits its right side: feature rows of a repeated key are dealt out.
    return spread_left_join(labels, right, keys)


def split_training_set(
    df: DataFrame,
    windows: TrainingWindows,
    keys: Sequence[str] = (LOAN, CUSTOMER, SNAPSHOT),
    train_share: float = TRAIN_SHARE,
    seed: int = 42,
) -> DataFrame:
    """Add `split`: train / val inside the fitting window, oot for the held-out months."""
    placed = df.withColumn("_window", window_of(windows, F.col(SNAPSHOT))).where(
        F.col("_window").isNotNull()
    )
    fitting = placed.where(F.col("_window") == "train_test").drop("_window")
    held_out = placed.where(F.col("_window") == "oot").drop("_window")
    return stratified_split(fitting, keys, train_share=train_share, seed=seed).unionByName(
        held_out.withColumn("split", F.lit("oot"))
    )
