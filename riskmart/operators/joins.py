"""Left joins that stay spread out when keys hold much of the right side.

The runtime planner splits a hot key of the left side by itself, but never the
right side of a left join. So the right side's rows are counted per key. A key of very many rows gets as
many buckets as its rows need: its right rows are dealt out over them and its left rows
repeated once per bucket. All other rows have one bucket, and one left join serves all.

A row's bucket follows from the row itself: a hash of all its columns, and a number
among equal rows, which are counted first. A task that runs again on rows in
another order deals them out as before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Right rows of one key in one bucket.
BUCKET_ROWS = 100_000
#: Keys that are dealt out at most, those of the most rows. No other key holds more than this share's inverse of the rows.
HOT_KEYS = 65_536


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = BUCKET_ROWS) -> DataFrame:
    """(keys..., __buckets) of the complete keys with more than `rows` rows, HOT_KEYS at most."""
    complete = reduce(and_, [F.col(f"`{k}`").isNotNull() for k in keys])
    counted = df.where(complete).groupBy(*[f"`{k}`" for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    hottest = counted.where(F.col("__n") > rows).orderBy(F.col("__n").desc(), *keys).limit(HOT_KEYS)
    return hottest.withColumn("__buckets", F.ceil(F.col("__n") / rows)).drop("__n")


def dealt(right: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of hot keys with their __bucket; equal rows are counted, then numbered."""
    columns = [F.col(f"`{c}`") for c in right.columns]
    counted = right.join(F.broadcast(hot), list(keys)).groupBy(*columns, "__buckets").agg(F.count(F.lit(1)).alias("__copies"))
    each = counted.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__copies") - 1)))
    own = F.pmod(F.xxhash64(*columns), F.col("__buckets"))
    bucket = F.pmod(own + F.col("__copy"), F.col("__buckets"))
    return each.select(*columns, bucket.alias("__bucket"))


def spread_left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int = BUCKET_ROWS
) -> DataFrame:
    """left ⟕ right on equal key columns, about `rows` right rows of a hot key together.

    A left row is repeated once per `rows` matches, so the repeated rows are a small part of
    the result whatever the left side holds. `left` and `right` may be any
    frames; columns of types that have no order (maps) can't be dealt out. Both are read in one go
    but for the counts; without a hot key the steps for them fall away at run time. A
    bucket that gets no row of its key gives no row.
    """
    keys = list(keys)
    hot = hot_keys(right, keys, rows)
    first = F.lit(0).cast("bigint")
    cold = right.join(F.broadcast(hot.drop("__buckets")), keys, "left_anti").select(*[F.col(f"`{c}`") for c in right.columns], first.alias("__bucket"))
    buckets = cold.unionByName(dealt(right, hot, keys)).withColumn("__hit", F.lit(True))
    every = F.explode(F.sequence(first, F.coalesce("__buckets", F.lit(1).cast("bigint")) - 1))
    repeated = left.join(F.broadcast(hot), keys, "left").withColumn("__bucket", every)
    joined = repeated.join(buckets, [*keys, "__bucket"], "left")
    matched = joined.where(F.col("__hit").isNotNull() | F.col("__buckets").isNull())
    names = [*left.columns, *[c for c in right.columns if c not in keys]]
    return matched.select(*[F.col(f"`{c}`") for c in names])
