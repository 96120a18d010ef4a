"""Table inspection in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """(column, data_type, n_rows, n_null) for every column, from one aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)],
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("n_rows"),
            (F.col("n_rows") - F.col(f"c{i}")).alias("n_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def preview(df: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """The first n rows in a stated order (a top-n, no full sort)."""
    return df.orderBy(*order).limit(n)
