"""Standard scaling fitted on one set of rows and applied to any other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a constant column keeps deviation 1."""

    mean: Mapping[str, float]
    deviation: Mapping[str, float]


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """One global aggregate; the result is two numbers per column."""
    measured = [
        f(F.col(f"`{c}`").cast("double")).alias(f"{tag}{i}")
        for i, c in enumerate(columns)
        for tag, f in (("m", F.avg), ("s", F.stddev_pop))
    ]
    row = df.agg(*measured).first()
    return Scaler(
        {c: row[f"m{i}"] for i, c in enumerate(columns)},
        {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)},
    )


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Scale in place; NULL stays NULL, a column without a fitted mean becomes NULL."""
    return df.withColumns(
        {
            c: (F.col(f"`{c}`").cast("double") - F.lit(mean).cast("double"))
            / F.lit(float(scaler.deviation[c]))
            for c, mean in scaler.mean.items()
        }
    )
