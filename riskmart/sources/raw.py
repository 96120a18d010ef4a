"""Raw CSV sources: header, every column as text, no inference pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_raw(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Scan CSV files by column name. The text in the file decides what the rules see.

    Only the first header line is read ahead. Files of one source must agree in
    their columns; one that does not stops the job instead of mixing columns up.
    """
    header = spark.read.option("header", True).csv(path).schema
    missing = [name for name in schema.names if name not in header.names]
    if missing:
        raise ValueError(f"{path}: columns missing: {missing}")
    return (
        spark.read.schema(header)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
        .select(*[f"`{name}`" for name in schema.names])
    )
