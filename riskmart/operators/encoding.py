"""Category vocabularies, pinned once and expanded to 0/1 columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOCABULARY_SCHEMA = "feature string, idx int, category string"


def category_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count of every category of every column (NULL is no category)."""
    names = list(columns)
    return (
        df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
        .unpivot([], names, "feature", "category")
        .where(F.col("category").isNotNull())
        .groupBy("feature", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, idx, category): categories by frequency, ties by name, however many there are."""
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), "category")
    ranked = category_ranks(df, columns).withColumn("idx", F.row_number().over(order) - 1)
    return ranked.select("feature", "idx", "category")


def fit_vocabulary(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The vocabulary of features that become one column per category, one job for all.

    A table has few columns, so few categories reach the driver. A feature of very many
    goes by vocabulary_table and one_hot_sparse instead and stays in Spark.
    """
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in vocabulary_table(df, columns).orderBy("feature", "idx").collect():
        found[row["feature"]].append(row["category"])
    return found


def index_categories(df: DataFrame, column: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """Adds the category's place in the vocabulary table; NULL for NULL and unseen ones."""
    places = vocabulary.where(F.col("feature") == column).select(
        F.col("category").alias("_category"), F.col("idx").alias(name)
    )
    same = F.col(f"`{column}`").cast("string") == F.col("_category")
    return df.join(places, same, "left").drop("_category")


def one_hot_sparse(
    df: DataFrame, column: str, vocabulary: DataFrame, name: str | None = None
) -> DataFrame:
    """One-hot encoding as a sparse ML vector of the vocabulary's width; NULL and unseen are all zeros."""
    from pyspark.ml.feature import OneHotEncoder

    of_column = vocabulary.where(F.col("feature") == column).select(F.col("idx").cast("double").alias("_idx"))
    width = of_column.count()
    # A last place more for what is unseen, which the encoder leaves out again.
    fitted = OneHotEncoder(
        inputCols=["_idx"], outputCols=[name or f"{column}_ohe"], handleInvalid="keep", dropLast=True
    ).fit(of_column)
    indexed = index_categories(df, column, vocabulary, "_idx")
    known = F.coalesce(F.col("_idx").cast("double"), F.lit(float(width)))
    return fitted.transform(indexed.withColumn("_idx", known)).drop("_idx")


def vocabulary_frame(spark: SparkSession, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """The vocabulary as a table, so that later runs use the same columns."""
    rows = [(f, i, c) for f, names in vocabulary.items() for i, c in enumerate(names)]
    return spark.createDataFrame(rows, VOCABULARY_SCHEMA)


def read_vocabulary(frame: DataFrame) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for row in frame.orderBy("feature", "idx").collect():
        found.setdefault(row["feature"], []).append(row["category"])
    return found


def one_hot(
    df: DataFrame, vocabulary: Mapping[str, Sequence[str]], keep_source: bool = False
) -> DataFrame:
    """One double column `<column>_ohe_<i>` per category; NULL and unseen give all zeros."""
    flags = [
        F.when(F.col(f"`{c}`") == F.lit(name), F.lit(1.0)).otherwise(F.lit(0.0)).alias(
            f"{c}_ohe_{i}"
        )
        for c, names in vocabulary.items()
        for i, name in enumerate(names)
    ]
    kept = [f"`{c}`" for c in df.columns if keep_source or c not in vocabulary]
    return df.select(*kept, *flags)


def one_hot_vector(
    df: DataFrame, column: str, vocabulary: Sequence[str], name: str | None = None
) -> DataFrame:
    """The same encoding as one ML vector column."""
    from pyspark.ml.functions import array_to_vector

    flags = [
        F.when(F.col(f"`{column}`") == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
        for v in vocabulary
    ]
    return df.withColumn(name or f"{column}_ohe", array_to_vector(F.array(*flags)))


def expand_vector(df: DataFrame, column: str, width: int) -> DataFrame:
    """A vector column -> `<column>_<i>` scalar columns, the width known up front."""
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array(F.col(f"`{column}`"))
    return df.select(
        *[f"`{c}`" for c in df.columns if c != column],
        *[F.get(values, F.lit(i)).alias(f"{column}_{i}") for i in range(width)],
    )
