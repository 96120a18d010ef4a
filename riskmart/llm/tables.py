"""Steps written to the shared folder, and connected components over links."""

from __future__ import annotations

import math
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.sources import remove_folder, working_folder

_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and lost executors cost nothing.

    `compact` shuffles once more for few files; for a small result of very many tasks.
    """
    path = working_folder(df.sparkSession, name)
    (df.hint("rebalance") if compact else df).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more: what was made of them is stored itself."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path is not None:
            remove_folder(table.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ceil_div(a: int, b: int) -> int:
    return max(1, math.ceil(a / b))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    `links` has columns a and b of one type. Two alternating star steps, as
    known for MapReduce: neighbours larger than a node are hung under the
    node's smallest neighbour, then each node and its smaller neighbours under
    the smallest of these. Stars stay stars, so a node with very many
    neighbours costs a partial aggregate and a join that the skew join may
    split; no neighbour list is ever gathered. The number of rounds grows with the
    logarithm of the longest path. Each round is a written table.
    """
    edges = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        below = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(below, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(below.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = stored(small, "links")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """`found`, as components() gives it, with more links (a, b) taken in.

    Links are lifted to the components of their ends, so only components that
    merge are walked again, however many nodes they have; ends that `found` does not have
    are components of their own. The result is a written table.
    """
    ends = links.select("a", "b")
    for end in ("a", "b"):
        known = found.select(F.col("node").alias(end), "component")
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    merged = components(ends)
    above = merged.select(F.col("node").alias("component"), F.col("component").alias("least"))
    nodes = found.unionByName(merged.select("node", F.col("node").alias("component"))).distinct()
    joined = nodes.join(above, "component", "left")
    return stored(joined.select("node", F.coalesce("least", "component").alias("component")), "components")
