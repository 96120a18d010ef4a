"""Pairs of sets that reach a Jaccard similarity, by prefixes of columns in order of rarity.

Sets are rows (c, n, grams): a name, a size and an array of distinct 64-bit
values. Two sets that reach the similarity share one of their first
`n - ceil(similarity * n) + 1` values in any common order; with rare values
first, hardly any others do. A value's position also bounds what can still follow, and so the size of a
partner. No pair is lost. Pairs within a component add nothing to it and are not formed:
see leader_pairs and open_pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(h, c, n, pos, reach): the shared values among each set's first ones, and the largest partner beyond."""
    entries = sets.select("c", "n", F.explode("grams").alias("h"))
    often = entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    by_set = Window.partitionBy("c")
    return (
        entries.join(often, "h")
        .withColumn("rank", F.row_number().over(by_set.orderBy("df", "h")))
        .withColumn("shared", F.count("*").over(by_set))
        # Values that no other set has come first.
        .withColumn("pos", F.expr("n - shared + rank - 1"))
        .where(F.expr(f"pos <= n - ceil({percent} * n / 100.0D)"))
        # With its first `pos` values gone, the set only reaches partners up to this size.
        .withColumn("reach", F.expr(f"(n - pos) * {100 + percent} div {percent} - n"))
        .select("h", "c", "n", "pos", "reach")
    )


def exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity, by their whole sets."""
    left = sets.select(F.col("c").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("c").alias("b"), F.col("grams").alias("gb"))
    return (
        pairs.select("a", "b")
        .join(right, "b")
        .join(left, "a")
        .withColumn("both", F.size(F.array_intersect("ga", "gb")).cast("long"))
        .where(F.expr(f"100 * both >= {percent} * (size(ga) + size(gb) - both)"))
        .select("a", "b")
    )


def _sized(percent: int) -> str:
    """May a set (n, reach) and another one (n2, reach2) that meet in a value be similar, by their sizes?"""
    return f"100 * least(n, n2) >= {percent} * greatest(n, n2) and n2 <= reach and n <= reach2"


def leader_pairs(meeting: DataFrame, salt: int, percent: int, every: bool = False) -> DataFrame:
    """Candidates in other components: for each set the leader it meets most often, or `every` leader it meets.

    `meeting` is (h, c, n, pos, reach, component). Leaders are first the sets with
    the fewest values of their own, then random ones. A group of n near copies gives at most n pairs, or
    as many as the sets have h.
    """
    order = F.xxhash64("c", F.lit(salt)) if salt else F.col("pos").cast("long")
    lead = meeting.groupBy("h").agg(F.min(F.struct(order.alias("order"), "c", "n", "reach", "component")).alias("l"))
    lead = lead.select("h", F.col("l.c").alias("a"), F.col("l.n").alias("n2"), F.col("l.reach").alias("reach2"), F.col("l.component").alias("k2"))
    near = meeting.join(lead, "h").where(F.expr(f"component <> k2 and {_sized(percent)}"))
    votes = near.groupBy("c", "a").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("n2").alias("n2"))
    if every:
        return votes.select("a", F.col("c").alias("b"))
    # The leader met most often is the most similar one.
    best = votes.groupBy("c").agg(F.max(F.struct("met", -F.abs(F.col("n") - F.col("n2")), "a")).alias("m"))
    return best.select(F.col("m.a").alias("a"), F.col("c").alias("b"))


def open_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs in different components whose accumulated overlap can still reach the bound."""
    sizes = prefix.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"))
    left = prefix.join(sizes.where("lo <> hi"), "h").where("least <= reach").select("h", "c", "n", "pos", "reach", "component")
    right = left.select("h", *[F.col(c).alias(f"{c}2") for c in ("c", "n", "pos", "reach", "component")])
    met = left.join(right, "h").where(F.expr(f"c < c2 and component <> component2 and {_sized(percent)}"))
    counted = met.groupBy("c", "c2", "n", "n2").agg(F.count("*").alias("overlap"), F.max("pos").alias("p"), F.max("pos2").alias("p2"))
    most = "overlap + least(n - p - 1, n2 - p2 - 1)"
    return counted.where(F.expr(f"{100 + percent} * ({most}) >= {percent} * (n + n2)")).select(F.col("c").alias("a"), F.col("c2").alias("b"))


def labelled(meeting: DataFrame, found: DataFrame) -> DataFrame:
    """`meeting` with the components found so far; a set without a link is its own."""
    known = found.select(F.col("node").alias("c"), "component")
    joined = meeting.drop("component").join(known, "c", "left")
    return joined.withColumn("component", F.coalesce("component", "c"))
