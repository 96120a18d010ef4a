"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source gets target / source size copies on average: a whole
part that every document gets, and a fraction. Fractions are rounded in pairs: mass (words)
moves from one document to the other, in a random direction, until one of the
two is out or whole. The direction is drawn so that every expected number of copies stays; the words of
the pair stay exactly. What is left of a pair is one fraction, so a bin of
pairs leaves one, and bins of such residuals leave one again: a reduction tree of
bounded bins whose depth is logarithmic in the source's documents.

The last fraction of a tree must become 0 or 1 by itself, which misses the
target by part of one document. So a source's large documents are rounded first,
and what they miss is spread over the smaller ones in proportion, which
keeps expectations again. Only part of one of its smallest documents is missed in the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.tables import stored
from riskmart.llm.words import GAP

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents or residuals that one bin of the tree holds on average.
BIN = 32
SEED = 20_240_917
#: Documents are rounded by size, in multiples of their source's mean: from the first edge up, then from the next one, and so on.
CLASS_EDGES = (16.0, 4.0, 1.0, 0.125)

_STATE = "struct<k:bigint,s:bigint,p:double,done:array<struct<k:bigint,one:boolean>>>"


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.size(F.filter(F.split(text, GAP), lambda w: w != "")), F.lit(0)).cast("long")


def row_key() -> Column:
    """A fingerprint of document, source and text; equal rows share it."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", "text")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, rows, target) from (source, size, m): one row per source.

    Weights go to the sources by code point, NULL last, and repeat. Shares that
    exceed `repeats` times their source are cut there and the excess goes to
    the others by weight; the level at which that ends is found by one pass
    over the sources ordered by the level at which each is full.
    """
    per = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("rows")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * repeats
    whole = Window.partitionBy()
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    )
    return (
        per.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole))
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "rows", "target")
    )


def _uniform(*parts: Column) -> Column:
    """A draw from [0, 1) that only depends on its parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11).cast("double") / float(1 << 53)


def _transfer(state: Column, new: Column) -> Column:
    """One step: mass moves between the residual and the next document until one of them is whole."""
    i_room, i_mass = state.s * (1 - state.p), state.s * state.p
    j_room, j_mass = new.s * (1 - new.p), new.s * new.p
    to_i, to_j = F.least(i_room, j_mass), F.least(i_mass, j_room)

    def result(residual: Column, p: Column, whole: Column, one: bool) -> Column:
        kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        ended = F.array(F.struct(whole.k.alias("k"), F.lit(one).alias("one")))
        return F.struct(residual.k.alias("k"), residual.s.alias("s"), kept.alias("p"), F.concat(state.done, ended).alias("done")).cast(_STATE)

    gain = F.when(i_room <= j_mass, result(new, new.p - i_room / new.s, state, True)).otherwise(
        result(state, state.p + j_mass / state.s, new, False)
    )
    loss = F.when(i_mass <= j_room, result(new, new.p + i_mass / new.s, state, False)).otherwise(
        result(state, state.p - j_room / state.s, new, True)
    )
    first = F.struct(new.k.alias("k"), new.s.alias("s"), new.p.alias("p"), state.done.alias("done")).cast(_STATE)
    up = _uniform(state.k, new.k) * (to_i + to_j) < to_j
    return F.when(state.k.isNull(), first).when(up, gain).otherwise(loss)


def pivotal(items: DataFrame) -> DataFrame:
    """(source, k, one) for items (source, k, s > 0, 0 < p < 1): which fractions became one.

    k is unique within a source. Every level is a written table.
    """
    counted = items.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
    most = counted.agg(F.max("n")).first()[0]
    here = items.join(counted, F.col("source").eqNullSafe(F.col("of"))).select("source", "k", "s", "p", "n")
    decided, level = [], 0
    empty = F.lit(None).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("s"), F.lit(0.0).alias("p")
    nothing = F.struct(*empty, F.array().cast("array<struct<k:bigint,one:boolean>>").alias("done")).cast(_STATE)
    while most:
        bins = F.ceil(F.col("n") / BIN).cast("long")
        place = F.pmod(F.xxhash64("k", F.lit(level)), bins)
        grouped = here.withColumn("bin", place).withColumn("bins", bins).groupBy("source", "bin", "bins")
        # A bin holds BIN rows on average and is dealt by a hash: its list is bounded.
        listed = grouped.agg(F.sort_array(F.collect_list(F.struct(_uniform("k").alias("u"), "k", "s", "p"))).alias("rows"))
        done = stored(listed.select("source", "bins", F.aggregate("rows", nothing, _transfer).alias("r")), f"mix-level-{level}")
        decided.append(done.select("source", F.explode("r.done").alias("d")).select("source", "d.k", "d.one"))
        here = done.select("source", "r.k", "r.s", "r.p", F.col("bins").alias("n"))
        most, level = (0 if most <= BIN else math.ceil(most / BIN)), level + 1
        decided.append(here.where("n = 1").select("source", "k", (_uniform("k") < F.col("p")).alias("one")))
        here = here.where("n > 1")
    if not decided:
        return items.select("source", "k", F.lit(False).alias("one")).limit(0)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per distinct (doc_id, source, text): what the mix takes of it.

    Columns row_key, doc_id, source, size, m (rows that are equal in the three),
    source_size, target, each (copies that every such row gets) and more (of
    the m rows, how many get one copy on top). Text NULL has size 0. NULL is a
    source of its own, the last. A source of size 0 takes nothing. An empty table gives no rows.
    """
    measured = documents.select(row_key().alias("row_key"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = stored(
        measured.groupBy("row_key", "source").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count("*").alias("m")),
        "mix-sizes",
    )
    goal = stored(targets(sized, weights, repeats), "mix-targets")
    joined = sized.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    mean = F.col("source_size") / F.col("rows")
    size_class = F.lit(len(CLASS_EDGES))
    for step, edge in reversed(list(enumerate(CLASS_EDGES))):
        size_class = F.when(F.col("size") >= edge * mean, step).otherwise(size_class)
    shared = stored(joined.withColumn("step", size_class), "mix-shares")
    weighed = stored(
        shared.groupBy(F.col("source").alias("of"), "step").agg(F.sum(F.col("size") * F.col("m")).alias("mass"), F.first("target").alias("target")),
        "mix-masses",
    )
    # What a source still has to give, and the copies a document gets if all that is left gives alike.
    plan = weighed.groupBy("of").agg(F.first("target").alias("owed"), F.sum("mass").alias("left"))
    done = None
    for step in range(len(CLASS_EDGES) + 1):
        ratio = F.when(F.col("left") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(repeats)), F.col("owed") / F.col("left")))).otherwise(0.0)
        here = (
            shared.where(F.col("step") == step)
            .join(plan.select("of", ratio.alias("ratio")), F.col("source").eqNullSafe(F.col("of")))
            .withColumn("each", F.floor(F.col("ratio") + 1e-12).cast("long"))
            .withColumn("all", F.greatest(F.lit(0.0), F.col("ratio") - F.col("each")) * F.col("m"))
            .withColumn("full", F.floor(F.col("all") + 1e-9).cast("long"))
            .withColumn("p", F.greatest(F.lit(0.0), F.col("all") - F.col("full")))
        )
        fractions = here.where("size > 0 and p > 1e-9").select("source", F.col("row_key").alias("k"), F.col("size").alias("s"), "p")
        ones = pivotal(fractions).where("one").select(F.col("source").alias("_source"), F.col("k").alias("_k"), F.lit(1).alias("one"))
        same = (F.col("row_key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_source"))
        decided = here.join(ones, same, "left").withColumn("more", F.col("full") + F.coalesce("one", F.lit(0)))
        decided = stored(
            decided.select("row_key", "doc_id", "source", "size", "m", "source_size", "target", "each", "more"), f"mix-class-{step}"
        )
        done = decided if done is None else done.unionByName(decided)
        if step < len(CLASS_EDGES):
            words = F.col("size") * (F.col("m") * F.col("each") + F.col("more"))
            got = decided.groupBy(F.col("source").alias("_of")).agg(F.sum(words).alias("got"), F.sum(F.col("size") * F.col("m")).alias("gone"))
            last = plan.join(got, F.col("of").eqNullSafe(F.col("_of")), "left")
            owed = F.col("owed") - F.coalesce("got", F.lit(0))
            plan = stored(last.select("of", owed.alias("owed"), (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left")), "mix-plan")
    return done


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix with their columns, each as often as it is taken.

    Of rows equal in doc_id, source and text one stands for all.
    """
    taken = mix(documents, weights, repeats).select("row_key", (F.col("m") * F.col("each") + F.col("more")).alias("_copies"))
    keyed = documents.withColumn("row_key", row_key())
    once = keyed.join(taken.where("_copies > 0"), "row_key").dropDuplicates(["row_key"])
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        *[F.col(f"`{c}`") for c in documents.columns]
    )
