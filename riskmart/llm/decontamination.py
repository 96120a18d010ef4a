"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

A window of a document has as many words as a benchmark item. It can only be
similar to the item if the two share shingles, so windows are laid where a
shared shingle puts the item's first word, and, for an item whose parts stand in another order,
wherever a window holds enough of its shingles. Windows and
items get 64-bit SimHashes. Fingerprints are cut into RADIUS + 1 blocks: two that differ in
at most RADIUS bits agree in a whole block, so equal blocks give all
fingerprints within the radius. Candidates are verified by their bags of
shingles, a shingle weighing as often as it occurs: the sum of the smaller
weights has to reach PERCENT of the sum of the larger ones.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.tables import stored
from riskmart.llm.words import GAP

GRAM = 5
PERCENT = 80
#: Similarity 0.8 turns about 10 of 64 bits, 3 more or less; the radius is four deviations beyond.
RADIUS = 21
#: The shingles of the benchmark are broadcast up to this many rows (of 24 bytes), joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def grams_of(size: int, words: str = "w") -> Column:
    """Hashes of all runs of `size` words of an array column, in order."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(
        f"if(size({words}) >= {size}, transform(sequence(0, size({words}) - {size}), i -> xxhash64({parts})), "
        "cast(array() as array<bigint>))"
    )


def row_key() -> Column:
    """A fingerprint of doc_id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def _bag(short: list[int]) -> Column:
    """The shingles of an item: its GRAM-word runs, or its whole sequence if that is shorter."""
    bag = F.when(F.size("w") >= GRAM, grams_of(GRAM))
    for size in short:
        bag = bag.when(F.size("w") == size, grams_of(size))
    return bag


def benchmark_items(benchmark: DataFrame) -> tuple[DataFrame, list[int], int]:
    """(item_id, n_words, bag) of the items with words; lengths below GRAM that occur; number of shingles."""
    split = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    sizes = split.agg(F.collect_set(F.when(F.size("w") < GRAM, F.size("w"))), F.sum(F.size("w"))).first()
    short = sorted(sizes[0])  # four values at most
    items = split.select("item_id", F.size("w").alias("n_words"), _bag(short).alias("bag"))
    return items.withColumn("fp", simhash("bag")), short, sizes[1] or 0


def simhash(bag: str) -> Column:
    """Bit b is set if most shingle hashes of the bag have it set."""
    ones = f"aggregate({bag}, 0, (n, h) -> n + int(shiftright(h, b) & 1))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({bag}), shiftleft(1L, b), 0L))")


def blocks_of(fp: str) -> Column:
    """(number, bits) of the RADIUS + 1 blocks of a fingerprint."""
    count = RADIUS + 1
    edges = [64 * i // count for i in range(count + 1)]
    parts = [
        f"named_struct('no', {i}, 'bits', shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)"
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return F.explode(F.expr(f"array({', '.join(parts)})"))


def reordered(keyed: DataFrame, items: DataFrame, percent: int, shingles: int) -> DataFrame:
    """(row_key, start, n_words): all item-sized windows with enough shingles of one item, in whatever order.

    Similarity needs percent of the item's shingles. How many stand in a window changes by
    one where a shared shingle comes in or leaves, so the starts between two changes are counted once.
    """
    shared = items.where(F.col("n_words") >= GRAM).select("item_id", "n_words", F.size("bag").alias("m"), F.explode(F.array_distinct("bag")).alias("h"))
    if shingles <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    runs = keyed.select("row_key", F.posexplode(grams_of(GRAM)).alias("pos", "h"))
    key = ["row_key", "item_id", "n_words", "m"]
    held = runs.join(shared, "h").groupBy(*key).agg(F.collect_list("pos").alias("at")).where(F.expr(f"100 * size(at) >= {percent} * m"))
    step = f"explode(array(named_struct('start', pos - n_words + {GRAM}, 'd', 1), named_struct('start', pos + 1, 'd', -1))) as e"
    steps = held.select(*key, F.explode("at").alias("pos")).selectExpr(*key, step).groupBy(*key, "e.start").agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*key).orderBy("start")
    counted = steps.withColumn("count", F.sum("d").over(order)).withColumn("next", F.lead("start").over(order))
    enough = counted.where(F.expr(f"100 * count >= {percent} * m"))
    return enough.select("row_key", F.explode(F.expr("sequence(start, next - 1)")).alias("start"), "n_words")


def windows(documents: DataFrame, items: DataFrame, short: list[int], shingles: int, percent: int = PERCENT) -> DataFrame:
    """(row_key, doc_id, start, n_words, aligned, bag, fp): item-sized windows around shared shingles.

    A window is cut at the ends of its document.
    """
    keyed = documents.select(row_key().alias("row_key"), "doc_id", words_of(F.col("text")).alias("w"))
    anchors = items.select("n_words", F.posexplode("bag").alias("offset", "h")).distinct()
    if shingles <= BROADCAST_ROWS:
        anchors = F.broadcast(anchors)
    met = None
    for size in [GRAM, *short]:
        runs = keyed.select("row_key", F.posexplode(grams_of(size)).alias("pos", "h"))
        same = F.col("n_words") >= GRAM if size == GRAM else F.col("n_words") == size
        hits = runs.join(anchors.where(same), "h").select("row_key", (F.col("pos") - F.col("offset")).alias("start"), "n_words")
        met = hits if met is None else met.unionByName(hits)
    met = met.withColumn("aligned", F.lit(True)).unionByName(reordered(keyed, items, percent, shingles).withColumn("aligned", F.lit(False)))
    # Bounded by one document's words and the items' lengths.
    places = met.groupBy("row_key").agg(F.collect_set(F.struct("start", "n_words", "aligned")).alias("places"))
    inside = keyed.join(places, "row_key").select("row_key", "doc_id", "places", "w", grams_of(GRAM).alias("g"))
    first, last = "greatest(p.start, 0)", "least(p.start + p.n_words, size(w))"
    bag = f"when p.n_words >= {GRAM} and {last} - {first} >= {GRAM} then slice(g, {first} + 1, {last} - {first} - {GRAM - 1})"
    for size in short:
        run = ", ".join(f"w[{first} + {k}]" for k in range(size))
        bag += f" when p.n_words = {size} and {last} - {first} = {size} then array(xxhash64({run}))"
    cut = f"transform(places, p -> named_struct('start', {first}, 'n_words', p.n_words, 'aligned', p.aligned, 'bag', case {bag} end))"
    each = inside.select("row_key", "doc_id", F.explode(F.expr(cut)).alias("p")).select("row_key", "doc_id", "p.*")
    return each.where("bag is not null").withColumn("fp", simhash("bag"))


def within_radius(fingerprints: DataFrame, items: DataFrame) -> DataFrame:
    """All (n_words, fp, item_id) whose fingerprints differ in at most RADIUS bits, by multi-index blocks."""
    left = fingerprints.select("n_words", "fp", blocks_of("fp").alias("k")).select("n_words", "fp", "k.*")
    right = items.select("item_id", "n_words", F.col("fp").alias("ifp"), blocks_of("fp").alias("k")).select("item_id", "n_words", "ifp", "k.*")
    near = left.join(right, ["n_words", "no", "bits"]).where(F.expr(f"bit_count(fp ^ ifp) <= {RADIUS}"))
    return near.select("n_words", "fp", "item_id", F.expr("int(bit_count(fp ^ ifp))").alias("distance")).distinct()


def _overlap(a: str, b: str) -> Column:
    plain = f"size(array_intersect({a}, {b}))"
    bags = f"aggregate(array_distinct({a}), 0, (s, h) -> s + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))"
    sets = f"size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b})"
    return F.expr(f"case when {sets} then {plain} else {bags} end")


def contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document and benchmark item found in it, with the best window.

    `documents` has doc_id and text, `benchmark` item_id and text; both are
    lower-cased and split at ASCII white space, other columns are ignored. Columns: row_key,
    doc_id, item_id, start (first word of the window), n_words, distance
    (bits), similarity. NULL and empty texts contain nothing and are contained
    nowhere. Windows in which a shared shingle has its place of the item go before others; of equally similar windows the first counts. Items of fewer than five
    words are looked for as a whole. Rows that repeat doc_id and text give one
    result, NULL doc_ids are searched too. Empty tables give no rows.
    """
    items, short, shingles = benchmark_items(benchmark)
    items = stored(items, "benchmark-items", compact=True)
    laid = stored(windows(documents, items, short, shingles, percent), "windows", compact=True)
    near = within_radius(laid.select("n_words", "fp").distinct(), items)
    pairs = laid.join(near, ["n_words", "fp"]).join(items.select("item_id", F.col("bag").alias("ibag")), "item_id")
    scored = pairs.withColumn("both", _overlap("bag", "ibag")).withColumn("all", F.expr("size(bag) + size(ibag) - both"))
    found = scored.where(F.expr(f"100 * both >= {percent} * all")).withColumn("similarity", F.col("both") / F.col("all"))
    best = F.max(F.struct("aligned", "similarity", (-F.col("start")).alias("back"), (-F.col("distance")).alias("near"), "n_words")).alias("b")
    return found.groupBy("row_key", "doc_id", "item_id").agg(best).select(
        "row_key",
        "doc_id",
        "item_id",
        (-F.col("b.back")).alias("start"),
        "b.n_words",
        (-F.col("b.near")).alias("distance"),
        "b.similarity",
    )


def without_benchmark(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents in which no benchmark item is found."""
    bad = contaminated(documents, benchmark, percent).select(F.col("row_key").alias("_row_key")).distinct()
    return documents.withColumn("_row_key", row_key()).join(bad, "_row_key", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
