"""URL filters: rules, and trust spread over the graph of hosts.

Rules name hosts with a path prefix; the longest that fits a url decides. For
all other urls the host decides: trust spreads from hosts of allowed urls
along links (personalised PageRank), distrust from hosts of blocked urls against
them, so hosts that link to blocked ones are distrusted. Hosts also
stand with their parent domains, as if they linked to each other. A host is
blocked where distrust has more than THRESHOLD of the sum of both. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.tables import stored
from riskmart.sources import remove_folder, working_folder

#: (verdict, host, path prefix); fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Rounds between two written tables.
WRITE_EVERY = 4
#: The masses stand once this part of each, at most, still moves in WRITE_EVERY rounds and no new host is reached.
#: What has not arrived then is less than TOLERANCE / (1 - DAMPING ** WRITE_EVERY).
TOLERANCE = 1e-3
THRESHOLD = 0.5
#: Links of a page to hosts by name; relative links stay on the page's host.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:https?:)?//[^\s"'<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else NULL."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Shortest first, so that the longest is the outermost condition.
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        here = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fit = F.when(here, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def host_edges(pages: DataFrame) -> DataFrame:
    """(a, b, weight): links between different hosts, and between a host and its parent domain (weight 1)."""
    links = pages.select(host_of(F.col("url")).alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    named = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    linked = links.select("a", host_of(named).alias("b")).where("a <> '' and b <> '' and a <> b")
    linked = linked.groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(host_of(F.col("url")).alias("a")).where("a <> ''").distinct()
    hosts = hosts.union(linked.select("b")).distinct()
    # Every domain above a host that still has a dot, as a chain.
    chain = F.expr("transform(filter(sequence(1, size(split(a, '[.]')) - 1), i -> i > 1), i -> substring_index(a, '.', -i))")
    steps = F.expr("transform(sequence(1, size(c) - 1), i -> named_struct('x', c[i - 1], 'y', c[i]))")
    chained = hosts.select(F.array_append(chain, F.col("a")).alias("c")).where("size(c) > 1").select(F.explode(steps).alias("s"))
    family = chained.select("s.x", "s.y").distinct()
    family = family.select(F.col("x").alias("a"), F.col("y").alias("b")).union(family.select("y", "x"))
    both = linked.unionByName(family.withColumn("weight", F.lit(1.0)))
    return both.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(side, host, mass): personalised PageRank per side over (side, a, b, weight) from (side, host, mass).

    A side's masses add up to 1 or less. Rounds go on until the masses stand: each host
    that links reach has its share, however many links away it is.
    """
    spark = edges.sparkSession
    totals = {r.side: r.total for r in seeds.groupBy("side").agg(F.sum("mass").alias("total")).collect()}  # two sides
    if not totals:
        return seeds.select("side", "host", F.lit(0.0).alias("mass")).limit(0)
    out = edges.groupBy("side", "a").agg(F.sum("weight").alias("total"))
    share = stored(edges.join(out, ["side", "a"]).select("side", "a", "b", (F.col("weight") / F.col("total")).alias("share")), "host-shares")
    part = F.element_at(F.create_map(*[x for side, total in totals.items() for x in (F.lit(side), F.lit(float(total)))]), F.col("side"))
    start = stored(seeds.select("side", "host", (F.col("mass") / part).alias("mass")), "host-seeds")
    base = start.select("side", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    rank, held = start, None
    while True:
        before, old = rank, held
        for _ in range(WRITE_EVERY):
            named = rank.withColumnRenamed("host", "a")
            moved = share.join(named, ["side", "a"]).select("side", F.col("b").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
            rank = moved.unionByName(base).groupBy("side", "host").agg(F.sum("mass").alias("mass"))
        held = working_folder(spark, "host-rank")
        rank.write.parquet(held)
        rank = spark.read.schema(start.schema).parquet(held)
        both = rank.join(before.withColumnRenamed("mass", "was"), ["side", "host"], "full")
        moved, new = both.agg(
            F.sum(F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))), F.count_if(F.col("was").isNull() & (F.col("mass") > 0))
        ).first()
        if old is not None:
            remove_folder(spark, old)
        if moved < tolerance and not new:
            return rank


def judged_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per row of `pages` (page_id, url, html).

    Without a rule the host's masses decide; a host that neither reaches, and a
    url without a host, is allowed. NULL urls have empty host and path, NULL html has no links. Extra
    columns are ignored, repeated rows stay and count as often. An empty table gives no rows.
    """
    fit = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = stored(named.withColumn("fit", fit).select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled")), "urls")
    edges = stored(host_edges(pages.select("url", "html")), "host-edges")
    seeds = named.where("host <> '' and ruled is not null").groupBy("host", "ruled").agg(F.count("*").cast("double").alias("mass"))
    seeds = stored(seeds, "host-ruled")
    sides = edges.select(F.lit("allow").alias("side"), "a", "b", "weight").unionByName(
        edges.select(F.lit("block").alias("side"), F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    )
    found = spread(sides, seeds.withColumnRenamed("ruled", "side"))
    trust = found.where("side = 'allow'").select("host", F.col("mass").alias("trust"))
    distrust = found.where("side = 'block'").select("host", F.col("mass").alias("distrust"))
    masses = stored(trust.join(distrust, "host", "full"), "host-masses").na.fill(0.0, ["trust", "distrust"])
    joined = named.join(masses, "host", "left").na.fill(0.0, ["trust", "distrust"])
    blocked = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
