"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Patterns find what looks like a secret by its surroundings. The method finds
what looks like one by itself: over every long run of key characters a window
slides, and the Shannon entropy of its characters is kept up by the counts of
the one that enters and the one that leaves. A run is a secret if some window
exceeds the threshold of the run's character class and no allow-list pattern
suppresses it. DataFrame and SQL functions only; nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns and lengths of the base kinds, in the order in which spans of one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
# Runs are maximal, so a least length may stand in the pattern itself.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Candidate strings: runs of key characters of the window's length or more.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Bits per character that some window must have, by the narrowest class that holds the run.
CLASSES = (("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9), ("alnum", "^[A-Za-z0-9]+$", 3.6), ("base64", ".", 3.8))
#: A run needs digits and letters; runs of words and path-like runs are no keys.
NEEDED = ("[0-9]", "[A-Za-z]")
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx",
    r"(?i)0123456789|abcdefgh|12345678",
    r"([A-Za-z0-9])\1{5}",
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{0,4}$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)

_SPAN = "struct<start:int,rank:int,kind:string,end:int>"
_RUN = "struct<start:int,end:int,value:string>"
#: Steps of a walk that share one growing list; lists of finished blocks are not copied again.
BLOCK = 512


def _walk(items: Column, zero: Column, kind: str, step) -> Column:
    """What `step(state, item)` gives for all items in order, as an array of `kind`.

    step returns (next state, array of results). Results are gathered block by block, so the work
    is in proportion to the items, however many a text has.
    """
    none = F.array().cast(f"array<{kind}>")

    def blocks(held: Column) -> Column:
        last = F.floor((F.size(held) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(held, b * BLOCK + 1, BLOCK))

    def inside(state: Column, item: Column) -> Column:
        after, found = step(state["at"], item)
        return F.struct(after.alias("at"), F.concat(state["out"], found).alias("out"))

    def outside(state: Column, block: Column) -> Column:
        one = F.aggregate(block, F.struct(state["at"].alias("at"), none.alias("out")), inside)
        given = F.transform(F.array(one), lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))
        return given[0]

    start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    # Named once: what a lambda's body mentions is worked out again at each of its steps.
    walked = F.transform(F.array(items), lambda held: F.aggregate(blocks(held), start, outside, lambda s: F.flatten(s["out"])))
    return walked[0]


def _matches(pattern: str, group: int, kind: str, make) -> Column:
    """make(start, end, value) for all matches of the pattern in column t, in code points.

    Texts between matches come from a split by the same pattern, so positions
    are running sums of lengths. Texts without a match are not split.
    """
    whole = F.regexp_extract_all(F.col("t"), F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(F.col("t"), F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(F.col("t"), pattern, -1)
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("hit"), values.alias("value"))

    def step(at: Column, part: Column) -> tuple[Column, Column]:
        first = at + F.length(part["gap"])
        last = first + F.length(part["hit"])
        return last, make(first, last, part["value"])

    return F.when(F.size(whole) > 0, _walk(parts, F.lit(0), kind, step)).otherwise(F.array().cast(f"array<{kind}>"))


def _spans(kind: str, rank: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the pattern's matches whose group is long enough."""
    none = F.array().cast(f"array<{_SPAN}>")

    def make(start: Column, end: Column, value: Column) -> Column:
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.when(F.length(value) >= least, F.array(span)).otherwise(none)

    return _matches(pattern, group, _SPAN, make)


def _runs() -> Column:
    """Candidate strings with their places."""
    return _matches(CANDIDATE, 0, _RUN, lambda start, end, value: F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value"))))


def _uncovered(runs: str, base: str) -> Column:
    """The runs that no span of `base` holds: of the spans that begin no later, none ends as late."""
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("run"), b["end"].alias("end"), F.lit("").alias("value")))
    found = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(1).alias("run"), r["end"].alias("end"), r["value"].alias("value")))

    def step(reach: Column, item: Column) -> tuple[Column, Column]:
        run = F.struct(item["start"].alias("start"), item["end"].alias("end"), item["value"].alias("value"))
        kept = (item["run"] == 1) & (item["end"] > reach)
        return F.when(item["run"] == 0, F.greatest(reach, item["end"])).otherwise(reach), F.when(kept, F.array(run)).otherwise(F.array().cast(f"array<{_RUN}>"))

    walked = _walk(F.array_sort(F.concat(spans, found)), F.lit(-1), _RUN, step)
    return F.when(F.size(runs) == 0, F.col(runs)).when(F.size(base) == 0, F.col(runs)).otherwise(walked)


def peak_entropy(value: str, window: int = WINDOW) -> str:
    """SQL for the highest Shannon entropy (bits a character) of any window of an ASCII string.

    With c the count of each character in the window, the entropy is
    log2(w) - sum(c * log2(c)) / w. The counts stand in one byte per character; each step takes
    away the character that leaves, or adds the one that enters, in its byte and in the sum.
    """
    zero, slots = 32, 128
    term = lambda c: c * math.log2(c) if c > 1 else 0.0
    grown = f"array({', '.join(f'{term(c + 1) - term(c)!r}D' for c in range(window + 1))})"
    bytes_ = f"cast({value} as binary)"
    byte = lambda text, at: f"ascii(cast(substring({text}, {at}, 1) as string))"
    # Step 2i takes away what leaves before the (i + 1)-th character, step 2i + 1 adds that one.
    place = f"if(e % 2 = 0, e div 2 + 1 - {window}, e div 2 + 1)"
    event = f"named_struct('p', {byte('v.b', 'e.p')} + 1, 'd', e.d)"
    count = f"({byte('a.k', 'x.p')} - {zero})"
    put = f"overlay(a.k placing cast(char({zero} + x.n + x.d) as binary) from x.p)"
    after = f"a.s + if(x.d = 1, {grown}[x.n], -{grown}[x.n - 1])"
    counted = f"aggregate(array(named_struct('p', c.p, 'd', c.d, 'n', {count.replace('x.p', 'c.p')})), a, (a, x) -> named_struct('k', {put}, 's', {after}, 'i', a.i + if(x.d = 1, 1, 0), 'best', a.best))"
    settled = f"named_struct('k', y.k, 's', y.s, 'i', y.i, 'best', if(c.d = 1 and y.i >= {window}, greatest(y.best, {math.log2(window)!r}D - y.s / {window}), y.best))"
    step = f"aggregate(array({event}), a, (a, c) -> aggregate(array({counted}), a, (z, y) -> {settled}))"
    begin = f"named_struct('k', cast(repeat(' ', {slots}) as binary), 's', 0D, 'i', 0, 'best', 0D)"
    moved = f"if(e.p < 1, a, {step})"
    named = f"aggregate(array(named_struct('p', {place}, 'd', if(e % 2 = 0, -1, 1))), a, (a, e) -> {moved})"
    walk = f"aggregate(sequence(0, 2 * octet_length(v.b) - 1), {begin}, (a, e) -> {named}, a -> a.best)"
    return f"if({value} = '', 0D, aggregate(array(named_struct('b', {bytes_})), 0D, (q, v) -> {walk}))"


def secret_spans(documents: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """`documents` with columns base and spans, arrays of (start, rank, kind, end) in code points.

    base has the spans of the fixed patterns by start, then kind; spans has
    those of kind `entropy` as well, in the same order. An entropy span inside a
    base span is not listed again. NULL counts as the empty text, which has no
    spans. All other columns, NULLs and repeated rows stay as they are; columns named base or spans are replaced.
    """
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("base", "spans")]
    base = F.concat(
        _spans("assign", 0, ASSIGN, 2, ASSIGN_LENGTH),
        _spans("access", 1, ACCESS),
        _spans("hex", 2, HEX),
    )
    rows = documents.select(F.struct(*kept).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("base", F.array_sort(base)).withColumn("runs", _runs()).drop("t")
    needed = " and ".join(f"r.value rlike '{p}'" for p in NEEDED)
    rule = "|".join(f"(?:{pattern})" for pattern in allowed)
    limit = "case " + " ".join(f"when r.value rlike '{pattern}' then {bits}D" for _, pattern, bits in CLASSES) + " end"
    some = lambda kept: F.when(F.size("runs") > 0, kept).otherwise(F.col("runs"))
    rows = rows.withColumn("runs", some(F.expr(f"filter(runs, r -> {needed})")))
    rows = rows.withColumn("runs", _uncovered("runs", "base"))
    rows = rows.withColumn("runs", some(F.filter("runs", lambda r: ~r["value"].rlike(rule))))
    rows = rows.withColumn("runs", some(F.expr(f"filter(runs, r -> {peak_entropy('r.value')} >= {limit})")))
    strong = F.expr("transform(runs, r -> named_struct('start', r.start, 'rank', 3, 'kind', 'entropy', 'end', r.end))")
    return rows.select("row.*", "base", F.array_sort(F.concat("base", strong)).alias("spans"))


def listing(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
