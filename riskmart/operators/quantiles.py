"""Exact quantiles of many columns without sorting or collecting their values.

One aggregate gives row counts, ends and a KLL sketch of every column. The sketch
brackets each wanted rank by two values. A counting scan then counts,
per bracket, the values below it and those in each of a few thousand equal cells of it, or every
value of a small one, inside each task over whole batches. Rows are never unfolded or joined; what is
shuffled and what reaches the driver depends on the number of columns and
ranks only. Small brackets are settled by that one scan. Of a larger one the cell that holds the rank is
counted again, and so is the whole range where a sketch was wrong.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 4096
SMALL = 65536
SKETCH_SIZE = 4096
#: A sketched rank is off by more than this share of the rows only by bad luck, which costs another scan.
SKETCH_ERROR = 2.5 / SKETCH_SIZE**0.9
LARGEST = sys.float_info.max


@dataclass(frozen=True)
class Interval:
    """Values from low to high of a column, about `size` of them, and the zero-based ranks wanted there."""

    column: str
    low: float
    high: float
    size: int
    wanted: tuple[int, ...]


def cell_counts(df: DataFrame, intervals: Sequence[Interval]) -> DataFrame:
    """(interval, cell, n, cell_low, cell_high) of all intervals in one scan; cell -inf counts the values below.

    A task gives at most CELLS cells or the distinct values of a small interval.
    """
    cells, small = CELLS, SMALL
    columns = sorted({i.column for i in intervals})
    plan = [(columns.index(i.column), i.low, i.high, i.size <= small) for i in intervals]
    names = ["interval", "cell", "n", "cell_low", "cell_high"]

    def place(values: np.ndarray, low: float, high: float, single: bool) -> np.ndarray:
        width = high / 2 - low / 2  # halves: the distance of two finite numbers may be too large for a double
        if single or width == 0:
            return values
        return np.minimum(np.floor((values / 2 - low / 2) / width * cells), cells - 1.0)

    def merged(held: list[tuple]) -> tuple:
        cell, n, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(cell, kind="stable")
        cell, n, low, high = cell[order], n[order], low[order], high[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        if not len(first):
            return cell, n, low, high
        return cell[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = [0] * len(plan)
        found: list[list[tuple]] = [[] for _ in plan]
        for batch in batches:
            for c in range(len(columns)):
                values = batch.column(c).drop_null().to_numpy()
                values = np.sort(values[np.isfinite(values)]) + 0.0  # -0 is 0
                for i, (at, low, high, single) in enumerate(plan):
                    if at != c:
                        continue
                    first, last = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
                    below[i] += int(first)
                    inside = values[first:last]
                    if len(inside):
                        found[i].append((place(inside, low, high, single), np.ones(len(inside), np.int64), inside, inside))
                        if len(found[i]) > 8 or len(inside) > cells:
                            found[i] = [merged(found[i])]
        for i in range(len(plan)):
            cell, n, low, high = merged(found[i]) if found[i] else [np.zeros(0)] * 4
            nothing = np.array([np.nan])
            columns_out = [np.full(len(cell) + 1, i), np.append(-np.inf, cell), np.append(below[i], n).astype(np.int64), np.append(nothing, low), np.append(nothing, high)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns_out], names=names)

    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{k}") for k, c in enumerate(columns)])
    each = values.mapInArrow(count, "interval long, cell double, n long, cell_low double, cell_high double")
    return each.groupBy("interval", "cell").agg(F.sum("n").alias("n"), F.min("cell_low").alias("cell_low"), F.max("cell_high").alias("cell_high"))


def order_statistics(df: DataFrame, intervals: Sequence[Interval], whole: dict[str, Interval]) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks per column; `whole` has each column's full range for ranks that an interval misses."""
    found: dict[tuple[str, int], float] = {}
    pending = list(intervals)
    while pending:
        # At most CELLS cells or the values of a small interval, so no window group grows with the data.
        order = Window.partitionBy("interval").orderBy("cell")
        wanted = [(i, r) for i, x in enumerate(pending) for r in x.wanted]
        ranks = F.broadcast(df.sparkSession.createDataFrame(wanted, "interval long, rank long"))
        hits = (
            cell_counts(df, pending)
            .withColumn("upto", F.sum("n").over(order))
            .join(ranks, "interval")
            .where("cell > double('-inf') and rank < upto and rank >= upto - n")
            .collect()
        )
        missing = set(wanted)
        following: dict[tuple, list[int]] = {}
        for hit in hits:
            interval = pending[hit["interval"]]
            missing.discard((hit["interval"], hit["rank"]))
            if hit["cell_low"] == hit["cell_high"]:
                found[interval.column, hit["rank"]] = hit["cell_low"]
            else:
                following.setdefault((interval.column, hit["cell_low"], hit["cell_high"], hit["n"]), []).append(hit["rank"])
        for i, rank in missing:
            if pending[i] == whole[pending[i].column] or rank in whole[pending[i].column].wanted:
                raise ArithmeticError(f"rank {rank} of {pending[i].column} is not there")
            all_of = whole[pending[i].column]
            following.setdefault((all_of.column, all_of.low, all_of.high, all_of.size), []).append(rank)
        before = {(x.column, x.low, x.high) for x in pending}
        pending = [Interval(*place, tuple(sorted(r))) for place, r in following.items()]
        stuck = before & {(x.column, x.low, x.high) for x in pending if x.low != x.high}
        if stuck:
            raise ArithmeticError(f"no progress in {sorted(stuck)}")
    return found


def _between(low: float, high: float, share: float) -> float:
    """Interpolate from the nearer end, so that either end is met exactly.

    Between numbers that are infinitely far apart the nearer end stands.
    """
    if low == high or share == 0:
        return low
    if math.isinf(low) or math.isinf(high):
        return low if share < 0.5 else high
    if math.isinf(high - low):
        return low * (1 - share) + high * share
    if share < 0.5:
        return low + (high - low) * share
    return high - (high - low) * (1 - share)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column; None for a column without values.

    NULL and NaN are left out.
    """
    columns = list(columns)
    if not columns:
        return {}
    clean = df.select(
        *[
            F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c)
            for c in columns
        ]
    )
    # Infinite values are counted and left out: they have no place in cells of equal width.
    finite = [F.when(F.abs(F.col(f"`{c}`")) < math.inf, F.col(f"`{c}`")) for c in columns]
    counted = clean.select(
        *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)], *[f.alias(f"f{i}") for i, f in enumerate(finite)]
    ).agg(
        *[
            f(F.col(f"{of}{i}")).alias(f"{tag}{i}")
            for i in range(len(columns))
            for tag, of, f in (
                ("n", "v", F.count),
                ("less", "v", lambda v: F.count_if(v == -math.inf)),
                ("more", "v", lambda v: F.count_if(v == math.inf)),
                ("m", "f", F.count),
                ("lo", "f", F.min),
                ("hi", "f", F.max),
                ("sketch", "v", lambda v: F.kll_sketch_agg_double(F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST)), F.lit(SKETCH_SIZE))),
            )
        ]
    )

    share = SKETCH_ERROR + 1 / SMALL  # and a rank of a large column more
    shares = [min(max(p + side * share, 0.0), 1.0) for side in (-1, 1) for p in probabilities]
    asked_shares = f"array({', '.join(f'double({x!r})' for x in shares)})"
    numbers = [f"{tag}{i}" for i in range(len(columns)) for tag in ("n", "less", "more", "m", "lo", "hi")]
    sketched = [f"if(n{i} > {SMALL}, kll_sketch_get_quantile_double(sketch{i}, {asked_shares}), null) as at{i}" for i in range(len(columns))]
    row = counted.selectExpr(*numbers, *sketched).first()
    counts = {c: (row[f"n{i}"], row[f"less{i}"], row[f"more{i}"]) for i, c in enumerate(columns)}
    positions = {c: [p * (n - 1) for p in probabilities] for c, (n, _, _) in counts.items() if n}
    intervals: dict[tuple, set[int]] = {}
    whole = {}
    for i, c in enumerate(columns):
        m = row[f"m{i}"]
        if not m:
            continue
        low, high = row[f"lo{i}"] + 0.0, row[f"hi{i}"] + 0.0
        whole[c] = Interval(c, low, high, m, ())
        ends = [(k, r) for k, x in enumerate(positions[c]) for r in {math.floor(x), math.ceil(x)}]
        for k, end in ends:
            rank, a, b, size = end - counts[c][1], low, high, m
            if not 0 <= rank < m:
                continue
            if m > SMALL:
                at = row[f"at{i}"]
                a, b = max(low, at[k] + 0.0), min(high, at[len(probabilities) + k] + 0.0)
                size = min(m, math.ceil(4 * abs(SKETCH_ERROR) * counts[c][0]) + 1)
                a, b, size = (a, b, size) if a <= b else (low, high, m)
            intervals.setdefault((c, a, b, size), set()).add(rank)
    asked = [Interval(*place, tuple(sorted(ranks))) for place, ranks in intervals.items()]
    among_finite = order_statistics(clean, asked, whole)

    def value_at(c: str, rank: int) -> float:
        n, less, more = counts[c]
        if rank < less:
            return -math.inf
        return math.inf if rank >= n - more else among_finite[(c, rank - less)]

    result: dict[str, list[float] | None] = {}
    for c in columns:
        if c not in positions:
            result[c] = None
            continue
        result[c] = []
        for x in positions[c]:
            low, high = value_at(c, math.floor(x)), value_at(c, math.ceil(x))
            result[c].append(_between(low, high, x - math.floor(x)))
    return result
