"""Which values of a set stand in another set as well, in packed blocks.

The incidence of sets and 64-bit values is dealt into blocks by value. A row of
the exchange is not one value but one piece of a block: packed arrays that
numpy reads in place. A piece covers many sets; a value that several of them
have goes out once, as a bare mark. So a value that very many sets share
costs one entry per piece, and no block depends on one value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.tables import ceil_div
from riskmart.llm.words import U64, release

#: Entries in a block on average; blocks at least, so that little data is spread, too.
BLOCK_ENTRIES = 8_000_000
MIN_BLOCKS = 64


def blocks_for(entries: int) -> int:
    return max(MIN_BLOCKS, ceil_div(entries, BLOCK_ENTRIES))


def _pack(home: tuple, many: np.ndarray, once: np.ndarray, key: np.ndarray, per_key: np.ndarray) -> bytes:
    head = np.array([len(home[0]), len(many), len(once), len(key)], np.int64)
    parts = [head, *home, key, per_key.astype(np.uint32), many, once]
    return b"".join(p.tobytes() for p in parts)


def _unpack(raw: bytes) -> list[np.ndarray]:
    at = 32
    homes, many, once, keys = np.frombuffer(raw, np.int64, 4).tolist()
    out = []
    kinds = ((np.uint64, homes), (np.int64, homes), (np.int64, homes), (np.uint64, keys), (np.uint32, keys), (np.uint32, many), (np.uint32, once))
    for kind, count in kinds:
        out.append(np.frombuffer(raw, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return out


def pack_pieces(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: int) -> pa.RecordBatch:
    """One packed row per block from (values, values per set, name of each set); a set's values are distinct."""
    values, counts, keys = (np.concatenate(x) for x in zip(*held, strict=True))
    keys, first = np.unique(keys, return_index=True)
    begin = np.cumsum(counts) - counts
    counts, begin = counts[first], begin[first]
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    values = values[np.repeat(begin, counts) + inside]
    owner = np.repeat(np.arange(len(keys)), counts)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    times = np.diff(np.append(np.flatnonzero(new), len(values)))
    shared = np.repeat(times > 1, times)
    local = np.bincount(owner[shared], minlength=len(keys)).astype(np.int64)
    many, once, once_owner = values[new & shared], values[~shared], owner[~shared]
    spread = U64(blocks)
    block_of = lambda v: ((v >> U64(32)) * spread) >> U64(32)
    edges = np.arange(blocks + 1)
    many_at, once_at = np.searchsorted(block_of(many), edges), np.searchsorted(block_of(once), edges)
    home_at = np.searchsorted(block_of(keys), edges)
    numbers, packed = [], []
    for b in range(blocks):
        h = slice(home_at[b], home_at[b + 1])
        m = many[many_at[b] : many_at[b + 1]].astype(np.uint32)
        o, who = once[once_at[b] : once_at[b + 1]].astype(np.uint32), once_owner[once_at[b] : once_at[b + 1]]
        if not (h.stop > h.start or len(m) or len(o)):
            continue
        by = np.argsort(who, kind="stable")
        sets, per = np.unique(who, return_counts=True)
        numbers.append(b)
        packed.append(_pack((keys[h], counts[h].astype(np.int64), local[h]), m, o[by], keys[sets], per))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], names=["block", "packed"])


def _resolve(table: pa.Table) -> pa.Table:
    """For one block: the size of the sets at home there, and per set the values that others have, too."""
    got = [_unpack(raw) for raw in table.column("packed").to_pylist()]
    home_key, home_n, home_shared, key, per_key, many, once = (np.concatenate(x) for x in zip(*got, strict=True))
    owner = np.repeat(key, per_key)
    # A value is shared if two different sets have it; one set in several pieces is no partner of itself.
    order = np.argsort(once, kind="stable")
    value, holder = once[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    opens = np.flatnonzero(new)
    other = holder != np.repeat(holder[opens], np.diff(np.append(opens, len(value))))
    marked = np.union1d(np.unique(value[other]), many)
    hit = np.zeros(len(once), bool)
    if len(marked):
        hit = marked[np.minimum(np.searchsorted(marked, once), len(marked) - 1)] == once
    keys, shared = np.unique(owner[hit], return_counts=True)
    release()
    return pa.table(
        {
            "c": np.concatenate([home_key, keys]).view(np.int64),
            "n": np.concatenate([home_n, np.zeros(len(keys), np.int64)]),
            "shared": np.concatenate([home_shared, shared.astype(np.int64)]),
        }
    )


def shared_counts(packed: DataFrame) -> DataFrame:
    """(c, n, shared) from packed pieces: size of each set and how many of its values another set has.

    A set found in k pieces counts k times in both. Within a block values are told apart by 32 bits, so
    `shared` may be too large by one in a thousand, never too small.
    """
    told = packed.groupBy("block").applyInArrow(_resolve, "c long, n long, shared long")
    return told.groupBy("c").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared"))
