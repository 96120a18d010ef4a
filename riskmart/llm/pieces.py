"""Which values of a document other documents have, which document has them first, and how often they occur.

Documents come as pieces of about PIECE_VALUES values. A piece writes its distinct values,
dealt into blocks by value, and one home row that says where they stand.
A block settles its values over all pieces and answers each piece; a piece joins the
answers to its home row. A value goes out once per piece, however many of its
documents have it or how often one repeats it, so no block depends on a hot value. All rows are packed arrays; nothing is a
row per value. Pieces are a written table: a task that runs again finds the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskmart.llm.tables import ceil_div
from riskmart.llm.words import U64, release

PIECE_VALUES = 1_000_000
#: Distinct values of pieces in a block on average; blocks at least, so that little data is spread, too.
BLOCK_VALUES = 4_000_000
MIN_BLOCKS = 32

NAMES = ["block", "piece", "base", "packed", "ids", "keys"]


def piece_schema(kind: str) -> str:
    """Block rows (with block) and home rows (without); ids and keys are doc_ids and row_keys."""
    return f"block int, piece long, base long, packed binary, ids array<{kind}>, keys array<long>"


def blocks_for(values: int) -> int:
    return max(MIN_BLOCKS, ceil_div(values, BLOCK_VALUES))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed: small numbers take few bytes."""
    head = [np.array([len(arrays)], np.int64)]
    body = []
    for a in arrays:
        head.append(np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], np.int64))
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    raw = b"".join([*(h.tobytes() for h in head), *body])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    kinds = np.frombuffer(raw, np.int64, 3 * count, 8).reshape(count, 3).tolist()
    at, out = 8 + 24 * count, []
    for kind, width, length in kinds:
        planes = np.frombuffer(raw, np.uint8, width * length, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.dtype(f"{chr(kind)}{width}")))
        at += width * length
    return out


def _ordered(ids: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): documents by doc_id, NULL last, then row_key; equal row_keys have one number."""
    order = pc.sort_indices(
        pa.table({"i": ids, "k": keys}), sort_keys=[("i", "ascending"), ("k", "ascending")], null_placement="at_end"
    ).to_numpy()
    key = keys.to_numpy(zero_copy_only=False)[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, number


def _lists(values: pa.Array, counts: list[int]) -> pa.Array:
    bounds = pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, values)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _places(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for each i, counts[i] of them."""
    return np.repeat(first - _starts(counts), counts) + np.arange(int(counts.sum()))


def _piece(held: list[tuple], blocks: int, width: np.dtype, piece: int) -> pa.RecordBatch:
    ids, keys = (pa.concat_arrays(list(x)) for x in list(zip(*held, strict=True))[:2])
    counts, values, *rest = (np.concatenate(x) for x in list(zip(*held, strict=True))[2:])
    # Documents in order, rows that repeat one once.
    order, number = _ordered(ids, keys)
    order = order[np.append(True, np.diff(number[order]) > 0)]
    ids, keys = ids.take(pa.array(order)), keys.take(pa.array(order))
    at = _places(_starts(counts)[order], counts[order])
    counts, values, rest = counts[order], values[at], [x[at] for x in rest]
    owner = np.repeat(np.arange(len(counts)), counts)
    # Owners ascend, so a stable sort leaves the first document first within a value.
    by_value = np.argsort(values, kind="stable")
    value, who = values[by_value], owner[by_value]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    opens = np.flatnonzero(new)
    times = np.diff(np.append(opens, len(value)))
    first, several = who[opens], who[opens] != who[opens + times - 1]
    where = np.empty(len(value), np.uint32)
    where[by_value] = np.cumsum(new) - 1
    value = value[opens]
    edges = np.searchsorted(((value >> U64(32)) * U64(blocks)) >> U64(32), np.arange(blocks + 1))
    # Home: values per document, the number of each value, and what goes with it as differences.
    numbers, bases, packed = [None], [len(value)], [pack(counts, where, *(np.diff(x, prepend=0).astype(np.int64) for x in rest))]
    taken, sizes = [np.arange(len(counts))], [len(counts)]
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        used, local = np.unique(first[part], return_inverse=True)
        numbers.append(b)
        bases.append(edges[b])
        packed.append(pack(value[part].astype(width), local.astype(np.uint32), times[part], several[part].astype(np.uint8)))
        taken.append(used)
        sizes.append(len(used))
    docs = pa.array(np.concatenate(taken))
    columns = [
        pa.array(numbers, pa.int32()),
        pa.array(np.full(len(numbers), piece)),
        pa.array(bases, pa.int64()),
        pa.array(packed, pa.binary()),
        _lists(ids.take(docs), sizes),
        _lists(keys.take(docs), sizes),
    ]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


class Pieces:
    """Gathers documents of one task into pieces. `width` is the type in which values are told apart within a block."""

    def __init__(self, blocks: int, width: type = np.uint64):
        self.blocks, self.width = blocks, np.dtype(width)
        self.held, self.size, self.number = [], 0, 0

    def add(self, ids: pa.Array, keys: pa.Array, counts: np.ndarray, values: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Documents with their values in order and numbers that go with each value; gives pieces that are full."""
        some = np.flatnonzero(counts)
        if len(some):
            self.held.append((ids.take(pa.array(some)), keys.take(pa.array(some)), counts[some].astype(np.int64), values, *rest))
            self.size += len(values)
        if self.size >= PIECE_VALUES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            # One stage writes all pieces, so its tasks' numbers tell them apart.
            piece = (TaskContext.get().partitionId() << 32) | self.number
            yield _piece(self.held, self.blocks, self.width, piece)
            self.held, self.size, self.number = [], 0, self.number + 1


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _settle(table: pa.Table) -> pa.Table:
    """For one block: to each piece its shared values with their first document and number of occurrences."""
    got = [unpack(x) for x in table.column("packed").to_pylist()]
    lengths = np.array([len(g[0]) for g in got])
    value, local, times, several = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    ids, keys = _column(table, "ids"), _column(table, "keys")
    docs = pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, keys = ids.flatten(), keys.flatten()
    order, number = _ordered(ids, keys)
    numbered = np.empty(int(number.max()) + 1, np.int64)
    numbered[number[order][::-1]] = order[::-1]
    who = number[np.repeat(_starts(docs), lengths) + local]
    by_value = np.lexsort((who, value))
    new = np.ones(len(value), bool)
    new[1:] = value[by_value][1:] != value[by_value][:-1]
    opens = np.flatnonzero(new)
    sizes = np.diff(np.append(opens, len(value)))
    shared = (who[by_value][opens] != who[by_value][opens + sizes - 1]) | (np.maximum.reduceat(several[by_value], opens) > 0)
    group = np.empty(len(value), np.int64)
    group[by_value] = np.cumsum(new) - 1
    copies, head = np.add.reduceat(times[by_value], opens), who[by_value][opens]
    hit = shared[group]
    row = np.repeat(np.arange(len(lengths)), lengths)
    index = np.arange(len(value)) - np.repeat(_starts(lengths), lengths)
    base = table.column("base").to_numpy()
    pieces, packed, taken, counts = [], [], [], []
    for r, p in enumerate(table.column("piece").to_pylist()):
        part = slice(*np.searchsorted(row, [r, r + 1]))
        mine = hit[part]
        if not mine.any():
            continue
        of = group[part][mine]
        used, spot = np.unique(head[of], return_inverse=True)
        pieces.append(p)
        packed.append(pack(base[r] + index[part][mine], spot.astype(np.uint32), copies[of]))
        taken.append(numbered[used])
        counts.append(len(used))
    where = pa.array(np.concatenate(taken) if taken else np.zeros(0, np.int64))
    release()
    columns = [pa.array(pieces, pa.int64()), pa.array(packed, pa.binary()), _lists(ids.take(where), counts), _lists(keys.take(where), counts)]
    return pa.Table.from_arrays(columns, names=["piece", "packed", "ids", "keys"])


class Answered:
    """A piece with its answers: documents, and of every shared value its document, numbers, first document, occurrences."""

    def __init__(self, home: pa.Table, answers: pa.Table):
        counts, where, *rest = unpack(home.column("packed")[0].as_py())
        self.ids, self.keys = _column(home, "ids").flatten(), _column(home, "keys").flatten()
        got = [unpack(x) for x in answers.column("packed").to_pylist()]
        heads = _column(answers, "keys")
        docs = pc.list_value_length(heads).to_numpy(zero_copy_only=False).astype(np.int64)
        self.head_ids, self.head_keys = _column(answers, "ids").flatten(), heads.flatten()
        first = np.full(home.column("base")[0].as_py(), -1, np.int64)
        copies = np.zeros(len(first), np.int64)
        for start, (index, spot, times) in zip(_starts(docs), got, strict=True):
            first[index] = start + spot
            copies[index] = times
        self.at = np.flatnonzero(first[where] >= 0)
        self.owner = np.repeat(np.arange(len(counts)), counts)[self.at]
        #: Number of the value within its document.
        self.nth = self.at - _starts(counts)[self.owner]
        self.rest = [np.cumsum(x)[self.at] for x in rest]
        self.first, self.copies = first[where[self.at]], copies[where[self.at]]


def answered(pieces: DataFrame, kind: str, result: Callable[[Answered], pa.Table], schema: str) -> DataFrame:
    """`result` of every piece that has shared values; `pieces` is a written table."""
    told = pieces.where("block is not null").groupBy("block").applyInArrow(
        _settle, f"piece long, packed binary, ids array<{kind}>, keys array<long>"
    )
    home = pieces.where("block is null and piece is not null").select("piece", "base", "packed", "ids", "keys")
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        out = result(Answered(left, right))
        release()
        return out

    return home.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(join, schema)
