"""Words, lines and shingles of Arrow text columns as flat numpy arrays.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return. All functions work on whole batches: one
array over all bytes, words or shingles of all texts, plus counts per text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same set as a regular expression for Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

U64 = np.uint64
#: Bytes of text taken into one set of arrays; some forty times that is needed for a moment.
SLICE_BYTES = 1 << 19

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64)) | U64(1)


@dataclass
class Texts:
    """The bytes of some texts, end to end; text i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray

    @property
    def count(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Words of some texts in order: byte positions, 64-bit hashes, words per text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    per_text: np.ndarray


def texts(column: pa.Array) -> Texts:
    """NULL counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body else np.zeros(0, np.uint8)
    return Texts(data, bounds - bounds[0])


def release() -> None:
    """Give freed memory back to the system: workers stay for later tasks and would hold it meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about SLICE_BYTES of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = texts(batch.column(column)).bounds
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
    release()


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; runs are in order, not empty, and do not overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    power = np.cumprod(np.full(int(length.max()), _BASE | U64(1), np.uint64))
    first = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(first, length)
    where = np.repeat(start, length) + inside
    total = np.add.reduceat(_BYTE_VALUE[data[where]] * power[inside], first)
    return mix(total + length.astype(np.uint64))


def words(found: Texts, lower: bool = False) -> Words:
    data = _LOWER[found.data] if lower else found.data
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(found.count, np.int64))
    inside = ~_IS_SEPARATOR[data]
    opens = np.zeros(size + 1, bool)
    opens[found.bounds[:-1]] = True
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | opens[:size]))
    after = np.zeros(size, bool)
    after[:-1] = inside[1:] & ~opens[1:size]
    end = np.flatnonzero(inside & ~after) + 1
    at = np.searchsorted(start, found.bounds)
    return Words(start, end, run_hashes(data, start, end), np.diff(at))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` neighbouring hashes, across whatever borders lie between."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, U64(size), np.uint64)
    for shift in range(size):
        total = total * _STEP + hashes[shift : shift + count]
    return mix(total)


def gram_mask(per_text: np.ndarray, size: int) -> np.ndarray:
    """True for each word at which a run of `size` words of the same text begins."""
    left = np.repeat(np.cumsum(per_text), per_text) - np.arange(int(per_text.sum()))
    return left >= size


def shingles(hashes: np.ndarray, per_text: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All shingles in text order with their number per text.

    A text of fewer words has its whole sequence as its one shingle, a text
    without words has none.
    """
    first = np.cumsum(per_text) - per_text
    full = grams(hashes, size)
    mask = gram_mask(per_text, size)
    value = np.zeros(len(hashes), np.uint64)
    value[: len(full)] = full
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    for count in range(1, size):
        at = first[short[per_text[short] == count]]
        if len(at):
            total = np.full(len(at), U64(count), np.uint64)
            for shift in range(count):
                total = total * _STEP + hashes[at + shift]
            value[at] = mix(total)
            mask[at] = True
    counts = np.where(per_text >= size, per_text - size + 1, (per_text > 0).astype(per_text.dtype))
    return value[mask], counts


def distinct_per_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, end to end, with their number per text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.bincount(owner[keep], minlength=len(counts))


def sum_per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's values; texts without values give 0."""
    total = np.zeros(len(counts), values.dtype)
    some = counts > 0
    if some.any():
        total[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return total


def set_digest(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each text's set, whatever the order of its values."""
    size = counts.astype(np.uint64)
    one = mix(sum_per_text(mix(values ^ U64(0x5851F42D4C957F2D)), counts) + size)
    two = mix(sum_per_text(mix(values + U64(0x14057B7EF767814F)), counts) ^ size)
    return one, two


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column of 64-bit integers from flat values."""
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64)))
