"""Shard files of raw token ids with a minimal perfect hash index.

    magic, then eight numbers: bytes per id, documents, ids, seed, levels, ...
    ids of all documents, end to end
    index: per level the bits of a bit array and, every 512 bits, how many
        bits are set before; then per slot a fingerprint, the first id and the
        number of ids of its document; then doc_ids and repeat numbers in file order

A document's key is its doc_id and a repeat number (0 unless the shard holds
the doc_id several times). A level sends each key to a position of its bit
array; keys that have a position to themselves stop there, the others go on
to the next level. The rank of a key's bit over all levels is its slot: n keys,
n slots, a few steps whatever n is. Keys that were never stored end in some slot,
too, where the fingerprint gives them away.
"""

from __future__ import annotations

import numpy as np

from riskmart.llm.words import U64, mix

MAGIC = b"TOKSHARD"
HEAD = len(MAGIC) + 8 * 8
#: Positions per key that is left at a level.
ROOM = 2
RANK_BITS = 512
NULL_ID = np.int64(-(2**63))


def keys_of(doc_ids: np.ndarray, repeats: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(doc_ids.astype(np.int64).view(np.uint64) + U64(seed)) + repeats.astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys + U64((level + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) % U64(size)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(32)).astype(np.uint32)


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (one byte a bit, whole rank blocks) for distinct keys."""
    levels = []
    while len(keys):
        size = -(-ROOM * len(keys) // RANK_BITS) * RANK_BITS
        at = _place(keys, len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
    return levels


class Index:
    """Slots of keys, from the bits as they stand in the file."""

    def __init__(self, levels: list[np.ndarray]):
        self.bits = [np.packbits(x, bitorder="little") for x in levels]
        self.ranks, before = [], 0
        for x in levels:
            per_block = x.reshape(-1, RANK_BITS).sum(axis=1)
            self.ranks.append((before + np.cumsum(per_block) - per_block).astype(np.uint32))
            before += int(per_block.sum())

    @classmethod
    def read(cls, bits: list[np.ndarray], ranks: list[np.ndarray]) -> Index:
        out = cls([])
        out.bits, out.ranks = bits, ranks
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the key ends at no level."""
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = _place(keys[left], level, 8 * len(bits)).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            stop = at[hit]
            block = stop // RANK_BITS
            bytes_of = bits.reshape(-1, RANK_BITS // 8)[block]
            inside = np.unpackbits(bytes_of, axis=1, bitorder="little")
            upto = np.arange(RANK_BITS)[None, :] < (stop % RANK_BITS)[:, None]
            slot[left[hit]] = ranks[block] + (inside & upto).sum(axis=1)
            left = left[~hit]
        return slot


def pack(ids: np.ndarray, per_doc: np.ndarray, doc_ids: np.ndarray) -> bytes:
    """A shard file; doc_ids (NULL_ID for NULL) are sorted, equal ones are numbered in order."""
    count = len(doc_ids)
    new = np.ones(count, bool)
    new[1:] = doc_ids[1:] != doc_ids[:-1]
    opened = np.flatnonzero(new)
    repeats = (np.arange(count) - np.repeat(opened, np.diff(np.append(opened, count)))).astype(np.uint32)
    seed = 0
    while len(np.unique(keys := keys_of(doc_ids, repeats, seed))) < count:
        seed += 1
    levels = build_levels(keys)
    index = Index(levels)
    slot = index.slots(keys)
    prints, first, size = np.zeros(count, np.uint32), np.zeros(count, np.int64), np.zeros(count, np.int64)
    prints[slot], first[slot], size[slot] = fingerprints(keys), np.cumsum(per_doc) - per_doc, per_doc
    body = ids.tobytes()
    head = np.array([ids.dtype.itemsize, count, len(ids), seed, len(levels), 0, 0, 0], "<i8")
    parts = [MAGIC, head.tobytes(), body, np.array([8 * len(b) for b in index.bits], "<i8").tobytes()]
    parts += [b.tobytes() for b in index.bits] + [r.tobytes() for r in index.ranks]
    parts += [x.tobytes() for x in (prints, first, size, doc_ids.astype("<i8"), repeats)]
    return b"".join(parts)


class Shard:
    """Keyed access to a shard file's bytes."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a shard file")
        width, count, total, self.seed, levels, *_ = np.frombuffer(raw, "<i8", 8, len(MAGIC)).tolist()
        at = HEAD

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.ids = take("<u2" if width == 2 else "<u4", total)
        sizes = take("<i8", levels).tolist()
        bits = [take("u1", s // 8) for s in sizes]
        ranks = [take("<u4", s // RANK_BITS) for s in sizes]
        self.index = Index.read(bits, ranks)
        self.prints, self.first, self.size = take("<u4", count), take("<i8", count), take("<i8", count)
        self.doc_ids, self.repeats = take("<i8", count), take("<u4", count)

    def find(self, doc_ids: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 and 0 for keys that are not there."""
        keys = keys_of(doc_ids, repeats, self.seed)
        slot = self.index.slots(keys)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == fingerprints(keys[there])
        first, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[there], size[there] = self.first[slot[there]], self.size[slot[there]]
        return first, size

    def get(self, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
        first, size = self.find(np.array([NULL_ID if doc_id is None else doc_id]), np.array([repeat]))
        return None if first[0] < 0 else self.ids[first[0] : first[0] + size[0]]
