"""A library tokenizer run once per distinct word.

For tokenizers that drop white space no token spans two words, so a text's
ids are its words' ids end to end. Words are told apart by 64-bit hashes;
what the library gave for a word is kept by each worker, up to a bound.
"""

from __future__ import annotations

import os

import numpy as np

from riskmart.llm import words as W
from riskmart.llm.hashruns import HashRuns

#: Distinct words that a worker keeps; beyond, it starts over.
KEPT_WORDS = 2_000_000


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        top = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.words = HashRuns()
        self.pool = np.zeros(1 << 16, self.kind)
        self.used = 0
        self.first = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.known = 0

    def _learn(self, hashes: np.ndarray, strings: list[str]) -> None:
        ids = [e.ids for e in self.library.encode_batch(strings, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        numbers = np.arange(self.known, self.known + len(ids))
        for name, room in (("first", numbers[-1] + 1), ("size", numbers[-1] + 1), ("pool", self.used + total)):
            held = getattr(self, name)
            if len(held) < room:
                grown = np.zeros(max(room, 2 * len(held)), held.dtype)
                grown[: len(held)] = held
                setattr(self, name, grown)
        self.first[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), self.kind, total)
        self.used += total
        self.known += len(ids)
        self.words.add(hashes, numbers)

    def encode(self, found: W.Texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, each text closed by end_id, and ids per text."""
        split = W.words(found)
        hashes, sample, inverse = np.unique(split.hash, return_index=True, return_inverse=True)
        at = self.words.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.known + len(new) > KEPT_WORDS:
                self._forget()
                new = np.arange(len(hashes))
            raw = found.data.tobytes()
            spots = sample[new]
            strings = [raw[a:b].decode() for a, b in zip(split.start[spots].tolist(), split.end[spots].tolist(), strict=True)]
            self._learn(hashes[new], strings)
            at = self.words.find(hashes)
        at = at[inverse]
        sizes = self.size[at]
        closing = 0 if end_id is None else 1
        per_text = W.sum_per_text(sizes, split.per_text) + closing
        out = np.full(int(per_text.sum()), end_id or 0, self.kind)
        owner = np.repeat(np.arange(found.count), split.per_text)
        target = np.cumsum(sizes) - sizes + owner * closing
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(target, sizes) + step] = self.pool[np.repeat(self.first[at], sizes) + step]
        return out, per_text


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
