"""A growing map from 64-bit hashes to numbers, as a few sorted arrays."""

from __future__ import annotations

import numpy as np


class HashRuns:
    """Runs of sorted keys; a run joins the one before it once it is a quarter of it."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        for held, numbers in self.runs:
            spot = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            hit = held[spot] == keys
            out[hit] = numbers[spot[hit]]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """New keys, sorted, none of them known."""
        if len(keys):
            self.runs.append((keys, numbers))
        while len(self.runs) > 1 and 4 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            (late, late_numbers), (early, early_numbers) = self.runs.pop(), self.runs.pop()
            held, numbers = np.concatenate([early, late]), np.concatenate([early_numbers, late_numbers])
            order = np.argsort(held, kind="stable")
            self.runs.append((held[order], numbers[order]))

    def __len__(self) -> int:
        return sum(len(held) for held, _ in self.runs)
