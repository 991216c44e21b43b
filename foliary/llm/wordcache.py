"""Ids of many spans at once: each distinct span is encoded once in a cache's life, the rest is gathering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from foliary.llm import textops


class WordCache:
    """``encode`` gives the ids of each of a list of strings. The cache starts anew beyond ``most`` spans."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.lengths, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans end to end, and how many each span has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, one, inverse = np.unique(textops.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.clear()
        keys = keys.tolist()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        if new:
            fresh = self.encode([data[starts[one[k]] : ends[one[k]]].tobytes().decode() for k in new])
            self.known.update(zip((keys[k] for k in new), range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
            lengths = np.array([len(x) for x in fresh], np.int64)
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in fresh for i in x), np.uint32, int(lengths.sum()))])
            self.starts = np.cumsum(self.lengths) - self.lengths
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[inverse]
        sizes = self.lengths[place]
        at = np.repeat(self.starts[place] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.flat[at], sizes
