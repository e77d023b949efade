"""A bounded table of words and their token ids, and vectorised assembly of texts from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np


class _Encoded:
    """Token ids of numbered words, one after the other."""

    def __init__(self):
        self._ids = np.zeros(1 << 16, dtype=np.uint32)
        self._starts = np.zeros(1 << 14, dtype=np.int64)
        self.used = self.words = 0

    def add(self, lengths: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self.words + len(lengths) + 1 > len(self._starts):
            self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
        self._ids[self.used : self.used + len(flat)] = flat
        self._starts[self.words + 1 : self.words + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.used += len(flat)
        self.words += len(lengths)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return gather(self._ids, self._starts, numbers)

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self._starts[numbers + 1] - self._starts[numbers]


class WordTable(dict):
    """Word to number; unseen words get the next number and are encoded in one call later.

    ``encode`` turns words into the lengths of their ids and the ids, one after the other.

    The table is emptied when it holds ``limit`` words or ``limit_chars`` characters of them, so memory stays bounded
    however many different words the corpus has, and however long; results do not depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000, limit_chars: int = 32_000_000):
        super().__init__()
        self._encode, self._limit, self._limit_chars = encode, limit, limit_chars
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self._new: list[str] = []
        self._chars = 0
        self._held = _Encoded()

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self._new.append(word)
        self._chars += len(word)
        return at

    def number(self, words: list[str]) -> np.ndarray:
        """Numbers of ``words``; valid until ``trim`` is called."""
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def flush(self) -> None:
        """Encode the words seen since the last call."""
        for begin in range(0, len(self._new), 20_000):
            self._held.add(*self._encode(self._new[begin : begin + 20_000]))
        self._new.clear()

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Token ids of the numbered words, one after the other."""
        return self._held.ids(numbers)

    def trim(self) -> None:
        if len(self) > self._limit or self._chars > self._limit_chars:
            self._reset()


class KeyTable:
    """Words known by a 64-bit key, in sorted arrays: a batch of keys is looked up at once.

    Bounded like ``WordTable``: emptied at ``limit`` words or ``limit_ids`` token ids.
    """

    def __init__(self, limit: int = 1_000_000, limit_ids: int = 8_000_000):
        self._limit, self._limit_ids = limit, limit_ids
        self._reset()

    def _reset(self) -> None:
        self._keys = np.zeros(0, dtype=np.uint64)
        self._numbers = np.zeros(0, dtype=np.int64)
        self._held = _Encoded()

    def number(self, keys: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Numbers of different keys; ``encode`` gives lengths and ids of the words at the places that are new."""
        at = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == keys[inside]
        out = np.empty(len(keys), dtype=np.int64)
        out[known] = self._numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self._held.words + np.arange(len(new))
            self._held.add(*encode(new))
            new = new[np.argsort(keys[new])]
            self._keys, self._numbers = np.insert(self._keys, at[new], keys[new]), np.insert(self._numbers, at[new], out[new])
        return out

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self._held.ids(numbers)

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self._held.lengths(numbers)

    def trim(self) -> None:
        if len(self._keys) > self._limit or self._held.used > self._limit_ids:
            self._reset()


def lists(parts: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists and their items, one after the other."""
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return lengths, np.fromiter(chain.from_iterable(parts), dtype=np.uint32, count=int(lengths.sum()))


def gather(flat: np.ndarray, starts: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[starts[i]:starts[i + 1]]`` for i in ``picked``."""
    begin = starts[picked]
    lengths = starts[1:][picked] - begin
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    # the place in ``flat`` of each item: one more than the item before, but at the starts of pieces
    at = np.repeat(begin - ends + lengths, lengths)
    at += np.arange(total)
    return flat.take(at)
