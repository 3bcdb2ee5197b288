"""Texts cut at spaces that no token crosses, so that each distinct piece is encoded once a worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable

import numpy as np

_LOOSE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def words(text: str) -> list[Hashable]:
    """Pieces of a text, cut before each space that follows a character other than white space.

    A piece that begins with a space is given without that space, as ``str``; a first piece that does not is
    given as ``(piece,)``. Joined, the pieces are the text; an empty text has none.
    """
    if not text:
        return []
    if _LOOSE.search(text) is None:
        first, *rest = text.split(" ")
        return [(first,), *rest] if first else rest
    return [p[1:] if p[0] == " " else (p,) for p in _CUT.split(text)]


def piece_text(key: Hashable) -> str:
    return key[0] if isinstance(key, tuple) else " " + key


class Remembered:
    """Numbers (below 2^31) learned for each distinct piece, laid back to back; a worker forgets them all beyond ``most`` pieces.

    ``learn`` maps new keys to columns: the numbers of all keys back to back, and how many each key has.
    """

    def __init__(self, learn: Callable[[list[Hashable]], list[tuple[np.ndarray, np.ndarray]]], most: int = 400_000) -> None:
        self.learn, self.most = learn, most
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[Hashable, int] = {}
        self.columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # values, first place and length of each slot

    def slots_of(self, keys: list[Hashable]) -> np.ndarray:
        found = list(map(self.slots.get, keys))
        missing = [i for i, s in enumerate(found) if s is None]
        if missing:
            new = list(dict.fromkeys([keys[i] for i in missing]))
            if self.slots and len(self.slots) + len(new) > self.most:
                self._forget()
                new, missing = list(dict.fromkeys(keys)), range(len(keys))
            self._add(new)
            for i in missing:
                found[i] = self.slots[keys[i]]
        return np.array(found, np.int64)

    def _add(self, keys: list[Hashable]) -> None:
        for i, (values, count) in enumerate(self.learn(keys)):
            values, count = values.astype(np.int32), count.astype(np.int32)
            first = np.cumsum(count, dtype=np.int64) - count
            if len(self.columns) > i:
                before = self.columns[i]
                values, first, count = np.concatenate([before[0], values]), np.concatenate([before[1], first + len(before[0])]), np.concatenate([before[2], count])
                self.columns[i] = (values, first, count)
            else:
                self.columns.append((values, first, count))
        self.slots.update(zip(keys, range(len(self.slots), len(self.slots) + len(keys)), strict=True))

    def spread(self, slots: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """The values of these slots back to back, and how many each slot has."""
        if not len(slots):
            return np.empty(0, np.int32), slots
        values, first, counts = self.columns[column]
        n = counts[slots].astype(np.int64)
        upto = np.cumsum(n)
        return values[np.arange(upto[-1]) + np.repeat(first[slots] - upto + n, n)], n
