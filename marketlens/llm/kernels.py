"""Vectorised text kernels over packed UTF-8 bytes, used inside Arrow tasks."""

from __future__ import annotations

import hashlib

import numpy as np

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Word bytes of the decontamination rule: 0-9, a-z (after lower-casing) and every byte of a non-ASCII character.
WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64))])
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint, ascending, non-empty byte ranges."""
    lengths = ends - starts
    if not len(lengths):
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    body = data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    body *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(body, first))


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different byte ranges (disjoint, ascending, non-empty): the number of one range of each, and each range's group.
    Hashes only sort them; ranges are in one group if their bytes are equal."""
    _, at, which = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths, model = ends - starts, at[which]
    same = lengths == lengths[model]
    rows = np.flatnonzero(same & (model != np.arange(len(starts))))
    n = lengths[rows]
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    differ = data[place + np.repeat(starts[rows], n)] != data[place + np.repeat(starts[model[rows]], n)]
    odd = rows[np.add.reduceat(differ, first, dtype=np.int64) > 0] if len(rows) else rows
    odd = np.concatenate([np.flatnonzero(~same), odd])
    if len(odd):  # other bytes of the same hash: groups of their own
        own: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            raw = data[starts[i] : ends[i]].tobytes()
            if raw not in own:
                own[raw] = len(at) + len(more)
                more.append(i)
            which[i] = own[raw]
        at = np.concatenate([at, more])
    return at, which


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit BLAKE2 digests of the different lower-cased words of packed rows, and each word's number among them
    and row. Words never cross rows."""
    low = LOWER[data]
    inside = WORD[low]
    none = np.empty(0, np.int64)
    if not inside.any():
        return np.empty(0, "S16"), none, none
    follows = np.empty(len(data) + 1, bool)  # byte i continues the word of byte i - 1
    follows[0] = follows[-1] = False
    np.logical_and(inside[1:], inside[:-1], out=follows[1:-1])
    follows[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~follows[:-1])
    ends = np.flatnonzero(inside & ~follows[1:]) + 1
    at, which = distinct_ranges(low, starts, ends)
    raw = low.tobytes()
    digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    return np.array(digests, "S16"), which, np.searchsorted(offsets, starts, side="right") - 1
