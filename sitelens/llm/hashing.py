"""Hashes of words and of windows of words."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time; a longer text is cut at white space, a longer word is taken whole.
CHUNK = 1 << 20
_PLACES = 64
#: Words whose windows are hashed side by side.
TOGETHER = 1 << 14
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX ^ (h >> np.uint64(31))


@cache
def _values(seed: int) -> np.ndarray:
    """A random 64-bit value of each byte; white space has none."""
    return np.random.default_rng([41, seed]).integers(0, 2**64, 256, np.uint64)


def _terms(data: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A mixed value of each byte at its place in the word.

    The mix is not linear in either, so that no exchange of bytes between places keeps the sum,
    as it would with powers of one base.
    """
    return _finish(_values(seed)[data] ^ (place.astype(np.uint64) + np.uint64(1)) * _MIX)


@cache
def _table(seed: int) -> np.ndarray:
    """The terms of the first places."""
    place, byte = np.divmod(np.arange(_PLACES * 256), 256)
    return _terms(byte, place, seed)


def _hash_together(raws: list[bytes], seed: int, lower: bool) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raws), np.uint8)
    if lower:
        data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    inside = ~_BLANK[data]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(data) else np.empty(0, int)
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in raws]
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    data, inside = data[starts[0] :], inside[starts[0] :]
    terms = _table(seed)[np.minimum(place, _PLACES - 1) << 8 | data]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        terms[far] = _terms(data[far], place[far], seed)
    terms[~inside] = 0
    h = _finish(np.add.reduceat(terms, starts - starts[0]) + (ends - starts).astype(np.uint64) * _MIX)
    bounds = np.cumsum([len(r) + 1 for r in raws])[:-1]
    return np.split(h, np.searchsorted(starts, bounds))


def _parts(raw: bytes) -> list[bytes]:
    """A long text in pieces that end before white space."""
    blank, out, at = np.flatnonzero(_BLANK[np.frombuffer(raw, np.uint8)]), [], 0
    while at < len(raw):
        i = np.searchsorted(blank, at + CHUNK)
        end = int(blank[i]) if i < len(blank) else len(raw)
        out.append(raw[at:end])
        at = end
    return out


def word_hashes(texts: list[str], seed: int = 0, lower: bool = False) -> list[np.ndarray]:
    """For each text the hashes of its words, in order; ``lower`` takes A-Z as a-z."""
    out: list[np.ndarray] = []
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if waiting and size + len(raw) > CHUNK:
            out += _hash_together(waiting, seed, lower)
            waiting, size = [], 0
        if len(raw) > CHUNK:
            out.append(np.concatenate([_hash_together([part], seed, lower)[0] for part in _parts(raw)]))
        else:
            waiting.append(raw)
            size += len(raw)
    return out + (_hash_together(waiting, seed, lower) if waiting else [])


def rolled(hashed: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` words."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = _finish(out + hashed[j : j + n])
    return out


def side_by_side(hashed: list[np.ndarray], width: int, make: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """What ``make`` gives for each array, one value a window of ``width`` words.

    Short arrays are given to it in a row; values of windows that reach into the next one are left out.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(hashed):
        end, size = at + 1, len(hashed[at])
        while end < len(hashed) and size + len(hashed[end]) <= TOGETHER:
            size += len(hashed[end])
            end += 1
        values, start = make(np.concatenate(hashed[at:end])), 0
        for h in hashed[at:end]:
            out.append(values[start : start + max(0, len(h) - width + 1)])
            start += len(h)
        at = end
    return out
