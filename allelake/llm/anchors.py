"""Content-defined anchors: positions that equal windows of bytes share, whatever surrounds them.

The anchor of a window is its GRAM-byte string with the least hash (the first of several). Equal windows have the same
anchor, so windows that repeat lie around strings that repeat as anchors; all others are left out at once.
"""

from __future__ import annotations

import numpy as np

from . import common

GRAM = 32


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of strings from hashes of two parts; the order of the parts counts."""
    out = x * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out += y
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def doubled(raw: np.ndarray, size: int, levels: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes of the strings of size bytes (a power of two) at all positions, and before them those of the levels asked for."""
    x, step, out = common.byte_codes()[raw], 1, []
    while step < size:
        if step in levels:
            out.append(x)
        x = joined(x[:-step], x[step:]) if len(x) > step else np.zeros(0, np.uint64)
        step *= 2
    return [*out, x]


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the first least of each width neighbours stands."""
    low, at, step = x, np.arange(len(x), dtype=np.int32), 1
    while step < width:
        move = min(step, width - step)
        a, b = low[:-move], low[move:]
        right = b < a
        low, at = np.where(right, b, a), np.where(right, at[move:], at[:-move])
        step += move
    return at


def runs(raw: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of concatenated texts by anchor: document, first window, windows, place of the anchor's string, for each anchor.

    ends: where each text ends. Windows that cross an end do not count.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < window:
        return none, none, none, none
    x = doubled(raw, GRAM)[0]
    at = first_least(x, window - GRAM + 1)
    starts = np.concatenate(([0], ends[:-1]))
    windows = np.maximum(0, ends - starts - window + 1)
    doc = np.repeat(np.arange(len(ends)), windows)
    spot = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(len(doc))
    if not len(spot):
        return none, none, none, none
    chosen = at[spot]
    edge = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    return doc[edge], spot[edge], np.diff(np.append(edge, len(spot))), chosen[edge].astype(np.int64)


def gram_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the anchors' strings, as runs() compares them."""
    return doubled(raw, GRAM)[0][at]
