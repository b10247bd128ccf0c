"""Banded alignment of two texts as sequences of words.

The alignment keeps as many words of both texts, in order, as it can. A row of its table is one large integer whose zero
bits mark where the number of kept words grows, so that a step over a word is a handful of integer operations; only
the columns within the band of the diagonal are held.
"""

from __future__ import annotations

import numpy as np

from . import common

#: Words of the second text that are taken between two moves of the band, at least.
STRIDE = 512


def kept_words(a: list[int], b: list[int], band: int, least: int = 0) -> int:
    """The most words that stand in both texts in the same order, none of them moved by more than band.

    Words moved a little further may count too, as the band moves by strides. Less than least may come out as any
    number below it.
    """
    stride, total, low, row, high = max(STRIDE, band), 0, 0, 0, 0
    for j in range(0, len(b), stride):
        # Columns left of the band are final: their zeros are counted and dropped. New columns come in as ones.
        first, last = max(0, j - band), min(len(a), j + stride + band)
        if first > low:
            gone = min(first, high) - low
            total += gone - (row & ((1 << gone) - 1)).bit_count()
            row >>= gone
            low = min(first, high)
        if first >= last:
            break
        if last > high:
            row |= ((1 << (last - high)) - 1) << (high - low)
            high = last
        full = (1 << (high - low)) - 1
        places: dict[int, int] = {}
        for i in range(low, high):
            places[a[i]] = places.get(a[i], 0) | 1 << (i - low)
        for x in b[j : j + stride]:
            at = places.get(x)
            if at is not None:
                hit = row & at
                row = ((row + hit) | (row - hit)) & full
        if total + (high - low - row.bit_count()) + max(0, len(b) - j - stride) < least:
            return 0
    return total + (high - low) - row.bit_count()


def same_ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words two texts share at their beginnings, and at the ends of what is left."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    return head, int(differ[0]) if len(differ) else n


def needed(longer: int, threshold: float) -> int:
    return int(np.ceil(threshold * longer - 1e-9))


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Does an alignment keep threshold of the words of the longer text?"""
    longer = max(len(a), len(b))
    least = needed(longer, threshold)
    if not longer or min(len(a), len(b)) < least:
        return False
    head, tail = same_ends(a, b)
    if head + tail >= least:
        return True
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    left = least - head - tail
    if shared(a, b) < left:
        return False
    return kept_words(a.tolist(), b.tolist(), longer - least, left) >= left


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two texts have in common, as often as both have them: no alignment keeps more."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def words(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents in order, and where each document's begin."""
    raw = np.frombuffer(b"\n".join(documents) + b"\n", np.uint8)
    first, until = common.word_spans(raw)
    ends = np.cumsum([len(d) + 1 for d in documents])
    return common.span_hashes(raw, first, until), np.append(0, np.searchsorted(first, ends))


def labelled(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """x with the number of earlier occurrences in the document mixed in, so that no value occurs twice in one."""
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((np.arange(len(x)), x, doc))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    begin = np.flatnonzero(new)
    label = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
    tagged = np.empty_like(x)
    tagged[order] = common.mixed(x[order] + label.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return tagged


def shared_words(tagged: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For all pairs of documents the labelled words that both have, by products of incidence columns."""
    n = len(cut) - 1
    _, column = np.unique(tagged, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(cut))
    often = np.bincount(column, minlength=1)
    keep = often[column] > 1
    column, row = column[keep], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((n, n), np.float32)
    step = max(1, (1 << 22) // max(n, 1))
    edges = np.append(np.flatnonzero(np.diff(column, prepend=-1)), len(column))
    for g in range(0, len(edges) - 1, step):
        a, b = edges[g], edges[min(g + step, len(edges) - 1)]
        grid = np.zeros((n, min(step, len(edges) - 1 - g)), np.float32)
        grid[row[a:b], np.cumsum(np.diff(column[a:b], prepend=column[a]) != 0)] = 1
        out += grid @ grid.T
    return out
