"""Pre-tokenisation without regular expressions.

Each code point becomes a symbol (letter, number, white space, other, head of a contraction); a small automaton over
these symbols says where pieces start. Its transition functions form a finite monoid under composition, so the states
before all characters follow from one associative scan over arrays rather than from a loop over characters.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata

import numpy as np

from . import common

# Symbols. A white-space character whose successor is no white space is "last" in its run.
LETTER, NUMBER, OTHER, GAP, LAST_BLANK, LAST_GAP, HEAD2, HEAD3, END = range(9)
# States, after a character: a piece has just been closed; inside a run; behind a blank that the next run takes along;
# one or two characters of a contraction are still to come.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, BLANK, IN_GAP, ONE_MORE, TWO_MORE = range(8)
#: Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode has had since version 16, first and last code points. The libraries know them, Python's own tables may not.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
WIDTH = 64


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after symbol, and whether a piece starts at it."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return CLOSED, False
    if symbol == END:
        return CLOSED, False
    if symbol in (HEAD2, HEAD3):
        if state in (IN_OTHERS, BLANK):
            return IN_OTHERS, False
        return (ONE_MORE if symbol == HEAD2 else TWO_MORE), True
    after = (IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, BLANK, IN_GAP)[symbol]
    goes_on = (state == BLANK and symbol in (LETTER, NUMBER, OTHER)) or (symbol == GAP and state == IN_GAP) or (state == after and symbol in (LETTER, NUMBER, OTHER))
    return after, not goes_on


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables: next state and start flag by state and symbol; the monoid's product; its elements for the symbols; each element's image of CLOSED."""
    steps = [[_step(q, s) for s in range(9)] for q in range(8)]
    generators = [tuple(steps[q][s][0] for q in range(8)) for s in range(9)]
    elements = {tuple(range(8)): 0}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[q] for q in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    every = np.array(list(elements), np.int64)
    product = np.array([[elements[tuple(g[f])] for g in every] for f in every], np.int32)
    return (
        np.array([[x[0] for x in row] for row in steps], np.uint8),
        np.array([[x[1] for x in row] for row in steps], bool),
        product,
        np.array([elements[g] for g in generators], np.int32),
        every[:, CLOSED].astype(np.uint8),
    )


@functools.cache
def classes() -> np.ndarray:
    """The symbol of each code point, before its neighbours are looked at."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    for ranges, symbol in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = symbol
    out[WHITE] = GAP
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of concatenated documents, each closed by one filler character at the positions ends."""
    out = classes()[points]
    out[ends] = END
    after = np.append(out[1:], END)
    last = (out == GAP) & (after != GAP) & (after != END)
    out[last] = np.where(points[last] == 32, LAST_BLANK, LAST_GAP)
    at = np.flatnonzero((points == 39) & (out == OTHER))
    if len(at):
        padded = np.append(points, np.zeros(2, points.dtype))
        one, two = padded[at + 1], padded[at + 2]
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = HEAD2
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[at[pair]] = HEAD3
    return out


def starts(marks: np.ndarray) -> np.ndarray:
    """Which characters start a piece. The rows of a matrix are scanned side by side, their products then one after another by doubling."""
    step, flag, product, element, image = automaton()
    n, m = len(marks), len(product)
    rows = -(-n // WIDTH)
    grid = np.full(rows * WIDTH, END, np.uint8)
    grid[:n] = marks
    grid = np.ascontiguousarray(grid.reshape(rows, WIDTH).T)
    flat, total = np.ascontiguousarray(product[:, element]).reshape(-1), np.zeros(rows, np.int32)
    for column in grid:
        total = flat[total * 9 + column]
    whole, shift = product.reshape(-1), 1
    while shift < rows:
        total[shift:] = whole[total[:-shift] * m + total[shift:]]
        shift *= 2
    state = np.concatenate((np.array([CLOSED], np.uint8), image[total[:-1]]))
    table = np.ascontiguousarray(step).reshape(-1)
    opens = np.ascontiguousarray(flag).reshape(-1)
    out = np.empty((WIDTH, rows), bool)
    for j, column in enumerate(grid):
        key = state.astype(np.int16) * 9 + column
        out[j] = opens[key]
        state = table[key]
    return out.T.reshape(-1)[:n]


def pieces(documents: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All documents as UTF-8, where each piece starts and ends there, and the number of pieces in each document."""
    text = "\n".join(documents) + "\n"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, documents), np.int64, len(documents)) + 1) - 1
    bounds = starts(symbols(points, ends))
    bounds[ends] = True
    raw = text.encode()
    where = np.flatnonzero(bounds)
    if len(raw) == len(points):
        at = where
    else:
        width = (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
        at = where + (np.cumsum(width, dtype=np.int64) - width)[where]
    closing = np.searchsorted(where, ends)
    real = np.ones(len(where), bool)
    real[closing] = False
    return raw, at[real], np.append(at[1:], len(raw))[real], np.diff(closing, prepend=-1) - 1


def _keys(raw: bytes, first: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each piece, its first eight bytes and its length."""
    length = until - first
    eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    head = eights[first] & (np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(length, 8)).astype(np.uint64)))
    key = common.mixed(head + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in (1, 2, 3):
        more = np.flatnonzero(length > 8 * k)
        key[more] = common.mixed(key[more] ^ (eights[np.minimum(first[more] + 8 * k, until[more] - 8)] * np.uint64(0xD6E8FEB86659FD93)))
    for i in np.flatnonzero(length > 32).tolist():
        key[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : until[i]], digest_size=8).digest())
    return key, head, length


def _folded(key: np.ndarray, head: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A piece of each hash, in order of the hashes, and which of them each piece is; None where two pieces share a hash."""
    order = np.argsort(key)
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    lead = order[new]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return None if (head[lead][which] != head).any() or (length[lead][which] != length).any() else (lead, which)


def _numbered(raw: bytes, first: np.ndarray, until: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    every: dict[bytes, int] = {}
    which = np.array([every.setdefault(raw[a:b], len(every)) for a, b in zip(first.tolist(), until.tolist())])
    return list(every), which


def distinct(raw: bytes, first: np.ndarray, until: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces, and which of them each piece is."""
    if not len(first):
        return [], np.zeros(0, np.int64)
    folded = _folded(*_keys(raw, first, until))
    if folded is None:
        return _numbered(raw, first, until)
    lead, which = folded
    return [raw[a:b] for a, b in zip(first[lead].tolist(), until[lead].tolist())], which


class Pieces:
    """Ids of pieces as little-endian 32-bit integers, made once for each distinct one and kept while no more than most are held.

    What is held lies in arrays in order of the pieces' hashes, about 45 bytes a piece. When there are too many, those that
    have come again stay, unless these are more than half.
    """

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, "<u4"))

    def _keep(self, key, head, length, base, size, again, flat):
        self.key, self.head, self.length, self.base, self.size, self.again, self.flat = key, head, length, base, size, again, flat

    def _made(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them."""
        ids = self.make(pieces)
        return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")

    def _ids(self, raw: bytes, first: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each distinct piece begin and how many they are; which of these each piece is."""
        key, head, length = _keys(raw, first, until)
        folded = _folded(key, head, length) if len(key) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if folded is None:
            every, which = _numbered(raw, first, until)
            n, flat = self._made(every)
            return flat, np.cumsum(n) - n, n, which
        lead, which = folded
        key, head, length = key[lead], head[lead], length[lead].astype(np.int32)
        at = np.searchsorted(self.key, key)
        spot = np.minimum(at, max(len(self.key) - 1, 0))
        taken = self.key[spot] == key if len(self.key) else np.zeros(len(key), bool)
        held = np.flatnonzero(taken)
        same = (self.head[spot[held]] == head[held]) & (self.length[spot[held]] == length[held])
        known, base, size = held[same], np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        base[known], size[known] = self.base[spot[known]], self.size[spot[known]]
        self.again[spot[known]] = True
        new = np.ones(len(key), bool)
        new[known] = False
        flat, fresh = self.flat, np.flatnonzero(new)
        if len(fresh):
            n, made = self._made([raw[a:b] for a, b in zip(first[lead[fresh]].tolist(), until[lead[fresh]].tolist())])
            base[fresh], size[fresh] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate((flat, made))
            add = fresh[~taken[fresh]]  # a hash that another piece holds stays with it
            self._add(at[add], key[add], head[add], length[add], base[add], size[add].astype(np.int32), flat)
        return flat, base, size, which

    def _add(self, at, key, head, length, base, size, flat) -> None:
        if len(self.key) + len(key) > self.most:
            stay = np.flatnonzero(self.again)
            stay = stay if len(stay) <= self.most // 2 else stay[:0]
            n, old = self.size[stay].astype(np.int64), self.base[stay]
            stop = np.cumsum(n)
            kept = flat[np.repeat(old - (stop - n), n) + np.arange(n.sum())]
            self._keep(self.key[stay], self.head[stay], self.length[stay], stop - n, self.size[stay], np.zeros(len(stay), bool), kept)
            room = max(0, self.most - len(stay))
            key, head, length, base, size = key[:room], head[:room], length[:room], base[:room], size[:room]
            n = size.astype(np.int64)
            stop = np.cumsum(n)
            flat = np.concatenate((kept, flat[np.repeat(base - (stop - n), n) + np.arange(n.sum())]))
            base, at = len(kept) + stop - n, np.searchsorted(self.key, key)
        more = lambda old, extra: np.insert(old, at, extra)
        self._keep(more(self.key, key), more(self.head, head), more(self.length, length), more(self.base, base), more(self.size, size), more(self.again, False), flat)

    def encode(self, documents: list[str], last: bytes = b"") -> tuple[list[bytes], list[np.ndarray]]:
        """Ids of whole documents, each closed by last, and of each document the byte offsets at which its pieces start."""
        raw, first, until, counts = pieces(documents)
        flat, base, size, which = self._ids(raw, first, until)
        n = size[which]
        stop = np.cumsum(n)
        data = flat[np.repeat(base[which] - (stop - n), n) + np.arange(n.sum())].tobytes()
        cut = np.cumsum(counts)
        edge = (4 * np.append(0, stop)[np.append(0, cut)]).tolist()
        begin = np.append(0, cut)
        offsets = [first[a:b] - first[a] if b > a else first[:0] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        return [data[a:b] + last for a, b in zip(edge[:-1], edge[1:])], offsets
