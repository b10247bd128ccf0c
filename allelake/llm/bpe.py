"""Byte-level BPE, encoding and decoding (operator 1).

Whole texts are cut by pretokenize.pieces; every distinct piece is merged once and kept in a bounded cache. Pieces not
yet seen are merged together as arrays, one merge a round in each of them; very long pieces take a heap instead.
Offsets of pieces are kept, so that ids decode to the bytes of any span.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common, pretokenize

#: Entries of a worker's piece cache (about 45 MB), and characters tokenised together.
CACHE = 1_000_000
CHUNK = 1 << 20
LONG = 400
NEVER = np.int32(2**31 - 1)


class Merges:
    """The merges that a rank file implies: two tokens merge to the token of their joined bytes, lowest rank first."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
        self.vocab = {i: t for t, i in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = max(self.vocab) + 1
        pairs = [(self.ranks[t[:i]] * self.size + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pairs.sort()
        keys = np.array([k for k, _ in pairs], np.uint64)
        self.bits = max(4, len(keys).bit_length() + 2)
        self.slot_key, self.slot_rank = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, NEVER, np.int32)
        self.probes, left = 0, np.arange(len(keys))
        ranks = np.array([r for _, r in pairs], np.int32)
        while len(left):  # open addressing, filled one probe at a time
            at = self._slot(keys[left], self.probes)
            free = self.slot_key[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.slot_key[at[take]], self.slot_rank[at[take]] = keys[left[take]], ranks[left[take]]
            left = left[~take]
            self.probes += 1
        self.encode = pretokenize.Pieces(self.merge, CACHE).encode

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)) + np.uint64(probe)).astype(np.int64) & ((1 << self.bits) - 1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) * np.uint64(self.size) + b.astype(np.uint64)
        out = np.full(len(keys), NEVER, np.int32)
        left = np.arange(len(keys))
        for probe in range(self.probes):
            at = self._slot(keys[left], probe)
            held = self.slot_key[at]
            hit = held == keys[left]
            out[left[hit]] = self.slot_rank[at[hit]]
            left = left[~hit & (held != np.uint64(2**64 - 1))]
            if not len(left):
                break
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One piece with a heap of pairs: n log n steps."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pair_ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist() if n > 1 else []
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NEVER]
        heapq.heapify(heap)
        text = self.vocab
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := self.ranks.get(text[ids[x]] + text[ids[y]])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.merge_long(w).astype("<u4").tobytes()
            else:
                short.append(i)
        lengths = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        ids = self.byte[np.frombuffer(b"".join(words[i] for i in short), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(short)), lengths)
        done_word, done_id = [], []
        rank = np.full(len(ids), NEVER, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:]) if len(ids) else np.zeros(0, np.int64)
        rank[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            if (least == NEVER).any():  # nothing left to merge in these
                over = np.repeat(least == NEVER, size)
                done_word.append(word[over])
                done_id.append(ids[over])
                ids, word, rank = ids[~over], word[~over], rank[~over]
                if not len(ids):
                    break
                keep = least != NEVER
                least, size = least[keep], size[keep]
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = hit[np.diff(word[hit], prepend=-1) != 0]
            ids[hit] = least
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            spot = (np.cumsum(stay) - 1)[hit]
            ids, word, rank = ids[stay], word[stay], rank[stay]
            renew = np.unique(np.concatenate((spot, spot[spot > 0] - 1)))
            same = (renew + 1 < len(ids)) & (word[renew] == word[np.minimum(renew + 1, len(ids) - 1)])
            rank[renew[~same]] = NEVER
            renew = renew[same]
            rank[renew] = self.pair_ranks(ids[renew], ids[renew + 1])
        if done_word:
            word, ids = np.concatenate(done_word), np.concatenate(done_id)
            order = np.argsort(word, kind="stable")
            data = ids[order].astype("<u4").tobytes()
            cuts = (np.cumsum(np.bincount(word, minlength=len(short))) * 4).tolist()
            begin = 0
            for i, end in zip(short, cuts):
                out[i] = data[begin:end]
                begin = end
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def merges(path: str) -> Merges:
    with open(path, "rb") as f:
        return Merges(f.read())


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = True) -> DataFrame:
    """Ids and decoded bytes of every whole text.

    vocabulary: a rank file, at the same place on every machine. A null text counts as empty and gives no ids; repeated
    rows give repeated results; other columns are not read. With keep_ids the columns ids (little-endian 32-bit) and
    piece_offsets (of the same kind: byte offsets of the pieces in the UTF-8 text) follow the digests.
    """
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, piece_offsets binary" * keep_ids
    schema = common.arrow_schema(ddl)

    def run(batches):
        model = merges(vocabulary)
        for b in batches:
            keys, all_texts = b.column(0), b.column(1).to_pylist()
            for i, j in common.chunks([len(t) for t in all_texts], CHUNK):
                ids, offsets = model.encode(all_texts[i:j])
                digests = [hashlib.sha256(x).hexdigest() for x in ids]
                decoded = [hashlib.sha256(model.decode(x)).hexdigest() for x in ids]
                more = [ids, [o.astype("<u4").tobytes() for o in offsets]] if keep_ids else []
                yield common.batch(schema, keys.slice(i, j - i), [len(x) // 4 for x in ids], digests, decoded, *more)

    return common.texts(docs).mapInArrow(run, ddl)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)
