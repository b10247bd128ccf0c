"""Encoding with the tokenizers library, each distinct piece once.

The byte-level pre-tokeniser cuts a text into pieces that are merged apart from each other, so ids of a text are the ids
of its pieces in order. Pieces are found by pretokenize.pieces and kept in a bounded cache; the library encodes those
that are new, many in one call. The strings of a vocabulary's added tokens stand for these tokens, as they do when the
library encodes a whole text; what is between them is encoded by itself.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from . import bpe, pretokenize

CHUNK = bpe.CHUNK
MARK = "\0"


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        # Of strings that start at one place the longest counts.
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.tokenizer.encode_special_tokens = True  # pieces hold no such string as a whole
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        # Pieces are handed over between marks, each of which stays a piece of its own.
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(MARK, "isolated"), mapped])
        if hasattr(self.tokenizer.model, "_resize_cache"):  # pieces come once, so the library's own cache only costs
            self.tokenizer.model._resize_cache(0)
        self.path = path
        self.pieces = pretokenize.Pieces(self._ids, bpe.CACHE)

    @functools.cached_property
    def alone(self):
        """The library as it is, for the few pieces that hold the mark."""
        from tokenizers import Tokenizer

        alone = Tokenizer.from_file(self.path)
        alone.encode_special_tokens = True
        return alone

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), 200):
            part = [p.decode() for p in pieces[i : i + 200]]
            odd = [p for p in part if MARK in p]
            if odd:
                known = {p: np.array(self.alone.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in odd}
                part = ["" if p in known else p for p in part]
            ids = np.array(self.tokenizer.encode_batch_fast([MARK.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts, data, begin = (4 * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes(), 0
            got = []
            for end in [*cuts, len(data)]:
                got.append(data[begin:end])
                begin = end + 4
            if odd:
                got = [known.get(p.decode(), x) for p, x in zip(pieces[i : i + 200], got)]
            out += got
        return out

    def encode(self, documents: list[str], last: int) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text, and the id last behind them."""
        end = np.array([last], "<u4").tobytes()
        if self.cut is None or not any(s in d for d in documents for s in self.added):
            return self.pieces.encode(documents, end)[0]
        parts = [self.cut.split(d) for d in documents]
        ids = iter(self.pieces.encode([x for p in parts for x in p[::2]])[0])
        return [b"".join(np.array([self.added[x]], "<u4").tobytes() if k % 2 else next(ids) for k, x in enumerate(p)) + end for p in parts]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
