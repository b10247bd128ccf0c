from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from allelake.llm import bpe, library, packing, pretokenize, tokenfile

from .conftest import edge_rows

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
LETTERS = st.text(st.sampled_from(list("ab1' \n\tstrevld!é中½٣’_\0 ")), max_size=60)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=5))
def test_pieces_are_the_matches(documents):
    raw, first, until, counts = pretokenize.pieces(documents)
    matches = [regex.findall(P.PATTERN, d) for d in documents]
    assert [raw[a:b].decode() for a, b in zip(first, until)] == [m for ms in matches for m in ms]
    assert counts.tolist() == [len(m) for m in matches]


def test_classes_of_all_code_points():
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, every))

    def matched(pattern):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        return {ord(c) for c in bytes(probe.encode_ordinary(text)).decode()}

    kinds = pretokenize.classes()
    for pattern, kind in ((r"\p{L}+", pretokenize.LETTER), (r"\p{N}+", pretokenize.NUMBER), (r"\s+", pretokenize.GAP)):
        assert matched(pattern) == {c for c in every if kinds[c] == kind}


def test_ids_of_new_and_other_code_points(reference):
    """All letters and numbers that are new, and other code points, by themselves and behind a letter, a number and a mark."""
    rnd = random.Random(2)
    new = [c for a, b in pretokenize.NEW_LETTERS + pretokenize.NEW_NUMBERS for c in range(a, b + 1)]
    some = [chr(c) for c in new[::7] + new[:60] + rnd.sample(range(0xD800), 1500) + rnd.sample(range(0xE000, 0x110000), 500)]
    tokenizer = Tokenizer.from_file(JSON)
    documents = ["".join(f"{c} a{c} 1{c} !{c}\n\n" for c in some[i : i + 250]) for i in range(0, len(some), 250)]
    ids, _ = bpe.merges(RANKS).encode(documents)
    for d, x, y in zip(documents, ids, library.encoder(JSON).encode(documents, 7)):
        assert np.frombuffer(x, "<u4").tolist() == reference.encode_ordinary(d)
        assert np.frombuffer(y, "<u4").tolist() == [*tokenizer.encode(d, add_special_tokens=False).ids, 7]


def test_added_tokens_as_the_library_has_them():
    documents = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", " <|endoftext|>  \n", "<|endoftext", "<<|endoftext|>|>", "no", ""]
    tokenizer = Tokenizer.from_file(JSON)
    for d, x in zip(documents, library.encoder(JSON).encode(documents, 0)):
        assert np.frombuffer(x, "<u4").tolist() == [*tokenizer.encode(d, add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(LETTERS, st.text(max_size=40)), min_size=1, max_size=4))
def test_distinct_pieces(documents):
    raw, first, until, _ = pretokenize.pieces(documents)
    every, which = pretokenize.distinct(raw, first, until)
    assert len(set(every)) == len(every)
    assert [every[k] for k in which] == [raw[a:b] for a, b in zip(first, until)]


def test_pieces_that_come_again_stay_held():
    """More pieces than are held, chunk by chunk: ids stay right, and a piece of every chunk is not made anew in each."""
    made = []

    def make(new):
        made.extend(new)
        return [np.frombuffer(p, np.uint8).astype("<u4").tobytes() for p in new]

    held = pretokenize.Pieces(make, 40)
    for k in range(60):
        documents = [f"the same words w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}x", f" n{k * 7919}", "", "the same"] + ["".join(chr(97 + (k * j) % 26) for j in range(12))] * 2 + [f"{k}" * 20] * (k % 3)
        got, _ = held.encode(documents, b"\1\0\0\0")
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*d.encode(), 1] for d in documents]
        assert len(held.key) <= 40 and (held.key[1:] > held.key[:-1]).all()
    assert made.count(b" same") == made.count(b"the") == 1 and len(made) > 80


def test_held_pieces_that_share_a_hash(monkeypatch):
    """Pieces of one hash, in one chunk and in different ones, keep their own ids."""
    monkeypatch.setattr(pretokenize.common, "mixed", lambda x: x & np.uint64(3))
    held = pretokenize.Pieces(lambda new: [np.frombuffer(p, np.uint8).astype("<u4").tobytes() for p in new], 1000)
    for documents in (["ab"], ["cd"], ["ef gh", "ij"], ["ab cd"], ["kl"], ["ab"], ["mn"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in held.encode(documents)[0]] == [list(d.encode()) for d in documents]


def test_ids_of_both_libraries(reference):
    rnd = random.Random(3)
    documents = [t or "" for _, t in edge_rows()] + ["aaab" * 400, "<|endoftext", "\0 a\0b", "".join(rnd.choices("abcdef ", k=5000))]
    ids, offsets = bpe.merges(RANKS).encode(documents)
    same = library.encoder(JSON).encode(documents, 7)
    for d, x, y, o in zip(documents, ids, same, offsets):
        assert np.frombuffer(x, "<u4").tolist() == reference.encode_ordinary(d)
        assert y == x + b"\7\0\0\0"
        assert bpe.merges(RANKS).decode(x) == d.encode()
        assert o.tolist() == [len(d[: m.start()].encode()) for m in regex.finditer(P.PATTERN, d)]


def test_long_pieces_as_short_ones():
    m = bpe.merges(RANKS)
    for w in (b"the" * 40, b"a" * 90, bytes(range(97, 123)) * 3):
        assert m.merge_long(w).astype("<u4").tobytes() == m.merge([w])[0]


def test_op1(clashing, nothing, reference):
    rows = {r.doc_id: r for r in bpe.encode(clashing, RANKS).collect()}
    for i, t in edge_rows():
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert bytes(rows[i].ids) == ids
    assert None in rows and bpe.encode(nothing, RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_256), st.integers(0, 2**32 - 1), st.just(3)), max_size=1200))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    data, starts = tokenfile.pack(ids)
    assert tokenfile.unpack(data, starts[:-1]).tolist() == values
    for k, at in enumerate(starts[:-1].tolist()):  # a block alone
        assert tokenfile.unpack_block(data, at).tolist() == values[k * tokenfile.BLOCK : (k + 1) * tokenfile.BLOCK]


def _ids(t: str | None, end: int) -> bytes:
    tokenizer = Tokenizer.from_file(JSON)
    return np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@pytest.mark.parametrize("most", [300, tokenfile.SEGMENT_IDS])
def test_op9(clashing, nothing, most):
    rows = tokenfile.read_ids(tokenfile.write_ids(clashing, JSON, 2, most)).orderBy("start").collect()
    assert rows[0].doc_id is None
    start = 0
    for r, (i, t) in zip(rows, [(None, "without an id " * 30), *sorted(edge_rows())]):
        ids = _ids(t, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert tokenfile.read_ids(tokenfile.write_ids(nothing, JSON, 2)).count() == 0


@given(st.lists(st.integers(1, 256), max_size=80))
@settings(max_examples=60, deadline=None)
def test_dealing(sizes):
    windows = packing.deal(sizes, 1024)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 1024 for w in windows)


def test_differencing_balances():
    rnd = random.Random(5)
    sizes = [rnd.randrange(1, 257) for _ in range(600)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 80)]
    assert max(sums) - min(sums) <= 16


def test_op10(clashing, nothing):
    rows = packing.pack(clashing, JSON, 0).toPandas()
    texts = dict([*edge_rows(), (-1, "without an id " * 30)])
    rows["doc_id"] = rows.doc_id.fillna(-1).astype(int)
    for i, mine in rows.sort_values("start").groupby("doc_id"):
        ids = _ids(texts[i], 0)
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]] and mine.length.sum() == len(ids) // 4
        assert set(mine.doc_tokens) == {len(ids) // 4}
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(mine.start, mine.length)]
    assert set(rows.doc_id) == set(texts)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert packing.pack(nothing, JSON, 0).count() == 0


@pytest.mark.parametrize("splits", [1, 32, 211])
def test_op10_padding(spark, splits):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(splits)
    rows = packing.pack(docs, JSON, 0).toPandas()
    sums = rows.groupby("sequence_id").length.sum()
    assert sums.max() <= 1024 and sums.sum() >= 0.99 * 1024 * len(sums)
    assert sums.sum() == rows.drop_duplicates("doc_id").doc_tokens.sum()
