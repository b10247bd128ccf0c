"""Language-model scores by a weighted backoff automaton (operator 8).

States are the histories that training texts hold, down to the empty one. An arc from a history by a token that followed
it carries the log-probability of the smoothed n-gram; all other tokens take the failure arc, which carries the history's
backoff weight, to the history without its first token. With Dirichlet smoothing of strength MU,

    p(w | h) = (c(hw) + MU p(w | h')) / (c(h) + MU),    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

so an arc's weight is log10 p(w | h) and a failure arc's is log10 (MU / (c(h) + MU)).

Counts cover all training texts but are never held in one place: documents form blocks, each block asks for the counts
of its own n-grams, shards of the n-gram space add up and answer all blocks, and each block scores its documents with
the automaton restricted to what occurs in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER, MU = 2, 100.0
#: Tokens that one lane of a traversal reads; all lanes of a block move on together.
STRETCH = 256
#: UTF-8 bytes in a block, about.
BLOCK_BYTES = 12 << 20
END = np.uint64(0x0E4D0E4D0E4D0E4D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each document as its start, its words and its end; and where each document begins, with one more at the end."""
    raw = LOWER[np.frombuffer(b"\n".join(documents) + b"\n", np.uint8)]
    first, until = common.word_spans(raw)
    counts = np.diff(np.append(0, np.searchsorted(first, np.cumsum([len(d) + 1 for d in documents]))))
    cut = np.append(0, np.cumsum(counts + 2))
    out = np.full(cut[-1], END, np.uint64)
    inside = np.ones(cut[-1], bool)
    inside[cut[:-1]] = inside[cut[1:] - 1] = False
    step = 1 << 17  # words hashed together, which bounds the tables of powers
    at = np.flatnonzero(inside)
    for i in range(0, len(first), step):
        a, b = first[i : i + step], until[i : i + step]
        out[at[i : i + step]] = common.span_hashes(raw[a[0] : b[-1]], a - a[0], b - a[0])
    return out, cut


def grams(token: np.ndarray, cut: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: keys of the n-grams, and the positions of their last tokens. A start is part of a history only."""
    place = (np.arange(len(token)) - np.repeat(cut[:-1], np.diff(cut))).astype(np.int32)
    out, key = [], token
    for k in range(1, order + 1):
        if k > 1:
            longer = np.zeros_like(key)
            longer[k - 1 :] = common.mixed(token[: len(token) - k + 1] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + key[k - 1 :])
            key = longer
        at = np.flatnonzero(place >= max(1, k - 1)).astype(np.int32)
        out.append((key[at], at))
    return out


def squeeze(keys: np.ndarray) -> bytes:
    """Ascending keys as a first one and differences of as few bytes as the largest needs."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def expand(data: bytes) -> np.ndarray:
    width = data[0]
    part = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(part), 8), np.uint8)
    gaps[:, :width] = part
    return np.cumsum(np.append(np.frombuffer(data, "<u8", 1, 1), gaps.view("<u8")[:, 0]), dtype=np.uint64)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers of up to 64 bits, in as many bytes each as the largest needs."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


ASK = "shard long, block long, gram int, keys binary, counts binary"
ANSWER = "block long, shard long, gram int, totals binary, n long, v long"


def _ask(bits: int, order: int):
    schema = common.arrow_schema(ASK)

    def run(table: pa.Table) -> pa.Table:
        data, held = table["text"].cast(pa.binary()).to_pylist(), table["held_out"].to_numpy()
        block = table["block"][0].as_py()
        token, cut = tokens(data)
        train = np.repeat(~held, np.diff(cut))
        rows = []
        for k, (keys, at) in enumerate(grams(token, cut, order), 1):
            turn = np.argsort(keys)
            s = keys[turn]
            edge = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            each, counts = s[edge], np.add.reduceat(train[at][turn].astype(np.int64), edge)
            shard = (each >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(each), np.int64)
            begin = np.flatnonzero(np.diff(shard, prepend=-1))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(each)]):
                rows.append((int(shard[a]), block, k, squeeze(each[a:b]), narrow(counts[a:b])))
        return pa.Table.from_batches([common.batch(schema, *zip(*rows))]) if rows else schema.empty_table()

    return run


def _answer():
    schema = common.arrow_schema(ANSWER)

    def run(table: pa.Table) -> pa.Table:
        shard, blocks = table["shard"][0].as_py(), table["block"].to_pylist()
        gram = table["gram"][0].as_py()
        keys = [expand(x) for x in table["keys"].to_pylist()]
        counts = np.concatenate([widen(x) for x in table["counts"].to_pylist()])
        flat = np.concatenate(keys)
        turn = np.argsort(flat)
        s = flat[turn]
        new = np.append(True, s[1:] != s[:-1])
        sums = np.add.reduceat(counts[turn], np.flatnonzero(new))
        totals = np.empty(len(flat), np.int64)
        totals[turn] = sums[np.cumsum(new) - 1]
        edge = np.append(0, np.cumsum([len(x) for x in keys])).tolist()
        packed = [narrow(totals[a:b]) for a, b in zip(edge[:-1], edge[1:])]
        # Tokens and distinct tokens of the shard, told once.
        n = [int(sums.sum()) if i == 0 and gram == 1 else 0 for i in range(len(keys))]
        v = [int((sums > 0).sum()) if i == 0 and gram == 1 else 0 for i in range(len(keys))]
        return pa.Table.from_batches([common.batch(schema, blocks, [shard] * len(keys), [gram] * len(keys), packed, n, v)])

    return run


class Automaton:
    """States, arcs and failure arcs for the n-grams of one block.

    State 0 is the empty history; the others are the n-grams below the highest order that training texts hold. fail and
    backoff give each state's failure arc and its weight. The arcs of all states lie in one ascending array of
    state * tokens + token, with their weights and the states they lead to; the empty history has an arc for each token.
    """

    def __init__(self, counts: list[np.ndarray], which: list[np.ndarray], at: list[np.ndarray], size: int, n: int, v: int, mu: float):
        """counts: by order, of each distinct n-gram how often training texts hold it; which: the n-gram of each order that ends at each position of at."""
        order, vocabulary = len(counts), max(len(counts[0]), 1)
        end = int(which[0][-1]) if len(which[0]) else 0  # a block's last token is an end; a start stands for the end of what came before
        ending = []
        for w, spots in zip(which, at):
            here = np.full(size, -1, np.int64)
            here[spots] = w
            ending.append(here)
        ending[0][ending[0] < 0] = end
        self.token, self.vocabulary = ending[0], vocabulary
        weights = [np.log10((counts[0] + 0.5) / (n + 0.5 * (v + 1)))]
        self.root = weights[0]
        fail, backoff = [np.zeros(1, np.int64)], [np.zeros(1)]
        numbers, made = [], 1  # of each order, the state that an n-gram is
        keys, arcs, targets = [], [], []
        for k in range(1, order + 1):
            held = counts[k - 1] > 0
            state = np.full(len(held), -1, np.int64)
            if k < order:
                state[held] = made + np.arange(held.sum())
                made += int(held.sum())
            numbers.append(state)
            first = np.zeros(len(held), np.int64)
            first[which[k - 1][::-1]] = at[k - 1][::-1]
            if k == 1:
                shorter = np.zeros(len(held), np.int64)
                source, weight = shorter, weights[0]
                arc = np.ones(len(held), bool)  # tokens that training texts lack lead from the empty history to itself
            else:
                suffix, history = ending[k - 2][first], ending[k - 2][first - 1]
                shorter, source = numbers[k - 2][suffix], numbers[k - 2][history]
                weight = np.log10((counts[k - 1] + mu * 10.0 ** weights[k - 2][suffix]) / (counts[k - 2][history] + mu))
                arc = held
                weights.append(weight)
            if k < order:
                fail.append(shorter[held])
                backoff.append(np.log10(mu / (counts[k - 1][held] + mu)))
            keys.append((source * vocabulary + ending[0][first])[arc])
            arcs.append(weight[arc])
            targets.append(np.where(state >= 0, state, np.maximum(shorter, 0))[arc])
        self.fail, self.backoff = np.concatenate(fail), np.concatenate(backoff)
        key = np.concatenate(keys)
        turn = np.argsort(key)
        self.key, self.arc, self.target = key[turn], np.concatenate(arcs)[turn], np.concatenate(targets)[turn]
        self.reach = order - 1

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of reading one token each, failure arcs included, and the states after it."""
        weight, after = np.zeros(len(state)), np.empty(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            want = state * self.vocabulary + token
            spot = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[spot] == want
            done = left[hit]
            weight[done] += self.arc[spot[hit]]
            after[done] = self.target[spot[hit]]
            left, state, token = left[~hit], state[~hit], token[~hit]
            weight[left] += self.backoff[state]
            state = self.fail[state]
        return weight, after

    def read(self, cut: np.ndarray) -> np.ndarray:
        """Weights of all positions, read from left to right.

        Lanes read a document, or a stretch of a long one, side by side. A state holds no more tokens than the histories have,
        so a lane that starts in the middle gets its state by reading as many tokens before it, whose weights do not count.
        """
        out = np.zeros(len(self.token))
        sizes = np.diff(cut)
        lanes = -(-sizes // STRETCH)
        doc = np.repeat(np.arange(len(sizes)), lanes)
        begin = cut[:-1][doc] + STRETCH * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(begin + STRETCH, cut[1:][doc])
        where = np.maximum(begin - self.reach, cut[:-1][doc])
        state = np.zeros(len(doc), np.int64)
        while len(where):
            weight, state = self.step(state, self.token[where])
            counted = where >= begin
            out[where[counted]] = weight[counted]
            where = where + 1
            on = where < stop
            where, begin, stop, state = where[on], begin[on], stop[on], state[on]
        out[cut[:-1]] = 0  # a start is no token of the text
        return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, n: int, v: int, mu: float):
    schema = common.arrow_schema(RESULT)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return schema.empty_table()
        data = docs["text"].cast(pa.binary()).to_pylist()
        token, cut = tokens(data)
        rows = sorted(zip(answers["gram"].to_pylist(), answers["shard"].to_pylist(), answers["totals"].to_pylist()))
        counts, which, spots = [], [], []
        for k, (keys, at) in enumerate(grams(token, cut, order), 1):
            counts.append(np.concatenate([np.zeros(0, np.int64), *(widen(x[2]) for x in rows if x[0] == k)]).astype(np.float64))
            turn = np.argsort(keys)
            s = keys[turn]
            index = np.empty(len(keys), np.int32)
            index[turn] = np.cumsum(np.append(True, s[1:] != s[:-1])[: len(s)]) - 1
            which.append(index)
            spots.append(at)
        automaton = Automaton(counts, which, spots, len(token), n, v, mu)
        weight = automaton.read(cut)
        known, base = np.zeros(len(token), np.int64), np.zeros(len(token))
        known[spots[0]] = counts[0][which[0]] > 0
        base[spots[0]] = automaton.root[which[0]]
        sums = [np.add.reduceat(x, cut[:-1]) for x in (known, base, weight)]
        return pa.Table.from_batches([common.batch(schema, docs["doc_id"].combine_chunks(), docs["held_out"].combine_chunks(), np.diff(cut) - 1, sums[0], np.full(len(data), n), sums[1], sums[2])])

    return run


def score(docs: DataFrame, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all whole texts by a model of the texts that are not held out.

    A document is held out if crc32 of its doc_id as text leaves 1 modulo 5; a null doc_id is not. A null text counts as
    empty: its one token is the end. Repeated rows count and are scored one by one; other columns are not read. n-grams are
    told apart by 64-bit hashes. A document longer than block_bytes is a block by itself or part of a larger one.
    """
    rows = common.texts(docs).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    blocks = max(1, -(-((size[0] or 0) + 16 * size[1]) // block_bytes))
    bits = (blocks - 1).bit_length()
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)))
    asked = placed.groupBy("block").applyInArrow(_ask(bits, order), ASK)
    answers = common.stored(asked.groupBy("shard", "gram").applyInArrow(_answer(), ANSWER), "gram-counts")
    total = answers.agg(F.sum("n"), F.sum("v")).first()
    scored = placed.groupBy("block").cogroup(answers.select("block", "shard", "gram", "totals").groupBy("block"))
    return scored.applyInArrow(_score(order, total[0] or 0, total[1] or 0, mu), RESULT)


def op8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
