"""Quality classifier by co-training two views (operator 7).

One logistic model reads the text (words, and measures of its form), the other the page's metadata (language, source,
length). In each round either labels the documents that it is sure of for the other. Both are calibrated on labelled
rows left out of training, their log-odds are combined, and every document is scored. A document is good if its label
says quality 1 and not toxic.

Labelled rows are a bounded sample: LABELLED documents, taken by hash of doc_id. The exchange covers all other documents:
a pass over them sums, for each feature that the sample has, the shares of the documents that the other view is sure of.
A document shares itself out evenly among its features, and each feature enters the next fit as one good and one bad row.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LABELLED = 12_000
#: Exchanges between the views, how sure a view must be, and the weight of all that it says against that of the labelled rows.
ROUNDS, SURE, PSEUDO_WEIGHT = 2, 0.98, 0.2
#: Features stand in so many of the labelled documents at least.
MIN_DOCS = 4
#: A document is counted in these parts, so that sums do not depend on their order.
WHOLE = 1 << 20
#: A document is rejected below this probability of being good.
THRESHOLD = 0.5
CHUNK = 1 << 18
EDGES = np.frombuffer(b".,;:!?\"'()[]", np.uint8)
MARKS = np.frombuffer(b"#*$%&|<>", np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
DENSE = 8


def text_features(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' hashes of all documents, how many each has, and measures of form: one row of DENSE numbers each."""
    raw = LOWER[np.frombuffer(b"\n".join(documents) + b"\n", np.uint8)]
    n = len(documents)
    ends = np.cumsum([len(d) + 1 for d in documents])
    first, until = common.word_spans(raw)
    doc = np.searchsorted(ends, first, "right")
    words = np.bincount(doc, minlength=n)
    whole = common.span_hashes(raw, first, until)
    a, b = first.copy(), until.copy()
    for _ in range(2):  # marks around a word are no part of it
        a += (a < b) & np.isin(raw[np.minimum(a, len(raw) - 1)], EDGES)
        b -= (a < b) & np.isin(raw[b - 1], EDGES)
    word = common.span_hashes(raw, a, b)[a < b]
    own = doc[a < b]
    order = np.lexsort((word, own))
    s, o = word[order], own[order]
    new = np.append(True, (s[1:] != s[:-1]) | (o[1:] != o[:-1]))[: len(s)]
    words_of, count = s[new], np.bincount(o[new], minlength=n)
    # Three-word windows that recur in the text, and lines that do.
    some = np.flatnonzero(doc[2:] == doc[:-2])
    window = common.mixed(common.mixed(whole[some] * np.uint64(3) + whole[some + 1]) * np.uint64(5) + whole[some + 2])
    turn = np.lexsort((window, doc[some]))
    w, d = window[turn], doc[some][turn]
    again = np.zeros(len(w), bool)
    again[1:] = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    repeats = np.bincount(d[again], minlength=n)
    stops = np.flatnonzero(raw == 10)
    begins = np.append(0, stops[:-1] + 1)
    line = common.span_hashes(raw, begins, stops)
    owner = np.searchsorted(ends, begins, "right")
    real = stops - begins > 1
    line, owner = line[real], owner[real]
    turn = np.lexsort((line, owner))
    ls, os_ = line[turn], owner[turn]
    dup = np.zeros(len(ls), bool)
    dup[1:] = (ls[1:] == ls[:-1]) & (os_[1:] == os_[:-1])
    size = np.array([len(x) for x in documents], np.float64) + 1
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), np.append(0, ends[:-1]))
    dense = np.stack(
        [
            np.log1p(words),
            np.sqrt(total(np.isin(raw, MARKS)) / size),
            np.sqrt(repeats / np.maximum(words, 1)),
            np.sqrt(np.bincount(os_[dup], minlength=n) / np.maximum(np.bincount(os_, minlength=n), 1)),
            np.log(size / (words + 1)),
            np.sqrt(total((raw >= 48) & (raw <= 57)) / size),
            np.sqrt(total(raw >= 128) / size),
            count / np.maximum(words, 1),
        ],
        axis=1,
    )
    return words_of, count, dense


def page_features(lang: list, source: list, n_chars: list) -> tuple[np.ndarray, np.ndarray]:
    """Five hashed features for each row of metadata."""
    rows = []
    for a, b, c in zip(lang, source, n_chars):
        size = int(c or 0).bit_length()
        rows += [f"lang={a}", f"source={b}", f"size={size}", f"{a}:{size}", f"{b}:{a}"]
    data = [r.encode() for r in rows]
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum([len(d) for d in data]).astype(np.int64)
    return common.span_hashes(raw, ends - [len(d) for d in data], ends), np.full(len(lang), 5)


class Rows:
    """Sparse rows over a vocabulary of hashes, beside dense columns."""

    def __init__(self, vocabulary: np.ndarray, hashes: np.ndarray, counts: np.ndarray, dense: np.ndarray):
        column, hit = np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        for i in range(0, len(hashes) if len(vocabulary) else 0, CHUNK):  # 64-bit places of a part of the hashes at a time
            part = hashes[i : i + CHUNK]
            at = np.minimum(np.searchsorted(vocabulary, part), len(vocabulary) - 1)
            column[i : i + CHUNK], hit[i : i + CHUNK] = at, vocabulary[at] == part
        self.row, self.column = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[hit], column[hit]
        self.dense, self.n = dense, len(counts)

    def with_features(self, columns: np.ndarray) -> Rows:
        """These rows, and behind them one row for each of the columns that holds it alone."""
        out = Rows.__new__(Rows)
        out.row = np.append(self.row, np.arange(self.n, self.n + len(columns), dtype=np.int32))
        out.column = np.append(self.column, columns.astype(np.int32))
        out.dense = np.concatenate((self.dense, np.zeros((len(columns), self.dense.shape[1]))))
        out.n = self.n + len(columns)
        return out

    def score(self, model: Model) -> np.ndarray:
        return np.bincount(self.row, model.sparse[self.column], self.n) + self.dense @ model.dense + model.bias


class Model:
    """Logistic regression with L2 shrinkage, fitted by Adam over all rows at once."""

    def __init__(self, words: int, dense: int):
        self.sparse, self.dense, self.bias = np.zeros(words), np.zeros(dense), 0.0

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.1, shrink: float = 2e-4) -> Model:
        size = len(self.sparse)
        w = np.concatenate((self.sparse, self.dense, [self.bias]))
        m, v = np.zeros_like(w), np.zeros_like(w)
        total = weight.sum()
        for t in range(1, steps + 1):
            self.sparse, self.dense, self.bias = w[:size], w[size:-1], w[-1]
            error = weight * (sigmoid(rows.score(self)) - y) / total
            grad = np.concatenate((np.bincount(rows.column, error[rows.row], size), error @ rows.dense, [error.sum()]))
            grad[:-1] += shrink * w[:-1]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.sparse, self.dense, self.bias = w[:size], w[size:-1], w[-1]
        return self


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibration(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset that turn scores into log-odds: a logistic fit, drawn towards (1, 0), by damped Newton steps."""
    x = np.stack((score, np.ones_like(score)), 1)

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * ((w - [1.0, 0.0]) ** 2).sum()

    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - y) + (w - [1.0, 0.0]))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return max(float(w[0]), 0.0), float(w[1])


def vocabulary(hashes: np.ndarray, least: int) -> np.ndarray:
    every, n = np.unique(hashes, return_counts=True)
    return every[n >= least]


def fit_views(text: tuple, page: tuple, y: np.ndarray, left_out: np.ndarray, told: tuple | None = None) -> dict[str, np.ndarray]:
    """Both views' models. y: 1 good, 0 bad; left_out: rows kept for calibration; told: by view, the parts of documents that
    the other view holds to be good and to be bad, for each feature in order."""
    center, spread = text[2].mean(axis=0), text[2].std(axis=0) + 1e-6
    words, pages = vocabulary(text[0], MIN_DOCS), vocabulary(page[0], MIN_DOCS)
    views = [Rows(words, text[0], text[1], (text[2] - center) / spread), Rows(pages, page[0], page[1], np.zeros((len(y), 0)))]
    sizes = [(len(words), DENSE), (len(pages), 0)]
    train = ~left_out
    models = []
    for k, (size, rows) in enumerate(zip(sizes, views)):
        target, weight = y.astype(float), train.astype(float)
        if told is not None and told[k].sum():
            share = told[k] * (PSEUDO_WEIGHT * weight.sum() / told[k].sum())
            good, bad = np.flatnonzero(share[0]), np.flatnonzero(share[1])
            rows = rows.with_features(np.append(good, bad))
            target = np.concatenate((target, np.ones(len(good)), np.zeros(len(bad))))
            weight = np.concatenate((weight, share[0][good], share[1][bad]))
        models.append(Model(*size).fit(rows, target, weight))
    check = left_out if left_out.any() and 0 < y[left_out].mean() < 1 else train
    scores = [r.score(m)[check] for r, m in zip(views, models)]
    fits = [calibration(s, y[check].astype(float)) for s in scores]
    prior = float(np.log(y[check].mean() / (1 - y[check].mean())))
    joint = sum(a * s + b for s, (a, b) in zip(scores, fits)) - prior
    mix = calibration(joint, y[check].astype(float))
    return {
        "words": words, "pages": pages, "center": center, "spread": spread,
        "text_sparse": models[0].sparse.astype(np.float32), "text_dense": models[0].dense, "page_sparse": models[1].sparse.astype(np.float32),
        "numbers": np.array([models[0].bias, models[1].bias, *fits[0], *fits[1], prior, *mix]),
    }


def _views(model: dict[str, np.ndarray], text: tuple, page: tuple) -> tuple[Rows, np.ndarray, Rows, np.ndarray]:
    """The rows of either view, and their uncalibrated scores."""
    bias_t, bias_p = model["numbers"][:2]
    t, p = Model(0, 0), Model(0, 0)
    t.sparse, t.dense, t.bias = model["text_sparse"], model["text_dense"], bias_t
    p.sparse, p.dense, p.bias = model["page_sparse"], np.zeros(0), bias_p
    texts = Rows(model["words"], text[0], text[1], (text[2] - model["center"]) / model["spread"])
    pages = Rows(model["pages"], *page, np.zeros((len(page[1]), 0)))
    return texts, texts.score(t), pages, pages.score(p)


def sure_parts(rows: Rows, size: int, other: np.ndarray) -> np.ndarray:
    """For each feature of a view the parts of the documents that the other view's scores hold to be good, and to be bad."""
    share = WHOLE // np.maximum(np.bincount(rows.row, minlength=rows.n), 1)
    p = sigmoid(other)
    return np.stack([np.bincount(rows.column, (share * sure)[rows.row], size) for sure in (p >= SURE, p <= 1 - SURE)]).astype(np.int64)


def predict(model: dict[str, np.ndarray], documents: list[bytes], lang: list, source: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of being good: by the text, by the page, by both."""
    _, _, a_t, b_t, a_p, b_p, prior, slope, offset = model["numbers"]
    _, t, _, p = _views(model, text_features(documents), page_features(lang, source, n_chars))
    x, z = a_t * t + b_t, a_p * p + b_p
    return sigmoid(x), sigmoid(z), sigmoid(slope * (x + z - prior) + offset)


def _laid_out(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The bytes of all values as one array of numbers, without an object a value."""
    out = np.empty(pc.sum(pc.binary_length(column)).as_py() // np.dtype(kind).itemsize, kind)
    raw, begin = out.view(np.uint8), 0
    for c in column.chunks:
        _, ends, data = c.buffers()
        ends = np.frombuffer(ends, np.int32)[c.offset : c.offset + len(c) + 1]
        n = int(ends[-1] - ends[0])
        raw[begin : begin + n] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if n else 0
        begin += n
    return out


SAMPLE = "y int, left_out boolean, hashes binary, dense binary, page binary"


def _exchange(pool: DataFrame, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What either view tells the other about all documents of the pool: no more rows than the sample has features."""
    ddl = "view int, feature int, good long, bad long"
    schema = common.arrow_schema(ddl)
    sizes = len(model["words"]), len(model["pages"])

    def run(batches):
        told = [np.zeros((2, n), np.int64) for n in sizes]
        for b in common.parts(batches, 0, CHUNK):
            data = b.column(0).cast(pa.binary()).to_pylist()
            texts, t, pages, p = _views(model, text_features(data), page_features(*(b.column(k).to_pylist() for k in (1, 2, 3))))
            told[0] += sure_parts(texts, sizes[0], p)
            told[1] += sure_parts(pages, sizes[1], t)
        pa.default_memory_pool().release_unused()
        for view, x in enumerate(told):
            some = np.flatnonzero(x.any(axis=0))
            yield common.batch(schema, np.full(len(some), view, np.int32), some.astype(np.int32), x[0][some], x[1][some])

    out = tuple(np.zeros((2, n), np.int64) for n in sizes)
    summed = pool.select(F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars").mapInArrow(run, ddl).groupBy("view", "feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    for view in (0, 1):
        of = summed.filter(pc.equal(summed["view"], view))
        out[view][:, of["feature"].to_numpy()] = np.stack((of["good"].to_numpy(), of["bad"].to_numpy()))
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, np.ndarray] | None:
    """The models; None where labelled documents are missing or all alike.

    The labelled rows are found by hash of doc_id, about labelled of them at most, and their features computed where they
    lie; one task fits both views on them, whatever the input. The views' labels for all other documents come as sums.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")
    wanted = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int")).alias("y"))
    n_labels = wanted.count()
    if not n_labels:
        return None
    share = 2**63 - 1 if n_labels <= labelled else int(2.0**64 * labelled / n_labels) - 2**63
    chosen = F.broadcast(wanted.filter(F.xxhash64("doc_id", F.lit(7)) <= share))  # about labelled rows at most, so small enough to send to all
    some = rows.join(chosen, "doc_id").withColumn("left_out", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0)
    pool = rows.join(chosen, "doc_id", "left_anti")
    schema = common.arrow_schema(SAMPLE)

    def features(batches):
        for b in common.parts(batches, 0, CHUNK):
            data = b.column(0).cast(pa.binary()).to_pylist()
            hashes, counts, dense = text_features(data)
            page, _ = page_features(*(b.column(k).to_pylist() for k in (1, 2, 3)))
            cut = np.append(0, np.cumsum(counts)).tolist()
            yield common.batch(schema, b.column(4), b.column(5), [hashes[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], [d.tobytes() for d in dense], [page[5 * i : 5 * i + 5].tobytes() for i in range(len(data))])

    sample = common.stored(some.select("text", "lang", "source", "n_chars", "y", "left_out").mapInArrow(features, SAMPLE), "labelled")
    ordered = sample.repartition(1).sortWithinPartitions("hashes", "page")

    def train(told):
        def run(batches):
            got = pa.Table.from_batches(list(batches), schema=schema)  # bounded: the labelled sample
            y = got["y"].to_numpy().astype(np.int64)
            if not (y == 0).any() or not (y == 1).any():
                return
            stack = lambda c, kind: _laid_out(got[c], kind)
            counts = pc.binary_length(got["hashes"]).to_numpy() // 8
            text = stack("hashes", np.uint64), counts, stack("dense", np.float64).reshape(-1, DENSE)
            page, left_out = (stack("page", np.uint64), np.full(len(y), 5)), got["left_out"].to_numpy()
            del got
            pa.default_memory_pool().release_unused()
            data = io.BytesIO()
            np.savez(data, **fit_views(text, page, y, left_out, told))
            yield pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], ["model"])

        made = ordered.mapInArrow(run, "model binary").first()
        return dict(np.load(io.BytesIO(made[0]))) if made else None

    model = train(None)
    for _ in range(rounds if model else 0):
        model = train(_exchange(pool, model))
    return model


def scores(model: dict[str, np.ndarray] | None) -> Column:
    """A struct column over text, lang, source and n_chars: text_score, page_score, score and kept; without a model all are kept."""
    if model is None:
        none = F.lit(None).cast("double")
        return F.struct(none.alias("text_score"), none.alias("page_score"), none.alias("score"), F.lit(True).alias("kept"))

    @F.arrow_udf("struct<text_score: double, page_score: double, score: double, kept: boolean>")
    def run(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        out = [np.zeros((0, 3))]
        for i, j in common.chunks(pc.binary_length(text).to_pylist(), CHUNK):
            out.append(np.stack(predict(model, text.slice(i, j - i).cast(pa.binary()).to_pylist(), *(c.slice(i, j - i).to_pylist() for c in (lang, source, n_chars))), 1))
        got = np.concatenate(out)
        return pa.StructArray.from_arrays([*(pa.array(got[:, k]) for k in range(3)), pa.array(got[:, 2] >= THRESHOLD)], ["text_score", "page_score", "score", "kept"])

    return run(F.coalesce("text", F.lit("")), F.col("lang"), F.col("source"), F.col("n_chars"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_score, page_score, score, kept.

    A null text counts as empty; null metadata is a value of its own. Labels of unknown documents and null labels do not
    count; of contradicting labels the worse one does. Without labels of both kinds every document is kept and has no
    scores. Columns other than doc_id, text, lang, source and n_chars are not read.
    """
    model = fit(docs, labels)
    return docs.select("doc_id", scores(model).alias("s")).select("doc_id", "s.*")


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
