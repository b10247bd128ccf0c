"""Licence scan (operator 6): TF-IDF cosine to templates, then inheritance from the nearest directory above.

Every line of a text, and the text as a whole, is a sparse TF-IDF vector; its licence is that of the template with the
highest cosine, if that reaches THRESHOLD. Lines, runs of adjacent blocks of lines and whole texts are likewise compared
with full licences and source headers (notices.py); there counts are damped, as the words that all English shares would
outweigh the others in texts of thousands of words. A text that is a licence and little else is a licence file of its
directory; files without a licence of their own take that of the nearest directory at or above theirs.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, notices

THRESHOLD = 0.75
#: A licence file's matched part holds this share of its words at least.
FILE_SHARE = 0.5
CHUNK = 1 << 20
#: A run of lines is so many adjacent blocks at most; a block ends at an empty line or where a comment begins or ends.
RUN = 16
#: Usual wordings of licence notices, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style 3-clause license."),
)
#: Marks around words, those of comments among them.
EDGES = ".,;:!?\"'()[]`*#/<>-=%"
_COMMENT = np.frombuffer(b"*#/;%<-", np.uint8)
_EDGE = np.frombuffer(EDGES.encode(), np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(text: str) -> list[str]:
    """Words without marks around them, A-Z in lower case."""
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)
    return [w for w in (x.strip(EDGES) for x in re.split(common.WORD_BREAK, lower)) if w]


class Templates:
    """TF-IDF vectors of templates; a word that no template holds has the weight of one that none would."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        counts = [Counter(words(t)) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        n = len(templates)
        every = sorted(df)
        data = [w.encode() for w in every]
        ends = np.cumsum([len(d) for d in data]).astype(np.int64)
        hashes = common.span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.unknown = math.log(1 + n) + 1
        self.idf = np.array([math.log((1 + n) / (1 + df[w])) + 1 for w in every])[order]
        vectors = np.array([[c[w] for w in every] for c in counts], float)[:, order] * self.idf
        self.vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]


class Notices:
    """TF-IDF vectors of long templates, counts damped by 1 + log."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        counts = [Counter(words(t)) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        n = len(templates)
        every = sorted(df)
        hashes = _hashes(every)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.unknown = math.log(1 + n) + 1
        self.idf = np.array([math.log((1 + n) / (1 + df[w])) + 1 for w in every])[order]
        vectors = np.array([[1 + math.log(c[w]) if w in c else 0.0 for w in every] for c in counts])[:, order] * self.idf
        self.vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        self.squares = self.vectors**2
        marks = sorted(notices.SPDX)
        self.spdx = dict(zip(_hashes(marks).tolist(), (notices.SPDX[m] for m in marks)))
        self.spdx_mark = _hashes(["spdx-license-identifier"])[0]

    def covered(self, columns: np.ndarray) -> np.ndarray:
        """The square of the highest cosine that a unit of these words and no others can have with each template."""
        return self.squares[:, columns].sum(axis=1)

    def nearest(self, word: np.ndarray) -> tuple[float, str]:
        distinct, tf = np.unique(word, return_counts=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
        hit = self.hashes[at] == distinct
        value = (1 + np.log(tf)) * np.where(hit, self.idf[at], self.unknown)
        dots = self.vectors[:, at[hit]] @ value[hit] / math.sqrt((value * value).sum())
        top = int(dots.argmax())
        return float(dots[top]), self.names[top]

    def hits(self, word: np.ndarray, line: np.ndarray, comment: np.ndarray, threshold: float):
        """Of one text's words: score, name and words of each unit that reaches the threshold."""
        for i in np.flatnonzero(word[:-1] == self.spdx_mark).tolist():
            if line[i] == line[i + 1] and int(word[i + 1]) in self.spdx:
                yield 1.0, self.spdx[int(word[i + 1])], 2
        at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
        known = np.where(self.hashes[at] == word, at, -1)
        least = (threshold - 1e-12) ** 2
        if not len(word) or self.covered(np.unique(known[known >= 0])).max() < least:
            return
        new_line = np.append(True, np.diff(line) != 0)
        new_block = np.append(True, (np.diff(line) > 1) | (np.diff(comment) != 0))
        units = set()
        lines = np.append(np.flatnonzero(new_line), len(word)).tolist()
        units.update(zip(lines[:-1], lines[1:]))
        blocks = np.append(np.flatnonzero(new_block), len(word)).tolist()
        for k in range(len(blocks) - 1):
            units.update((blocks[k], end) for end in blocks[k + 1 : k + 1 + RUN])
        units.add((0, len(word)))
        # Units from one place on: where the longest cannot reach the threshold, none can.
        by_start: dict[int, list[int]] = {}
        for i, j in units:
            by_start.setdefault(i, []).append(j)
        for i in sorted(by_start):
            for j in sorted(by_start[i], reverse=True):
                seen = known[i:j]
                if self.covered(np.unique(seen[seen >= 0])).max() < least:
                    break
                score, name = self.nearest(word[i:j])
                if score >= threshold - 1e-12:
                    yield score, name, j - i


def _hashes(every: list[str]) -> np.ndarray:
    data = [w.encode() for w in every]
    ends = np.cumsum([len(d) for d in data]).astype(np.int64)
    return common.span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends)


def matches(known: Templates, documents: list[bytes], threshold: float, long: Notices | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """Of each document the licence or None, its cosine, and the largest share of its words in a unit of that licence."""
    raw = _LOWER[np.frombuffer(b"\n".join(documents) + b"\n", np.uint8)]
    ends = np.cumsum([len(d) + 1 for d in documents])
    a, b = common.word_spans(raw)
    breaks = np.flatnonzero(raw == 10)
    # Does the line of a word begin with the mark of a comment?
    of_line = np.searchsorted(breaks, a)
    head = np.append(True, np.diff(of_line) != 0)[: len(a)]
    comment = np.isin(raw[a[head]], _COMMENT)[np.cumsum(head) - 1].astype(np.int8) if len(a) else np.zeros(0, np.int8)
    # The first byte at or behind, and the last before each place, that is no mark.
    edge, place = np.isin(raw, _EDGE), np.arange(len(raw))
    behind = np.minimum.accumulate(np.where(edge, len(raw), place)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(edge, -1, place))
    if len(a):
        a = np.minimum(behind[a], b)
        b = np.maximum(before[b - 1] + 1, a)
    comment = comment[a < b]
    a, b = a[a < b], b[a < b]
    n = len(documents)
    best, name, share = np.zeros(n), [None] * n, np.zeros(n)
    most_of: dict[tuple[int, str], float] = {}

    def take(d: int, score: float, licence: str, count: int) -> None:
        most_of[d, licence] = max(most_of.get((d, licence), 0.0), count / size[d])
        if score > best[d] + 1e-12:
            best[d], name[d] = score, licence

    doc = np.searchsorted(ends, a, "right")
    size = np.bincount(doc, minlength=n)
    line = np.searchsorted(breaks, a)
    word = common.span_hashes(raw, a, b)
    at = np.minimum(np.searchsorted(known.hashes, word), len(known.hashes) - 1)
    hit = known.hashes[at] == word
    weight = np.where(hit, known.idf[at], known.unknown)
    for unit in (line, doc):  # both ascend
        if not len(unit):
            break
        begin = np.flatnonzero(np.diff(unit, prepend=-1))
        # The cosine is at most this share of the unit's weights, whatever the counts; units below are out.
        most = np.add.reduceat(weight * hit, begin) / np.sqrt(np.add.reduceat(weight * weight, begin))
        length = np.diff(np.append(begin, len(unit)))
        open_ = np.repeat(most >= threshold, length)
        if not open_.any():
            continue
        pick = np.flatnonzero(open_)
        order = pick[np.lexsort((word[pick], unit[pick]))]
        new = np.append(True, (unit[order][1:] != unit[order][:-1]) | (word[order][1:] != word[order][:-1]))
        lead = order[new]
        tf = np.diff(np.append(np.flatnonzero(new), len(order)))
        value = tf * weight[lead]
        first = np.flatnonzero(np.diff(unit[lead], prepend=-1))
        norm = np.sqrt(np.add.reduceat(value * value, first))
        dots = np.add.reduceat((value * hit[lead])[:, None] * known.vectors[:, at[lead]].T, first, axis=0) / norm[:, None]
        top = dots.argmax(axis=1)
        score = dots[np.arange(len(top)), top]
        count = np.add.reduceat(tf, first)
        for d, s, t, c in zip(doc[lead[first]].tolist(), score.tolist(), top.tolist(), count.tolist()):
            if s >= threshold - 1e-12:
                take(d, s, known.names[t], c)
    if long is not None:
        # Few texts hold words enough of any notice; the rest are left out by the bound of covered().
        for d, (i, j) in enumerate(zip(np.searchsorted(doc, np.arange(n)).tolist(), np.searchsorted(doc, np.arange(n), "right").tolist())):
            for s, licence, c in long.hits(word[i:j], line[i:j], comment[i:j], threshold):
                take(d, s, licence, c)
    for d, licence in enumerate(name):
        share[d] = most_of[d, licence] if licence else 0.0
    return name, best, share


def found(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """A struct column over text: licence, score, share."""
    known, long = Templates(templates), Notices(notices.NOTICES)

    @F.arrow_udf("struct<licence: string, score: double, share: double>")
    def run(text: pa.Array) -> pa.Array:
        data = text.cast(pa.binary()).to_pylist()
        names, scores, shares = [], [np.zeros(0)], [np.zeros(0)]
        for i, j in common.chunks([len(d) for d in data], CHUNK):
            x, y, z = matches(known, data[i:j], threshold, long)
            names += x
            scores.append(y)
            shares.append(z)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(shares))], ["licence", "score", "share"])

    return run(F.coalesce("text", F.lit("")))


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """files has doc_id, path and text; the result doc_id, path, own (licence or null), score, is_file, licence, origin.

    origin is the directory that a licence comes from, the path itself for an own one, null without one. Of several licence
    files in a directory the one with the best score counts, then the least licence name. A null text has no
    licence; a null path lies in the root directory. Repeated rows are scanned one by one; other columns are not read.
    """
    own = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), found(templates).alias("f")).select(
        "doc_id", "path", F.col("f.licence").alias("own"), "f.score", (F.col("f.licence").isNotNull() & (F.col("f.share") >= FILE_SHARE)).alias("is_file")
    )
    own = common.stored(own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licences")
    givers = own.filter("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("own"))).alias("g")).select("dir", F.col("g.own").alias("given"))
    # Directories are few beside files: each is joined to those above it, and the deepest that gives a licence stays.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    levels = own.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = levels.join(givers.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "given"), F.length("up")).alias("n"))
    out = own.join(nearest, "dir", "left")
    return out.select("doc_id", "path", "own", "score", "is_file", F.coalesce("own", "n.given").alias("licence"), F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("n.up")).alias("origin"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in a directory for each thousand of ids below one for the language below one for the source."""
    docs = common.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
