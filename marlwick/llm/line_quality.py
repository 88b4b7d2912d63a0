"""Quality rules by line sequence labelling.

The lines of a document are a sequence; a linear-chain conditional random field over properties of the lines says of each
whether it is content or boilerplate (Viterbi decoding), and the share of the document's characters that stand in content
lines decides whether it is kept.

The field is fitted, by penalised likelihood around the weights PRIOR, on at most TRAIN_DOCS labelled documents (half of them of
either quality, as far as there are so many; chosen by a hash of doc_id), of each on the first TRAIN_LINES lines, whose
features are made where the texts are.  A line's label is its document's quality, or
boilerplate for a licence line.  These bounds concern the fit alone: every document is labelled and judged, with its whole text.
Without labels the weights are PRIOR.

Defined cases: lines end at line feeds; blank lines count for nothing.  Null, empty and blank texts have no content and are
rejected (share 0).  Each row is judged by itself, so repeated rows share their fate and missing ids do no harm.  Labels that
are null, or contradict one another for one doc_id, are not used; of several texts of one doc_id the least teaches.  Columns other than doc_id, text and quality are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

TRAIN_DOCS, TRAIN_LINES, KEEP_SHARE = 2000, 500, 0.4
BOILERPLATE, CONTENT = 0, 1

_LICENCE = re.compile(r"\b(?:licen[sc]ed? under|all rights reserved|copyright (?:\(c\)|©|\d)|spdx-license|cookie policy|terms of (?:use|service)|privacy policy)\b", re.I)

FEATURES = ("bias", "capitals", "symbols", "bars", "digits", "repeats", "sameness", "longwords", "brief", "licence", "again", "stop", "bangs")
#: Weights towards content, before any training: prose with ordinary shares of everything is content.
PRIOR = np.array([2.0, -4.0, -12.0, -6.0, -3.0, -6.0, -3.0, -2.0, -0.3, -4.0, -1.0, 0.5, -4.0])
#: Log weights of (from, to), and of the first line's label.
PRIOR_STEP, PRIOR_START = np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2)

# classes of bytes: 0 other, 1 capital, 2 small letter, 3 digit, 4 space, 5 symbol, 6 vertical bar
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 1, 2, 3, 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"]], _CLASS[ord("|")] = 5, 6


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, document number) of each line that isn't blank."""
    lines: list[str] = []
    of: list[int] = []
    stats: list[tuple] = []
    for d, text in enumerate(texts):
        seen: set[str] = set()
        for line in (text or "").split("\n"):
            words = line.split()
            if not words:
                continue
            n = len(words)
            repeats = sum(map(eq, words, words[1:]))
            distinct = len(set(words))
            # of n words of prose, about n ** 0.8 differ
            sameness = 0.0 if n < 20 else max(0.0, 1 - distinct / n**0.8)
            letters = len(line) - n + 1
            stats.append((repeats / n, sameness, letters / n > 14, n < 3, "icen" in line and bool(_LICENCE.search(line)) or "ights" in line and bool(_LICENCE.search(line)) or "opyright" in line and bool(_LICENCE.search(line)), line in seen, line.rstrip()[-1] in ".!?:;…\"'", line.count("!!") / n))
            seen.add(line)
            lines.append(line)
            of.append(d)
    if not lines:
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # shares of classes of characters, over the bytes of all lines at once
    coded = [x.encode("utf-8", "replace") for x in lines]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8)
    kind = _CLASS[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1  # Latin-1 letters in UTF-8
    kind[after] = np.where(data[after] < 0x9F, 1, 2)
    starts = np.append(0, np.cumsum(sizes)[:-1])
    capital, small, digit, symbol, bar = (np.add.reduceat(kind == k, starts, dtype=np.int64) for k in (1, 2, 3, 5, 6))
    s = np.array(stats, np.float64)
    x = np.empty((len(lines), len(FEATURES)))
    x[:, 0] = 1
    x[:, 1] = capital / np.maximum(capital + small, 1) * (capital + small > 5)
    x[:, 2] = symbol / sizes
    x[:, 3] = np.minimum(bar / sizes * 8, 1)
    x[:, 4] = digit / sizes
    x[:, 5:] = s
    return x, np.fromiter(map(len, lines), np.int64, len(lines)), np.array(of, np.int64)


class Field:
    """A linear-chain conditional random field with the labels BOILERPLATE and CONTENT."""

    def __init__(self, weights=PRIOR, step=PRIOR_STEP, start=PRIOR_START):
        self.weights, self.step, self.start = (np.array(a, np.float64) for a in (weights, step, start))

    def decode(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Viterbi labels of the lines; ties go to content."""
        gain = (x @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.step.tolist()
        b0, c0 = self.start.tolist()
        labels = np.zeros(len(gain), np.int64)
        ends = np.append(np.flatnonzero(np.diff(of)) + 1, len(of)).tolist() if len(of) else []
        at = 0
        for end in ends:
            b, c, back = b0, c0 + gain[at], []
            for g in gain[at + 1 : end]:
                from_b, from_c = b + bb > c + cb, b + bc > c + cc
                back.append((from_b, from_c))
                b, c = (b + bb if from_b else c + cb), (b + bc if from_c else c + cc) + g
            label = CONTENT if c >= b else BOILERPLATE
            labels[end - 1] = label
            for i in range(len(back) - 1, -1, -1):
                label = BOILERPLATE if back[i][label] else CONTENT
                labels[at + i] = label
            at = end
        return labels

    @classmethod
    def fit(cls, x: np.ndarray, of: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 0.5, stiff: float = 500.0) -> Field:
        """Gradient ascent (Adam) on the penalised log likelihood of the label sequences, around the prior.

        Labels of lines come from documents, which makes neighbours look more alike than they are; so transitions are held
        closer to the prior (stiff) than the weights are (penalty).
        """
        self = cls()
        if not len(of):
            return self
        ends = np.append(np.flatnonzero(np.diff(of)) + 1, len(of))
        starts = np.append(0, ends[:-1])
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        live = [int((length > t).sum()) for t in range(int(length[0]))]
        truth = np.zeros((len(of), 2))
        truth[np.arange(len(of)), y] = 1
        inner = np.ones(len(of), bool)
        inner[starts] = False
        pairs = np.flatnonzero(inner)
        steps = np.zeros((2, 2))
        np.add.at(steps, (y[pairs - 1], y[pairs]), 1)
        first = truth[starts].sum(0)
        theta, base = np.concatenate([self.weights, self.step.ravel(), self.start]), np.concatenate([PRIOR, PRIOR_STEP.ravel(), PRIOR_START])
        k, m, v = len(PRIOR), 0.0, 0.0
        pull = np.append(np.full(k, penalty), np.full(6, stiff))
        for r in range(1, rounds + 1):
            w, step, start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
            score = np.zeros((len(of), 2))
            score[:, CONTENT] = x @ w
            ahead, behind = np.zeros((len(of), 2)), np.zeros((len(of), 2))
            ahead[starts] = start + score[starts]
            for t in range(1, len(live)):
                i = starts[: live[t]] + t
                prev = ahead[i - 1]
                ahead[i] = np.logaddexp(prev[:, :1] + step[0], prev[:, 1:] + step[1]) + score[i]
            for t in range(len(live) - 1, 0, -1):
                i = starts[: live[t]] + t
                nxt = behind[i] + score[i]
                behind[i - 1] = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
            last = starts + length - 1
            total = np.empty(len(of))
            z = np.logaddexp(ahead[last, 0], ahead[last, 1])
            for s, n, value in zip(starts.tolist(), length.tolist(), z.tolist()):
                total[s : s + n] = value
            p = np.exp(ahead + behind - total[:, None])
            joint = np.exp(ahead[pairs - 1][:, :, None] + step + (score[pairs] + behind[pairs])[:, None, :] - total[pairs][:, None, None]).sum(0)
            slope = np.concatenate([x.T @ (truth - p)[:, CONTENT], (steps - joint).ravel(), first - p[starts].sum(0)]) - pull * (theta - base)
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + 0.05 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
        return cls(theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """The field fitted on at most so many labelled documents."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    told = told.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    # the most rows of either quality: a bounded top of a fixed order
    halves = [told.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2).select("doc_id", "quality") for q in (0, 1)]
    chosen = halves[0].union(halves[1]).toArrow()
    if not chosen.num_rows:
        return Field()
    picked = docs.sparkSession.createDataFrame(list(zip(chosen["doc_id"].to_pylist(), chosen["quality"].to_pylist())), "_picked long, quality int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_picked")).where("text IS NOT NULL").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            x, _, of = line_features(part["text"])
            rows = [x[of == i][:TRAIN_LINES].astype(np.float32).tobytes() for i in range(len(part["text"]))]
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(part["quality"], pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "quality", "x"])

    rows = sorted(lean(texts).mapInArrow(features, "doc_id long, quality int, x binary").toArrow().to_pylist(), key=lambda r: r["doc_id"])
    each = [np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in rows]
    if not sum(map(len, each)):
        return Field()
    x, n = np.concatenate(each), [len(e) for e in each]
    of, y = np.repeat(np.arange(len(n)), n), np.repeat(np.array([r["quality"] for r in rows], np.int64), n)
    y[x[:, FEATURES.index("licence")] > 0] = BOILERPLATE
    return Field.fit(x, of, y)


def judge(texts: list[str | None], field: Field) -> list[tuple[int, int, float]]:
    """(lines, content lines, content share) of each text."""
    x, size, of = line_features(texts)
    good = field.decode(x, of)
    n, total = np.bincount(of, minlength=len(texts)), np.bincount(of, size, len(texts))
    content, chars = np.bincount(of, good, len(texts)), np.bincount(of, good * size, len(texts))
    return list(zip(n.tolist(), content.astype(int).tolist(), (chars / np.maximum(total, 1)).tolist()))


def line_quality(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE, most: int = TRAIN_DOCS) -> DataFrame:
    """Rows (doc_id, n_lines, content_lines, content_share, keep) for every document."""
    field = train(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = judge(part["text"], field)
            share = np.array([r[2] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(share), pa.array((share >= keep_share) & (share > 0))], ["doc_id", "n_lines", "content_lines", "content_share", "keep"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_lines int, content_lines int, content_share double, keep boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE, most: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, in one pass."""
    field, place = train(docs, labels, most), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                share = np.array([r[2] for r in judge(part.column(place).to_pylist(), field)])
                yield part.filter(pa.array((share >= keep_share) & (share > 0)))

    return lean(docs).mapInArrow(run, docs.schema)
