"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shape measures of itself and of the lines before and after it; the
chain's transitions tie neighbours. A document's quality is the mean of its lines' forward-backward marginals weighted by
their lengths, mapped to a probability by a logistic curve. Labels exist for documents only: lines first take their
document's label, and good-looking lines of bad documents are then relabelled before the chain is trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.llm import bytestats as B
from granulo.llm import hashing
from granulo.llm.common import chunks, in_arrow
from granulo.llm.labels import remainder, training_rows, within

#: Most labelled documents that are learned from, and lines of theirs; longer chains than PIECE lines are trained on in pieces.
MAX_TRAIN, MAX_LINES, PIECE = 6000, 400_000, 64
OWN = 13


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of texts: own features (OWN a line), lengths in bytes, and where each text's lines begin (one more entry).

    A text has one line more than newlines, so an empty text has one empty line. A line's newline has no length.
    """
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets)
    at = before + np.arange(len(offsets))
    at[-1] = before[-1] + len(offsets) - 1
    first = np.empty(at[-1], np.int64)
    first[at[:-1]] = offsets[:-1]
    others = np.ones(len(first), bool)
    others[at[:-1]] = False
    first[others] = breaks + 1
    bounds = np.append(first, len(data))
    size = np.diff(bounds)
    sums = lambda mask: B.sums(mask, bounds)

    start, stop = hashing.spans(~B.BLANK[data], offsets)
    h = hashing.hash_spans(data, start, stop)
    line = np.searchsorted(first, start, "right") - 1
    n = len(first)
    words = np.bincount(line, minlength=n)
    per = 1 / np.maximum(words, 1)
    repeat = np.zeros(len(h), bool)
    if len(h) > 1:
        repeat[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    length = stop - start
    letters = sums(B.LETTER[data])
    marks = B.SYMBOL[data]
    final = np.zeros(n)
    some = words > 0
    ends = np.searchsorted(line, np.arange(n), "right") - 1
    final[some] = np.isin(data[stop[ends[some]] - 1], np.frombuffer(b".!?:;\"')", np.uint8)) if len(stop) else 0
    solid = np.maximum(np.bincount(line, length, n), 1)
    x = np.stack([
        np.log1p(words), sums(B.upper_mask(data)) / np.maximum(letters, 1), sums(B.DIGIT[data]) / solid, np.minimum(sums(marks) * per, 5),
        np.minimum(sums(data == ord("|")) * per, 2), np.minimum(sums(data == ord("!")) * per, 3), np.minimum(sums(B.PUNCTUATION[data]) * per, 3),
        np.minimum(np.bincount(line, length, n) * per, 30) / 10, np.bincount(line, repeat, n) * per, np.bincount(line, length <= 3, n) * per,
        final, letters / solid, (words == 0).astype(float),
    ], 1)
    size -= 1
    size[at[1:] - 1] += 1  # a text's last line has no newline
    return x, size, at


def in_context(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after within the text (zeros where there is none), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[at[:-1]] = 0
    after[at[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


def marginals(node: np.ndarray, step: np.ndarray, at: np.ndarray, pairs: bool = False):
    """P(good) of every line by scaled forward-backward passes over all chains at once.

    ``node`` is a line's log-odds of good, ``step[a, b]`` the score of state b after a. With ``pairs``, also the expected
    number of each transition.
    """
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    start, long = at[:-1][order], size[order]
    e, t = np.exp(np.stack([np.zeros(len(node)), np.clip(node, -30, 30)], 1)), np.exp(step)
    alpha, beta = np.ones_like(e), np.ones_like(e)
    live = np.searchsorted(-long, -np.arange(long[0] + 1), "left") if len(long) else [0]
    for k in range(long[0] if len(long) else 0):
        i = start[: live[k]] + k
        a = e[i] if k == 0 else (alpha[i - 1] @ t) * e[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for k in range((long[0] if len(long) else 0) - 2, -1, -1):
        i = start[: live[k + 1]] + k
        ahead = e[i + 1] * beta[i + 1]
        b = ahead @ t.T
        if pairs:
            joint = alpha[i][:, :, None] * t[None] * ahead[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[i] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    good = p[:, 1] / p.sum(1)
    return (good, expected) if pairs else good


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    step: np.ndarray
    slope: float
    shift: float

    def lines(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return marginals(in_context((x - self.mean) / self.spread, at) @ self.weight, self.step, at)

    def quality(self, x: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        return by_length(self.lines(x, at), size, at)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.quality(*line_features(data, offsets)) + self.shift)))


def by_length(good: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Means of line marginals weighted by length; lines of no length count a little, so that every text has a mean."""
    weight = size + 1e-3
    return np.add.reduceat(good * weight, at[:-1]) / np.add.reduceat(weight, at[:-1]) if len(at) > 1 else np.empty(0)


def _adam(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, size: np.ndarray, at: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> Model:
    """The chain from lines (features, lengths, where documents begin) and document labels ``y``."""
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / spread
    wide = in_context(z, at)
    of = np.repeat(np.arange(len(y)), np.diff(at))
    line_y = y[of].astype(float)
    weight = np.sqrt(1.0 + size) / np.sqrt(1.0 + size).mean()
    own = np.concatenate([z, np.ones((len(z), 1))], 1)
    for _ in range(2):  # lines by themselves, then those of bad documents that look good count as good
        w = _adam(lambda w: own.T @ ((_sigmoid(own @ w) - line_y) * weight) / len(own) + l2 * w, np.zeros(own.shape[1]), 120, 0.1)
        looks = _sigmoid(own @ w)
        share = by_length((looks > 0.5).astype(float), size, at)
        line_y = np.where((y[of] == 0) & (looks > 0.5) & (share[of] < 0.5), 1.0, y[of])
    cuts = np.unique(np.concatenate([at, *[np.arange(a, b, PIECE) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if b - a > PIECE]]))
    inner = np.ones(len(x), bool)
    inner[cuts[:-1]] = False
    state = line_y.astype(int)
    pairs = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[pairs - 1], state[pairs]), 1)

    def gradient(p: np.ndarray) -> np.ndarray:
        good, expected = marginals(wide @ p[:-4], p[-4:].reshape(2, 2), cuts, True)
        return np.concatenate([wide.T @ (good - line_y), (expected - seen).ravel()]) / len(x) + l2 * p

    p = _adam(gradient, np.zeros(wide.shape[1] + 4), 150, 0.1)
    m = Model(mean, spread, p[:-4], p[-4:].reshape(2, 2), 1.0, 0.0)
    q = m.quality(x, size, at)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    curve = _adam(lambda c: np.array([((_sigmoid(c[0] * q + c[1]) - y) * balance * d).mean() for d in (q, 1.0)]) + 1e-4 * c, np.array([6.0, -3.0]), 300, 0.2)
    m.slope, m.shift = float(max(curve[0], 0.1)), float(curve[1])
    return m


#: Without labelled rows of both kinds: every line is good.
EVERY = Model(np.zeros(OWN), np.ones(OWN), np.r_[np.zeros(3 * OWN), 3.0], np.zeros((2, 2)), 6.0, -3.0)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labelled documents whose crc32 remainder is not ``held_out``; at most about MAX_TRAIN of them and MAX_LINES lines.

    The driver receives the line features of the sample (52 bytes a line), never texts. Documents are taken whole: where they
    have too many lines together, those with more than a hundredth of MAX_LINES are not learned from, and fewer of the others.
    """
    rows = training_rows(docs, labels, "quality", remainder(F.col("doc_id"), folds) != held_out, MAX_TRAIN, id_col, text_col)
    rows = within(rows, F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, MAX_LINES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                x, size, at = line_features(data, offsets)
                lists = lambda v, width: pa.ListArray.from_arrays(pa.array((at * width).astype(np.int32)), pa.array(v))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("y").slice(first, n), lists(x.astype(np.float32).ravel(), OWN), lists(size, 1)], names=["doc_id", "y", "x", "size"])

    got = in_arrow(rows.select("doc_id", "text", "y"), work, "doc_id long, y int, x array<float>, size array<long>").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return EVERY
    sizes = got["size"].combine_chunks()
    at = np.r_[0, np.cumsum(sizes.value_lengths().to_numpy())]
    x = got["x"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, OWN)
    return fit(x, sizes.flatten().to_numpy(), at, y)


def score(docs: DataFrame, model: Model, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, or, with ``keep``, those columns of ``docs`` in a struct ``row``, ``score`` and ``predicted``.

    One pass without a shuffle. Null texts score as empty ones; a null id is not held out; repeated rows score alike.
    """
    carried = F.struct(*[F.col(c) for c in keep]) if keep is not None else F.struct(F.col(id_col).cast("long").alias("doc_id"))
    rows = docs.select(carried.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(offsets) - 1), pa.array(model.score(data, offsets))], names=["row", "score"])

    out = in_arrow(rows, work, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    if keep is not None:
        return out.select("row", "score", predicted)
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), F.coalesce(remainder(doc_id, folds) == held_out, F.lit(False)).alias("held_out"), "score", predicted)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
