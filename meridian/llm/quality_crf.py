"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and its neighbours'; forward-backward gives each line's marginal,
and their mean, weighted by length, is the document's quality, calibrated by isotonic regression. The field is fitted by
gradient ascent on a bounded sample (rows and lines) in which a document's label stands for its lines'; a document's
calibration row comes from a field that did not see it. Scoring is one pass over whole texts without a shuffle, a bounded
number of lines at a time: a line's emission is a sum over its own features and its neighbours', and a very long chain is
cut into spans that overlap by so many lines that the marginals are the same to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import calibrated, isotonic
from .scratch import Scratch
from .textcore import DIGIT, LETTER, SIGN, UPPER, WHITE, chunks, word_hashes, words
from .training import held_out, labelled_sample

OWN = 14
#: Lines whose features are held at once; lines of a span of a long chain, and of its overlap on either side. Transitions
#: lie within 2 of each other's mean, so a line's influence shrinks by tanh(2) = 0.964 a line at least: 0.964**1024 < 1e-16.
PIECE, SPAN, HALO = 1 << 16, 1 << 15, 1 << 10
_PLAIN_SIGN = np.zeros(256, bool)
_PLAIN_SIGN[[*b".,;:'\"!?()-"]] = True


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all lines, and n+1 offsets of each document's lines among them.

    A line ends at a newline; every document, an empty one too, has at least one line.
    """
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offs, breaks, "right") - 1
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    loff = np.concatenate([[0], np.cumsum(1 + np.bincount(owner, minlength=len(offs) - 1))]).astype(np.int64)
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[loff[1:] - 1] = offs[1:]
    return np.minimum(starts, ends), ends, loff


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, OWN): length, words, letters, capitals, digits, signs, repeats and the like of each line."""
    size = np.maximum(ends - starts, 1)
    within = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[ends] - c[starts]
    ws, we, _ = words(data, np.unique(np.concatenate([[0, len(data)], starts, ends])))
    first, after = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    count = np.maximum(after - first, 1)
    h = word_hashes(data, ws, we) if len(ws) else np.zeros(0, np.uint64)
    same = np.zeros(len(ws) + 1)
    if len(ws) > 1:
        same[1:-1] = h[1:] == h[:-1]
    runs = np.concatenate([[0], np.cumsum(same[: len(ws)])])
    again = np.maximum(runs[after] - runs[np.minimum(first + 1, after)], 0)
    letters, sign = within(LETTER[data]), within(SIGN[data] & ~_PLAIN_SIGN[data])
    tail = np.where(ends > starts, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    longest = np.zeros(len(starts))
    if len(ws):
        np.maximum.at(longest, np.searchsorted(starts, ws, "right") - 1, (we - ws).astype(float))
    return np.stack(
        [
            np.log1p(ends - starts) / 5, np.log1p(after - first) / 4, letters / size, within(UPPER[data]) / np.maximum(letters, 1), within(DIGIT[data]) / size, sign / size,
            sign / count / 3, within(data == 124) / count, within(data == 33) / count, within(_PLAIN_SIGN[data]) / size, again / count, np.isin(tail, [46, 33, 63, 59]),
            within(WHITE[data]) / size, np.log1p(longest) / 5,
        ],
        axis=1,
    ).astype(float)


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Own features of PIECE lines at a time, from the bytes of these lines only."""
    for a in range(0, len(starts), PIECE):
        b = min(a + PIECE, len(starts))
        lo, hi = starts[a], ends[b - 1]
        yield a, b, own_features(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo)


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, 3 * OWN + 2) features, n+1 offsets of each document's lines, and the lines' lengths in bytes (1 at least).

    The features are the line's own, those of the line before and after it (zero at the ends), and whether it is the first
    or last. For the bounded sample; scoring doesn't form them (``emissions``).
    """
    starts, ends, loff = line_spans(data, offs)
    own = np.concatenate([x for _, _, x in _pieces(data, starts, ends)] or [np.zeros((0, OWN))])
    head, tail = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    head[loff[:-1]], tail[loff[1:] - 1] = True, True
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    before[head], behind[tail] = 0, 0
    return np.concatenate([own, before, behind, head[:, None], tail[:, None]], axis=1), loff, np.maximum(ends - starts, 1)


@dataclass
class Field:
    """Weights of "good" over features and bias, transition scores (from, to), and the features' means and scales."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def part(self, x: np.ndarray, at: int) -> np.ndarray:
        """What features that stand at column ``at`` add to the emission."""
        own = slice(at, at + x.shape[1])
        return np.clip((x - self.mean[own]) / self.scale[own], -8, 8) @ self.weights[own]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.part(x, 0) + self.weights[-1]


def emissions(field: Field, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's score of "good" by the field, n+1 offsets of each document's lines, and the lines' lengths."""
    starts, ends, loff = line_spans(data, offs)
    parts = np.empty((len(starts), 3))
    for a, b, x in _pieces(data, starts, ends):
        for k in range(3):
            parts[a:b, k] = field.part(x, k * OWN)
    edge = field.part(np.zeros((1, OWN)), OWN)[0], field.part(np.zeros((1, OWN)), 2 * OWN)[0]
    before, behind = np.concatenate([[0.0], parts[:-1, 1]]), np.concatenate([parts[1:, 2], [0.0]])
    before[loff[:-1]], behind[loff[1:] - 1] = edge
    head, tail = np.zeros((len(starts), 1)), np.zeros((len(starts), 1))
    head[loff[:-1]], tail[loff[1:] - 1] = 1, 1
    score = parts[:, 0] + before + behind + field.part(head, 3 * OWN) + field.part(tail, 3 * OWN + 1) + field.weights[-1]
    return score, loff, np.maximum(ends - starts, 1)


def forward_backward(score: np.ndarray, loff: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of "good" of every line, expected moves (2, 2) over all chains, and each chain's log partition sum.

    All chains advance a line at a time together, so the steps are as many as the longest has lines.
    """
    n, length = len(loff) - 1, np.diff(loff)
    order = np.argsort(-length, kind="stable")
    start, sizes = loff[:-1][order], length[order]
    emit = np.stack([np.zeros(len(score)), score], axis=1)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[start] = emit[start]
    lives = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if n else 0) + 1), "right")  # chains of at least t lines
    for t in range(1, len(lives)):
        at = start[: lives[t]] + t
        p = alpha[at - 1]
        alpha[at] = emit[at] + np.logaddexp(p[:, :1] + moves[0], p[:, 1:] + moves[1])
    pairs = np.zeros((2, 2))
    end = loff[1:] - 1
    log_z = np.logaddexp(alpha[end, 0], alpha[end, 1])
    by_chain = log_z[order]
    for t in range(len(lives) - 1, 0, -1):
        at = start[: lives[t]] + t
        q = emit[at] + beta[at]
        joint = alpha[at - 1][:, :, None] + moves[None] + q[:, None, :]
        pairs += np.exp(joint - by_chain[: lives[t], None, None]).sum(axis=0)
        beta[at - 1] = np.logaddexp(moves[:, 0] + q[:, :1], moves[:, 1] + q[:, 1:])
    chain = np.repeat(np.arange(n), length)
    return np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - log_z[chain], 0)), pairs, log_z


def marginals(score: np.ndarray, loff: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginal of "good" of every line; chains longer than SPAN are cut into overlapping spans."""
    length = np.diff(loff)
    out = np.empty(len(score))
    short = length <= SPAN + 2 * HALO
    if short.all():
        return forward_backward(score, loff, moves)[0]
    for which in np.flatnonzero(~short):
        lo, hi = loff[which], loff[which + 1]
        spans = [(max(lo, a - HALO), a, min(hi, a + SPAN), min(hi, a + SPAN + HALO)) for a in range(lo, hi, SPAN)]
        for k in range(0, len(spans), 32):  # about a million lines together
            own = spans[k : k + 32]
            p = forward_backward(np.concatenate([score[f:t] for f, _, _, t in own]), np.concatenate([[0], np.cumsum([t - f for f, _, _, t in own])]), moves)[0]
            at = 0
            for f, a, b, t in own:
                out[a:b] = p[at + a - f : at + b - f]
                at += t - f
    lines = np.repeat(short, length)
    out[lines] = forward_backward(score[lines], np.concatenate([[0], np.cumsum(length[short])]), moves)[0]
    return out


def fit_field(x: np.ndarray, loff: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.08, l2: float = 2e-3) -> Field:
    """Adam on chains whose lines all carry the document's label.

    Emissions follow the gradient of the log likelihood weighted by 1 / sqrt(lines) of a chain, moves that of the mean over
    all moves: a composite of two likelihoods, so that few very long documents decide neither.
    """
    if not len(y):
        return Field(np.zeros(x.shape[1] + 1), np.zeros((2, 2)), np.zeros(x.shape[1]), np.ones(x.shape[1]))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)
    good = np.repeat(y, np.diff(loff))
    # chains weigh alike whatever their length, else a few very long documents decide
    weight = np.repeat(1 / np.sqrt(np.diff(loff)), np.diff(loff))
    moved = (np.diff(loff) - 1).astype(float)
    seen = np.array([[moved[y == 0].sum(), 0], [0, moved[y == 1].sum()]])
    theta, m, v = np.zeros(z.shape[1] + 4), 0.0, 0.0
    for k in range(1, steps + 1):
        p, pairs, _ = forward_backward(z @ theta[:-4], loff, theta[-4:].reshape(2, 2))
        g = np.concatenate([z.T @ ((good - p) * weight) / len(y), (seen - pairs).ravel() / max(1.0, moved.sum())]) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -2, 2)  # a chain may still change its mind
    return Field(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)


def document_quality(field: Field, score: np.ndarray, loff: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of the lines' marginals, weighted by length."""
    p = marginals(score, loff, field.moves)
    return np.add.reduceat(p * size, loff[:-1]) / np.add.reduceat(size, loff[:-1]) if len(loff) > 1 else np.zeros(0)


def text_quality(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Calibrated quality, 0 to 1, of each text."""
    return np.clip(calibrated(document_quality(model["field"], *emissions(model["field"], data, offs)), model["knots"]), 0, 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in chunks(batches):
        x, loff, size = line_features(data, offs)
        rows = [(x[a:b].astype("<f4").tobytes(), size[a:b].astype("<i8").tobytes()) for a, b in zip(loff[:-1], loff[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["y", "fold", "x", "size"])


def fit(sample: DataFrame) -> dict:
    """The model from ``sample(y, fold, text)``, whose rows and lines the caller bounds."""
    rows = sample.select("y", "fold", "text").mapInArrow(_extract, "y int, fold int, x binary, size binary").collect()
    rows.sort(key=lambda r: (r.fold, r.y, bytes(r.x)))
    xs = [np.frombuffer(r.x, "<f4").reshape(-1, 3 * OWN + 2).astype(float) for r in rows]
    sizes = [np.frombuffer(r.size, "<i8") for r in rows]
    y, fold = np.array([r.y for r in rows], float), np.array([r.fold for r in rows])

    def stacked(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [xs[i] for i in which]
        loff = np.concatenate([[0], np.cumsum([len(a) for a in own])]).astype(np.int64)
        return (np.concatenate(own) if own else np.zeros((0, 3 * OWN + 2))), loff, (np.concatenate([sizes[i] for i in which]) if own else np.zeros(0))

    unseen = np.zeros(len(rows))
    for f in (0, 1):
        mine, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(mine):
            x, loff, _ = stacked(others)
            field = fit_field(x, loff, y[others])
            x, loff, size = stacked(mine)
            unseen[mine] = document_quality(field, field.emissions(x), loff, size)
    x, loff, _ = stacked(np.arange(len(rows)))
    return {"field": fit_field(x, loff, y), "knots": isotonic(unseen, y)}


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_quality(model, data, offs))], names=["id", "score"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, most_labelled: int = 6_000, most_lines: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Learns from at most ``most_labelled`` labelled documents, chosen by hash, and of these from as many, shortest first,
    as have ``most_lines`` lines together: what the driver gathers is bounded in rows and in lines."""
    scratch = Scratch(docs.sparkSession)
    sample = scratch.write(labelled_sample(docs, labels, "quality", modulus, rest, most_labelled, id_col, text_col), "sample")
    lines = sample.withColumn("lines", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    order = Window.orderBy("lines", F.xxhash64("text"), "y", "fold")  # a window over the bounded sample
    held = lines.withColumn("sum", F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= most_lines)
    return fit(scratch.write(held.select("y", "fold", "text"), "fitted"))


def score_column(docs: DataFrame, model: dict, key: str, text_col: str = "text") -> DataFrame:
    """(key, score) of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_score(model), f"id {kind}, score double").withColumnRenamed("id", key)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, rest: int = 0, most_labelled: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), one row for each row of ``docs``; ``labels(id, quality)``.

    A bounded sample of labelled rows is learned from (``fit_quality``), whatever the size of the tables. Null text counts
    as empty (one empty line) and gets a score too; ids may be null (held out) or repeated; other columns are ignored, an
    empty table gives an empty result. Without labels the score is a half.
    """
    model = fit_quality(docs, labels, modulus, rest, most_labelled, id_col=id_col, text_col=text_col)
    scored = score_column(docs, model, id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col), modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
