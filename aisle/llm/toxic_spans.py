"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, so the tokens of a bounded sample of labelled documents are labelled first:
in a toxic document, those whose word or beginning occurs in many toxic and in hardly any other
documents. The field has a weight per hashed token feature and four transitions and is fitted on
windows of those tokens. Every whole text is then read forward and backward; the marginals name the
offending offsets, and their sum and largest value, calibrated on the sample, give the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm import arrow
from aisle.llm.common import by_size, materialise

#: The fit reads so many labelled documents at most, drawn by hash, each of so many characters at most.
SAMPLE_ROWS = 4_000
SAMPLE_CHARS = 20_000
FEATURE_BITS = 18
WINDOW = 48
STEPS = 40
THRESHOLD = 0.3
CACHE_TOKENS = 400_000

_TOKEN = re.compile(r"\w+")


class Field(NamedTuple):
    """Weights of the features, log transitions, and the calibration of document scores."""

    weights: np.ndarray
    moves: np.ndarray
    scale: np.ndarray


def beginnings(token: str) -> tuple[str, str, str]:
    return "4" + token[:4], "5" + token[:5], "6" + token[:6]


def features(token: str) -> list[int]:
    """Hashed features: the word, its first four, five and six characters, its last three."""
    parts = ("w" + token, *beginnings(token), "e" + token[-3:])
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - FEATURE_BITS) for p in parts]


def _token_labels(docs: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Tokens to label in toxic documents, from counts over the distinct documents of the sample."""
    counts: dict[str, list[int]] = {}
    totals = [0, 0]
    seen = set()
    for tokens, label in zip(docs, toxic.tolist()):
        key = tuple(tokens)
        if key in seen:
            continue
        seen.add(key)
        totals[label] += 1
        for part in {p for t in set(tokens) for p in ("w" + t, *beginnings(t))}:
            counts.setdefault(part, [0, 0])[label] += 1
    least = max(4, 0.02 * totals[1])
    marked = {
        part
        for part, (clean, bad) in counts.items()
        if bad >= least and bad / max(totals[1], 1) > 20 * (clean + 0.5) / max(totals[0], 1)
    }
    words = {t for tokens in docs for t in tokens}
    return {t for t in words if "w" + t in marked or not marked.isdisjoint(beginnings(t))}


def _windows(docs: list[list[str]], toxic: np.ndarray, marked: set[str]):
    """Windows of tokens and labels; all with a marked token, and four times as many others."""
    with_marks, without = [], []
    for tokens, label in zip(docs, toxic.tolist()):
        for at in range(0, len(tokens), WINDOW):
            part = tokens[at : at + WINDOW]
            y = [int(label and t in marked) for t in part]
            (with_marks if any(y) else without).append((part, y))
    rng = np.random.default_rng(0)
    few = rng.permutation(len(without))[: 4 * len(with_marks) + 200]
    return with_marks + [without[i] for i in few]


def _fit_field(docs: list[list[str]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    marked = _token_labels(docs, toxic)
    windows = _windows(docs, toxic, marked)
    size = 1 << FEATURE_BITS
    weights, moves = np.zeros(size), np.zeros((2, 2))
    if not windows:
        return weights, moves
    rows = len(windows)
    known: dict[str, list[int]] = {}
    x = np.zeros((rows, WINDOW, 5), np.int32)
    y = np.zeros((rows, WINDOW), np.int8)
    inside = np.zeros((rows, WINDOW), bool)
    for i, (tokens, labels) in enumerate(windows):
        for t in tokens:
            if t not in known:
                known[t] = features(t)
        x[i, : len(tokens)] = [known[t] for t in tokens]
        y[i, : len(tokens)] = labels
        inside[i, : len(tokens)] = True
    seen_moves = np.zeros((2, 2))
    both = inside[:, 1:]
    np.add.at(seen_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
    weights[:] = 0.0
    bias = -3.0
    squares, move_squares, bias_square = np.full(size, 1e-6), np.full((2, 2), 1e-6), 1e-6
    for _ in range(STEPS):
        unary = np.where(inside, weights[x].sum(axis=2) + bias, 0.0)
        lift = np.exp(np.clip(unary, -30, 30))
        move = np.exp(moves)
        ahead = np.zeros((WINDOW, rows, 2))
        back = np.ones((WINDOW, rows, 2))
        now = np.stack([np.ones(rows), lift[:, 0]], axis=1)
        ahead[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, WINDOW):
            now = ahead[t - 1] @ move
            now[:, 1] *= lift[:, t]
            now = np.where(inside[:, t, None], now, ahead[t - 1])
            ahead[t] = now / now.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(WINDOW - 2, -1, -1):
            later = back[t + 1] * np.stack([np.ones(rows), lift[:, t + 1]], axis=1)
            now = later @ move.T
            on = inside[:, t + 1]
            pair = ahead[t][:, :, None] * move[None] * later[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            expected += pair[on].sum(axis=0)
            now = np.where(on[:, None], now, 1.0)
            back[t] = now / now.sum(axis=1, keepdims=True)
        chance = ahead * back
        chance = (chance[:, :, 1] / chance.sum(axis=2)).T
        error = np.where(inside, y - chance, 0.0)
        slope = np.bincount(x.ravel(), np.repeat(error.ravel(), 5), size) - 0.1 * weights
        squares += slope**2
        weights += 0.5 * slope / np.sqrt(squares)
        slope = seen_moves - expected - 0.01 * moves
        move_squares += slope**2
        moves = moves + 0.3 * slope / np.sqrt(move_squares)
        slope = error.sum()
        bias_square += slope**2
        bias += 0.3 * slope / np.sqrt(bias_square)
    return np.append(weights, bias), moves


def marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log odds of the toxic state at each token of all documents, laid end to end.

    All documents go one token at a time, the long ones last; forward and backward messages are the
    log odds of the two states.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[order]
    sizes = lengths[order]
    move = np.exp(moves)

    def step(odds: np.ndarray, m: np.ndarray) -> np.ndarray:
        x = np.exp(np.clip(odds, -30, 30))
        return np.log((x * m[1, 1] + m[0, 1]) / (x * m[1, 0] + m[0, 0]))

    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    ahead = emissions.copy()
    for t in range(1, longest):
        at = starts[: active[t]] + t
        ahead[at] += step(ahead[at - 1], move)
    back = np.zeros_like(emissions)
    turned = move.T
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        back[at] = step(emissions[at + 1] + back[at + 1], turned)
    return ahead + back


def _summaries(odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, the log of the expected number of toxic tokens, the largest marginal."""
    chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    filled = np.flatnonzero(lengths)
    at = (np.cumsum(lengths) - lengths)[filled]
    if len(filled):
        out[filled, 1] = np.add.reduceat(chance, at)
        out[filled, 2] = np.maximum.reduceat(chance, at)
    out[:, 1] = np.log(out[:, 1] + 0.05) - np.log(0.05)
    return out


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.05 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


class Tagger:
    """Reads texts with a fitted field; emissions of tokens are kept between batches."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, float] = {}

    def emission(self, token: str) -> float:
        w = self.field.weights
        return float(w[features(token)].sum() + w[-1]) if len(w) > 1 << FEATURE_BITS else -3.0

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [_TOKEN.findall(t.lower()) for t in texts]
        if len(self.known) > CACHE_TOKENS:
            self.known.clear()
        known = self.known
        for t in set().union(*tokens).difference(known):
            known[t] = self.emission(t)
        lengths = np.array([len(t) for t in tokens], np.int64)
        total = int(lengths.sum())
        flat = np.fromiter((known[t] for ts in tokens for t in ts), np.float64, total)
        return marginals(flat, lengths, self.field.moves), lengths

    def scores(self, odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_summaries(odds, lengths) @ self.field.scale, -30, 30)))


def fit(texts: list[str], toxic: list[int]) -> Field:
    """Fits field and calibration on labelled texts."""
    y = np.array(toxic, np.int64)
    docs = [_TOKEN.findall(t.lower()) for t in texts]
    if not len(y) or y.min() == y.max():
        return Field(np.zeros(1), np.zeros((2, 2)), np.array([-3.0 if not y.sum() else 3.0, 0, 0]))
    weights, moves = _fit_field(docs, y)
    tagger = Tagger(Field(weights, moves, np.zeros(3)))
    odds, lengths = tagger.read(texts)
    return Field(weights, moves, _calibrated(_summaries(odds, lengths), y))


def training_rows(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled documents whose remainder is not 2."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return (
        named.join(F.broadcast(known), "doc_id")
        .where(F.length("text") <= SAMPLE_CHARS)
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .select("text", "toxic")
    )


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    train_on: DataFrame | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, n_spans, spans``.

    ``spans`` lists start and end (code points, end exclusive) of tokens that are toxic rather than
    not. Null and empty texts have no tokens and get the lowest score; null ids are not held out;
    repeated rows score alike. Without labels of both kinds all scores are equal. An empty table
    gives an empty result. ``train_on`` names other documents to learn from. Other columns are not
    read.
    """
    learned = training_rows(docs if train_on is None else train_on, labels, doc_id, text).collect()
    field = fit([r.text for r in learned], [r.toxic for r in learned])
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        for piece, texts in arrow.chunks(batches, "text"):
            odds, lengths = tagger.read(texts)
            ends = np.cumsum(lengths)
            spans = []
            for t, n, end in zip(texts, lengths.tolist(), ends.tolist()):
                hits = np.flatnonzero(odds[end - n : end] > 0)
                if not len(hits):
                    spans.append([])
                    continue
                # lower-casing may change lengths, so offsets are taken from the text itself
                places = [m.span() for m in _TOKEN.finditer(t)]
                if len(places) != n:
                    places = [m.span() for m in _TOKEN.finditer(t.lower())]
                spans.append([{"start": places[k][0], "end": places[k][1]} for k in hits.tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array(tagger.scores(odds, lengths), pa.float64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "score", "n_spans", "spans"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(
        score, "doc_id long, score double, n_spans long, spans array<struct<start:long,end:long>>"
    )
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_spans",
        "spans",
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    plain = numbered.select(F.col("_row").alias(doc_id), F.col(text).alias(text))
    scored = score_documents(plain, labels, doc_id, text, threshold, train_on=docs)
    dropped = materialise(scored.where("predicted = 1").select(F.col("doc_id").alias("_row")), "toxic")
    return numbered.join(by_size(dropped), "_row", "left_anti").select(*docs.columns)
