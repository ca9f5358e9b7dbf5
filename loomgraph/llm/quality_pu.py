"""Quality classifier from trusted positives and unlabelled text.

Positive-unlabelled learning with the non-negative risk of Kiryo et al. (NIPS 2017): with class prior ``pi``,

    R(f) = pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)]),

where the second term estimates the negatives' risk from unlabelled text and may not fall below zero. ``f`` is a
small network over language-independent features of the whole text: how its characters follow each other by class,
how its words repeat, and how long they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import words as W
from loomgraph.llm.frames import hash_below, map_rows, one_text_each
from loomgraph.llm.language_id import fold

# The network is fit on at most so many rows of each kind, those whose ids have the smallest hashes.
SAMPLE_POSITIVES = 4000
SAMPLE_UNLABELLED = 10_000
HIDDEN = 24
EPOCHS = 60
BATCH = 500
RATE = 0.004
DECAY = 1e-4
SEED = 11

# Character classes of bytes: lower, upper, digit, space, new line, sentence marks, quotes and brackets, joins,
# bar and markup, other symbols, bytes of non-ASCII characters, controls.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "\"'()[]{}", "-_/", "|<>=", "#*$%&@^~`+\\", "!?")
N_CLASSES = len(_CLASSES) + 2
_CLASS = np.full(256, N_CLASSES - 1, np.uint8)
_CLASS[128:] = N_CLASSES - 2
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
N_STYLE = 12
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + N_STYLE


def _style(data: bytes) -> list[float]:
    words = W.hashes(data)
    n = len(words)
    if not n:
        return [0.0] * N_STYLE
    triples = W.grams(words, 3)
    _, times = np.unique(words, return_counts=True)
    runs = float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
    repeated = 0.0
    if len(triples):
        _, seen = np.unique(triples, return_counts=True)
        repeated = float(seen[seen > 1].sum() / len(triples))
    lines = [x for x in data.split(b"\n") if x.strip()]
    half = n // 2
    early = len(np.unique(words[:half])) / half if half else 1.0
    return [
        np.log1p(n) / 10,
        len(times) / n,
        len(times) / np.sqrt(n) / 10,
        float(times.max()) / n,
        runs,
        repeated,
        1 - len(set(lines)) / len(lines),
        len(data) / n / 10,
        np.log1p(len(data) / len(lines)) / 10,
        float((times == 1).sum()) / n,
        early,
        float(n < 20),
    ]


def features(text: str | None) -> np.ndarray:
    data = W.utf8(text)
    single, pairs = np.zeros(N_CLASSES), np.zeros(N_CLASSES * N_CLASSES)
    for at in range(0, len(data), W.STRETCH):
        kinds = _CLASS[np.frombuffer(data, np.uint8)[at : at + W.STRETCH + 1]]
        single += np.bincount(kinds[: W.STRETCH], minlength=N_CLASSES)
        pairs += np.bincount(kinds[:-1].astype(np.int64) * N_CLASSES + kinds[1:], minlength=N_CLASSES * N_CLASSES)
    n = max(1, len(data))
    return np.concatenate([np.sqrt(pairs / n), np.sqrt(single / n), _style(data)]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float
    labelled_share: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(self.standard(x) @ w1 + b1) @ w2 + b2

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Model:
    """Minimise the non-negative risk with the sigmoid loss by Adam; where a batch's estimate of the
    negatives' risk is below zero, the step goes up that term instead, as in the paper."""
    everything = np.concatenate([positives, unlabelled])
    draw = np.random.Generator(np.random.PCG64(seed))
    d = everything.shape[1]
    layers = [draw.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    model = Model(everything.mean(axis=0), everything.std(axis=0) + 0.02, layers, prior)
    p, u = model.standard(positives), model.standard(unlabelled)
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    step = 0
    for _ in range(EPOCHS):
        p_order, u_order = draw.permutation(len(p)), draw.permutation(len(u))
        batches = max(1, len(u) // BATCH)
        for chosen_u, chosen_p in zip(np.array_split(u_order, batches), np.array_split(p_order, min(batches, len(p))), strict=False):
            x = np.concatenate([p[chosen_p], u[chosen_u]])
            is_p = np.arange(len(x)) < len(chosen_p)
            w1, b1, w2, b2 = layers
            hidden = np.tanh(x @ w1 + b1)
            s = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30)))
            # The loss of calling x positive is 1 - s, of calling it negative s.
            negative = s[~is_p].mean() - prior * s[is_p].mean()
            curve = s * (1 - s)
            to_negative = np.where(is_p, -prior / is_p.sum(), 1 / (~is_p).sum()) * curve
            slope = np.where(is_p, -prior / is_p.sum(), 0) * curve + to_negative if negative >= 0 else -to_negative
            back = slope[:, None] * w2 * (1 - hidden**2)
            slopes = [x.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ slope + DECAY * w2, np.array([slope.sum()])]
            step += 1
            for i, g in enumerate(slopes):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            model.layers = layers
    return model


def prior_from_scores(positives: np.ndarray, unlabelled: np.ndarray, slack: float = 0.03) -> float:
    """Share of positives among the unlabelled: the smallest ratio of the two groups above any score, where
    enough positives are left for it to be known (best bin estimation, Garg et al., NeurIPS 2021)."""
    cuts = np.quantile(positives, np.linspace(0, 0.95, 60))
    ratios = [((unlabelled >= c).mean() + slack) / ((positives >= c).mean() + slack) for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.99))


def _first(rows: DataFrame, n: int, total: int) -> DataFrame:
    """The ``n`` ids with the smallest hashes, of about ``total``; only about four times as many are looked at."""
    few = rows.where(hash_below("doc_id", 4.0 * n / max(1, total))).select("doc_id").distinct()
    return few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _feature_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, positive, text in rows:
        yield doc_id, positive, features(text).tobytes()


def train(docs: DataFrame, labels: DataFrame, n_positive: int = SAMPLE_POSITIVES, n_unlabelled: int = SAMPLE_UNLABELLED) -> Model | None:
    """Fit on samples of ``docs`` (``doc_id, text``): those ``labels`` (``doc_id, quality``) calls good, and any.

    Ids with two different labels have none; rows without id teach nothing; null texts count as empty, and of an id's rows one
    text is taken, that with the smallest hash; other columns are ignored. The prior is estimated from a first
    classifier's scores; the share of good ones among the labelled stands beside it in the model. None if there is nothing to
    learn from."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("high")).where("q = high")
    known = docs.select("doc_id").distinct().join(known, "doc_id").select("doc_id", "q")
    counts = {r.q: r["count"] for r in known.where("q in (0, 1)").groupBy("q").count().collect()}
    # Ids are counted, not rows: very many rows may share one.
    ids = docs.agg(F.approx_count_distinct("doc_id")).first()[0]
    # Bounded by the two sample sizes, so the broadcast is bounded too.
    chosen = _first(known.where("q = 1"), n_positive, counts.get(1, 0)).withColumn("positive", F.lit(True)).unionByName(
        _first(docs, n_unlabelled, ids).withColumn("positive", F.lit(False))
    )
    sample = one_text_each(docs.join(F.broadcast(chosen), "doc_id"), ["doc_id", "positive"])
    found = map_rows(sample, _feature_rows, "doc_id long, positive boolean, x binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.positive))
    x = np.array([np.frombuffer(r.x, np.float32) for r in found]).reshape(len(found), N_FEATURES).astype(np.float64)
    is_p = np.array([r.positive for r in found], bool)
    if not is_p.any():
        return None
    first = fit(x[is_p], x[~is_p], 0.5)
    model = fit(x[is_p], x[~is_p], prior_from_scores(first.score(x[is_p]), first.score(x[~is_p])))
    model.labelled_share = counts[1] / (counts[1] + counts.get(0, 0))
    return model


def _score(rows: Iterator[tuple], shared) -> Iterator[tuple]:
    model: Model | None = shared.value
    held: list[tuple] = []

    def scored():
        if held:
            s = model.score(np.array([features(t) for _, t in held])) if model else np.ones(len(held))
            yield from ((r[0], float(v)) for r, v in zip(held, s, strict=True))

    size = 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if len(held) >= 256 or size > 8 << 20:
            yield from scored()
            held, size = [], 0
    yield from scored()


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, predicted`` of each row, from its whole text alone; null counts as empty, and an empty text gets
    the score of its features like any other. Without a model every score is 1. Repeated rows and null ids
    are rows like others; an empty table gives no rows; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = map_rows(docs.select("doc_id", "text"), lambda r: _score(r, shared), "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted to be bad."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pd.Series) -> pd.Series:
        found = shared.value
        if found is None:
            return pd.Series(np.ones(len(texts), bool))
        return pd.Series([bool(found.score(features(t)[None])[0] >= 0.5) for t in texts], dtype=bool)

    return docs.where(F.pandas_udf(keep, "boolean")("text"))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, learned from those outside fold 1 of 3."""
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    model = train(docs.where(~held_out), labels)
    return scores(docs, model).withColumn("held_out", held_out)
