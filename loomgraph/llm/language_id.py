"""Language identification by error-correcting output codes.

Each language has a codeword of -1 and +1; each bit has a binary classifier over the byte n-grams of a text
(Dietterich & Bakiri, JAIR 1995). A text's language is the codeword with the smallest loss, where bits
count by how well their classifier does on that language (loss-weighted decoding, Escalera et al.,
PAMI 2010). A small lead over the second codeword is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.frames import hash_below, map_rows, one_text_each
from loomgraph.llm.words import STRETCH, utf8

FEATURE_BITS = 12
ORDERS = (2, 3)
# The classifiers are fit on about this many labelled rows, at most so many and at least so many (if there are) of one language.
SAMPLE_ROWS = 4000
SAMPLE_PER_LANGUAGE = 500
LEAST_PER_LANGUAGE = 4
# The driver holds the model and its sample: a codeword, and at least four rows of 32 KB, for each language.
MOST_LANGUAGES = 2000
STEPS = 150
PENALTY = 1e-4
AMBIGUOUS_LEAD = 0.2
UNKNOWN = "und"

# Letters stay (ASCII ones in lower case), other ASCII becomes space; bytes of non-ASCII characters stay.
_FOLD = bytes(c | 32 if chr(c).isalpha() else c if c >= 128 else 32 for c in range(256))
_CHUNK = 256


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams: a vector of length 1."""
    data = np.frombuffer(utf8(text).translate(_FOLD), np.uint8)
    counts = np.zeros(1 << FEATURE_BITS)
    for n in ORDERS:
        places = len(data) - n + 1
        for at in range(0, places, STRETCH):
            end = min(at + STRETCH, places)
            codes = np.zeros(end - at, np.uint32)
            for i in range(n):
                codes = codes << np.uint32(8) | data[at + i : end + i]
            codes = (codes + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - FEATURE_BITS)
            counts += np.bincount(codes, minlength=len(counts))
    total = counts.sum()
    return np.sqrt(counts / total if total else counts).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of -1 and +1: all splits of up to five languages, else the random code with the best spread of many."""
    if n <= 5:
        splits = [[1 if i == 0 or bits >> (i - 1) & 1 else -1 for i in range(n)] for bits in range(2 ** max(0, n - 1) - 1)]
        return np.array(splits, np.float64).reshape(len(splits), n).T
    draw = np.random.Generator(np.random.PCG64(seed))
    best, most = None, -1
    # All pairs of few languages, a sample of the pairs of many.
    one, other = np.triu_indices(n, 1) if n <= 300 else draw.integers(0, n, (2, 50_000))
    one, other = one[one != other], other[one != other]
    for _ in range(100 if n <= 300 else 20):
        code = draw.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        spread = int((code[one] != code[other]).sum(axis=1).min())
        if spread > most:
            best, most = code, spread
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the languages for rows of features; the order of the languages, best first."""
        margins = x @ self.weights + self.bias
        # A bit's loss depends on its sign alone, so no array has rows by languages by bits.
        distance = np.logaddexp(0, -margins) @ (self.trust * (self.code > 0)).T + np.logaddexp(0, margins) @ (self.trust * (self.code < 0)).T
        distance = distance * self.code.shape[1]
        p = np.exp(distance.min(axis=1, keepdims=True) - distance)
        p /= p.sum(axis=1, keepdims=True)
        return p, np.argsort(-p, axis=1, kind="stable")


def fit(x: np.ndarray, languages: list[str]) -> Model:
    """Logistic regression per bit by accelerated gradient steps; every language weighs the same."""
    names = sorted(set(languages))
    code = codewords(len(names))
    place = {v: i for i, v in enumerate(names)}
    of = np.array([place[v] for v in languages], int)
    y = code[of]
    share = 1 / np.bincount(of, minlength=len(names))[of] / max(1, len(names)) if len(of) else np.zeros(0)
    w, bias = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    x = x.astype(np.float64)
    w_ahead, bias_ahead, rate = w.copy(), bias.copy(), 4.0
    for step in range(STEPS if y.size else 0):
        slope = -y * share[:, None] / (1 + np.exp(np.clip(y * (x @ w_ahead + bias_ahead), -40, 40)))
        w_new = w_ahead - rate * (x.T @ slope + PENALTY * w_ahead)
        bias_new = bias_ahead - rate * 0.25 * slope.sum(axis=0)
        pull = step / (step + 3)
        w_ahead, bias_ahead = w_new + pull * (w_new - w), bias_new + pull * (bias_new - bias)
        w, bias = w_new, bias_new
    right = (y * (x @ w + bias) > 0).astype(float)
    trust = np.array([right[of == i].mean(axis=0) for i in range(len(names))]).reshape(code.shape) + 1e-3
    return Model(names, code, w.astype(np.float32), bias, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, per_language: int = SAMPLE_PER_LANGUAGE, most: int = MOST_LANGUAGES) -> Model:
    """Fit on a sample of ``labelled`` (``doc_id, text, lang``): of each language the rows whose ids have the smallest hashes.

    Every language with a labelled row is learned, however rare; with more than ``rows / 4`` of them the sample is four rows of
    each. Beyond ``most`` values of ``lang``, those with the most ids are learned. Rows without id or language teach nothing;
    null texts count as empty; of an id's rows in one language one text is taken, that with the smallest hash."""
    labelled = labelled.where("lang is not null and doc_id is not null")
    # Ids are counted, not rows: very many rows may share one. The estimate is within a few per cent.
    ids = F.greatest(F.approx_count_distinct("doc_id"), F.lit(1)).alias("n")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(ids).orderBy(F.desc("n"), "lang").limit(most).collect()}
    each = max(LEAST_PER_LANGUAGE, min(per_language, rows // max(1, len(counts))))
    # Four times as many ids by their hashes, so that ranking them takes no more rows than that. The model on the driver
    # has a codeword for each language, so one row for each can be broadcast.
    shares = labelled.sparkSession.createDataFrame([(v, 4.0 * each / n) for v, n in counts.items()], "lang string, share double")
    drawn = labelled.select("doc_id", "lang").join(F.broadcast(shares), "lang").where(hash_below("doc_id", F.col("share")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = drawn.select("doc_id", "lang").distinct()
    chosen = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("doc_id", "lang")
    # At most ``each`` ids a language, so the broadcast is as small as the sample. An id may have rows in several languages.
    rows_of = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    sample = one_text_each(rows_of, ["doc_id", "lang"])
    found = map_rows(sample.select("doc_id", "lang", "text"), _feature_rows, "doc_id long, lang string, x binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.lang))
    x = np.array([np.frombuffer(r.x, np.float32) for r in found]).reshape(len(found), 1 << FEATURE_BITS)
    return fit(x, [r.lang for r in found])


def _feature_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, lang, text in rows:
        yield doc_id, lang, features(text).tobytes()


def _predict(rows: Iterator[tuple], shared, lead: float) -> Iterator[tuple]:
    model: Model = shared.value
    held: list[tuple] = []

    def decoded():
        known = [i for i, r in enumerate(held) if r[2]]
        out = [(*r[:1], UNKNOWN, 0.0, None, False) for r in held]
        if known and model.languages:
            p, order = model.decode(np.array([features(held[i][1]) for i in known]))
            for i, probabilities, best in zip(known, p, order, strict=True):
                second = model.languages[best[1]] if len(best) > 1 else None
                ahead = probabilities[best[0]] - (probabilities[best[1]] if len(best) > 1 else 0)
                out[i] = (held[i][0], model.languages[best[0]], float(probabilities[best[0]]), second, bool(ahead < lead))
        return out

    size = 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if len(held) >= _CHUNK or size > 8 << 20:
            yield from decoded()
            held, size = [], 0
    yield from decoded()


def identify(docs: DataFrame, model: Model, lead: float = AMBIGUOUS_LEAD) -> DataFrame:
    """``doc_id, lang_pred, score, runner_up, ambiguous`` of each row, from its whole text alone.

    ``und`` with score 0 for null, empty and letterless texts, and for all texts if nothing was learned;
    repeated rows and null ids are rows like others; an empty table gives no rows; ties between codewords
    go to the language first in the alphabet and are ambiguous; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = "doc_id long, lang_pred string, score double, runner_up string, ambiguous boolean"
    return map_rows(rows, lambda r: _predict(r, shared, lead), schema)


def fold(remainders: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(remainders))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from those outside fold 2 of 4."""
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return identify(docs, model).withColumn("held_out", held_out)
