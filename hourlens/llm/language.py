"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are trained with follow-the-regularised-leader steps under an elastic
net, which leaves most of them zero; a temperature is then fitted on texts
that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourlens.llm.shared import held_out, small, written

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PRIME = np.uint32(0x01000193)


@dataclass(frozen=True)
class Settings:
    """n-gram lengths, hashed features, most labelled texts that are fitted, and the optimiser's parameters."""

    grams: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    sample: int = 6000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    seed: int = 0


@dataclass(frozen=True)
class Model:
    settings: Settings
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def features(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text in lower case, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift, value, parts = np.uint32(32 - settings.bits), np.full(len(codes), 0x811C9DC5, np.uint32), []
    for n in range(1, min(max(settings.grams), len(codes)) + 1):
        value = (value[:len(codes) - n + 1] ^ codes[n - 1:]) * _PRIME
        value ^= value >> np.uint32(15)
        if n in settings.grams:
            parts.append((value * np.uint32(0x9E3779B1) + np.uint32(n)) >> shift)
    counts = np.bincount(np.concatenate(parts) if parts else codes, minlength=1 << settings.bits)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _vector(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of a text's counts: 1 + log of each, times idf, scaled to length 1."""
    found, n = counts
    value = (1 + np.log(n)) * idf[found]
    length = np.sqrt(value @ value)
    return found, value / length if length else value


def document_counts(texts: DataFrame, settings: Settings) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each feature: every task adds up an array of fixed size."""

    def count(batches):
        total, met = 0, np.zeros(1 << settings.bits, np.int64)
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                total += 1
                met[features(text, settings)[0]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(met) + 1), pa.int32()), pa.array(np.append(met, total))], ["feature", "n"])

    rows = texts.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    met = np.zeros((1 << settings.bits) + 1, np.int64)
    met[rows["feature"]] = rows["n"]
    return int(met[-1]), met[:-1]


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: tuple[str, ...], idf: np.ndarray,
        settings: Settings) -> Model:
    """FTRL-proximal with per-coordinate rates, one text at a time; every tenth text sets the temperature instead."""
    k, rng = len(languages), np.random.default_rng(settings.seed)
    z, n = np.zeros((1 << settings.bits, k)), np.zeros((1 << settings.bits, k))
    zb, nb = np.zeros(k), np.zeros(k)
    order = rng.permutation(len(rows))
    kept, train = order[::10], np.delete(order, np.s_[::10]) if len(rows) > 20 else order

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((settings.beta + np.sqrt(n)) / settings.alpha
                                                                         + settings.l2))

    def step(z, n, w, gradient):
        squared = gradient * gradient
        rate = (np.sqrt(n + squared) - np.sqrt(n)) / settings.alpha
        return z + gradient - rate * w, n + squared

    for _ in range(settings.epochs):
        for i in rng.permutation(train):
            at, value = rows[i]
            w, b = weights(z[at], n[at], settings.l1), weights(zb, nb, 0.0)
            error = _softmax(value @ w + b)
            error[labels[i]] -= 1
            z[at], n[at] = step(z[at], n[at], w, np.outer(value, error))
            zb, nb = step(zb, nb, b, error)
    w, b = weights(z, n, settings.l1), weights(zb, nb, 0.0)
    scores = np.array([rows[i][1] @ w[rows[i][0]] + b for i in kept])
    grid = np.geomspace(0.05, 20, 200)
    losses = [-np.log(_softmax(scores / t)[range(len(kept)), labels[kept]] + 1e-12).mean() for t in grid]
    return Model(settings, languages, idf, w.astype(np.float32), b, float(grid[int(np.argmin(losses))]))


def _sample(rows: DataFrame, settings: Settings) -> tuple[list, list[str]]:
    """n-gram counts and languages of at most ``settings.sample`` rows, drawn evenly by language and doc_id's hash."""
    met = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(1, settings.sample // max(1, met.count()))
    place = F.xxhash64(F.lit(settings.seed), "doc_id")
    likely = F.pmod(place, F.lit(1 << 30)) < F.lit(1.5 * each * (1 << 30)) / F.col("n")
    first = Window.partitionBy("lang").orderBy("place")
    drawn = rows.join(met, "lang").where(likely).select("lang", "text", place.alias("place")).withColumn(
        "i", F.row_number().over(first)).where(F.col("i") <= each).select("lang", "text")

    def extract(batches):
        for batch in small(batches):
            found = [features(text, settings) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()),
                pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], ["lang", "found", "counts"])

    taken = drawn.mapInArrow(extract, "lang string, found binary, counts binary").collect()
    taken.sort(key=lambda r: (r.lang, r.found, r.counts))
    return [(np.frombuffer(r.found, "<i4"), np.frombuffer(r.counts, "<i4")) for r in taken], [r.lang for r in taken]


def train(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from (doc_id, text, lang) of rows that are not held out, with text and lang; None if there are none.

    Document counts for the idf cover all these rows. Weights are fitted on at
    most ``settings.sample`` of them; the driver gets their n-gram counts only.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "text", "lang")
    total, met = document_counts(rows.select("text"), settings)
    counts, names = _sample(rows, settings)
    if not names:
        return None
    idf = np.log((1 + total) / (1 + met)) + 1
    languages = tuple(sorted(set(names)))
    code = {name: i for i, name in enumerate(languages)}
    return fit([_vector(c, idf) for c in counts], np.array([code[n] for n in names]), languages, idf, settings)


def predict_texts(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, sure
    for i, text in enumerate(texts):
        if text and _LETTER.search(text):
            at, value = _vector(features(text, model.settings), model.idf)
            p = _softmax((value @ model.weights[at] + model.bias) / model.temperature)
            names[i], sure[i] = model.languages[int(p.argmax())], min(float(p.max()), 1.0)
    return names, sure


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang; other columns are ignored).

    The model is learned by :func:`train` from the same table. A text that is
    null or has no letter gets ``und`` and score 0, as do all texts where
    nothing could be learned; null ids are never held out; ties go to the
    language first in order; repeated rows are predicted each.
    """
    docs = docs.select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, settings))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            names, sure = predict_texts(part.tolist(), shared.value)
            yield pd.DataFrame({"lang_pred": names, "score": sure})

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
