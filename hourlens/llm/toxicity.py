"""Toxicity: a convolutional classifier of whole texts over hashed word embeddings.

A word's embedding is the mean of those that its hash and the hashes of its
character n-grams look up, so forms of one stem are alike. Filters of several widths run over
neighbouring words; the largest answer of each filter over the whole text goes
to a logistic output, so one passage decides however long the text is.
Trained in numpy with Adam; probabilities are calibrated on texts that training
left out, and thresholds for decisions are calibrated by language.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlens.llm.shared import held_out, release, written

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """Sizes of the model; most labelled texts and bytes fitted, of which at most half are toxic; and of training."""

    buckets: int = 1 << 16
    grams: tuple[int, ...] = (4, 5)
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    sample: int = 5000
    sample_bytes: int = 64 << 20
    epochs: int = 8
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    threshold: float = 0.7
    precision: float = 0.98
    seed: int = 0


@dataclass(frozen=True)
class Model:
    settings: Settings
    weights: dict[str, np.ndarray]
    #: Logit scale and shift from calibration.
    scale: float
    shift: float
    thresholds: dict[str, float]


def split(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and of its character n-grams, one word after another, and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    ids = [np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint64, len(words))]
    owners = [np.arange(len(words))]
    for n in settings.grams:
        if len(codes) < n:
            continue
        value = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            value = (value ^ codes[j:len(codes) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        whole = np.arange(len(value)) + n <= ends[:len(value)]
        ids.append(value[whole] >> np.uint64(20))
        owners.append(owner[:len(value)][whole])
    order = np.argsort(np.concatenate(owners), kind="stable")
    counts = np.bincount(np.concatenate(owners), minlength=len(words))
    ids = (np.concatenate(ids)[order] % np.uint64(settings.buckets)).astype(np.int64)
    return ids, (np.cumsum(counts) - counts).astype(np.int64)


def embed(table: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros((0, table.shape[1]), np.float32)
    counts = np.diff(np.append(starts, len(ids)))
    return np.add.reduceat(table[ids], starts, axis=0) / counts[:, None].astype(np.float32)


class Net:
    """The network with Adam's state; texts are (distinct words' subwords, their starts, word numbers in order)."""

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.s = settings
        # Embeddings begin near zero: a word that training never met says almost nothing.
        self.p = {"e": rng.normal(0, 0.01, (settings.buckets, settings.dims)).astype(np.float32)}
        for w in settings.widths:
            self.p[f"f{w}"] = rng.normal(0, 0.5, (w, settings.dims, settings.filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(settings.filters, np.float32)
        self.p["o"] = np.full(len(settings.widths) * settings.filters, 0.5, np.float32)
        self.p["c"] = np.full(1, -1, np.float32)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def pooled(self, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest answer of every filter over one text (0 at least), where it was (-1: nowhere), word embeddings."""
        ids, starts, order = text
        s, e = self.s, embed(self.p["e"], ids, starts)
        best = np.zeros((len(s.widths), s.filters), np.float32)
        place = np.full(best.shape, -1)
        for k, w in enumerate(s.widths):
            n = len(order) - w + 1
            if n < 1:
                continue
            out = sum((e @ self.p[f"f{w}"][j])[order[j:j + n]] for j in range(w)) + self.p[f"b{w}"]
            at = out.argmax(axis=0)
            top = out[at, range(s.filters)]
            best[k], place[k] = np.maximum(top, 0), np.where(top > 0, at, -1)
        return best.ravel(), place, e

    def logit(self, text) -> float:
        return float(self.pooled(text)[0] @ self.p["o"] + self.p["c"][0])

    def train_batch(self, texts: list, labels: np.ndarray) -> None:
        s, g = self.s, {k: np.zeros_like(v) for k, v in self.p.items() if k != "e"}
        touched, pieces = [], []
        for (ids, starts, order), label in zip(texts, labels):
            h, place, e = self.pooled((ids, starts, order))
            error = 1 / (1 + np.exp(-np.clip(h @ self.p["o"] + self.p["c"][0], -30, 30))) - label
            g["o"] += error * h
            g["c"] += error
            back = (error * self.p["o"]).reshape(place.shape)
            stops = np.append(starts[1:], len(ids))
            for k, w in enumerate(s.widths):
                for f in np.flatnonzero(place[k] >= 0):
                    own = order[place[k, f]:place[k, f] + w]
                    g[f"f{w}"][:, :, f] += back[k, f] * e[own]
                    g[f"b{w}"][f] += back[k, f]
                    for j, word in enumerate(own):
                        rows = ids[starts[word]:stops[word]]
                        touched.append(rows)
                        pieces.append(np.broadcast_to(
                            back[k, f] * self.p[f"f{w}"][j, :, f] / len(rows), (len(rows), s.dims)))
        self.t += 1
        rate = s.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)

        def adam(key, rows, gradient):
            m, v = self.m[key], self.v[key]
            m[rows] = 0.9 * m[rows] + 0.1 * gradient
            v[rows] = 0.999 * v[rows] + 0.001 * gradient ** 2
            self.p[key][rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-8) + rate * s.decay * self.p[key][rows]

        for key, gradient in g.items():
            adam(key, slice(None), gradient / len(texts))
        if touched:
            rows, where = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(rows), s.dims), np.float32)
            np.add.at(total, where, np.concatenate(pieces))
            adam("e", rows, total / len(texts))


def calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make the logistic of logits fit the weighted labels best, by Newton steps."""
    up, down = labels.sum(), len(labels) - labels.sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weights * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (weights * (p - target)) + 1e-2 * (w - [1.0, 0.0]))
        w -= move / max(1.0, np.abs(move).max())
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def language_thresholds(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, languages: list[str],
                        settings: Settings) -> dict[str, float]:
    """For each language the lowest score, not under 1/2, from which on the wanted share of texts is toxic.

    A language's threshold is never above the general one: what is predicted toxic is toxic in every language, and a
    language where only higher scores reach that share, or none, or that lacks one of the labels, keeps the general one.
    """
    out = {}
    for name in sorted(set(languages)):
        own = np.array([x == name for x in languages])
        s, y, n = scores[own], labels[own], weights[own]
        if 0 < y.sum() < len(y):
            order = np.argsort(-s, kind="stable")
            share = np.cumsum((y * n)[order]) / np.cumsum(n[order])
            ends = np.append(s[order][1:] < s[order][:-1], True)
            good = s[order][ends & (share >= settings.precision) & (s[order] >= 0.5)]
            if len(good):
                out[name] = float(min(good.min(), settings.threshold))
    return out


class Corpus:
    """Texts as numbers of their words, with every distinct word's subwords once.

    ``corpus[i]`` is what :class:`Net` reads of text i. Only word numbers are
    kept of a text, four bytes a word.
    """

    def __init__(self, settings: Settings):
        self.settings, self.known, self.texts = settings, {}, []
        self.ids = self.starts = self.stops = None

    def add(self, text: str | None) -> None:
        known = self.known
        self.texts.append(np.array([known.setdefault(w, len(known)) for w in split(text)], np.int32))

    def close(self) -> None:
        """No more texts: look up the subwords, a part of the words at a time, and forget the words."""
        words, ids, counts = list(self.known), [], []
        for i in range(0, len(words), 20_000):
            part, starts = subwords(words[i:i + 20_000], self.settings)
            ids.append(part.astype(np.int32))
            counts.append(np.diff(np.append(starts, len(part))))
        self.known = None
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.stops = np.cumsum(np.concatenate(counts)) if counts else np.zeros(0, np.int64)
        self.starts = self.stops - (np.concatenate(counts) if counts else 0)

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, order = np.unique(self.texts[i], return_inverse=True)
        lengths = self.stops[words] - self.starts[words]
        begins = np.cumsum(lengths) - lengths
        places = np.arange(lengths.sum()) + np.repeat(self.starts[words] - begins, lengths)
        return self.ids[places], begins, order


def fit(texts: Iterable[str | None] | Corpus, labels: np.ndarray, languages: list[str], weights: np.ndarray,
        settings: Settings) -> Model:
    """``weights``: how many rows of the corpus a text stands for, for calibration."""
    rng, net, data = np.random.default_rng(settings.seed), Net(settings), texts
    if not isinstance(texts, Corpus):
        data = Corpus(settings)
        for text in texts:
            data.add(text)
        data.close()
    order = rng.permutation(len(data))
    aside = order[::5] if len(data) >= 50 else order
    train = np.setdiff1d(order, aside) if len(data) >= 50 else order
    for _ in range(settings.epochs):
        mixed = rng.permutation(train)
        for i in range(0, len(mixed), settings.batch):
            rows = mixed[i:i + settings.batch]
            net.train_batch([data[r] for r in rows], labels[rows])
    logits = np.array([net.logit(data[i]) for i in aside])
    scale, shift = calibrate(logits, labels[aside], weights[aside] / weights[aside].mean())
    scores = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -30, 30)))
    thresholds = language_thresholds(
        scores, labels[aside], weights[aside], [languages[i] for i in aside], settings)
    return Model(settings, net.p, scale, shift, thresholds)


class Scorer:
    """Scores whole texts; keeps what the words met so far add to each filter, up to ``size`` words."""

    def __init__(self, model: Model, size: int = 100_000):
        self.m, self.size, self.known = model, size, {}
        s, p = model.settings, model.weights
        #: All filters' places side by side: dims x (places x filters).
        self.filters = np.concatenate([p[f"f{w}"][j] for w in s.widths for j in range(w)], axis=1)
        self.adds = np.empty((size, self.filters.shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.size:
            self.known, new = {}, list(words)
            if len(new) > len(self.adds):  # a text with more words than are kept
                self.adds = np.empty((len(new), self.filters.shape[1]), np.float32)
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new))))
        for i in range(0, len(new), 10_000):
            part = new[i:i + 10_000]
            self.adds[first + i:first + i + len(part)] = embed(
                self.m.weights["e"], *subwords(part, self.m.settings)) @ self.filters

    def scores(self, texts: list[str | None]) -> np.ndarray:
        s, p, out = self.m.settings, self.m.weights, np.zeros(len(texts))
        words = [split(t) for t in texts]
        self.learn(set().union(*words))
        for i, own in enumerate(words):
            adds = self.adds[np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))]
            pooled, column = [], 0
            for w in s.widths:
                n = len(own) - w + 1
                if n < 1:
                    pooled.append(np.zeros(s.filters, np.float32))
                else:
                    answers = adds[:n, column:column + s.filters]
                    for j in range(1, w):
                        answers = answers + adds[j:j + n, column + j * s.filters:column + (j + 1) * s.filters]
                    pooled.append(np.maximum(answers.max(axis=0) + p[f"b{w}"], 0))
                column += w * s.filters
            logit = np.concatenate(pooled) @ p["o"] + p["c"][0]
            out[i] = 1 / (1 + np.exp(-np.clip(self.m.scale * logit + self.m.shift, -30, 30)))
        return out


def _sample(docs: DataFrame, known: DataFrame, settings: Settings) -> tuple[Corpus, np.ndarray, list[str], np.ndarray]:
    """Words, labels, languages and weights of at most ``settings.sample`` rows, half of each label at most.

    The ids are drawn from the labels (doc_id, toxic), so no text is shuffled
    for it; their number, and so the size of what is broadcast, is bounded.
    Rows are taken whole while those of their label hold at most half of
    ``settings.sample_bytes``, the first one always. They are read one by one.
    """
    each = max(1, settings.sample // 2)
    met = written(known.groupBy("toxic").agg(F.count("*").alias("n")), "labels")
    place = F.xxhash64(F.lit(settings.seed), "doc_id")
    likely = F.pmod(place, F.lit(1 << 30)) < F.lit(1.5 * each * (1 << 30)) / F.col("n")
    first = Window.partitionBy("toxic").orderBy("place", "doc_id")
    ids = written(known.join(met, "toxic").where(likely).withColumn("place", place).withColumn(
        "i", F.row_number().over(first)).where(F.col("i") <= each).drop("i"), "sample")
    # An id may stand on many rows.
    in_order = first.orderBy("place", "doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    taken = docs.join(F.broadcast(ids), "doc_id").withColumns({
        "i": F.row_number().over(in_order), "bytes": F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
    }).where((F.col("i") <= each) & ((F.col("bytes") <= settings.sample_bytes // 2) | (F.col("i") == 1))).select(
        "toxic", "n", "lang", "text", "place").orderBy("place", "toxic", F.coalesce("text", F.lit("")))
    corpus, rows = Corpus(settings), []
    for r in taken.toLocalIterator():
        corpus.add(r.text)
        rows.append((r.toxic, r.n, r.lang or ""))
    corpus.close()
    toxic = np.array([t for t, _, _ in rows], float)
    share = {t: max(1, int((toxic == t).sum())) for t in (0, 1)}
    return corpus, toxic, [lang for _, _, lang in rows], np.array([n / share[t] for t, n, _ in rows], float)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on at most ``settings.sample`` rows that have a label and are not held out; None if there are none.

    Of several labels for one doc_id the largest counts. The driver reads the
    texts of the sample one by one and keeps numbers of their words.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    corpus, toxic, languages, weights = _sample(docs.select("doc_id", "text", "lang"), known, settings)
    return fit(corpus, toxic, languages, weights, settings) if len(toxic) else None


def scorer(spark, model: Model | None) -> Column:
    """Column function from text to score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer_ = Scorer(shared.value) if shared.value else None
        for part in texts:
            values = part.tolist()
            yield pd.Series(np.concatenate([
                scorer_.scores(values[i:i + 128]) if scorer_ else np.zeros(len(values[i:i + 128]))
                for i in range(0, max(len(values), 1), 128)]))
        del scorer_
        release()

    return score


def threshold(lang: Column, model: Model | None) -> Column:
    """The threshold for decisions on texts of a language; the general one for others and null."""
    settings = model.settings if model else Settings()
    out = F.lit(settings.threshold)
    for name, value in sorted((model.thresholds if model else {}).items()):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return F.coalesce(out, F.lit(settings.threshold))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic of every row of ``docs`` (doc_id, text, lang; others are ignored).

    ``predicted`` is 1 from the general threshold on; ``toxic`` decides by the
    threshold of the row's language. Scores come from the text alone. Null and
    empty texts get the score of a text without words; where no label could be
    learned all scores are 0. Repeated rows are scored each.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs, labels, settings)
    return docs.select(
        "doc_id", "lang", held_out(F.col("doc_id")).alias("held_out"),
        scorer(docs.sparkSession, model)("text").alias("score"),
    ).select("doc_id", "held_out", "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
             (F.col("score") >= threshold(F.col("lang"), model)).alias("toxic"))


def harmless(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, and any others) under the threshold of their language."""
    model = train(docs, labels, settings)
    score = scorer(docs.sparkSession, model)("text")
    return docs.where(score < threshold(F.col("lang"), model))
