import random
import zlib

import numpy as np

from hourlens.llm import toxicity
from hourlens.llm.toxicity import Settings

from .conftest import prose

SMALL = Settings(buckets=1 << 12, sample=400, epochs=8)


def rows(n=400):
    """A third of the texts hold a bad word, in a form of its own, somewhere in a text of up to 200 words."""
    rng, out = random.Random(8), []
    for i in range(n):
        words, bad = prose(rng, rng.randint(5, 200)).split(), i % 3 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words) + 1), "zork" + rng.choice(["", "ing", "ed", "ly"]))
        out.append((i, " ".join(words), ("en", "de")[i % 2], int(bad)))
    return out


def tables(spark, data):
    docs = spark.createDataFrame([r[:3] for r in data], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(r[0], 1, r[3]) for r in data], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    data = rows()
    docs, labels = tables(spark, data)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels, SMALL).collect()}
    assert len(got) == len(data)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].predicted == data[i][3] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    # Labels of rows that are held out, lang and doc_id change no score.
    other = [(i, t, "xx", 1 - y if i in set(held) else y) for i, t, _, y in data]
    again = {r.doc_id: r.score for r in toxicity.classify(*tables(spark, other), SMALL).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)
    clean = toxicity.harmless(docs.withColumnRenamed("lang", "lang"), labels, SMALL)
    assert clean.columns == docs.columns
    gone = {i for i, *_ in data} - {r.doc_id for r in clean.collect()}
    assert np.mean([data[i][3] for i in gone]) > 0.95 and len(gone) > 110


def test_scorer_equals_network():
    data = rows(60)
    model = toxicity.fit([r[1] for r in data], np.array([r[3] for r in data], float), ["en"] * 60, np.ones(60), SMALL)
    net = toxicity.Net(SMALL)
    net.p = model.weights
    texts = [r[1] for r in data] + ["", None, "one", "two words"]
    want = []
    for text in texts:
        words, order = np.unique(np.array(toxicity.split(text), dtype=object), return_inverse=True)
        logit = net.logit((*toxicity.subwords(list(words), SMALL), order))
        want.append(1 / (1 + np.exp(-(model.scale * logit + model.shift))))
    for size in (10**6, 30):  # also where the words kept are thrown away again and again
        scorer = toxicity.Scorer(model, size)
        got = np.concatenate([scorer.scores(texts[i:i + 5]) for i in range(0, len(texts), 5)])
        assert np.allclose(got, want, atol=1e-4)


def test_gradients():
    """One step lowers the loss of its batch."""
    net = toxicity.Net(Settings(buckets=256, rate=0.001))
    data = []
    for _, text, _, _ in rows(16):
        words, order = np.unique(np.array(toxicity.split(text), dtype=object), return_inverse=True)
        data.append((*toxicity.subwords(list(words), net.s), order))
    labels = np.array([i % 2 for i in range(16)], float)

    def loss():
        p = 1 / (1 + np.exp(-np.array([net.logit(t) for t in data])))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    before = loss()
    for _ in range(5):
        net.train_batch(data, labels)
    assert loss() < before


def test_thresholds_by_language():
    scores = np.array([0.9, 0.6, 0.55, 0.2, 0.95, 0.8, 0.75, 0.1, 0.5])
    labels = np.array([1, 1, 1, 0, 1, 0, 0, 0, 0.0])
    languages = ["a"] * 4 + ["b"] * 4 + ["c"]
    got = toxicity.language_thresholds(scores, labels, np.ones(9), languages, Settings())
    assert got == {"a": 0.55, "b": 0.7}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.classify(odd, labels, SMALL).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.classify(none, labels, SMALL).collect() == []
    untaught = toxicity.classify(odd, labels.limit(0), SMALL).collect()
    assert {(r.score, r.predicted, r.toxic) for r in untaught} == {(0.0, 0, False)}
    assert toxicity.harmless(odd, labels.limit(0), SMALL).columns == odd.columns
