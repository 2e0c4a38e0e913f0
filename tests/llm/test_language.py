import random
import zlib

import numpy as np

from hourlens.llm import language

STEMS = {"en": ["the", "ing", "er", "th", "wh"], "de": ["sch", "ung", "ein", "keit", "ß"], "es": ["ción", "os", "que", "ñ"]}


def rows(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = sorted(STEMS)[i % 3]
        text = " ".join("".join(rng.choice(STEMS[lang]) for _ in range(2)) for _ in range(rng.randint(3, 60)))
        out.append((i, text, lang))
    return out


def test_learns_and_keeps_out_what_is_held_out(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(got) == len(data)
    for i, _, lang in data:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1
    held = [i for i, _, _ in data if got[i].held_out]
    assert np.mean([got[i].lang_pred == data[i][2] for i in held]) > 0.95
    # Labels and texts of rows that are held out change nothing.
    other = [(i, t, "xx" if got[i].held_out else lang) for i, t, lang in data]
    again = {r.doc_id: r for r in language.identify(spark.createDataFrame(other, docs.schema)).collect()}
    assert all(again[i].lang_pred == got[i].lang_pred and again[i].score == got[i].score for i in got)


def test_weights_are_sparse_and_idf_counts_documents(spark):
    settings = language.Settings(bits=12, l1=0.05)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = language.train(docs, settings)
    assert 0 < (model.weights != 0).mean() < 0.3
    total, met = language.document_counts(docs.select("text"), settings)
    want = np.zeros(1 << 12, int)
    for _, text, _ in rows():
        want[language.features(text, settings)[0]] += 1
    assert total == 240 and (met == want).all()


def test_features_are_all_grams():
    settings = language.Settings(bits=15)
    found, counts = language.features("abab", settings)
    assert counts.sum() == 4 + 3 + 2 and len(found) == 2 + 2 + 2


def test_odd_rows(odd, none):
    got = language.identify(odd).collect()
    assert len(got) == odd.count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert language.identify(none).collect() == []


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.identify(docs).select("lang_pred", "score").collect()] == [("und", 0.0)]
