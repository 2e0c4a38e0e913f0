import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourlens.llm import fill_middle as fim
from hourlens.llm.fill_middle import rearrange, restored

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    pre, mid, suf = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(tokens), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(tokens), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts(n, seed=3):
    rng = random.Random(seed)
    letters = ["a", "B", "word", " ", "é", "中", "\U0001f600", "1", "<", ">", "P", "S>", "\n", "\0", "<M", "́"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_rows_equal_brute_force_and_rebuild(spark):
    rows = list(enumerate([*texts(800), "x<P>y", "<S>", "word " * 30_000, "é" * 50_000 + "a" * 200_000 + " b" * 9]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rearrange(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert {tuple(r)[:6] for r in found} == {brute(*r) for r in rows}
    assert {(r.doc_id, r.back) for r in found} == set(rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_odd_rows(odd, none):
    found = rearrange(odd).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(str(brute(r.doc_id, r.text)) for r in odd.collect())
    assert rearrange(none).collect() == []


@pytest.mark.parametrize("span, error", [(1, 0), (7, 1), (4096, 127), (100_000, 3)])
def test_index_is_exact_and_bounded(span, error):
    rng = np.random.default_rng(1)
    words = [b"a" * int(n) + b" " for n in rng.geometric(0.2, 3000)] + [b"z" * 40_000, b" " * 500]
    joined = [b"".join(words), b"", b"one", "é中".encode() * 700]
    offsets, first = fim.borders(joined)
    index = fim.RankIndex(offsets, first, span, error)
    ranks = np.arange(len(offsets))
    assert (index.place(ranks) == offsets).all()
    assert (np.abs(index.predict(ranks) - offsets) <= error).all()
    assert (np.diff(first) == [len(TOKEN.findall(t.decode())) + 1 for t in joined]).all()


def test_index_of_even_borders_is_one_segment():
    offsets, first = fim.borders([b"ab " * 1000])
    assert len(fim.RankIndex(offsets, first).start) == 1
