import random

import numpy as np
import pytest

from hourlens.llm import minhash
from hourlens.llm.components import components
from hourlens.llm.shared import shingles, words

from .conftest import prose, word


def brute(rows, percent):
    """doc_id -> (size, component) by comparing all sets of word runs."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=0):
    """Unlike texts, exact copies, copies with 1 to 12 words changed, chains of edits, and a common passage."""
    rng, rows = random.Random(seed), []
    common = prose(rng, 40)
    for _ in range(40):
        rows.append(prose(rng, rng.randint(1, 120)))
        rows.append(common + " " + prose(rng, rng.randint(3, 80)))
    base = prose(rng, 150).split()
    for i in range(60):
        copy = list(base)
        for _ in range(i % 13):
            copy[rng.randrange(len(copy))] = word(rng) + "x"
        rows.append(" ".join(copy))
    chain = prose(rng, 100).split()
    for i in range(20):
        chain[(7 * i) % 100] = f"chain{i}"
        rows.append(" ".join(chain).upper())
    rows += rows[::9]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("percent", [85, 80])
def test_equals_comparing_all_pairs(spark, percent):
    rows = corpus()
    settings = minhash.Settings() if percent == 85 else minhash.Settings(percent=80, bands=32, agree=130)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()
    want = brute(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(rows) - 40


def test_prefix_step_alone_finds_every_link(spark):
    """Exactly, also where first comparisons with pivots have found nothing."""
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id long, found binary")
    labels = spark.createDataFrame([], "id long, label long")
    settings = minhash.Settings()
    got = {(r.a, r.b) for r in minhash._prefix_pairs(table, labels, settings).collect()}
    for i in sets:
        for j in sets:
            if i < j:
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    assert (i, j) in got
    assert docs.count() == len(rows)


def test_signatures_estimate_similarity():
    a, b = minhash.functions(minhash.Settings())
    rng = np.random.default_rng(0)
    both = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    x, y = minhash.signature(both[:2500], a, b), minhash.signature(both[500:], a, b)
    assert abs((x == y).mean() - 2000 / 3000) < 0.12
    assert (minhash.signature(both[:5000], a, b) == np.minimum.reduce(
        [(both >> np.uint64(32)).astype(np.uint32)[i] * a + b for i in range(3000)])).all()


def test_odd_rows(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True)
        if r.doc_id is None:
            assert r.component_id is None and r.kept
    assert minhash.near_duplicates(none).collect() == []


def test_without_copies(odd, none):
    kept = minhash.without_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 6, 7]
    assert minhash.without_copies(none).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(5000, i) for i in range(5001, 5400)] + [(7, 7), (None, 3), (4, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ids_on_several_texts_and_rows_without_id(spark):
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 150) for _ in range(4))
    near = {x: " ".join(x.split()[:-1] + ["changed"]) for x in (a, b, c, d)}
    rows = [(5, a), (5, b), (9, near[a]), (11, near[b]), (20, c), (None, c), (None, near[c]), (None, d), (None, d), (None, near[d]),
            (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == {(5, 5, True), (9, 5, False), (11, 5, False), (20, 20, True)}
    kept = [(r.doc_id, r.text) for r in minhash.without_copies(docs).collect()]
    assert sorted(t for i, t in kept if i is not None) == sorted([a, b, c]) and kept.count((None, "")) == 2
    assert len(kept) == 6 and [t for i, t in kept if i is None and t][0] in (d, near[d])


def test_columns_with_clashing_names(spark):
    names = ["id", "_id", "key", "_key", "n", "kept", "component", "part"]
    rows = [(1, "one two three four five six seven", *names), (2, "one two three four five six seven", *names), (3, "else", *names)]
    left = minhash.without_copies(spark.createDataFrame(rows, ["doc_id", "text", *names]))
    assert left.columns == ["doc_id", "text", *names] and sorted(r.doc_id for r in left.collect()) == [1, 3]
