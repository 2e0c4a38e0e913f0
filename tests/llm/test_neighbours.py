import numpy as np
import pytest

from hourlens.llm import neighbours
from hourlens.llm.neighbours import Settings, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = vectors @ vectors[i]
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -scores[others]))][:k]
        out[int(ids[i])] = [(int(ids[j]), scores[j]) for j in best]
    return out


@pytest.mark.parametrize("dims, settings", [
    (64, Settings()), (10, Settings(block=50, queries=7, k=5)), (130, Settings(block=64, k=30))])
def test_recall_and_scores(spark, dims, settings):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    vectors = (centres[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, dims))).astype(np.float32)
    vectors[5] = vectors[6]  # a tie
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), 20, settings).collect()
    want = brute(np.arange(600), vectors.astype(float), 20, settings.k)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    for q, pairs in found.items():
        assert len(pairs) == settings.k
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
        for i, s in pairs:
            assert s == pytest.approx(float(vectors[i].astype(float) @ vectors[q].astype(float)), rel=1e-12)


@pytest.mark.parametrize("block", [16, 37, 8192])
def test_equal_vectors_are_in_order_of_their_ids(spark, block):
    """Copies of one vector lie in many blocks and at all places of a block; their scores are equal to the last bit."""
    rng = np.random.default_rng(block)
    vectors = rng.normal(size=(300, 48))
    copied = rng.choice(300, 120, replace=False)
    vectors[copied] = vectors[copied[rng.integers(0, 4, 120)]]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    docs = spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(5)
    found = {}
    for r in nearest(docs, 20, Settings(block=block, queries=5, width=6.0)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, own in found.items():
        exact = (vectors * vectors[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(300), -exact)) if i != q][:20]
        assert [i for _, i, _ in sorted(own)] == order


def test_bounds_hold():
    """Of the estimates nearly all are within the bound."""
    rng = np.random.default_rng(0)
    vectors, queries = rng.normal(size=(2000, 64)), rng.normal(size=(20, 64))
    turn = neighbours.rotation(64, 7)
    assert np.allclose(turn @ turn.T, np.eye(64))
    words, scale, off = neighbours.codes(vectors, turn)
    signs = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :64] * 2.0 - 1
    estimate = signs @ (queries @ turn.T).T * scale[:, None]
    error = np.abs(estimate - vectors @ queries.T)
    bound = 3 * off[:, None] * np.linalg.norm(queries, axis=1)
    assert (error <= bound).mean() > 0.99


def test_odd_rows(spark):
    v = [1.0, 2.0]
    rows = [(0, v, 1), (20, None, 1), (40, [0.0, 0.0], 1), (60, [float("nan"), 1.0], 1), (80, [1.0, None], 1),
            (100, [float("inf"), 1.0], 1), (1, [3.0, 4.0], 1), (1, [3.0, 4.0], 1), (2, [1.0, 2.0], 1), (3, [1.0], 1),
            (None, v, 1), (4, [], 1), (5, [1.0, 2.0], 1), (120, [2.0, 2.0, 2.0], 1)]
    got = nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [
        (0, 1, 1, 11.0), (0, 2, 2, 5.0), (0, 3, 5, 5.0)]
    assert nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_what_is_repeated_is_never_broadcast(spark):
    """Only queries go to every group; few bytes of them must not become a broadcast of all their copies, and rounds change nothing."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 32))
    docs = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA.replace("float", "double")).repartition(3)
    settings = Settings(block=40, queries=4, k=5, width=6.0)
    found = nearest(docs, 20, settings)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    want = brute(np.arange(400), vectors, 20, 5)
    assert [(q, r, i) for q, r, i, _ in rows] == [(q, r, i) for q in sorted(want) for r, (i, _) in enumerate(want[q], 1)]
    again = nearest(docs, 20, Settings(block=40, queries=4, k=5, width=6.0, asked=6))
    assert sorted(map(tuple, again.collect())) == rows
