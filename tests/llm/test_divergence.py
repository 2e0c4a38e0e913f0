import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from hourlens.llm import divergence as div
from hourlens.llm.queries import DIVERGENCE_SQL

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(rows, least=10, top=10):
    """Every share of every kept term in every group, and all pairs of groups."""
    count, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        count[lang, source].update(terms(text))
        in_docs[lang].update(set(terms(text)))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            best = [(-apart(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in ("pair", sorted(pair)), ("term", sorted(best)[:top]):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(items, 1)}
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["a", "The", "word", "été", "中文字", "x" * 8, "y" * 9, "z" * 16, "w" * 17, "Z" * 40, "eightbyt", "ends-with", "q\0r"]
    weights = [rng.random() ** 3 for _ in words]
    return [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", "", None, "S"]),
             " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for _ in range(n)]


SCHEMA = "lang string, source string, text string"


@pytest.mark.parametrize("n, least", [(400, 10), (60, 3), (30, 100)])
def test_rows_equal_brute_force(spark, n, least):
    rows = [*corpus(n), ("xx", "only", "none kept here"), ("xx", "two", None), ("alone", "one", "")]
    found = div.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), least).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == brute(rows, least)


def test_sql_equals_brute_force(spark):
    documents = spark.createDataFrame(corpus(300, 4), SCHEMA).toPandas()
    found = duckdb.sql(DIVERGENCE_SQL).fetchall()
    assert set(found) == brute(documents.itertuples(index=False))


def test_odd_rows(odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert {tuple(r) for r in div.divergence(odd, 1).collect()} == brute(rows, 1)
    assert div.divergence(none).collect() == []


def test_counts_of_long_and_short_terms():
    rng = random.Random(2)
    made = ["".join(rng.choice("abAB zé中.\0\n") for _ in range(rng.randint(0, 90))) for _ in range(2000)]
    made += ["x" * 70_000, "", "é" * 9000 + " " + "a" * 17]
    groups = np.array([rng.randint(0, 70_000) for _ in made])
    own, n, in_docs, found = div.count_terms([t.encode() for t in made], groups)
    count, docs = Counter(), Counter()
    for g, text in zip(groups.tolist(), made):
        count.update((g, t) for t in terms(text))
        docs.update({(g, t) for t in terms(text)})
    got = list(zip(own.tolist(), found.to_pylist(), n.tolist(), in_docs.tolist()))
    assert sorted(got) == sorted((g, t, c, docs[g, t]) for (g, t), c in count.items())


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 5000).astype(np.uint32), rng.integers(0, 2**63, 40).astype(np.uint64)[rng.integers(0, 40, 5000)]
    assert (div.radix_order([a, b]) == np.lexsort([b, a])).all()


def test_shares_stay_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, size long, terms long")
    found = row.select(div._share("n", "size", "terms").alias("p")).first().p
    assert found == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)
