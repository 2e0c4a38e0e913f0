import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hourlens.llm import bpe, token_counts, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def strange_texts(n, seed=1):
    rng = random.Random(seed)
    letters = " \n\t ab'sÀ1.,  \x0b\x1f́ΣİßÑ​中\U0001f600͸"
    ends = ["", "<|endoftext|>", " <|endoftext|>x", "<|startoftext|>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(ends) for _ in range(n)]


def test_counts_equal_the_library():
    texts, library = strange_texts(5000) + [None], Tokenizer.from_file(BYTES)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    known = {"ab": len(library.encode(" ab", add_special_tokens=False).ids)}
    assert token_counts.count_texts(texts, known, BYTES, 50).tolist() == want


def test_ids_equal_the_library():
    texts, library = strange_texts(5000, 2) + [None], Tokenizer.from_file(WORDS)
    want = [[*e.ids, 2] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = token_files.encode_texts(texts, WORDS, 2, 50)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_neighbouring_signs_are_split_like_the_library():
    """All pairs of ASCII signs side by side, beside letters, digits and spaces."""
    signs = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    texts = [f"{left}{x}{y}{right}" for x in signs for y in signs for left in ("", "a", "1 ", " ") for right in ("", "b", "2", " .")]
    texts += ["a_, b", "so _this_, and that_. end", "a._b", ",_", "_,_._", "'s_.", "x_y,z"]
    library = Tokenizer.from_file(WORDS)
    want = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in token_files.encode_texts(texts, WORDS, 2, 10**6)] == want
    counts = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(texts, {}, BYTES, 10**6).tolist() == counts


@pytest.mark.parametrize("start", range(0, 0x30000, 0x8000))
def test_every_character_is_split_like_the_library(start):
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} {chr(c)}A \n{chr(c)}x's" for c in range(start, start + 0x8000, 7)
             if not 0xD800 <= c < 0xE000]
    if texts:
        counts = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
        assert token_counts.count_texts(texts, {}, BYTES, 10**6).tolist() == counts
        ids = [[*e.ids, 2] for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(g, "<u4").tolist() for g in token_files.encode_texts(texts, WORDS, 2, 10**6)] == ids


def test_count_rows(odd, none):
    rows = token_counts.token_counts(odd, BYTES, limit=5).collect()
    library = Tokenizer.from_file(BYTES)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "").ids), n > 5)
                   for r in odd.collect())
    assert Counter(map(tuple, rows)) == want
    assert token_counts.token_counts(none, BYTES).collect() == []


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408, 1 << 32])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::37] = min(high * 5, (1 << 32) - 1)
    payload = token_files.encode(ids)
    assert (token_files.decode(payload) == ids).all()
    assert (token_files.decode(payload, 500, 1030) == ids[500:1030]).all()


def test_outliers_are_exceptions():
    ids = np.full(512, 7, np.uint32)
    ids[5] = 4_000_000_000
    assert len(token_files.encode(ids)) < 60


def test_files(odd, none):
    library = Tokenizer.from_file(WORDS)
    rows = sorted(token_files.token_files(odd, WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i))
    place = 0
    for r in rows:
        assert r.start == place
        place += r.n_tokens
    crc = Counter()
    for r in odd.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        crc[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == crc
    assert token_files.token_files(none, WORDS).collect() == []


def test_texts_of_one_doc_id_have_an_order(spark):
    rows = [(1, "b b"), (1, "a"), (1, None), (1, "c c c"), (0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.token_files(docs, WORDS).collect())
    assert found == [(0, 0, 2), (2, 1, 1), (3, 1, 2), (5, 1, 3), (8, 1, 4)]


def test_whole_texts_are_left_to_the_library_where_classes_are_in_doubt():
    assert bpe.spaced("plain Text, here.").split() == ["plain", "text", ",", "here", "."]
    assert bpe.spaced("a ͸") is None
    assert bpe.space_pieces("a \n b") is not None and bpe.space_pieces("a\n \nb") is None
