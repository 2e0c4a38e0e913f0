"""The corpus pipeline on a small corpus with planted rows, stage by stage and as a whole."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hourlens.llm import mixing

from .conftest import odd_rows, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, copies int, held_id string, _id int"
EXTRA = (0, "h", 9, "x", 1)
PASSAGE = ("A farm has 14 cows and 9 goats and the farmer sells 3 cows to the neighbour who pays 20 dollars for each "
           "of them, so how many animals are left on the farm at the end of that day?")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, toxic ones with some labelled, groups of exact and near copies, benchmark passages, odd rows."""
    rng = random.Random(31)
    bad = ["vilex", "grubon", "stankur", "morbid"]
    docs, labels, kind = [], [], {}
    for i in range(240):
        text = prose(rng, rng.randint(40, 90))
        kind[i] = "clean"
        if i % 4 == 0:
            words = text.split()
            for _ in range(12):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
            text, kind[i] = " ".join(words), "toxic"
        docs.append((i, text, "en", f"s{i % 3}"))
        if i % 8 < 6:
            labels.append((i, 1, int(kind[i] == "toxic")))
    for i in range(300, 330):
        base = docs[(i - 300) % 5 * 4 + 1][1]
        words = base.split()
        if i % 2:
            words[-1] = "changed"
        docs.append((i, " ".join(words), "en", "s1"))
        kind[i] = "copy"
    for i in range(400, 410):
        docs.append((i, f"{prose(rng, 40)}. {PASSAGE} {prose(rng, 40)}", "en", "s2"))
        kind[i] = "leak"
    out = tmp_path_factory.mktemp("corpus")
    odd = [(r[0] + 1000 if r[0] is not None else None, *r[1:4]) for r in odd_rows()]
    rows = [(*r, *EXTRA) for r in docs + odd]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, PASSAGE), (1, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), kind


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_clean_rows_and_columns(spark, folder):
    base, kind = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    of = lambda name: {i for i, k in kind.items() if k == name}
    calm = corpus_pipeline.drop_toxic(spark, docs, base)
    assert calm.columns == docs.columns
    assert len(ids(calm) & of("toxic")) <= 3 and len(of("clean") - ids(calm)) <= 3
    single = corpus_pipeline.drop_copies(spark, docs, base)
    # A group of copies keeps its smallest id, which is the clean text it was made from.
    assert single.columns == docs.columns and not ids(single) & of("copy") and of("clean") | of("leak") <= ids(single)
    fair = corpus_pipeline.drop_benchmark(spark, docs, base)
    assert fair.columns == docs.columns and not ids(fair) & of("leak") and of("clean") | of("copy") <= ids(fair)
    mixed = corpus_pipeline.mix_sources(spark, docs, base)
    assert mixed.columns == docs.columns
    sizes = docs.select("source", mixing.size_of(docs["text"]).alias("n")).groupBy("source").sum("n").collect()
    assert {r.source for r in sizes} == {"s0", "s1", "s2", "a", "b", None, "é"}


def test_run_writes_what_the_stages_left(spark, folder):
    base, kind = folder
    found = corpus_pipeline.run(spark, base).collect()
    left = {r.doc_id for r in found}
    assert not left & {i for i, k in kind.items() if k in ("copy", "leak")}
    assert len(left & {i for i, k in kind.items() if k == "toxic"}) <= 3
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    library, place = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
        if r.doc_id in kind:
            own = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(own), zlib.crc32(own.tobytes()))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
