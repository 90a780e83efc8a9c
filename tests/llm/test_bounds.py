"""Sizes at which a switch or a slow path would show: long words, small samples, rows that differ beside their text, small groups of codes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import anisotropic, content_store, ngram_jaccard, quality
from quarryline.llm.token_tables import LONG, library, tokenizer_path, vocabulary


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_very_long_words(name):
    rng = np.random.default_rng(1)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    texts = [letters("abcdefghijklmnopqrstuvwxyz", n) for n in (LONG - 1, LONG, LONG + 1, 200_000)]
    texts += ["a" * 50_001, letters("日本語中文字", 40_000), "ab" * 3000 + " short words " + "xyz" * 3000, letters("ABab01+/", 2_000_000)]
    words, reference = vocabulary(tokenizer_path(name), name.startswith("byte")), library(tokenizer_path(name))
    began = time.time()
    ids, counts = words.encode(texts)
    took = time.time() - began
    began = time.time()
    want = [reference.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
    assert took < 20 * (time.time() - began) + 5


@pytest.mark.parametrize("each", [1, 2, 3, 31, 33])
def test_quality_learns_alike_at_every_size(spark, each):
    """Dictionaries and calibration never share a text, however few there are; a single text of a label is too few."""
    rng = np.random.default_rng(each)
    words = {1: ["river", "stone", "light", "winter", "garden"], 0: ["buy", "now", "click", "$$$", "win"]}
    rows = [(q, int(rng.integers(-(2**62), 2**62)), " ".join(rng.choice(words[q], 60))) for q in (0, 1) for _ in range(each)]
    model = quality.fit(spark.createDataFrame(rows, "quality int, h long, text string").repartition(3))
    if each == 1:
        assert (model.good, model.bad, model.score("river stone")) == (b"", b"", 0.5)
        return
    for q, data in ((1, model.good), (0, model.bad)):
        ranked = [t for _, _, t in sorted(r for r in rows if r[0] == q)]
        assert all((t.encode() in data) == (i % 2 == 0) for i, t in enumerate(ranked) if i % 2 or len(data) > each * 1000)
        assert ranked[0].encode()[:200] in data
    assert model.score("river stone light winter " * 20) > 0.5 > model.score("buy now click $$$ " * 20)


def test_keep_one_chooses_by_all_columns(spark):
    same = "one two three four five six seven eight"
    rows = [(1, same, "en", "b"), (1, same, "en", "a"), (1, same, None, "c"), (1, same, None, "c"), (2, same, "en", "a"), (3, None, "en", "y"), (3, "", "en", "x"), (3, None, "en", "z"), (4, None, None, None)]
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(rows))
        docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string, lang string, source string").repartition(1 + 2 * seed)
        kept = sorted(map(tuple, ngram_jaccard.keep_one(docs).collect()), key=str)
        assert kept == sorted([(1, same, None, "c"), (3, None, "en", "y"), (4, None, None, None)], key=str)


@pytest.mark.parametrize("keep", [1, 8, 96, 5000])
def test_anisotropic_groups_smaller_than_keep(spark, keep):
    """Groups of fewer vectors than ``keep`` go through the same scan; answers don't depend on it."""
    rng = np.random.default_rng(4)
    n, k = 600, 7
    x = rng.normal(size=(n, 12))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in anisotropic.nearest(table, F.col("vec_id") % 50 == 0, k, keep).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(0, n, 50):
        scores = (x * x[q]).sum(axis=1)
        assert [got[q][r] for r in range(1, k + 1)] == [i for i in np.lexsort((np.arange(n), -scores)).tolist() if i != q][:k]


def test_a_failed_job_leaves_no_table(spark, monkeypatch, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(content_store, "_recipes", lambda batches: (_ for _ in ()).throw(ValueError("lost")))
    with pytest.raises(Exception, match="lost"):
        content_store.write_store(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"), str(tmp_path / "s"))
    assert {t.name for t in spark.catalog.listTables()} == before
