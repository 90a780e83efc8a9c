"""Models against brute force on small texts, and odd rows: repeated ids, nulls, empty tables, clashing names, long texts."""

import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import anisotropic, katz, language_id, mtree, ngram_jaccard, packing, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _grams(text):
    """The blended spectrum of a text's folded bytes, as plain sets."""
    raw = bytes(ord("0") if 48 <= b < 58 else b + 32 if 65 <= b < 91 else b for b in text.encode())
    return {raw[i : i + n] for n in (1, 2, 3, 4) for i in range(len(raw) - n + 1)}


def test_language_kernel_is_exact_kernel_ridge():
    """With every text a landmark the Nyström model is plain kernel ridge regression on the exact kernel of sets of n-grams."""
    rng = np.random.default_rng(3)
    words = {a: ["".join(rng.choice(list(letters), 4)) for _ in range(20)] for a, letters in {"x": "abcde", "y": "dfghi", "z": "ijkla"}.items()}
    texts = [(a, " ".join(rng.choice(words[a], 12))) for a in "xyz" for _ in range(20)]
    sample = [(a, language_id.gram_slots(np.frombuffer(t.encode(), np.uint8))) for a, t in texts]
    model = language_id.fit(sample, landmarks=1000, ridge=1e-2)
    order = sorted(range(60), key=lambda i: (sample[i][0], sample[i][1].tobytes()))
    learned = [texts[i] for i in order]
    kernel = lambda s, t: len(_grams(s) & _grams(t)) / math.sqrt(len(_grams(s)) * len(_grams(t)))
    k = np.array([[kernel(s, t) for _, t in learned] for _, s in learned])
    y = np.where(np.array([a for a, _ in learned])[:, None] == np.array(["x", "y", "z"]), 1.0, -1.0) - (2 / 3 - 1)
    dual = np.linalg.solve(k + 1e-2 * 60 * np.eye(60), y)
    fresh = [" ".join(rng.choice(words[a], 9)) for a in "xyzxyz"]
    want = np.array([[kernel(s, t) for _, t in learned] for s in fresh]) @ dual + (2 / 3 - 1)
    got = model.scores([np.frombuffer(t.encode(), np.uint8) for t in fresh])
    assert np.abs(got - want).max() < 2e-2  # slots may hold two n-grams
    assert (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_quality_sizes_and_calibration():
    """Sizes by fresh compressors; Newton's optimum is no worse than any point of a grid around it."""
    rng = np.random.default_rng(1)
    good, bad = (" ".join(rng.choice(w, 3000)).encode() for w in (["river", "stone", "light", "winter"], ["buy", "now", "click", "$$$"]))
    for text in ("", "river stone", "buy now " * 900, "light click " * 300):
        sizes = []
        for data in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw = text.encode()
            sizes.append(sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False).compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)))
        want = (sizes[1] - sizes[0]) / (sum(sizes) + quality.STEADY)
        assert quality.difference(text, good, bad) == pytest.approx(want, abs=1e-12)
    x = np.concatenate([rng.normal(0.2, 0.2, 80), rng.normal(-0.1, 0.2, 60)])
    y = np.array([1.0] * 80 + [0.0] * 60)
    slope, shift = quality.calibrate(x, y, 0.7, ridge=1e-4)
    scale = np.abs(x).mean()
    weight = np.where(y == 1, 0.7 / 80, 0.3 / 60)

    def loss(a, b):
        z = a * x / scale + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-4 * (a * a + b * b)

    best = loss(slope * scale, shift)
    assert all(best <= loss(slope * scale + da, shift + db) + 1e-9 for da in np.linspace(-2, 2, 21) for db in np.linspace(-2, 2, 21))


def test_quality_pieces_cover_the_whole_text():
    text = b"".join(b"%06d " % i for i in range(20000))
    cut = quality.pieces(text, 8 * quality.PIECE)
    assert len(cut) == 8 * quality.PIECE and text.index(cut[-quality.PIECE :]) > len(text) // 3
    assert quality.pieces(b"short", 4096) == b"short"


@pytest.fixture(scope="module")
def fitted(spark):
    """A corpus to learn from, with odd rows: null, empty and very long texts, no letters, repeated ids and rows, null labels."""
    rng = np.random.default_rng(9)
    words = {"en": ["the", "river", "and", "stone", "walks", "under", "light"], "fr": ["le", "fleuve", "et", "pierre", "marche", "sous", "lune"]}
    rows = [(i, " ".join(rng.choice(words[a], 40)), a, "s", 1) for i, a in enumerate(["en", "fr"] * 60)]
    rows += [(200, None, "en", None, None), (201, "", "fr", "s", 0), (202, "12 34 !!", "en", "s", 1), (203, "the river and stone " * 40000, None, "s", 1), (None, "no id the river", "en", "s", 1), (3, "another text le fleuve sous la pierre et lune marche", "fr", "s", 1), (5, rows[5][1], "fr", "s", 1), (5, rows[5][1], "fr", "s", 1)]
    return spark.createDataFrame(rows, COLUMNS).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i // 2 % 2, 0) for i in range(120)] + [(1, 1, 0), (2, None, None), (None, 1, 1), (999, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_models_on_odd_rows(fitted, labels):
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.language_id(fitted).collect()]
    assert len(got) == fitted.where("doc_id is not null").count()
    told = {i: p for i, p, _ in got}
    assert told[200] == told[201] == told[202] == "und" and told[203] == "en" and all(0 <= s <= 1 for _, _, s in got)
    scored = quality.quality(fitted, labels).collect()
    assert len(scored) == len(got) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert len({r.score for r in scored if r.doc_id in (200, 201)}) == 1


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, fitted, labels, tmp_path, stage):
    """Every stage takes odd rows, clashing names and an empty table; all but the last keep the columns, in order."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clashing = fitted.selectExpr("*", "1 AS h", "2 AS class", "'x' AS _made_0", "'y' AS lang_pred", "3 AS score", "4 AS label", "5 AS n", "6 AS piece", "7 AS _quality")
    for docs in (clashing, clashing.limit(0)):
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if stage is not corpus_pipeline.packing:
            assert out.columns == docs.columns
            held = {tuple(r) for r in docs.collect()}
            assert all(tuple(r) in held for r in rows)
        assert bool(rows) == bool(docs.limit(1).count())
    kept = {(r.doc_id, r.text) for r in stage(spark, fitted, str(tmp_path)).collect()} if stage is not corpus_pipeline.packing else set()
    if stage is corpus_pipeline.language:
        assert not {i for i, _ in kept} & {200, 201, 202} and 203 in {i for i, _ in kept}
    if stage is corpus_pipeline.near_duplicates:
        assert len([i for i, _ in kept if i == 3]) == 2 and len([i for i, _ in kept if i == 5]) == 1 and None not in {i for i, _ in kept}
    if stage is corpus_pipeline.packing:
        pieces = stage(spark, fitted, str(tmp_path)).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in fitted.where("doc_id is not null").collect()} and max(r.length for r in pieces) <= packing.CAPACITY


def test_jaccard_keeps_links_of_a_shared_id(spark):
    words = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = lambda w: " ".join([*w[:-1], "last"])
    rows = [(1, " ".join(words)), (1, " ".join(other)), (2, near(words)), (3, near(other)), (4, "alone with five words here")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = {(r.doc_id, r.component_id) for r in ngram_jaccard.near_duplicates(docs).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
        kept = sorted((r.doc_id, r.text) for r in ngram_jaccard.keep_one(docs).collect())
        assert kept == sorted([rows[0], rows[1], rows[4]])


def test_searches_ask_a_repeated_query_once(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [rows[0]] * 3 + [rows[7]] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    every = np.array([i for i, _ in rows])
    for got, vectors in (
        (mtree.top_k(mtree.quantised(table), F.col("vec_id") % 20 == 0, 5), np.floor(256 * np.array([v for _, v in rows]))),
        (anisotropic.nearest(table, F.col("vec_id") % 20 == 0, 5), np.array([v for _, v in rows])),
    ):
        found = {(r.query_id, r.rank): r.vec_id for r in got.collect()}
        assert len(found) == got.count() == 10
        for q in (0, 20):
            scores = vectors @ vectors[list(every).index(q)]
            order = [int(every[i]) for i in np.lexsort((every, -scores)) if every[i] != q][:5]
            assert [found[q, r] for r in range(1, 6)] == order


def test_anisotropic_splits_cells_and_queries(spark, monkeypatch):
    """Two thirds of the rows in one cell, several sides of it, several lanes of queries."""
    for name, value in (("SAMPLE", 200), ("GROUP", 64), ("SIDE", 2), ("LANE", 8), ("QUERIES", 4), ("LEAST_CELLS", 3), ("TASKS", 5)):
        monkeypatch.setattr(anisotropic, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6))
    x[:600] = x[0] + 0.01 * rng.normal(size=(600, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in anisotropic.nearest(table, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(got) == 45
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        others = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert [v for _, v, _ in sorted(found)] == others
        assert np.allclose([s for _, _, s in sorted(found)], scores[others])


def test_mtree_is_exact_with_many_subtrees(spark, monkeypatch):
    for name, value in (("SUBTREE", 32), ("HELD", 64), ("FAN", 4), ("PAGE", 8), ("QUERIES", 7), ("LEAST_ROUTES", 6)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(size=(150, 6)) for c in rng.normal(size=(6, 6)) * 8])
    x[300:600] = x[300]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    whole = np.floor(256 * x)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in mtree.top_k(mtree.quantised(table), F.col("vec_id") % 30 == 0, 5).collect()}
    for q in range(0, 900, 30):
        scores = whole @ whole[q]
        order = [int(i) for i in np.lexsort((np.arange(900), -scores)) if i != q][:5]
        assert [got[q, r] for r in range(1, 6)] == [(i, int(scores[i])) for i in order]


def test_katz_without_training_rows_and_with_repeated_rows(spark):
    held_out = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = spark.createDataFrame([(held_out, "a b c"), (held_out, None)], "doc_id long, text string")
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.train_and_score(alone, 7, 2).collect())
    assert got == [(1, 0, 0, 0.0, 0.0), (4, 0, 0, 0.0, 0.0)]
    learned = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2)
    twice = spark.createDataFrame([(learned, "a b")] * 3 + [(held_out, "a")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in katz.train_and_score(twice, 7, 2).collect())
    assert got == sorted([(learned, 3, 3, 9)] * 3 + [(held_out, 2, 2, 9)])
