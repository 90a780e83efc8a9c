"""Inputs on which a bound, a cut or an arbitrary choice would show: hot groups, many labels, repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import anisotropic, language_id


@pytest.mark.parametrize("noise", [0.0, 1e-6, 0.02])
def test_anisotropic_hot_group(spark, noise):
    """A third of all rows are copies or near copies: far more of them in each group of codes than ``keep``."""
    rng = np.random.default_rng(6)
    n, k = 9000, 20
    x = rng.normal(size=(n, 16))
    hot = rng.permutation(n)[: n // 3]
    x[hot] = 2 * x[hot[0]] + noise * rng.normal(size=(len(hot), 16))
    step = 450
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in anisotropic.nearest(table, F.col("vec_id") % step == 0, k).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert len(got) == n // step
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(n), -scores)).tolist() if i != q][:k]
        assert [found[r] for r in range(1, k + 1)] == order


def test_anisotropic_counts_repeated_rows(spark):
    """Copies of the query's own rows take no part, those of another row count each."""
    rows = [(0, [2.0, 1.0])] * 5 + [(1, [2.0, 1.0])] * 4 + [(2, [-0.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in anisotropic.nearest(table, F.col("vec_id") == 2, 5).collect()}
    assert [got[2, r] for r in range(1, 6)] == [(0, 1.0)] * 5
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in anisotropic.nearest(table, F.col("vec_id") == 4, 7).collect()}
    assert [got[4, r] for r in range(1, 8)] == [(0, 2.0)] * 5 + [(1, 2.0)] * 2
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in anisotropic.nearest(table, F.col("vec_id") == 3, 10).collect()}
    assert [got[3, r] for r in range(1, 11)] == [(0, 1.0)] * 5 + [(1, 1.0)] * 4 + [(2, 1.0)]


def _made_up(labels, rng):
    """(label, text) rows of invented languages with words in common, as many for each label as ``labels`` says."""
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda p: "".join(rng.choice(letters, rng.integers(2, 8), p=p))
    common, rows = [word(None) for _ in range(150)], []
    for label, n in labels.items():
        own = [word(p) for p in [rng.dirichlet(np.full(26, 0.6))] for _ in range(150)]
        rows += [(label, " ".join(rng.choice(common if rng.random() < 0.3 else own) for _ in range(rng.integers(20, 60)))) for _ in range(n)]
    return rows


def test_language_learns_more_than_64_labels(spark):
    """The rarer labels of 90 are told and pass the pipeline's threshold as the commoner ones do."""
    rows = _made_up({f"l{i:02}": 36 if i < 64 else 18 for i in range(90)}, np.random.default_rng(8))
    docs = spark.createDataFrame([(i, t, a) for i, (a, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(8).cache()
    out = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    shares = {r.rare: (r.right, r.passed) for r in out.groupBy((F.col("lang") >= "l64").alias("rare")).agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.avg((F.col("score") >= 0.4).cast("int")).alias("passed")
    ).collect()}
    assert min(shares[True]) > 0.85 and min(shares[False]) > 0.85
    kept = {r.lang: r.n for r in language_id.keep_languages(docs).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert len(kept) == 90 and sum(kept.values()) > 0.9 * len(rows)
