"""Models and searches against brute force, exact sums or held-out accuracy, on small tables with odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import anisotropic, katz, language_id, mtree, ngram_jaccard, quality
from quarryline.llm.components import components

ODD = [(1, ""), (2, None), (3, "   \t\n"), (4, "one two"), (5, "ONE two"), (6, "a b c d e f"), (7, "1234 !!"), (8, "x " * 30000), (None, "no id at all"), (9, "a b c d e f")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "extra", 1) for i, t in ODD], "doc_id long, text string, lang string, score string, n int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_katz_base_and_normalisation(docs, odd):
    for table in (docs, odd):
        rows = [(r.doc_id, [*words(r.text), None]) for r in table.collect() if r.doc_id is not None]
        train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
        c = Counter(w for t in train for w in t)
        n, v = sum(c.values()), len(c)
        got = {r.doc_id: r for r in katz.train_and_score(table, 7, 2).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
            assert r.score <= 0
    assert katz.train_and_score(odd.limit(0), 7, 2).count() == 0


def test_katz_is_the_plain_recursion(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(12)]
    texts = [(i, " ".join(rng.choices(vocab, [12 - k for k in range(12)], k=rng.randint(0, 30)))) for i in range(300)]
    rows = [(i, [*t.split(), None]) for i, t in texts]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t))
    met = lambda c: np.array([sum(x == r for x in c.values()) for r in range(1, 7)])
    d1, d2 = (np.append(katz.discounts(met(c)), 1.0) for c in (one, two))
    total = sum(one.values())
    left = sum(c * (1 - d1[min(c, 6)]) for c in one.values())
    p1 = (lambda w: d1[min(one[w], 6)] * one[w] / total if one[w] else left / total) if left > 1e-9 else (lambda w: (one[w] or 1) / (total + 1))
    after = defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c

    def p2(h, w):
        seen = after.get(h)
        if not seen:
            return p1(w)
        c, kept = sum(seen.values()), sum(d2[min(x, 6)] * x for x in seen.values())
        below = c + 1 if c - kept <= 1e-9 * c else c
        if w in seen:
            return d2[min(seen[w], 6)] * seen[w] / below
        return (below - kept) / below / max(1e-12, 1 - sum(p1(x) for x in seen)) * p1(w)

    for h in [*after][:8]:
        assert sum(p2(h, w) for w in [*one, "<unknown>"]) == pytest.approx(1)
    got = {r.doc_id: r.score for r in katz.train_and_score(spark.createDataFrame(texts, "doc_id long, text string"), 7, 2).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *t], t)), rel=1e-9)


def test_language(spark, sf_dir, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.95
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(odd).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0) and len(got) == 9
    assert language_id.keep_languages(d).columns == d.columns
    assert language_id.language_id(odd.limit(0)).count() == 0


def test_quality(spark, odd):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality(d, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out")
    right, n = out.agg(F.count_if(F.col("quality") == F.col("predicted")), F.count("*")).first()
    assert right / n > 0.85
    none = labels.limit(0)
    assert {r.score for r in quality.quality(odd, none).collect()} == {0.5}
    assert quality.quality(odd.limit(0), labels).count() == 0


def brute_jaccard(rows):
    sets, inverted = {}, defaultdict(list)
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for x in sets[i]:
            inverted[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = Counter((a, b) for found in inverted.values() for k, a in enumerate(found) for b in found[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("short,block,long_here", [(24, 512, 4), (2, 4, 10**9), (1, 3, 2)])
def test_jaccard_components(spark, odd, monkeypatch, short, block, long_here):
    for name, value in (("SHORT", short), ("BLOCK", block), ("LONG_HERE", long_here)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    rng = random.Random(short)
    base = [[f"w{rng.randint(0, 999)}" for _ in range(rng.choice([3, 8, 60, 120]))] for _ in range(12)]
    passage = [f"p{k}" for k in range(40)]
    rows = [(i, t) for i, t in ODD if i is not None]
    for i in range(20, 260):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = f"e{rng.randint(0, 9)}"
        rows.append((i, " ".join(text + (passage if rng.random() < 0.3 else []))))
    table = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(table).collect()}
    want = brute_jaccard(rows)
    assert got == want
    if short == 24:
        kept = ngram_jaccard.keep_one(table.withColumn("n", F.lit(1)))
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns == ["doc_id", "text", "n"]
        assert ngram_jaccard.near_duplicates(table.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(300)]
    rows += [(1000, None), (1001, [None] * 16), (1002, [float("nan")] * 16), (1003, [0.0] * 16), (1004, [1.0] * 5), (None, [1.0] * 16), (1050, [float("inf")] * 16), (1100, [0.0] * 16)]
    return spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, score string")


def exact(rows, step, k, zero):
    out = set()
    for q, x in rows.items():
        if q % step == 0 and (zero or any(x)):
            others = sorted(((-float(np.dot(x, y)), i) for i, y in rows.items() if i != q and (zero or any(y))))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(others, 1)}
    return out


def good(table):
    rows = {r.vec_id: r.embedding for r in table.collect() if r.vec_id is not None and r.embedding}
    return {i: np.array(e) for i, e in rows.items() if len(e) == 16 and all(c is not None and math.isfinite(c) for c in e)}


def test_mtree_is_exact(vectors):
    rows = {i: np.floor(256 * e) for i, e in good(vectors).items()}
    got = {tuple(r) for r in mtree.top_k(mtree.quantised(vectors), F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == {(q, n, i, int(s)) for q, n, i, s in exact(rows, 50, 5, True)}
    assert mtree.top_k(mtree.quantised(vectors.limit(0)), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_mtree_skips_products():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + rng.normal(size=(64, 8)) * 0.01 for c in rng.normal(size=(8, 8)) * 100]).round()
    row = mtree.node(0, 0, x[0], x, [np.array([i]) for i in range(len(x))])
    _, _, products = mtree.search(row, np.array([-1]), x[:1], np.array([-np.inf]), 3)
    assert products < len(x) / 2


def test_anisotropic_recall(vectors):
    want = exact(good(vectors), 20, 20, False)
    got = anisotropic.nearest(vectors, F.col("vec_id") % 20 == 0, 20).collect()
    pairs = {(q, i) for q, _, i, _ in want}
    assert len({(r.query_id, r.vec_id) for r in got} & pairs) / len(pairs) >= 0.9
    rows = good(vectors)
    assert all(r.score == pytest.approx(float(np.dot(rows[r.query_id], rows[r.vec_id]))) and r.vec_id != r.query_id for r in got)
    assert anisotropic.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, corpus_pipeline.language(spark, docs, sf_dir), sf_dir), sf_dir)
    assert kept.columns == docs.columns
    languages = {r.doc_id for r in language_id.language_id(docs).where("lang_pred <> 'und' and score >= 0.4").collect()}
    first = docs.where(F.col("doc_id").isin(list(languages)))
    good_ones = {r.doc_id for r in quality.quality(first, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("score >= 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good_ones]
    want = {c for _, c in brute_jaccard(rows).values()}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == want
