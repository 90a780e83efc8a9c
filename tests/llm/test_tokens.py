"""Token operators against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.llm import bpe, content_store, packing, token_counts
from quarryline.llm.common import shared_folder
from quarryline.llm.token_tables import Vocabulary, library, tokenizer_path, vocabulary

ODD = [
    (1, ""), (2, None), (3, "a <|endoftext|> b"), (4, "日本語 text x　 y"), (5, "it's WE'RE  they'll   \n\n x '' 'tis"),
    (6, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbbbbb"), (7, "x" * 5000), (8, "word " * 6000), (9, "\x00\x1c\x1f\x85\xa0 tab\ttab  "),
    (10, "ſ ĸ İ ǅ Å é naïve ½ ² 12345"), (11, "word " * 6000), (11, "word " * 3), (None, "no id"), (12, "😀😀 🇩🇪"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in ODD], "doc_id long, text string, n_tokens string, ids int")


def rows(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,speculation", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True), ("byte_bpe_50k.json", False)])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(
    st.text(st.sampled_from("aAtThHeE' \n\t1é.,'sre\u0301\u0307ΣσςİıΑ\u3000\u2019—Жж日本ー가각ｱ٣²Ⅷ\u200b\u200d😀🇩"), max_size=20),
    st.text(st.characters(exclude_categories=["Cs"]), max_size=20), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>"]),
), max_size=6).map("".join), max_size=4))
def test_encoding_equals_the_library(name, speculation, texts):
    words = vocabulary(tokenizer_path(name), speculation)
    flat, counts = words.encode(texts)
    want = [library(tokenizer_path(name)).encode(t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_no_text_is_left_to_the_library(monkeypatch):
    """Curly quotes, dashes, Greek, Cyrillic, CJK and emoji are encoded by the dealt method."""
    from quarryline.llm import token_tables

    texts = ["“quoted” – and don’t…", "ΟΔΥΣΣΕΥΣ και Σίσυφος", "Привет, мир! Ёлка", "日本語のテキスト、中文字符", "한국어 텍스트", "😀👍🏽 emoji 🇩🇪", "e\u0301 A\u030a \u212b", "मानक हिन्दी १२३", "x<|endoftext|>y"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        want = [library(tokenizer_path(name)).encode(t, add_special_tokens=False).ids for t in texts]
        with monkeypatch.context() as m:
            m.setattr(token_tables, "library", None)
            words = Vocabulary(tokenizer_path(name), name.startswith("byte"))
            flat, counts = words.encode(texts)
        assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
        assert words.spoken_whole > 0 and words.seen > len(texts)


def test_counts(spark, sf_dir, odd):
    lib = library(tokenizer_path("word_bpe_49k.json"))
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        want = sorted((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect() if r.doc_id is not None)
        got = token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json")).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.token_counts(odd.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_round_trip(spark, sf_dir, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        want = []
        for r in docs.collect():
            if r.doc_id is not None:
                ids = library(path).encode(r.text or "", add_special_tokens=False).ids
                text = library(path).decode(ids, skip_special_tokens=False)
                want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.round_trip(bpe.encode(docs, path), path).collect())) == sorted(want)


def test_whole_strings_are_proved():
    words = Vocabulary(tokenizer_path("byte_bpe_50k.json"))
    lib = library(tokenizer_path("byte_bpe_50k.json"))
    for piece, i in list(words.alone.items())[::500]:
        assert lib.encode(piece, add_special_tokens=False).ids == [i]


def brute_force_packing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in room if r >= n), default=None)
        if best is None:
            room.append(capacity - n)
        else:
            room[room.index(best)] -= n
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_equals_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used, placed = {}, {}
    for length, rank, each, first, offset in sorted(packing.plan(histogram, 20).tolist(), key=lambda r: (-r[0], r[1])):
        last = min([r for n, r, *_ in packing.plan(histogram, 20).tolist() if n == length and r > rank], default=histogram[length])
        for k in range(last - rank):
            b, at = first + k // each, offset + k % each * length
            assert placed.get(b, 0) == at  # gapless, in order of length
            placed[b] = at + length
            used[b] = used.get(b, 0) + length
    assert sorted(20 - u for u in used.values()) == brute_force_packing(lengths, 20)


def test_packing(spark, sf_dir, odd):
    lib = library(tokenizer_path("byte_bpe_50k.json"))
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        want = []
        for r in docs.collect():
            if r.doc_id is None:
                continue
            ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
            first = (len(ids) - 1) % 2048 + 1
            edges = [0, *range(first, len(ids) + 1, 2048)]
            want += [(r.doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        got = packing.best_fit_packing(docs).collect()
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        bins = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert bins.get(r.sequence_id, 0) == r.offset
            bins[r.sequence_id] = r.offset + r.length
        assert sorted(2048 - n for n in bins.values()) == brute_force_packing([w[3] for w in want], 2048)
    assert packing.best_fit_packing(odd.limit(0)).count() == 0


def test_store(spark, sf_dir, odd):
    path = tokenizer_path("word_bpe_49k.json")
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd.where("doc_id is null or doc_id <> 11")):
        folder = shared_folder(spark, "store")
        content_store.write_store(docs, path, folder)
        got = {r.doc_id: r for r in content_store.read_store(spark, folder).collect()}
        start, sums = 0, []
        for r in sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: r.doc_id):
            ids = [*library(path).encode(r.text or "", add_special_tokens=False).ids, 1]
            g = got.pop(r.doc_id)
            assert (g.start, g.n_tokens, np.frombuffer(g.ids, "<u4").tolist()) == (start, len(ids), ids)
            start += len(ids)
            sums.append((r.doc_id, g.start, len(ids), crc(ids)))
        assert not got
        assert sorted(map(tuple, content_store.digests_read(spark, folder).collect())) == sorted(sums)
        chunks = spark.read.parquet(f"{folder}/chunks")
        assert chunks.count() == chunks.select("digest").distinct().count()
    folder = shared_folder(spark, "store")
    content_store.write_store(odd, path, folder)
    assert content_store.read_store(spark, folder).where("doc_id = 11").count() == 2


@pytest.fixture(scope="module")
def written(spark, odd):
    """A store whose Merkle tree has several levels."""
    folder = shared_folder(spark, "store")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(content_store, "FAN", 4)
        content_store.write_store(odd, tokenizer_path("word_bpe_49k.json"), folder)
    spark.read.parquet(f"{folder}/chunks").createOrReplaceTempView("chunks_seen")
    return folder


@pytest.mark.parametrize("table,change,match", [
    ("chunks", lambda t: t.withColumn("ids", F.expr("overlay(ids placing x'0909' from 1)")), "match"),
    ("chunks", lambda t: t.where("digest <> (select max(digest) from chunks_seen)"), "do not match"),
    ("recipes", lambda t: t.withColumn("digests", F.when(F.col("doc_id") == 8, F.reverse("digests")).otherwise(F.col("digests"))), "level 1"),
    ("recipes", lambda t: t.withColumn("doc_id", F.when(F.col("doc_id") == 5, 6).when(F.col("doc_id") == 6, 5).otherwise(F.col("doc_id"))), "level 1"),
    ("recipes", lambda t: t.where("doc_id <> 8"), "level 1"),
    ("recipes", lambda t: t.withColumn("start", F.col("start") + 1), "level 1"),
    ("manifest", lambda t: t.withColumn("tokens", F.when(F.col("level") == 1, F.col("tokens") + 1).otherwise(F.col("tokens"))), "level 1"),
    ("manifest", lambda t: t.withColumn("hash", F.when(F.col("level") == 2, F.reverse("hash")).otherwise(F.col("hash"))), "level 2"),
    ("head", lambda t: t.withColumn("root", F.reverse("root")), "root"),
])
def test_store_refuses_what_was_changed(spark, written, monkeypatch, table, change, match):
    monkeypatch.setattr(content_store, "FAN", 4)
    other = shared_folder(spark, "store")
    for name in ("chunks", "recipes", "manifest", "head"):
        t = spark.read.parquet(f"{written}/{name}")
        t = (change(t) if name == table else t).coalesce(1)
        (t.write.partitionBy("level") if name == "manifest" else t.write).parquet(f"{other}/{name}")
    with pytest.raises(Exception, match=match):
        content_store.digests_read(spark, other).collect()
    if table != "manifest":
        with pytest.raises(Exception, match=match):
            content_store.read_store(spark, other).collect()
