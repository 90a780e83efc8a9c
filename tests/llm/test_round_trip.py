"""op8 in one pass: one Python worker a core, arrays of bounded size, the same rows as its two steps."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa

from quarryline.llm import bpe
from quarryline.llm.token_tables import library, tokenizer_path, vocabulary

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = [
    (1, ""), (2, None), (3, "a <|endoftext|> b<|endoftext|>"), (4, "日本語 text x　 y 😀"), (5, "it's WE'RE  they'll   \n\n x"), (6, "x" * 5000),
    (7, "word " * 300_000), (7, "word"), (None, "no id"), (8, "\x00\x85\xa0 tab\t"), (9, "é" * (bpe.SLICE if hasattr(bpe, "SLICE") else 1 << 19)), (10, ""),
]


def test_query_has_one_worker_a_core(spark, sf_dir):
    """Two steps one behind the other are two Python workers a core, each with its own vocabulary and batches of ids between them."""
    plan = bpe.op8_bpe_round_trip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_one_pass_equals_the_library(spark):
    docs = spark.createDataFrame([(i, t, "more") for i, t in ODD], "doc_id long, text string, ids string").repartition(3)
    want = []
    for i, t in ODD:
        if i is not None:
            ids = library(PATH).encode(t or "", add_special_tokens=False).ids
            text = library(PATH).decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe.there_and_back(docs, PATH)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.schema == bpe.round_trip(bpe.encode(docs, PATH), PATH).schema
    assert bpe.there_and_back(docs.limit(0), PATH).count() == 0


class Recorded:
    """Stands for the texts: keeps the functions that the query hands to Spark, to run them in this process."""

    def __init__(self, *functions):
        self.functions = functions

    def mapInArrow(self, function, schema):  # noqa: N802
        return Recorded(*self.functions, function)

    def run(self, batches):
        for function in self.functions:
            batches = function(batches)
        return batches


def test_arrays_of_a_slice_are_bounded(spark, sf_dir, monkeypatch):
    """16 MB of text in one batch: what the worker holds beside its table of pre-tokens stays under 40 MB."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(2000)]
    texts = [" ".join(rng.choice(words, 600)) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    monkeypatch.setattr(bpe, "texts", lambda docs: Recorded())
    query = bpe.op8_bpe_round_trip(spark, sf_dir)
    vocabulary(PATH, True)._fresh()
    assert sum(o.num_rows for o in query.run([batch.slice(0, 1)])) == 1
    tracemalloc.start()
    try:
        rows = sum(o.num_rows for o in query.run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 40 << 20
