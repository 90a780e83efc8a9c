"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once per worker (``Vocabulary.whole``);
pre-tokens among them count one, and only the rest are merged. No shuffle: each task counts its own rows.

Defined results: null text counts as the empty text (0 bytes, 0 tokens); rows without doc_id are left out;
repeated rows are counted each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.common import documents, slices, texts, to_batches
from quarryline.llm.token_tables import tokenizer_path, vocabulary

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every text."""

    def count(batches):
        words = vocabulary(path)
        for batch in slices(batches):
            text = batch.column("text")
            n_bytes = np.asarray(pa.compute.binary_length(text), np.int64)
            n_tokens = words.counts(text.to_pylist())
            yield to_batches({"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": n_tokens > limit}, SCHEMA)

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
