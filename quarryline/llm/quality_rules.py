"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it has had before.

Texts are worked through in slices. Words get hashes of their bytes, n-grams rolling hashes of their words (the hash of n words is made from that of
n - 1), lines hashes of their bytes; equal hashes within a document are found by one sort a length. An n-gram can only repeat where the
shorter ones in it do, so that each length sorts only what the one before left. Hashes have 64 bits.

A document is judged bad if, for one length n of ``SHARES``, the characters of its words inside repeated n-grams (all but the first of each
kind; a word counts once however many cover it) are more than that percentage of its words' characters, or the characters of the words
of repeated lines more than ``LINE_SHARE`` percent.

Defined results: a null text is one without words; a text of fewer than n words has no n-gram; equal rows are judged alike, each; rows
without doc_id are left out; a line is what newlines part, compared byte for byte, spaces included, and counts if it has a word; a text of any length is read whole,
in one piece; extra columns are ignored by ``repetition`` and kept by ``keep_clean``; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import _powers, documents, mix, slices, text_bytes, texts, to_batches

#: The percentage of characters in repeated n-grams above which a text is bad, by n; and in repeated lines.
SHARES = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_SHARE = 20
#: Fixed values of the base rules.
LEAST_WORDS, BASE_N, BASE_SHARE = 50, 3, 50

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEXT = np.uint64(0xD1342543DE82EF95)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*COUNTS, "line_chars", *(f"chars_{n}" for n in SHARES))
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in MEASURES)])


@functools.cache
def _values() -> np.ndarray:
    """An odd 64-bit value for each byte."""
    return np.random.default_rng(20240612).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sums(raw: np.ndarray) -> np.ndarray:
    """Sums of the values of all bytes before each, each times its place's power; differences of them tell spans apart."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_values()[raw] * _powers(len(raw))[0], out=total[1:])
    return total


def _span_hashes(total: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes; equal ones for equal bytes."""
    with np.errstate(over="ignore"):
        return mix((total[stops] - total[starts]) * _powers(len(total))[1][starts] + (stops - starts).astype(np.uint64))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which have occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, before


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in a window of n words that starts at one of starts."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of the texts of an Arrow column."""
    raw, offsets = text_bytes(column.fill_null(""))
    rows = len(offsets) - 1
    row_of = lambda places: np.searchsorted(offsets, places, "right") - 1
    per_row = lambda row, weight=None: np.bincount(row, weight, minlength=rows).astype(np.int64)
    opens = np.zeros(len(raw) + 1, bool)
    opens[offsets] = True
    space, size = _SPACE[raw], len(raw)
    starts = np.flatnonzero(~space & (np.concatenate([[True], space])[:size] | opens[:-1]))
    stops = np.flatnonzero(~space & (np.concatenate([space, [True]])[1:] | opens[1:])) + 1
    row = row_of(starts)
    characters = np.concatenate([np.zeros(1, np.int64), np.cumsum((raw & 0xC0) != 0x80)])
    chars = characters[stops] - characters[starts]
    out = {"n_words": per_row(row), "word_chars": per_row(row, chars), "n_symbols": per_row(row_of(np.flatnonzero(_SYMBOL[raw])))}
    total = _sums(raw)

    newline = raw == 10
    line_ends = np.flatnonzero(newline | opens[1:])
    line_starts = np.concatenate([[0], line_ends + 1])[: len(line_ends)]
    line_stops = line_ends + ~newline[line_ends]
    in_line = np.searchsorted(line_ends, starts)
    words_in, chars_in = (np.bincount(in_line, w, minlength=len(line_ends)).astype(np.int64) for w in (None, chars))
    lines = np.flatnonzero(words_in)
    line_row = row_of(line_starts[lines])
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        _, again = _repeats(mix(_span_hashes(total, line_starts[lines], line_stops[lines]) + salt[line_row]))
    out |= {"n_dup_lines": per_row(line_row[again]), "line_chars": per_row(line_row[again], chars_in[lines[again]])}

    with np.errstate(over="ignore"):
        gram = _span_hashes(total, starts, stops)
        words, at, n = gram.copy(), np.arange(len(gram)), 1
        while n < max(SHARES):
            # Those that go on within their document, and whose last n words may repeat as well.
            at = at[at + n < len(words)]
            at = at[row[at] == row[at + n]]
            gram[at] = gram[at] * _NEXT + words[at + n]
            n += 1
            if n != BASE_N and n not in SHARES:
                continue
            twice, before = _repeats(mix(gram[at] + salt[row[at]]))
            if n == BASE_N:
                out["n_repeat_words"] = per_row(row[_covered(at[twice], n, len(words))])
            if n in SHARES:
                inside = _covered(at[before], n, len(words))
                out[f"chars_{n}"] = per_row(row[inside], chars[inside])
            at = at[twice]
    return out


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every document: counts, and characters inside repeated lines (``line_chars``) and n-grams (``chars_n``)."""

    def work(batches):
        for batch in slices(batches):
            yield to_batches({"doc_id": batch.column("doc_id")} | measure(batch.column("text")), _SCHEMA)

    return texts(docs).mapInArrow(work, ", ".join(f"{f.name} long" for f in _SCHEMA))


def base_failed(m):
    """The base rules on measures: columns or arrays by name."""
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > BASE_SHARE * m["n_words"])


def repetitive(m):
    """Whether a text's coverage by repeated lines or n-grams is above a limit."""
    found = 100 * m["line_chars"] > LINE_SHARE * m["word_chars"]
    for n, share in SHARES.items():
        found = found | (100 * m[f"chars_{n}"] > share * m["word_chars"])
    return found


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that pass the base rules and the limits on coverage; a null doc_id is no reason to go."""

    def work(batches):
        for batch in slices(batches):
            m = measure(batch.column("text"))
            yield batch.filter(pa.array(~base_failed(m) & ~repetitive(m)))

    return docs.mapInArrow(work, docs.schema)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = repetition(documents(spark, sf_dir))
    return m.select("doc_id", *COUNTS, base_failed(m).alias("base_failed"), (~base_failed(m) & ~repetitive(m)).alias("kept"), "line_chars", *(f"chars_{n}" for n in SHARES))
