"""Groups of spelling variants: words of a corpus that differ by one code point, and the commoner form that each leads to.

Two words that differ by one inserted, deleted or replaced code point have the first or the last half of the shorter one in common. So each
word is dealt to the groups of its halves, by their length, once for words as long and once for words longer by one. A task puts
its groups' words into a minimal acyclic automaton, forward for first halves and of reversed words for last halves; every node knows how
many words lie before each of its branches, so that a walk ends with the word's number. A search matches the half exactly, then completes the word with one
error. Words found in both directions are counted once.

A half that more than ``GROUP`` words have in common is refined: the error lies in one half of what is left, so that either half of that
is exact as well; this goes on until a group is small enough or at most one code point is left (two for the longer words), which an
alphabet bounds. So no task gathers more than that, however many words begin alike.

Counts are summed in each task before the shuffle. Roots are found by doubling the steps taken through the forms; a
form has a multiple of its word's count, so a few rounds do.

Defined results: a null text has no words; a null doc_id is written as nothing (``:<run>``); rows that repeat a doc_id are counted each; extra columns are ignored;
an empty table, or one without frequent words, gives no rows. Texts and runs of any length are taken whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import documents, slices, small, stored, to_batches

#: A word's least length and count, and how much commoner a form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
NOISE = 199
#: Words of a group beyond which it is refined; words of a task that share an automaton.
GROUP, BATCH = 2048, 16384
#: Counts that a task holds before it hands them on.
HELD = 1 << 17

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _count(batches):
    counts: Counter = Counter()

    def handed():
        yield to_batches({"word": [w.decode() for w in counts], "n": list(counts.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))
        counts.clear()

    for batch in batches:
        for part in slices([batch]):
            ids, raws = part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist()
            for doc_id, raw in zip(ids, raws):
                seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for run, n in Counter(_RUN.findall((raw or b"").lower())).items():
                    length = len(run) - run.count(b"\xc3")
                    if length < LEAST_LENGTH:
                        continue
                    h = zlib.crc32(run, seed)
                    if h % NOISE == 0:
                        text, at = run.decode(), h % length
                        run = (text[:at] + text[at + 1 :]).encode()
                        if length == LEAST_LENGTH:
                            continue
                    counts[run] += n
                if len(counts) > HELD:
                    yield from handed()
    if counts:
        yield from handed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of the frequent words of docs."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of sorted different words. A node is (branches, final, words): branches lead a letter to a node and the number of words before it."""

    def __init__(self, words: list[str]):
        register: dict = {}
        open_nodes: list[list] = [[{}, False]]  # of the last word's letters: their branches, and whether a word ends there
        letters, before = "", ""

        def close(depth: int) -> None:
            while len(open_nodes) > depth + 1:
                branches, final = open_nodes.pop()
                key = (final, *((c, id(node)) for c, node in branches.items()))
                node = register.get(key)
                if node is None:
                    placed, passed = {}, int(final)
                    for c, child in branches.items():
                        placed[c] = (child, passed)
                        passed += child[2]
                    node = register[key] = (placed, final, passed)
                open_nodes[-1][0][letters[len(open_nodes) - 1]] = node

        for word in words:
            common = len(os.path.commonprefix((before, word)))
            letters = before
            close(common)
            open_nodes.extend([{}, False] for _ in word[common:])
            open_nodes[-1][1] = True
            before = word
        letters = before
        close(0)
        branches, final = open_nodes[0]
        placed, passed = {}, int(final)
        for c, child in branches.items():
            placed[c] = (child, passed)
            passed += child[2]
        self.start, self.size = (placed, final, passed), len(register) + 1

    def number(self, word: str) -> int:
        """A word's place among all in order, or -1."""
        return self._rest(self.start, word, 0, 0)

    @staticmethod
    def _rest(node, word: str, at: int, number: int) -> int:
        for c in word[at:]:
            step = node[0].get(c)
            if step is None:
                return -1
            node, number = step[0], number + step[1]
        return number if node[1] else -1

    def near(self, word: str, exact: int) -> list[int]:
        """Numbers of the words that one replaced or inserted code point makes of word, the first ``exact`` ones kept."""
        node, number, found, rest = self.start, 0, [], self._rest
        for c in word[:exact]:
            step = node[0].get(c)
            if step is None:
                return found
            node, number = step[0], number + step[1]
        for at in range(exact, len(word) + 1):
            here = word[at] if at < len(word) else None
            for c, (child, passed) in node[0].items():
                if c != here:  # inserted before the same letter, it is the one inserted behind it
                    if here is not None and (k := rest(child, word, at + 1, number + passed)) >= 0:
                        found.append(k)
                    if (k := rest(child, word, at, number + passed)) >= 0:
                        found.append(k)
            step = node[0].get(here)
            if step is None:
                break
            node, number = step[0], number + step[1]
        return found


def _dealt(words: DataFrame) -> DataFrame:
    """Each word's groups: (size, front, back): length of the shorter word of a pair, exact code points at both ends."""
    length = F.char_length("word")
    sizes = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    ends = F.array(F.struct(half.alias("front"), F.lit(0).alias("back")), F.struct(F.lit(0).alias("front"), (F.col("size") - half).alias("back")))
    return sizes.select("word", "n", "size", F.explode(ends).alias("e")).select("word", "n", "size", "e.*").withColumn("key", _key())


def _key():
    return F.xxhash64("size", "front", "back", F.expr("left(word, front)"), F.expr("right(word, back)"))


def _groups(words: DataFrame) -> DataFrame:
    """The rows of ``_dealt``, groups of more than GROUP refined."""
    rows, done = _dealt(words), None
    while True:
        large = stored(rows.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.lit(True).alias("large")), "large")
        number = large.count()
        if not number:
            return rows if done is None else done.unionByName(rows)
        marked = rows.join(small(large, number), "key", "left")
        middle = F.col("size") - F.col("front") - F.col("back")
        split = F.coalesce("large", F.lit(False)) & (middle > 1)
        fine = marked.where(~split).drop("large")
        done = fine if done is None else done.unionByName(fine)
        half = F.floor(middle / 2).cast("int")
        ends = F.array(F.struct((F.col("front") + half).alias("front"), "back"), F.struct("front", (F.col("back") + middle - half).alias("back")))
        rows = stored(marked.where(split).select("word", "n", "size", F.explode(ends).alias("e")).select("word", "n", "size", "e.*").withColumn("key", _key()), "refined")


_PAIRS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _search(batches):
    """Pairs, both ways, of the words of groups (size, front, back, words)."""
    held: dict[bool, tuple[dict, list]] = {}  # by direction: counts of the words, and what to search

    def pairs(forward: bool):
        counts, asked = held.pop(forward)
        turned = (lambda w: w) if forward else (lambda w: w[::-1])
        words = sorted(map(turned, counts))
        automaton, rows = Automaton(words), {c: [] for c in _PAIRS.names}
        for word, exact in asked:
            for k in automaton.near(turned(word), exact):
                other = turned(words[k])
                for a, b in ((word, other), (other, word)):
                    for c, v in zip(_PAIRS.names, (a, counts[a], b, counts[b])):
                        rows[c].append(v)
        return to_batches(rows, _PAIRS)

    for batch in batches:
        for group in batch.to_pylist():
            forward = group["front"] > 0
            counts, asked = held.setdefault(forward, ({}, []))
            counts.update((w["word"], w["n"]) for w in group["words"])
            asked.extend((w["word"], group["front"] or group["back"]) for w in group["words"] if len(w["word"]) == group["size"])
            if len(counts) >= BATCH:
                yield pairs(forward)
    for forward in list(held):
        yield pairs(forward)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words (word, n) that differ by one code point, both ways, once each."""
    gathered = _groups(words).groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "front", "back")), F.collect_list(F.struct("word", "n")).alias("words"))
    found = gathered.where("size(words) > 1").drop("key").mapInArrow(_search, "word string, n long, near string, near_n long")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form (word, form): the last word that forms lead to."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return now


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every frequent word of docs."""
    words = stored(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    good = form_n >= RATIO * F.col("n")
    near = stored(near.select("word", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, form_n).alias("form_n")), "near")
    led = words.join(near, "word", "left").join(roots(near.where("form is not null").select("word", "form")), "word", "left")
    return led.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))
