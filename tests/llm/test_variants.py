"""Spelling variants, quality rules and the Merkle manifest against brute force, with odd rows; and against their SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import manifest, quality_rules, queries, spelling

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, TREE string, word int, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rows(texts, sources=("a", "b", None, "")):
    return [(i, t, "en" if i % 3 else None, sources[i % len(sources)], len(t or ""), "x", 1, 2) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_quality_rules", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[k] for k in columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


# Spelling variants


def _counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def _one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _grouped(words):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and _one_apart(v, w)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    rows = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return rows


def _variant_rows():
    """Words with a common beginning or end, chains of forms, repeated letters, accents, a long run, odd rows."""
    rng = np.random.default_rng(11)
    rows, letters = [], list("abcé×")
    for k in range(260):
        middle = "".join(rng.choice(letters, rng.integers(1, 5)))
        word = ("commonstart" + middle, middle + "commonending", "aaaa" + middle + "aaaa")[k % 3]
        rows += [(len(rows), f"{word.upper() if k % 2 else word}, {word};{word}9{word} {word}")]
    chain = ["gardener", "gardenerr", "gardenerrs", "xgardenerrs"]
    for k, word in enumerate(chain):
        rows += [(1000 + k, (word + " ") * (5 * 6 ** (3 - k)))]
    rows += [(2000, None), (2001, ""), (None, "nameless " * 7), (2002, "short word " * 9), (2003, ("z" * 70_001 + " ") * 5), (2003, ("z" * 70_000 + " ") * 5), (2004, "hôteldieu\U0001f600hôteldieu " * 3)]
    return rows


@pytest.mark.parametrize("group", [spelling.GROUP, 3])
def test_spelling_groups_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    rows = _variant_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 1, 2) for i, t in rows], COLUMNS).repartition(5)
    got = spelling.spelling_groups(docs).collect()
    assert len(got) == len({r.word for r in got})
    want = _grouped(_counted(rows))
    assert {tuple(r) for r in got} == want
    assert {r.root for r in got if "gardener" in r.word} == {"gardener"}
    assert any(r[3] and r[3] != r[5] for r in want)


def test_a_common_half_is_refined(spark, monkeypatch):
    """Thousands of words with one first half: no group keeps more than GROUP words while anything is left to split, and no pair is lost."""
    monkeypatch.setattr(spelling, "GROUP", 50)
    rng = np.random.default_rng(3)
    words = sorted({"samebeginning" + "".join(rng.choice(list("abcdefgh"), rng.integers(4, 9))) for _ in range(2500)})
    table = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    groups = spelling._groups(table)
    middle = F.col("size") - F.col("front") - F.col("back")
    assert groups.where(middle > 1).groupBy("key").count().agg(F.max("count")).first()[0] <= 50
    got = {(r.word, r.near) for r in spelling.near_words(table).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and _one_apart(a, b)} and got


def test_automaton_numbers_and_searches():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(0, 7))) for _ in range(400)})
    automaton = spelling.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("zz") == automaton.number("abcabcabcabc") == -1
    assert automaton.size < sum(map(len, words)) / 3
    for w in words:
        for exact in (0, len(w) // 2):
            found = automaton.near(w, exact)
            assert len(found) == len(set(found))
            assert {words[k] for k in found} == {v for v in words if len(w) <= len(v) <= len(w) + 1 and v[:exact] == w[:exact] and v != w and _one_apart(v, w)}
    assert spelling.Automaton([]).near("abc", 0) == []


def test_no_frequent_words(spark):
    for rows in ([], [(1, None)], [(1, "once only here")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert spelling.spelling_groups(docs).collect() == []


# Quality rules


def _measured(text):
    text = text or ""
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": 0, "line_chars": 0}
    seen = set()
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                out["n_dup_lines"] += 1
                out["line_chars"] += sum(map(len, WORD.findall(line)))
            seen.add(line)
    for n in (3, *quality_rules.SHARES):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts, seen, inside = Counter(grams), set(), set()
        for i, gram in enumerate(grams):
            if (counts[gram] > 1) if n == 3 else gram in seen:
                inside |= set(range(i, i + n))
            seen.add(gram)
        if n == 3:
            out["n_repeat_words"] = len(inside)
        else:
            out[f"chars_{n}"] = sum(len(words[i]) for i in inside)
    return out


def _clean(m):
    failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    return failed, not failed and 100 * m["line_chars"] <= 20 * m["word_chars"] and all(100 * m[f"chars_{n}"] <= s * m["word_chars"] for n, s in quality_rules.SHARES.items())


def _quality_texts():
    rng = np.random.default_rng(12)
    pool = [f"w{i}é" for i in range(3000)]
    fresh = lambda n: " ".join(rng.choice(pool, n))
    passage = fresh(30)
    texts = [None, "", " \n\t\n ", "one", "x y z x y z", "a b c d\n" * 3, "a b c d \na b c d\n a b c d", "#*$%&|<>\n#*$%&|<>", "é中\U0001f600 " * 60, fresh(200), fresh(20_000)]
    texts += [fresh(150) + " " + passage + "\n" + fresh(k) + "\n" + passage for k in (10, 60, 120, 400)]
    texts += ["\n".join([fresh(60), *(["The same line."] * k), fresh(40)]) for k in (2, 5, 9, 30)]
    texts += [" ".join(rng.choice(["yes", "no", "maybe"], 80)), "word" * 400_000, "tail of a row\n" + fresh(60), "tail of a row\n" + fresh(60)]
    return texts


def test_quality_rules_equal_brute_force(spark):
    texts = _quality_texts()
    docs = spark.createDataFrame([*_rows(texts), (None, texts[9], None, None, None, None, None, None)], COLUMNS).repartition(3)
    got = {r.doc_id: r.asDict() for r in quality_rules.repetition(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert {k: v for k, v in got[i].items() if k != "doc_id"} == _measured(text), i
    kept = quality_rules.keep_clean(docs)
    assert kept.columns == docs.columns
    want = sorted([i for i, t in enumerate(texts) if _clean(_measured(t))[1]] + [-1])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want
    assert 9 in want and any(not _clean(m)[0] and not _clean(m)[1] for m in map(_measured, texts))
    assert quality_rules.repetition(docs.limit(0)).collect() == quality_rules.keep_clean(docs.limit(0)).collect() == []


def test_coverage_does_not_cross_rows():
    """The last words of a row and the first of the next form no n-gram, and a line of another row is no earlier line."""
    texts = ["a b c d e f g\nh", "h\na b c d e f g", "h", "", "h"]
    found = quality_rules.measure(pa.array(texts))
    assert all(v.tolist() == [_measured(t)[k] for t in texts] for k, v in found.items())
    assert not found["n_dup_lines"].any() and not found["chars_5"].any()


# Merkle manifest


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(hashes):
    """The root and the siblings (left, right) of each leaf, level by level."""
    steps, place = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i : i + 16] for i in range(0, len(hashes), 16)]
        for k, p in enumerate(place):
            steps[k].append(("".join(runs[p // 16][: p % 16]), "".join(runs[p // 16][p % 16 + 1 :])))
            place[k] = p // 16
        hashes = [_hash("".join(r)) for r in runs]
    return hashes[0], steps


def _manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _hash("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    if not rows:
        return []
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    for found in by.values():
        found.sort(key=lambda x: x[:3])
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([x[2] for x in by[s]]) for s in sources]
    root, tops = _tree([t[0] for t in trees])
    out = []
    for s, (subroot, steps), top in zip(sources, trees, tops):
        for (_, _, digest, r), step in zip(by[s], steps):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if c < "\x80" else c for c in text)
            folded = leaf(r, text)
            for left, right in step + top:
                folded = _hash(left + folded + right)
            out.append((r[0], digest, subroot, root, _hash("".join(a + b for a, b in step + top)), folded, folded == root))
    return sorted(out, key=str)


def _manifest_rows():
    texts = [f"Text É {i}" if i % 7 else ("", None, "lower only")[i % 3] for i in range(700)]
    rows = _rows(texts, ["hot"] * 20 + [f"s{i}" for i in range(25)] + [None, "", "é", "Z", "a"])
    rows += [(5, "Text again", None, "hot", None, None, None, None)] * 40  # equal rows
    rows += [(None, "No Name", "en", s, 1, None, None, None) for s in ("hot", None, "alone")]
    rows += [(-3, "X" * 300_000, "en", "hot", 1, None, None, None)]
    return rows


@pytest.mark.parametrize("rows", [_manifest_rows(), _manifest_rows()[:1], _rows(["A"] * 17, ["one"]), _rows(["A"] * 257, ["one"]), []], ids=["odd", "single", "17", "257", "empty"])
def test_manifest_equals_brute_force(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, COLUMNS.replace("TREE", "pos")).repartition(7).write.parquet(path)
    got = manifest.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == _manifest(rows)
    if len(rows) > 300:
        assert {r.verified for r in got} == {True, False}


def test_a_proof_refuses_another_row(spark, tmp_path):
    docs = spark.createDataFrame(_rows([f"t{i}" for i in range(60)], ["a", "b"]), COLUMNS)
    made = manifest.build_manifest(docs, str(tmp_path / "m"))
    root = made.first()["root"]
    # The path of the row that is 32 before: another row's siblings don't lead to the root.
    other = made.select((F.col("doc_id") + 32).alias("doc_id"), F.col("path").alias("path_2"))
    told = made.join(other, "doc_id").select((manifest.folded(F.col("leaf"), F.col("path")) == F.lit(root.hex())).alias("own"), (manifest.folded(F.col("leaf"), F.col("path_2")) == F.lit(root.hex())).alias("others")).collect()
    assert told and all(r.own and not r.others for r in told)
    kept = spark.read.parquet(*(str(p) for p in (tmp_path / "m/rows").iterdir()))
    assert kept.count() == 2 * (2 + 1)
