"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quarryline.llm.manifest import FAN, LOWER, UPPER
from quarryline.llm.quality_rules import BASE_SHARE, LEAST_WORDS, LINE_SHARE, SHARES

#: crc32: a table for each byte value, made by eight steps of the polynomial, and the sum over a list of bytes.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY k) AS crc FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(k)))"""


def _crc(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def _ascii(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"


OP11 = f"""WITH RECURSIVE {_CRC_TABLE},
low AS (SELECT doc_id, translate(text, '{UPPER}', '{LOWER}') AS t FROM documents),
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM low) WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, n, {_crc("list_concat(" + _ascii("coalesce(doc_id::VARCHAR, '') || ':'") + ", flatten(list_transform(string_split(w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)))")} AS h FROM run, crc_table),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, (h % length(w))::BIGINT) || substring(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed),
word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gap AS MATERIALIZED (SELECT word, n, length(word) AS l, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS MATERIALIZED (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gap a JOIN gap b USING (rest, i, l) WHERE a.word <> b.word
    UNION SELECT g.word, g.n, w.word, w.n FROM gap g JOIN word w ON g.rest = w.word
    UNION SELECT w.word, w.n, g.word, g.n FROM gap g JOIN word w ON g.rest = w.word),
best AS (SELECT word, n, count(*) AS n_near, max(near_n) AS m FROM near GROUP BY word, n),
form AS MATERIALIZED (SELECT b.word, b.n_near, CASE WHEN m >= 5 * b.n THEN (SELECT min(near) FROM near x WHERE x.word = b.word AND x.near_n = m) END AS form, CASE WHEN m >= 5 * b.n THEN m END AS form_n FROM best b),
step AS (SELECT word, word AS root FROM word UNION ALL SELECT s.word, f.form FROM step s JOIN form f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, f.form, f.form_n, s.root FROM word w LEFT JOIN form f USING (word)
JOIN (SELECT step.word, step.root FROM step LEFT JOIN form ON step.root = form.word WHERE form.form IS NULL) s ON s.word = w.word"""

_WORD = "[^\\x20\\x09-\\x0D]"


def _grams(n: int, repeat: str, name: str) -> str:
    """The words of each text inside its windows of n words for which ``repeat`` (over rid, gram, i) holds: their number and characters."""
    return f"""{name}_window AS (SELECT rid, i, w, {repeat} AS again FROM (SELECT rid, i, w, CASE WHEN count(*) OVER s = {n} THEN string_agg(w, ' ') OVER s END AS gram FROM word WINDOW s AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING))),
{name} AS (SELECT rid, count(*) AS words, sum(length(w)) AS chars FROM (SELECT rid, w, bool_or(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM {name}_window) WHERE inside GROUP BY rid)"""


OP12 = f"""WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
word AS MATERIALIZED (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '{_WORD}+') AS w FROM doc)),
line AS (SELECT rid, l, row_number() OVER (PARTITION BY rid, l ORDER BY i) > 1 AS again FROM (SELECT rid, unnest(s) AS l, generate_subscripts(s, 1) AS i FROM (SELECT rid, string_split(text, chr(10)) AS s FROM doc)) WHERE regexp_matches(l, '{_WORD}')),
lines AS (SELECT rid, count(*) AS n, sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM line WHERE again GROUP BY rid),
counted AS (SELECT rid, count(*) AS words, sum(length(w)) AS chars FROM word GROUP BY rid),
{_grams(3, "gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1", "g3")},
{", ".join(_grams(n, "gram IS NOT NULL AND row_number() OVER (PARTITION BY rid, gram ORDER BY i) > 1", f"g{n}") for n in SHARES)},
found AS (SELECT doc_id, coalesce(c.words, 0)::BIGINT AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(k.n, 0)::BIGINT AS n_dup_lines, coalesce(g3.words, 0)::BIGINT AS n_repeat_words,
    coalesce(k.chars, 0)::BIGINT AS line_chars, {", ".join(f"coalesce(g{n}.chars, 0)::BIGINT AS chars_{n}" for n in SHARES)}
    FROM doc LEFT JOIN counted c USING (rid) LEFT JOIN lines k USING (rid) LEFT JOIN g3 USING (rid) {" ".join(f"LEFT JOIN g{n} USING (rid)" for n in SHARES)}),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_SHARE} * n_words AS base_failed FROM found)
SELECT *, NOT base_failed AND 100 * line_chars <= {LINE_SHARE} * word_chars {" ".join(f"AND 100 * chars_{n} <= {share} * word_chars" for n, share in SHARES.items())} AS kept FROM judged"""

#: Levels of a tree that the SQL spells out: enough for 16**6 rows.
_LEVELS = 6


def _leaf(text: str) -> str:
    told = (f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(told)})"


def _tree(name: str, nodes: str) -> str:
    """Levels name0 (nodes: tree, pos, hash) to the top and the path of each node of name0: siblings left and right by level, as lists."""
    parts = [f"{name}0 AS MATERIALIZED ({nodes})"]
    for k in range(1, _LEVELS + 1):
        below = f"(SELECT *, count(*) OVER (PARTITION BY tree) AS many FROM {name}{k - 1})"
        parts.append(f"""{name}{k} AS MATERIALIZED (SELECT tree, pos, CASE WHEN many = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY place)) END AS hash FROM (SELECT tree, pos // {FAN} AS pos, pos AS place, hash, many FROM {below}) GROUP BY tree, pos, many),
        {name}{k}_around AS (SELECT tree, pos, many > 1 AS real, coalesce(string_agg(hash, '') OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(hash, '') OVER (s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {below} WINDOW s AS (PARTITION BY tree, pos // {FAN} ORDER BY pos))""")
    # A level at which only the root is left changes nothing.
    told = ", ".join(f"CASE WHEN a{k}.real THEN [{{'l': a{k}.l, 'r': a{k}.r}}] ELSE [] END" for k in range(1, _LEVELS + 1))
    joins = " ".join(f"JOIN {name}{k}_around a{k} ON a{k}.tree = x.tree AND a{k}.pos = x.pos // {FAN ** (k - 1)}" for k in range(1, _LEVELS + 1))
    parts.append(f"{name}_path AS (SELECT x.tree, x.pos, flatten([{told}]) AS path FROM {name}0 x {joins})")
    return ",\n".join(parts)


OP13 = f"""WITH {_CRC_TABLE},
leaf AS MATERIALIZED (SELECT doc_id, source, {_leaf("text")} AS hash, CASE WHEN doc_id IS NOT NULL AND {_crc(_ascii("doc_id::VARCHAR"))} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents, crc_table),
placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos FROM leaf),
{_tree("row", "SELECT tree, pos, hash FROM placed")},
{_tree("top", f"SELECT 0 AS tree, tree AS pos, hash FROM row{_LEVELS}")},
whole AS (SELECT p.*, s.hash AS subroot, r.hash AS root, list_concat(a.path, b.path) AS path FROM placed p JOIN row_path a USING (tree, pos) JOIN row{_LEVELS} s ON s.tree = p.tree JOIN top_path b ON b.pos = p.tree, top{_LEVELS} r),
folded AS (SELECT *, list_reduce(list_prepend({{'l': '', 'r': coalesce(tampered, hash)}}, path), lambda a, s: {{'l': '', 'r': sha256(s.l || a.r || s.r)}}).r AS folded_root FROM whole)
SELECT doc_id, hash AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
