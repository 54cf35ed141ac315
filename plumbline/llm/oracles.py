"""SQL for the rows of queries whose operators are plain counting over words, shingles or patterns."""

from __future__ import annotations

from plumbline.llm import secrets

FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Every window of every item is looked up among all windows of each document; hit words are counted one by one.
DECONTAMINATION = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS passage
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM wanted),
places AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS passage
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs CROSS JOIN sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT r, size, i, passage FROM places SEMI JOIN wanted USING (size, passage)),
marked AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY r),
listed AS (SELECT r, list_sort(list(DISTINCT item)) AS ids FROM hits JOIN wanted USING (size, passage) WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (r) LEFT JOIN listed USING (r)
"""

#: Links between distinct sets by counting common shingles; reachability by recursion.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM docs),
hashed AS (SELECT r, doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS same FROM sets),
classes AS (SELECT same, min(r) AS r, min(doc_id) AS class, any_value(n) AS n FROM hashed WHERE n > 0 AND doc_id IS NOT NULL GROUP BY same),
grams AS (SELECT class, n, unnest(s) AS g FROM classes JOIN sets USING (r)),
common AS (SELECT a.class AS a, b.class AS b, a.n + b.n AS total, count(*) AS shared
  FROM grams a JOIN grams b ON a.g = b.g AND a.class < b.class GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 75 * (total - shared)
  UNION SELECT doc_id, class FROM hashed JOIN classes USING (same) WHERE doc_id <> class),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, u) AS (SELECT DISTINCT a, a FROM edges UNION SELECT v, b FROM reach JOIN edges ON u = a),
least_of AS (SELECT v AS doc_id, min(u) AS component FROM reach GROUP BY v)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id,
  coalesce(doc_id = coalesce(component, doc_id), true) AS kept
FROM hashed LEFT JOIN least_of USING (doc_id)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def secrets_oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``op6``: the stretches between matches and the matches, summed up, are the positions."""
    # The engine has no look-behind, which is not needed for a greedy run, and folds more than A-Z without regard to case.
    names = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    spelt = {"assign": rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "hex": "[0-9a-f]+"}
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = "'" + spelt.get(rule.kind, rule.pattern).replace("'", "''") + "'"
        parts.append(f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, unnest(range(1, len(m) + 1)) AS i,
    unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) AS gap, unnest(list_transform(m, lambda x: length(x))) AS len,
    unnest(list_transform(v, lambda x: length(x))) AS worth FROM (SELECT r, regexp_split_to_array(text, {pattern}) AS gaps,
    regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {rule.value_group}) AS v FROM docs)""")
    counts = ", ".join(f"CAST(count(s) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in secrets.BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {table}),
found AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, sum(gap + len) OVER (PARTITION BY r, rank ORDER BY i) AS stop FROM found),
spans AS (SELECT r, rank, kind, stop - len AS start, concat(kind, ':', stop - len, ':', stop) AS s FROM placed WHERE worth >= least)
SELECT doc_id, {counts},
  sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE)}), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans
FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id"""
