"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from relflow.llm.secrets import BASE, RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, least(len(w), 5) AS k, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _kind(rank: int) -> str:
    """Spans of one rule: what stands between matches tells where they are."""
    r = RULES[rank]
    p = _quoted(r.pattern)
    return f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, list_sum([length(x) for x in s[1:k]])::BIGINT + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0)::BIGINT AS a,
  length(m[k])::BIGINT AS n, length(v[k]) AS measured
FROM (SELECT doc_id, regexp_split_to_array(t, {p}) AS s, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.measured}) AS v FROM d), unnest(range(1, len(m) + 1)) AS u(k)
WHERE length(v[k]) >= {r.least}"""


_LINE = "string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank)"
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(map(_kind, range(len(RULES))))}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, {_LINE} FILTER (WHERE rank < {len(BASE)}) AS base, {_LINE} AS spans FROM f GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

SQL = {"op1_decontamination": DECONTAMINATION, "op5_near_duplicates": NEAR_DUPLICATES, "op9_secret_scan": SECRETS}
