"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

OP2 = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents),
sized AS (SELECT doc_id, data, octet_length(data) AS n FROM texts),
starts AS (SELECT doc_id, data, unnest(range(0, n - 49)) AS q FROM sized),
strings AS (SELECT doc_id, q, md5(data[q + 1 : q + 50]) AS k FROM starts),
hits AS (SELECT doc_id, q FROM (SELECT doc_id, q, min(doc_id) OVER (PARTITION BY k) AS low FROM strings) WHERE doc_id > low),
marked AS (SELECT doc_id, q, CASE WHEN q <= lag(q) OVER (PARTITION BY doc_id ORDER BY q) + 50 THEN 0 ELSE 1 END AS opens FROM hits),
numbered AS (SELECT doc_id, q, sum(opens) OVER (PARTITION BY doc_id ORDER BY q) AS run FROM marked),
runs AS (SELECT doc_id, min(q) AS a, max(q) + 50 AS z FROM numbered GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
edges AS (SELECT doc_id, a AS z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a FROM runs
          UNION ALL SELECT s.doc_id, any_value(s.n), coalesce(max(r.z), 0) FROM sized s LEFT JOIN runs r USING (doc_id) GROUP BY s.doc_id),
kept AS (SELECT e.doc_id, string_agg(CASE WHEN e.z > e.a THEN hex(s.data[e.a + 1 : e.z]) ELSE '' END, '' ORDER BY e.a, e.z) AS h
         FROM edges e JOIN sized s USING (doc_id) GROUP BY e.doc_id)
SELECT s.doc_id, s.n AS n_bytes, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, coalesce(g.n_spans, 0) AS n_spans,
  sha256(unhex(k.h)) AS kept_sha256
FROM sized s JOIN kept k USING (doc_id) LEFT JOIN gone g USING (doc_id)
"""

OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingles FROM words),
sized AS (SELECT doc_id, len(shingles) AS n FROM sets),
members AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM members x JOIN members y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN sized x ON x.doc_id = c.a JOIN sized y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
found AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN found USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2, "op3_hyperminhash_dedup": OP3}
