"""DuckDB SQL for operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_ITEM_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
j AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, w[k + 1 : k + n] AS g FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM j)),
l AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, l WHERE len(w) >= n),
h AS (SELECT doc_id, k, p.n AS n, item_id FROM p JOIN g ON p.n = g.n AND p.w[k + 1 : k + p.n] = g.g),
x AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN y ON d.doc_id = y.doc_id
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.id = e.a),
c AS (SELECT id, min(m) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.id
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
m AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING count(*) > 1),
x AS (SELECT doc_id, p FROM s JOIN m USING (g) WHERE first < doc_id),
y AS (SELECT *, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM y),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM z GROUP BY doc_id, run),
q AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a)
      UNION ALL SELECT r.doc_id, max(r.b), max(d.n) FROM r JOIN d ON r.doc_id = d.doc_id GROUP BY r.doc_id),
k AS (SELECT q.doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS kept FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
