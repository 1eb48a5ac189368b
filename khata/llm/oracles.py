"""DuckDB SQL of the queries that SQL can express, for tables of the oracle's size: pairs are formed plainly."""

from __future__ import annotations

# What links reach from each node, and the smallest id of it.
_COMPONENTS = """, reach AS (SELECT id, id AS to_ FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_ = l.a),
component AS (SELECT id, min(to_) AS component_id FROM reach GROUP BY id)"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS pos FROM later, (SELECT unnest(range(20)) AS i)),
lists AS (SELECT doc_id, list(pos) AS places FROM gone GROUP BY doc_id),
placed AS (SELECT d.doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(w[pos], ' ' ORDER BY pos) AS text FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(lists.places), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# Hexadecimal digits stand for bytes; windows are taken from chunks, as finding a place in a long string takes long.
OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
chunks AS (SELECT doc_id, n, c, substr(x, 2 * c + 1, 4800) AS y FROM (SELECT *, unnest(range(0, n - 399, 2000)) AS c FROM d WHERE n >= 400)),
windows AS (SELECT doc_id, c + q AS p, md5(substr(y, 2 * q + 1, 800)) AS h FROM (SELECT *, unnest(range(0, least(2000, n - 399 - c))) AS q FROM chunks)),
again AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS k FROM windows) WHERE k > 1),
marked AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 1 ELSE 0 END AS fresh FROM again),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT doc_id, max(b), 9223372036854775807 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (least(b, n) - a)), '' ORDER BY a) AS x FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS spans, sum(b - a) AS removed FROM runs GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
sizes AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
flat AS (SELECT doc_id, n, g AS h FROM (SELECT doc_id, unnest(g) AS g FROM s) JOIN sizes USING (doc_id)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS k FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (m + n - k)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
nodes AS (SELECT doc_id AS id FROM d){_COMPONENTS}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM component JOIN sizes ON doc_id = id"""

OP6 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT *, sqrt(list_dot_product(e, e)) AS length FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.length * b.length) >= 0.93),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
nodes AS (SELECT vec_id AS id FROM v){_COMPONENTS}
SELECT id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = id) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM component"""
