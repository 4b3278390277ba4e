"""SQL that states the exact results of operators 5, 7 and 10 on tables whose ids are there and unique."""

from __future__ import annotations

_WORDS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM d)"""

#: Words covered by a window of 50 that also starts in a document with a smaller id, with the least such id.
_REPEATED = _WORDS + """,
win AS (SELECT * FROM (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS t FROM p) WHERE i <= n - 49),
low AS (SELECT t, min(doc_id) AS f FROM win GROUP BY t),
again AS (SELECT win.doc_id, win.i, f FROM win JOIN low USING (t) WHERE f < win.doc_id),
hit AS (SELECT doc_id, i + k AS i, min(f) AS f FROM again, range(0, 50) r(k) GROUP BY ALL)"""

SUBSTRING = _REPEATED + """,
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text FROM p LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.i = p.i WHERE hit.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1) USING (doc_id)
"""

SPANS = _REPEATED + """,
island AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
span AS (SELECT doc_id, run, min(i) AS s, count(*) AS n FROM island GROUP BY 1, 2),
first AS (SELECT span.doc_id, s, n, min(f) AS f FROM span JOIN again ON again.doc_id = span.doc_id AND again.i BETWEEN s AND s + n - 1 GROUP BY ALL),
told AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_repeated, count(*) AS n_spans, string_agg((s - 1) || ':' || n || ':' || f, ';' ORDER BY s) AS spans FROM first GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (doc_id)
"""

NEAR = _WORDS.replace("WITH d", "WITH RECURSIVE d") + """,
node AS (SELECT w, min(doc_id) AS node, count(*) AS copies FROM d GROUP BY w),
gram AS (SELECT DISTINCT doc_id AS node, t FROM (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS t FROM p WHERE doc_id IN (SELECT node FROM node)) WHERE i <= n - 4),
size AS (SELECT node, count(*) AS n FROM gram GROUP BY 1),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM gram a JOIN gram b ON a.t = b.t AND a.node <> b.node GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.node = a JOIN size y ON y.node = b WHERE 5 * common.n >= 4 * (x.n + y.n - common.n)),
reach AS (SELECT node AS a, node AS b FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY 1),
links AS (SELECT a AS node, count(*) AS n FROM link GROUP BY 1)
SELECT d.doc_id, class_id, node.node AS text_class_id, copies AS n_copies, coalesce(links.n, 0) AS n_links FROM d JOIN node USING (w) JOIN class ON class.node = node.node LEFT JOIN links ON links.node = node.node
"""

#: Runs of letters and digits; A-Z in lower case. Everything from \\x80 on is a letter.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"

SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM s),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY t, docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
score AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN df USING (t) JOIN s USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

# crc32: bit by bit over the bytes of each distinct word.
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
RESAMPLE = f"""
WITH RECURSIVE raw AS (SELECT 0 AS side, doc_id, {_TERMS} AS w FROM documents UNION ALL SELECT 1, item_id, {_TERMS} FROM benchmark),
f AS (SELECT side, doc_id, unnest(w) AS t FROM raw),
bits AS (SELECT i, i AS c, 0 AS k FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i) UNION ALL SELECT i, {_STEP}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS lookup FROM bits WHERE k = 8),
word AS (SELECT t, hex(encode(t)) AS h FROM (SELECT DISTINCT t FROM f)),
walk AS (SELECT t, h, CAST(4294967295 AS BIGINT) AS c, 0 AS pos FROM word UNION ALL
  SELECT t, h, xor(c // 256, lookup[CAST(xor(c % 256, CAST('0x' || substr(h, 2 * pos + 1, 2) AS BIGINT)) AS INTEGER) + 1]), pos + 1 FROM walk, crc WHERE 2 * pos < length(h)),
bucket AS (SELECT t, xor(c, 4294967295) % 10000 AS b FROM walk WHERE 2 * pos = length(h)),
n AS (SELECT b, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS tt FROM f JOIN bucket USING (t) GROUP BY 1),
every AS (SELECT sum(s) AS s_all, sum(tt) AS t_all FROM n),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST((tt + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n, every),
w AS (SELECT doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN bucket USING (t) JOIN gain USING (b) WHERE side = 0 GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN w USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM placed
"""
