"""DuckDB SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_OP6 = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
iw AS (SELECT item_id, text, {_WORDS} AS w FROM i),
ig AS (SELECT DISTINCT item_id, text, least(len(w), 5) AS k, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
q AS (SELECT item_id, text, count(*) AS q FROM ig GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM ig),
dw AS (SELECT doc_id, text, {_WORDS} AS w FROM d),
dg AS (SELECT DISTINCT doc_id, text, k, array_to_string(w[p:p + k - 1], ' ') AS g
       FROM (SELECT doc_id, text, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k)),
s AS (SELECT dg.doc_id, dg.text AS dt, ig.item_id, ig.text AS it, count(*) AS shared
      FROM dg JOIN ig ON dg.g = ig.g AND dg.k = ig.k GROUP BY ALL)
SELECT s.doc_id, s.item_id, q.q AS item_shingles, s.shared, round(s.shared / q.q, 6) AS containment
FROM s JOIN q ON s.item_id = q.item_id AND s.it = q.text WHERE s.shared * 100 >= q.q * 80
"""

_OP7 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' '))) END AS s FROM d),
c AS MATERIALIZED (SELECT list_sort(s) AS s, min(doc_id) AS id FROM g WHERE len(s) > 0 GROUP BY list_sort(s)),
t AS (SELECT id, unnest(s) AS x, len(s) AS n FROM c),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.x = b.x AND a.id < b.id
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT id AS a, id AS b FROM c UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
l AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, CASE WHEN len(g.s) = 0 THEN g.doc_id ELSE l.component_id END AS component_id
FROM g LEFT JOIN c ON list_sort(g.s) = c.s LEFT JOIN l ON l.a = c.id
"""

_OP10 = r"""
WITH r AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap::DOUBLE
      ELSE w * (SELECT arg_min(level, cap / w) FROM f WHERE cap > w * level) END AS target FROM f),
p AS (SELECT r.doc_id, r.size, t.source_size, t.target, row_number() OVER (PARTITION BY r.source ORDER BY floor(ln(r.size + 1.0) * 8)::BIGINT,
        ('0x' || substr(md5('mix:' || coalesce(r.doc_id::VARCHAR, '')), 1, 8))::BIGINT, r.doc_id NULLS FIRST, r.size) AS place,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix/' || coalesce('s:' || r.source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * place + u) - floor(rate * (place - 1) + u)) * size)::BIGINT AS taken FROM p
"""

_OP3 = r"""
WITH RECURSIVE s AS (SELECT i, ('0x' || substr(md5('offset:' || n), 1, 15))::BIGINT % 5003 AS start, ('0x' || substr(md5('step:' || n), 1, 15))::BIGINT % 5002 + 1 AS step
      FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS n FROM range(32) x(i))),
p AS MATERIALIZED (SELECT list(start ORDER BY i) AS start, list(step ORDER BY i) AS step FROM s),
fill AS (
  SELECT -1 AS turn, NULL::BIGINT AS slot, repeat('0', 5003)::BIT AS taken
  UNION ALL
  SELECT turn + 1, slot, set_bit(taken, slot::INT, 1) FROM (
    SELECT turn, taken, list_filter(list_transform(range(5003), lambda j: (p.start[(turn + 1) % 32 + 1] + j * p.step[(turn + 1) % 32 + 1]) % 5003), lambda x: get_bit(taken, x::INT) = 0)[1] AS slot
    FROM fill, p WHERE turn < 5002)),
o AS MATERIALIZED (SELECT slot, (turn % 32)::INT AS shard FROM fill WHERE turn >= 0)
SELECT d.doc_id, o.slot::BIGINT AS slot, o.shard FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 5003 AS slot FROM documents) d JOIN o USING (slot)
"""

_OP5 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= 20
"""

# A line goes if a run of 50 words or more around it occurs earlier: then so does the shortest such run from the line
# on, or the shortest that ends where the run ends.
_OP8 = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, text, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM d)),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
c AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY doc_id, text ORDER BY i) AS upto, sum(n) OVER (PARTITION BY doc_id, text ORDER BY i) - n AS before FROM w),
ab AS MATERIALIZED (SELECT a.doc_id, a.text, a.i AS i, b.i AS j FROM c a JOIN c b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text AND a.i <= b.i AND b.upto - a.before >= 50),
win AS (SELECT doc_id, text, i, min(j) AS j FROM ab GROUP BY doc_id, text, i UNION SELECT doc_id, text, max(i), j FROM ab GROUP BY doc_id, text, j),
k AS (SELECT doc_id, text, i, j, row_number() OVER (PARTITION BY array_to_string(string_split(text, chr(10))[i + 1:j + 1], chr(10)) ORDER BY doc_id NULLS FIRST, text, i) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(i, j + 1)) AS i FROM k WHERE nth > 1),
kept AS (SELECT c.doc_id, c.text, coalesce(string_agg(c.line, chr(10) ORDER BY c.i) FILTER (g.i IS NULL), '') AS now, count(g.i) AS n
         FROM c LEFT JOIN gone g ON c.doc_id IS NOT DISTINCT FROM g.doc_id AND c.text = g.text AND c.i = g.i GROUP BY c.doc_id, c.text)
SELECT o.doc_id, coalesce(kept.n, 0)::INT AS lines_deleted, length(coalesce(now, o.text))::BIGINT AS n_chars, md5(coalesce(now, o.text)) AS text_md5
FROM documents o LEFT JOIN kept ON o.doc_id IS NOT DISTINCT FROM kept.doc_id AND o.text = kept.text
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(c)::HUGEINT AS cl FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c, k.cl FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
n AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, sum(cl) OVER (PARTITION BY lang, source) AS nl, count(*) OVER (PARTITION BY lang, source) AS v FROM f),
p AS (SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v)::HUGEINT)::BIGINT AS p, (1 + (1000000000::HUGEINT * (cl + 5)) // (nl + 5 * v)::HUGEINT)::BIGINT AS q FROM n),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {"op3_sharding": _OP3, "op5_exact_topk": _OP5, "op6_decontamination": _OP6, "op7_ngram_jaccard_join": _OP7, "op8_line_dedup": _OP8, "op10_mixing": _OP10, "op13_source_divergence": _OP13}
