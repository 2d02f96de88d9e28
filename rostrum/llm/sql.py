"""The numbered queries that SQL can express, by brute force, for DuckDB."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10ffff}]+')"
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"

OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
  m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
     CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM m"""

OP8 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
  ds AS (SELECT doc_id, unnest(list_distinct({_SHINGLES})) AS s FROM d), xs AS (SELECT item_id, list_distinct({_SHINGLES}) AS all_s FROM i),
  x AS (SELECT item_id, len(all_s) AS n, unnest(all_s) AS s FROM xs)
  SELECT doc_id, item_id, count(*) AS shared, any_value(n)::BIGINT AS item_shingles, count(*)::DOUBLE / any_value(n) AS containment
  FROM x JOIN ds USING (s) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)"""

OP10 = f"""WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY text) AS k, text FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
  w AS (SELECT k, {_WORDS} AS w FROM t), b AS (SELECT k, unnest({_SHINGLES}) AS s FROM w), c AS (SELECT k, s, count(*) AS n FROM b GROUP BY k, s), z AS (SELECT k, sum(n) AS n FROM c GROUP BY k),
  o AS (SELECT a.k AS a, b.k AS b, sum(least(a.n, b.n)) AS n FROM c a JOIN c b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
  l AS (SELECT a, b FROM o JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE o.n >= 0.8 * (x.n + y.n - o.n)),
  r AS (SELECT k AS a, k AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), g AS (SELECT a AS k, min(b) AS g FROM r GROUP BY a),
  m AS (SELECT doc_id, g.k, g.g FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN g ON g.k = t.k)
  SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS class_id, (SELECT count(*) FROM g h WHERE h.g = m.g)::BIGINT AS n_texts, count(*) OVER (PARTITION BY g) AS n_docs FROM m"""

OP13 = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL), kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 3),
  v AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
  cell AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, lang_n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
  s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM cell),
  p AS (SELECT s.*, 1 + (1000000000::HUGEINT * (n + 1)) // (s.total + v.v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // (v.total + v.v) AS q FROM s JOIN v USING (lang)),
  f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
     UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_archive": OP5, "op8_decontamination": OP8, "op10_near_duplicates": OP10, "op13_source_divergence": OP13}
