"""What the queries return, as DuckDB SQL, where SQL can express it."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (s) WHERE doc_id > first_id),
hit AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM gone GROUP BY doc_id),
spans AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) WHERE before IS NULL OR before < i - 1 GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS t FROM pos p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256, CAST(coalesce(s.n, 0) AS INTEGER) AS n_spans
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN spans s USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
shared AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM sizes),
levels AS (SELECT *, ((SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM shared) - coalesce(sum(weight) OVER o, 0)) AS level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth
  FROM shared WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT level, nth FROM levels WHERE level * weight < cap ORDER BY nth LIMIT 1),
targets AS (SELECT l.source, l.source_size, CASE WHEN l.nth >= (SELECT nth FROM free) THEN least(l.cap, (SELECT level FROM free) * l.weight) ELSE l.cap END AS target FROM levels l),
rated AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST(('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS chance
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""

OP9 = """
WITH RECURSIVE usable AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.u LEFT JOIN counts c ON e.vec_id = c.u
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_rlz_dedup": OP1, "op3_mix_sources": OP3, "op9_metric_join": OP9}
