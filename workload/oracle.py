"""The registered queries again, as SQL over the given tables.

Each text is a chain of common table expressions, so that one definition of
the corpus, the postings and the ranked lists serves all of them.
"""

from __future__ import annotations

from workload import stems
from workload.tables import BM25_THRESHOLD, NEEDLE, PHRASE, RARE_NEEDLE, RRF_THRESHOLD, VECTOR_THRESHOLD

NW = r"[^\p{L}\p{N}_]+"
WORD = r"^[\p{L}\p{N}_]+$"
EDGES = r"^[\p{L}\p{N}_](.*[\p{L}\p{N}_])?$"

# name -> (names it builds on, SQL)
PARTS: dict[str, tuple[list[str], str]] = {
    "docs0": ([], r"""
        SELECT doc_id AS id, split_part(text, chr(10), 1) AS title,
               substr(text, length(split_part(text, chr(10), 1)) + 2) AS content,
               source AS category, lang FROM documents"""),
    "docs": (["docs0"], r"""
        SELECT *, title || ' ' || content AS full_text,
               len(regexp_split_to_array(title || ' ' || content, '\s+'))::BIGINT AS word_count FROM docs0"""),
    "toks": (["docs"], f"""
        SELECT id AS doc_id, list_filter(regexp_split_to_array(lower(full_text), '{NW}'), lambda x: x <> '') AS t
        FROM docs"""),
    "occ": (["toks"], """
        SELECT doc_id, len(t)::BIGINT AS doc_len, unnest(t) AS term, unnest(range(len(t))) AS pos FROM toks"""),
    "post": (["occ"], """
        SELECT term, doc_id, count(*)::BIGINT AS tf, any_value(doc_len) AS doc_len FROM occ GROUP BY term, doc_id"""),
    "stats": (["toks"], """
        SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_tokens, sum(len(t)) / count(*)::DOUBLE AS avg_len
        FROM toks"""),
    "df": (["post", "stats"], """
        SELECT term, count(*)::BIGINT AS doc_freq,
               ln((any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf
        FROM post, stats GROUP BY term"""),
    "q": ([], """
        SELECT item_id AS query_id, text AS query, embedding, label / 10.0::DOUBLE AS vw,
               (10 - label) / 10.0::DOUBLE AS kw
        FROM benchmark LEFT JOIN embeddings ON vec_id = item_id"""),
    "q_agent": ([], """
        SELECT conv_id AS query_id, query, embedding, label / 10.0::DOUBLE AS vw, (10 - label) / 10.0::DOUBLE AS kw
        FROM (SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id)
        LEFT JOIN embeddings ON vec_id = conv_id"""),
    "qt": (["q"], f"""
        SELECT query_id, unnest(ts) AS term, len(ts)::BIGINT AS n_terms FROM (
          SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '{NW}'), lambda x: x <> '')) AS ts
          FROM q)"""),
    "dt": (["q"], r"""
        SELECT query_id, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: length(x) >= 2) AS terms
        FROM q"""),
    "scores": (["qt", "post", "df", "stats"], """
        SELECT query_id, doc_id, count(*)::BIGINT AS n_matched, any_value(n_terms) AS n_terms,
               sum(tf)::BIGINT AS tf_rank,
               sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS score
        FROM qt JOIN df USING (term) JOIN post USING (term), stats GROUP BY query_id, doc_id"""),
    "bool_top": (["scores"], """
        SELECT query_id, doc_id, rank, score FROM (
          SELECT query_id, doc_id, tf_rank::DOUBLE AS score,
                 row_number() OVER (PARTITION BY query_id ORDER BY tf_rank DESC, doc_id) AS rank
          FROM scores WHERE n_matched = n_terms) WHERE rank <= 10"""),
    "bm25": (["scores"], """
        SELECT query_id, doc_id, rank, score FROM (
          SELECT query_id, doc_id, score,
                 row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
          FROM scores WHERE score > 0) WHERE rank <= 10"""),
    "vec": (["q"], """
        SELECT query_id, doc_id, rank, distance, 1 - distance AS similarity FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank FROM (
            SELECT query_id, vec_id AS doc_id,
                   1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
            FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, q WHERE q.embedding IS NOT NULL))
        WHERE rank <= 10"""),
    "pairs": (["vec", "bm25"], """
        SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.doc_id, k.doc_id) AS doc_id,
               v.rank AS vector_rank, k.rank AS keyword_rank
        FROM vec v FULL OUTER JOIN bm25 k ON v.query_id = k.query_id AND v.doc_id = k.doc_id"""),
    "fused_all": (["pairs", "q"], """
        SELECT p.*, coalesce(vw, 0.5) AS vw, coalesce(kw, 0.5) AS kw,
               coalesce(vw, 0.5) * coalesce(1.0::DOUBLE / (60 + vector_rank), 0)
               + coalesce(kw, 0.5) * coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS score
        FROM pairs p JOIN q USING (query_id)"""),
    "fused": (["fused_all"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
                       FROM fused_all) WHERE rank <= 10"""),
    "combined": (["bool_top", "bm25", "vec", "fused"], """
        SELECT 'boolean' AS method, query_id, doc_id, rank, score FROM bool_top
        UNION ALL SELECT 'bm25', query_id, doc_id, rank, score FROM bm25
        UNION ALL SELECT 'vector', query_id, doc_id, rank, similarity FROM vec
        UNION ALL SELECT 'hybrid', query_id, doc_id, rank, score FROM fused"""),
    "shown": (["dt"], "SELECT DISTINCT unnest(terms) AS term FROM dt"),
    "dstats": (["shown", "stats", "toks", "docs"], f"""
        SELECT term, doc_freq, CASE WHEN doc_freq > 0 THEN
                 ln((n_docs - doc_freq + 0.5::DOUBLE) / (doc_freq + 0.5::DOUBLE) + 1) END AS idf, n_docs
        FROM (SELECT s.term, count(p.doc_id)::BIGINT AS doc_freq
              FROM shown s LEFT JOIN (SELECT DISTINCT doc_id, unnest(t) AS term FROM toks) p
                ON p.term = s.term AND regexp_matches(s.term, '{WORD}')
              GROUP BY s.term), stats"""),
    "files": (["docs"], """
        SELECT 'doc-' || id || '.md' AS source_file,
               CASE WHEN lang = 'de' THEN '' ELSE '---' || chr(10) END
               || CASE WHEN lang = 'fr' THEN 'title: replaced' || chr(10) ELSE '' END
               || CASE WHEN lang = 'es' THEN 'author: unknown' || chr(10) ELSE 'title: no: ' || id || chr(10) END
               || CASE WHEN quality IS NULL THEN '' ELSE 'category : quality-' || quality || chr(10) END
               || '---' || chr(10) || chr(10) || content || chr(10) AS value, docs.*, quality
        FROM docs LEFT JOIN labels ON labels.doc_id = docs.id"""),
    "content_toks": (["docs"], f"""
        SELECT id AS doc_id, list_filter(regexp_split_to_array(lower(content), '{NW}'), lambda x: x <> '') AS t
        FROM docs"""),
    "spam": ([], "SELECT DISTINCT doc_id FROM labels WHERE quality = 0"),
    "ratios": (["scores", "spam"], """
        SELECT query_id, tfs / tfo AS tf_ratio, bs / bo AS bm25_ratio FROM (
          SELECT query_id, max(CASE WHEN s.doc_id IS NOT NULL THEN tf_rank END)::DOUBLE AS tfs,
                 max(CASE WHEN s.doc_id IS NULL THEN tf_rank END)::DOUBLE AS tfo,
                 max(CASE WHEN s.doc_id IS NOT NULL THEN score END) AS bs,
                 max(CASE WHEN s.doc_id IS NULL THEN score END) AS bo
          FROM scores x LEFT JOIN spam s ON s.doc_id = x.doc_id GROUP BY query_id)"""),
    "counts": (["scores", "q"], """
        SELECT query_id, coalesce(a, 0)::BIGINT AS and_matches, coalesce(b, 0)::BIGINT AS bm25_matches
        FROM q LEFT JOIN (SELECT query_id, count(*) FILTER (n_matched = n_terms) AS a, count(*) FILTER (score > 0) AS b
                          FROM scores GROUP BY query_id) USING (query_id)"""),
}


def analysed(source: str, text: str = "title || ' ' || content", extra: str = "") -> str:
    """Term matches of a ranked list: lists and counts joined to text."""
    return f"""
        SELECT r.*, d.content, d.word_count, terms, lower({text}) AS body,
               list_filter(terms, lambda x: contains(lower({text}), x)) AS matched,
               list_filter(terms, lambda x: NOT contains(lower({text}), x)) AS missing {extra}
        FROM {source} r JOIN docs d ON d.id = r.doc_id JOIN dt USING (query_id)"""


# Distinct terms in order of first occurrence, each with its literal count.
COUNTS = """array_to_string(list_transform(
    list_filter(terms, lambda x, i: list_position(terms, x) = i),
    lambda x: x || '=' || ((length(body) - length(replace(body, x, ''))) // length(x))), ' ')"""
LISTS = f"""array_to_string(matched, ' ') AS matched_terms, array_to_string(missing, ' ') AS missing_terms,
    {COUNTS} AS term_counts"""

for _name, _source, _text in [
    ("an_bm25", "bm25", "title || ' ' || content"), ("an_bool", "bool_top", "title || ' ' || content"),
    ("an_vec", "vec", "title || ' ' || content"), ("an_fused", "fused", "title || ' ' || left(content, 200)"),
]:
    PARTS[_name] = ([_source, "docs", "dt"], analysed(_source, _text))

PARTS["contrib"] = (["an_bm25", "dstats"], """
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY i) - 1 AS pos,
           term, n, idf, doc_freq,
           CASE WHEN doc_freq <= 3 THEN 'HIGH' WHEN doc_freq <= 7 THEN 'MEDIUM' ELSE 'LOW' END AS level
    FROM (SELECT query_id, doc_id, i, term, ((length(body) - length(replace(body, term, ''))) // length(term))::BIGINT AS n
          FROM (SELECT query_id, doc_id, body, unnest(terms) AS term, unnest(range(len(terms))) AS i FROM an_bm25))
    JOIN dstats USING (term) WHERE n > 0""")


_STOP = ", ".join(f"'{w}'" for w in stems.STOP)
# English terms: stop words and stems for English rows (and for the queries, which count as English), plain tokens for others.
PARTS |= {
    "plain": (["toks", "docs"], "SELECT doc_id, coalesce(lang = 'en', false) AS en, unnest(t) AS w FROM toks JOIN docs ON id = doc_id"),
    "english_words": (["plain", "qt"], "SELECT DISTINCT w FROM (SELECT w FROM plain WHERE en UNION ALL SELECT term FROM qt)"),
    **stems.parts("english_words"),
    "eocc": (["plain", "stems"], f"""
        SELECT doc_id, CASE WHEN en THEN stem ELSE plain.w END AS term FROM plain LEFT JOIN stems ON stems.w = plain.w
        WHERE NOT (en AND plain.w IN ({_STOP}))"""),
    "elen": (["eocc"], "SELECT doc_id, count(*)::BIGINT AS doc_len FROM eocc GROUP BY doc_id"),
    "epost": (["eocc", "elen"], """
        SELECT term, doc_id, count(*)::BIGINT AS tf, any_value(doc_len) AS doc_len FROM eocc JOIN elen USING (doc_id) GROUP BY term, doc_id"""),
    "estats": (["eocc", "docs"], """
        SELECT (SELECT count(*) FROM docs)::BIGINT AS n_docs, (SELECT count(*) FROM eocc) / (SELECT count(*) FROM docs)::DOUBLE AS avg_len"""),
    "edf": (["epost", "estats"], """
        SELECT term, count(*)::BIGINT AS doc_freq,
               ln((any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf
        FROM epost, estats GROUP BY term"""),
    "eqt": (["qt", "stems"], f"""
        SELECT DISTINCT query_id, stem AS term FROM qt JOIN stems ON stems.w = qt.term WHERE qt.term NOT IN ({_STOP})"""),
    "ebm25": (["eqt", "edf", "epost", "estats"], """
        SELECT query_id, doc_id, rank, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
            SELECT query_id, doc_id,
                   sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS score
            FROM eqt JOIN edf USING (term) JOIN epost USING (term), estats GROUP BY query_id, doc_id)) WHERE rank <= 10"""),
}


def with_parts(needs: list[str], select: str) -> str:
    """``WITH`` the parts a query needs, each once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in PARTS[name][0]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return select
    # Materialised, so that a list used twice is ranked once.
    parts = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order)
    return f"WITH {parts}\n{select}"


R6 = "round(score, 6) AS score"
TOP = f"SELECT query_id, doc_id, rank, {R6} FROM "

SQL: dict[str, str] = {
    "corpus_documents": with_parts(["docs"], "SELECT id, title, content, category, word_count, full_text FROM docs"),
    "ordered_texts": with_parts(["docs"], "SELECT id, title, full_text FROM docs ORDER BY id"),
    "category_filter": with_parts(["docs"], "SELECT id, title, category FROM docs WHERE category = 'src1'"),
    "surrogate_keys": """SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS key_id FROM documents""",
    "frontmatter_load": with_parts(["files"], r"""
        SELECT source_file, 'no: ' || id AS title,
               CASE WHEN quality IS NULL THEN 'general' ELSE 'quality-' || quality END AS category,
               body AS content, len(regexp_split_to_array('no: ' || id || ' ' || body, '\s+'))::BIGINT AS word_count,
               (1 + (quality IS NOT NULL)::INT)::BIGINT AS n_keys
        FROM (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS body FROM files) WHERE lang IN ('en', 'fr')"""),
    "frontmatter_rejects": with_parts(["files"], """
        SELECT source_file, CASE WHEN lang = 'es' THEN 'missing title'
               WHEN value LIKE '---%' THEN 'missing closing marker' ELSE 'missing front matter' END AS error
        FROM files WHERE lang NOT IN ('en', 'fr')"""),
    "keyword_like": with_parts(["docs"], f"SELECT id, category FROM docs WHERE lower(content) LIKE '%{NEEDLE}%'"),
    "keyword_like_indexed": with_parts(["docs"], " UNION ALL ".join(
        f"SELECT id, category, '{n}' AS needle FROM docs WHERE contains(lower(content), lower('{n}'))" for n in (NEEDLE, RARE_NEEDLE))),
    "shortest_matching": with_parts(["docs"], f"""
        SELECT id, word_count FROM docs WHERE lower(content) LIKE '%{NEEDLE}%' ORDER BY word_count, id"""),
    "keyword_mass": with_parts(["docs"], f"""
        SELECT id, category, ((length(content) - length(replace(lower(content), '{PHRASE}', ''))) // {len(PHRASE)})::BIGINT AS n
        FROM docs"""),
    "doc_length_table": with_parts(["toks"], "SELECT doc_id, len(t)::BIGINT AS doc_len FROM toks"),
    "token_positions": with_parts(["occ"], "SELECT doc_id, pos::BIGINT AS pos, term FROM occ"),
    "compound_tokens": with_parts(["docs"], rf"""
        SELECT doc_id, sum(n)::BIGINT AS n_terms, sum(c)::BIGINT AS n_compounds FROM (
          SELECT doc_id, CASE WHEN len(parts) > 1 THEN len(parts) + 1 ELSE len(parts) END AS n,
                 (len(parts) > 1)::INT AS c
          FROM (SELECT id AS doc_id, list_filter(regexp_split_to_array(w, '{NW}'), lambda x: x <> '') AS parts
                FROM (SELECT id, unnest(regexp_split_to_array(lower(full_text), '\s+')) AS w FROM docs))
          WHERE len(parts) > 0) GROUP BY doc_id"""),
    "postings": with_parts(["occ"], """
        SELECT term, doc_id, count(*)::BIGINT AS tf, any_value(doc_len) AS doc_len,
               string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM occ GROUP BY term, doc_id"""),
    "term_stats": with_parts(["df"], "SELECT term, doc_freq, round(idf, 6) AS idf FROM df"),
    "corpus_stats": with_parts(["stats"], "SELECT n_docs, n_tokens, round(avg_len, 6) AS avg_len FROM stats"),
    "query_terms": with_parts(["qt"], "SELECT query_id, n_terms, term FROM qt"),
    "display_terms": with_parts(["dt"], """
        SELECT query_id, len(terms)::BIGINT AS n_terms, array_to_string(terms, ' ') AS terms FROM dt"""),
    "query_workload": with_parts(["q_agent"], """
        SELECT query_id, query, 'agent' AS category, round(vw, 6) AS vector_weight, round(kw, 6) AS keyword_weight
        FROM q_agent"""),
    "query_rejects": """
        SELECT conv_id * 1000 + turn AS query_id, 'Query is required' AS error FROM conversations
        WHERE role <> 'user' OR text = ''""",
    "match_and": with_parts(["scores"], "SELECT query_id, doc_id, n_matched FROM scores WHERE n_matched = n_terms"),
    "match_or": with_parts(["scores"], "SELECT query_id, doc_id, n_matched, n_terms FROM scores"),
    "match_counts": with_parts(["counts"], "SELECT * FROM counts"),
    "tf_rank_topk": with_parts(["bool_top"], TOP + "bool_top"),
    "bm25_topk": with_parts(["bm25"], TOP + "bm25"),
    "bm25_bounded_topk": with_parts(["bm25"], TOP + "bm25"),
    "bm25_threshold": with_parts(["bm25"], TOP + f"bm25 WHERE score > {BM25_THRESHOLD}"),
    "bm25_content_field": with_parts(["content_toks", "docs", "qt"], f"""
        , cpost AS (SELECT term, doc_id, count(*)::BIGINT AS tf, any_value(n) AS doc_len
                    FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM content_toks) GROUP BY term, doc_id),
        cstats AS (SELECT count(*) AS n_docs, sum(len(t)) / count(*)::DOUBLE AS avg_len FROM content_toks),
        cdf AS (SELECT term, ln((any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf
                FROM cpost, cstats GROUP BY term),
        s AS (SELECT query_id, doc_id,
                     sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS score
              FROM qt JOIN cdf USING (term) JOIN cpost USING (term)
              JOIN (SELECT id AS doc_id FROM docs WHERE lower(content) LIKE '%{NEEDLE}%') USING (doc_id), cstats
              GROUP BY query_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
        SELECT query_id, doc_id, rank, {R6} FROM r WHERE rank <= 5"""),
    "bm25_english": with_parts(["ebm25"], TOP + "ebm25"),
    "english_terms": with_parts(["edf"], "SELECT term, doc_freq, round(idf, 6) AS idf FROM edf"),
    "df_word_boundary": with_parts(["dstats"], "SELECT term, doc_freq, round(idf, 6) AS idf FROM dstats"),
    "rare_terms": with_parts(["dstats"], """
        SELECT term, doc_freq <= 3 AS is_rare, term || ' (' || doc_freq || '/' || n_docs || ')' AS shown_as FROM dstats"""),
    "embedding_coverage": """
        SELECT count(*)::BIGINT AS n_embedded, avg(len(embedding)) AS avg_dims
        FROM embeddings JOIN documents ON doc_id = vec_id""",
    "vector_topk": with_parts(["vec"], """
        SELECT query_id, doc_id, rank, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM vec"""),
    "vector_pruned_topk": with_parts(["vec"], """
        SELECT query_id, doc_id, rank, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM vec"""),
    "vector_threshold": with_parts(["vec"], f"""
        SELECT query_id, doc_id, rank, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM vec
        WHERE distance < 1 - {VECTOR_THRESHOLD} / 100.0"""),
    "vector_labels": with_parts(["vec"], """
        SELECT query_id, doc_id, rank,
               CASE WHEN similarity > 0.4 THEN 'High' WHEN similarity > 0.25 THEN 'Moderate' ELSE 'Low' END AS label
        FROM vec"""),
    "ann_all_cells": with_parts(["vec"], "SELECT query_id, doc_id, rank, round(similarity, 4) AS similarity FROM vec"),
    "embed_resumed": with_parts(["docs"], """
        SELECT id AS doc_id, run::BIGINT AS run, """ + ", ".join(
            f"round(((length(full_text) - length(replace(full_text, '{x}', ''))) / length(full_text)::DOUBLE)::FLOAT::DOUBLE, 5) "
            f"+ CASE WHEN run IS NULL THEN NULL ELSE 0 END AS share_{x}" for x in "aens") + """
        FROM (SELECT *, CASE WHEN contains(full_text, '###') THEN NULL WHEN contains(full_text, 'er') THEN 2 ELSE 1 END AS run FROM docs)"""),
    "rrf_topk": with_parts(["fused"], f"SELECT query_id, doc_id, rank, vector_rank, keyword_rank, {R6} FROM fused"),
    "rrf_threshold": with_parts(["fused"], TOP + f"fused WHERE score >= {RRF_THRESHOLD} / 1000.0"),
    "rrf_missing_rank": with_parts(["pairs"], f"""
        SELECT query_id, doc_id, rank, {R6} FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
            SELECT query_id, doc_id, 1.0::DOUBLE / (60 + coalesce(vector_rank, 1000))
                   + 1.0::DOUBLE / (60 + coalesce(keyword_rank, 1000)) AS score FROM pairs)) WHERE rank <= 10"""),
    "rrf_weight_sweep": with_parts(["pairs"], f"""
        SELECT query_id, mix, doc_id, rank, {R6} FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id, mix ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
            SELECT query_id, doc_id, mix, mix / 100.0::DOUBLE * coalesce(1.0::DOUBLE / (60 + vector_rank), 0)
                   + (100 - mix) / 100.0::DOUBLE * coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS score
            FROM pairs, (SELECT unnest([0, 25, 50, 75, 100])::BIGINT AS mix))) WHERE rank <= 10"""),
    "rrf_source_labels": with_parts(["fused"], """
        SELECT query_id, doc_id,
               CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL THEN 'BOTH'
                    WHEN vector_rank IS NOT NULL THEN 'VECTOR' ELSE 'KEYWORD' END AS found_by,
               CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL
                    THEN 'Found by BOTH: Vector #' || vector_rank || ' + Keyword #' || keyword_rank
                    WHEN vector_rank IS NOT NULL THEN 'Found by VECTOR only: #' || vector_rank
                    ELSE 'Found by KEYWORD only: #' || keyword_rank END AS reason,
               'RRF combines ranks: (' || vw || '×vector) + (' || kw || '×keyword)' AS why_ranked FROM fused"""),
    "match_analysis": with_parts(["an_bm25"], f"""
        SELECT query_id, doc_id, rank, {LISTS},
               CASE WHEN len(matched) = 0 THEN 'No direct term matches (scored by related terms)'
                    ELSE 'Matched ' || len(matched) || '/' || len(terms) || ' terms' END AS reason,
               left(content, 200) AS preview FROM an_bm25"""),
    "boolean_explanation": with_parts(["an_bool"], f"""
        SELECT query_id, doc_id, rank, {LISTS},
               CASE WHEN len(matched) = len(terms) THEN '✓ Contains ALL ' || len(terms) || ' query terms'
                    ELSE 'Contains ' || len(matched) || '/' || len(terms) || ' terms' END AS reason FROM an_bool"""),
    "vector_explanation": with_parts(["an_vec"], f"""
        SELECT query_id, doc_id, rank, {LISTS},
               CASE WHEN similarity > 0.4 THEN 'High' WHEN similarity > 0.25 THEN 'Moderate' ELSE 'Low' END
               || ' semantic similarity (' || round(similarity * 100)::INT || '%)' AS reason FROM an_vec"""),
    "hybrid_explanation": with_parts(["an_fused"], f"""
        SELECT query_id, doc_id, rank, {LISTS},
               CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL
                    THEN 'Found by BOTH: Vector #' || vector_rank || ' + Keyword #' || keyword_rank
                    WHEN vector_rank IS NOT NULL THEN 'Found by VECTOR only: #' || vector_rank
                    ELSE 'Found by KEYWORD only: #' || keyword_rank END AS reason FROM an_fused"""),
    "term_contributions": with_parts(["contrib"], """
        SELECT c.query_id, c.doc_id, pos, term, n, round(idf, 6) AS idf, doc_freq, level,
               'IDF boost from: ' || coalesce(names, 'none') AS why_ranked
        FROM contrib c LEFT JOIN (SELECT query_id, doc_id, string_agg(term, ', ' ORDER BY pos) AS names
                                  FROM contrib WHERE level = 'HIGH' GROUP BY query_id, doc_id) USING (query_id, doc_id)"""),
    "length_factor": with_parts(["bm25", "docs", "stats"], """
        SELECT query_id, doc_id, word_count,
               CASE WHEN word_count < avg_len THEN 'boost (shorter than avg)'
                    WHEN word_count > avg_len * 1.5 THEN 'penalty (longer than avg)' ELSE 'neutral' END AS length_factor
        FROM bm25 JOIN docs ON id = doc_id, stats"""),
    "snippet": with_parts(["an_bm25"], r"""
        SELECT query_id, doc_id, CASE WHEN len(matched) > 0 THEN regexp_replace(cut, '(' || array_to_string(
                 list_transform(matched, lambda x: regexp_escape(x)), '|') || ')', '<mark>\1</mark>', 'gi') ELSE cut END AS snippet
        FROM (SELECT *, CASE WHEN length(content) > 120 THEN left(content, 120) || '...' ELSE content END AS cut FROM an_bm25)"""),
    "shown_terms": with_parts(["an_bm25"], """
        SELECT query_id, doc_id, array_to_string(matched[1:3], ',') AS shown_matched,
               array_to_string(missing[1:2], ',') AS shown_missing FROM an_bm25"""),
    "headline": with_parts(["bm25", "docs", "qt"], rf"""
        , w AS (SELECT query_id, doc_id, word, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY i) - 1 AS p
                FROM (SELECT query_id, doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i
                      FROM (SELECT query_id, doc_id, regexp_split_to_array(content, '\s+') AS ws
                            FROM bm25 JOIN docs ON id = doc_id)) WHERE word <> ''),
        n AS (SELECT query_id, doc_id, count(*) AS n FROM w GROUP BY ALL),
        ql AS (SELECT query_id, list(term) AS ts FROM qt GROUP BY query_id),
        h AS (SELECT query_id, doc_id, p FROM w JOIN ql USING (query_id)
              WHERE list_has_any(regexp_split_to_array(lower(word), '{NW}'), ts)),
        best AS (SELECT query_id, doc_id, arg_min(p, -c * 1000000 + p) AS s FROM (
                   SELECT a.query_id, a.doc_id, a.p, count(*) AS c FROM h a JOIN h b
                   ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.p >= a.p AND b.p < a.p + 50 GROUP BY ALL)
                 GROUP BY ALL),
        st AS (SELECT bm25.query_id, bm25.doc_id,
                      greatest(least(coalesce(s, 0), coalesce(n, 0) - 20), 0) AS s, CASE WHEN s IS NULL THEN 20 ELSE 50 END AS size
               FROM bm25 LEFT JOIN n USING (query_id, doc_id) LEFT JOIN best USING (query_id, doc_id))
        SELECT st.query_id, st.doc_id, coalesce(string_agg(
                 CASE WHEN h.p IS NULL THEN word ELSE '<mark>' || word || '</mark>' END, ' ' ORDER BY w.p), '') AS headline
        FROM st LEFT JOIN w ON w.query_id = st.query_id AND w.doc_id = st.doc_id AND w.p >= s AND w.p < s + size
        LEFT JOIN h ON h.query_id = w.query_id AND h.doc_id = w.doc_id AND h.p = w.p GROUP BY st.query_id, st.doc_id"""),
    "side_by_side": with_parts(["combined"], f"SELECT method, query_id, doc_id, rank, {R6} FROM combined"),
    "search_results": with_parts(["an_bool", "an_bm25", "an_vec", "an_fused", "contrib"], """
        , u AS (
          SELECT 'boolean' AS method, query_id, rank, doc_id, score, terms, matched,
                 NULL::BIGINT AS vector_rank, NULL::BIGINT AS keyword_rank,
                 CASE WHEN len(matched) = len(terms) THEN '✓ Contains ALL ' || len(terms) || ' query terms'
                      ELSE 'Contains ' || len(matched) || '/' || len(terms) || ' terms' END AS reason FROM an_bool
          UNION ALL SELECT 'bm25', query_id, rank, doc_id, score, terms, matched, NULL, NULL,
                 CASE WHEN len(matched) = 0 THEN 'No direct term matches (scored by related terms)'
                      ELSE 'Matched ' || len(matched) || '/' || len(terms) || ' terms' END FROM an_bm25
          UNION ALL SELECT 'vector', query_id, rank, doc_id, similarity, terms, matched, NULL, NULL,
                 CASE WHEN similarity > 0.4 THEN 'High' WHEN similarity > 0.25 THEN 'Moderate' ELSE 'Low' END
                 || ' semantic similarity (' || round(similarity * 100)::INT || '%)' FROM an_vec
          UNION ALL SELECT 'hybrid', query_id, rank, doc_id, score, terms, matched, vector_rank, keyword_rank,
                 CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL
                      THEN 'Found by BOTH: Vector #' || vector_rank || ' + Keyword #' || keyword_rank
                      WHEN vector_rank IS NOT NULL THEN 'Found by VECTOR only: #' || vector_rank
                      ELSE 'Found by KEYWORD only: #' || keyword_rank END FROM an_fused)
        SELECT method, u.query_id, rank, u.doc_id, title, left(content, 200) AS content, category,
               round(score, 6) AS score, word_count, len(terms)::BIGINT AS n_terms, len(matched)::BIGINT AS n_matched,
               CASE WHEN method = 'bm25' THEN coalesce(n, 0) ELSE -1 END::BIGINT AS n_contributions,
               vector_rank, keyword_rank, reason
        FROM u JOIN docs ON id = u.doc_id
        LEFT JOIN (SELECT query_id, doc_id, count(*) AS n FROM contrib GROUP BY ALL) k
          ON k.query_id = u.query_id AND k.doc_id = u.doc_id"""),
    "visible_methods": with_parts(["combined"], """
        SELECT method, query_id, doc_id, rank FROM combined WHERE method IN ('bm25', 'hybrid')"""),
    "method_overlap": with_parts(["combined"], """
        SELECT query_id, doc_id, count(*)::BIGINT AS n_methods, string_agg(method, ',' ORDER BY method) AS methods,
               min(rank) AS best_rank FROM combined GROUP BY query_id, doc_id"""),
    "rank_table": with_parts(["combined"], """
        SELECT query_id, doc_id, min(rank) FILTER (method = 'boolean') AS boolean, min(rank) FILTER (method = 'bm25') AS bm25,
               min(rank) FILTER (method = 'vector') AS vector, min(rank) FILTER (method = 'hybrid') AS hybrid
        FROM combined GROUP BY query_id, doc_id"""),
    "result_pages": with_parts(["bm25"], """
        SELECT query_id, doc_id, rank, n_more FROM (
          SELECT *, greatest(count(*) OVER (PARTITION BY query_id) - 5, 0)::BIGINT AS n_more FROM bm25) WHERE rank <= 5"""),
    "method_hit_rate": with_parts(["combined", "q"], """
        SELECT method, count(*)::BIGINT AS n_answered, sum(hit)::BIGINT AS n_hit,
               round(sum(hit) / (SELECT count(*) FROM q)::DOUBLE, 6) AS hit_rate
        FROM (SELECT method, query_id, max((l.doc_id IS NOT NULL)::INT) AS hit
              FROM combined c LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = c.doc_id
              GROUP BY method, query_id) GROUP BY method"""),
    "spam_ratio": with_parts(["ratios"], """
        SELECT query_id, round(tf_ratio, 6) AS tf_ratio, round(bm25_ratio, 6) AS bm25_ratio FROM ratios"""),
    "first_spam_and_other": with_parts(["bm25", "spam"], """
        SELECT query_id, arg_min(doc_id, rank) FILTER (is_spam) AS spam_doc, arg_min(doc_id, rank) FILTER (NOT is_spam) AS other_doc
        FROM (SELECT b.*, s.doc_id IS NOT NULL AS is_spam FROM bm25 b LEFT JOIN spam s ON s.doc_id = b.doc_id)
        GROUP BY query_id"""),
    "short_in_top": with_parts(["bm25", "docs"], """
        SELECT query_id, bool_or(word_count < 100) AS has_short FROM bm25 JOIN docs ON id = doc_id
        WHERE rank <= 3 GROUP BY query_id"""),
}

# The documents after two rounds of changes take the place of the given ones.
_CHANGED = """
        SELECT id, title, content, category, lang FROM (
          SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source AS category, lang,
                 substr(text, length(split_part(text, chr(10), 1)) + 2) AS old,
                 CASE WHEN doc_id % 40 = 3 THEN 'second ' || title WHEN doc_id % 100 = 7 THEN 'again ' || left(old, 100)
                      WHEN doc_id % 20 = 3 THEN title || ' ' || left(old, 500) ELSE old END AS content
          FROM documents WHERE doc_id % 100 <> 23 AND (doc_id % 20 <> 7 OR doc_id % 100 = 7))
        UNION ALL
        SELECT doc_id + 1000000, 'copy ' || split_part(text, chr(10), 1), substr(text, length(split_part(text, chr(10), 1)) + 2), source, lang
        FROM documents WHERE doc_id % 50 = 1"""


def _changed(needs: list[str], select: str) -> str:
    return with_parts(needs, select).replace(PARTS["docs0"][1], _CHANGED)


SQL["folder_rejects"] = SQL["frontmatter_rejects"]
SQL["folder_load"] = f"""
    SELECT row_number() OVER (ORDER BY source_file) AS id, source_file, title, category, content, word_count
    FROM ({SQL['frontmatter_load']})"""
SQL["updated_documents"] = _changed(["docs"], "SELECT id, title, content, category, word_count FROM docs")
SQL["updated_term_stats"] = _changed(["df"], "SELECT term, doc_freq, round(idf, 6) AS idf FROM df")
SQL["updated_ranking"] = _changed(["bm25"], TOP + "bm25")

# The conversation queries take the place of the keyword queries.
_RAG = with_parts(["fused", "docs"], """
    SELECT query_id, count(*)::BIGINT AS n_docs, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids,
           string_agg(full_text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM fused JOIN docs ON id = doc_id WHERE rank <= 5 GROUP BY query_id""")
SQL["rag_context"] = _RAG.replace(f"q AS MATERIALIZED ({PARTS['q'][1]})", f"q AS MATERIALIZED ({PARTS['q_agent'][1]})")

_CHECKS = with_parts(["docs", "spam", "bm25", "ratios", "counts", "qt", "df", "post"], f"""
    , top AS (SELECT query_id, arg_min(term, (doc_freq, term)) AS term FROM qt JOIN df USING (term) GROUP BY query_id),
    rare AS (SELECT query_id, max((b.rank IS NOT NULL)::INT) AS hit FROM top JOIN post USING (term)
             LEFT JOIN (SELECT * FROM bm25 WHERE rank <= 3) b USING (query_id, doc_id) GROUP BY query_id),
    checks AS (
      SELECT 'corpus size' AS name, count(*) >= 10 AS passed, count(*)::VARCHAR AS details FROM docs
      UNION ALL SELECT 'keyword mass in spam', m >= 20, m::VARCHAR FROM (
        SELECT coalesce(max((length(content) - length(replace(lower(content), '{PHRASE}', ''))) // {len(PHRASE)}), 0) AS m
        FROM docs JOIN spam ON doc_id = id)
      UNION ALL SELECT 'topic coverage', count(*) >= 5, count(*)::VARCHAR FROM docs WHERE lower(content) LIKE '%{NEEDLE}%'
      UNION ALL SELECT 'rare terms on top', sum(hit) = count(*), sum(hit) || ' of ' || count(*) FROM rare
      UNION ALL SELECT 'saturation', count(*) FILTER (bm25_ratio < tf_ratio) = count(*),
                count(*) FILTER (bm25_ratio < tf_ratio) || ' of ' || count(*) FROM ratios WHERE tf_ratio > 1
      UNION ALL SELECT 'short documents compete', count(*) FILTER (word_count < 50) > 0,
                count(*) FILTER (word_count < 50) || ' of ' || count(*) FROM bm25 JOIN docs ON id = doc_id WHERE rank <= 2
      UNION ALL SELECT 'ranked finds more', sum(bm25_matches) > sum(and_matches)
                AND count(*) FILTER (bm25_matches < and_matches) = 0,
                'BM25 ' || sum(bm25_matches) || ', AND ' || sum(and_matches) FROM counts
      UNION ALL SELECT 'embeddings loaded', count(embedding) > 0 AND count(*) FILTER (len(embedding) <> 64) = 0,
                count(embedding) || ' of ' || count(*) FROM documents LEFT JOIN embeddings ON vec_id = doc_id)""")
SQL["validation_checks"] = _CHECKS + "\nSELECT name, passed, details FROM checks"
SQL["check_summary"] = _CHECKS + """
SELECT count(*) FILTER (passed)::BIGINT AS n_passed, count(*)::BIGINT AS n_checks FROM checks"""
