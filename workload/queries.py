"""Registered queries: one callable per operator, ``(spark, sf_dir) -> DataFrame``.

Every query reads the whole given tables. Scores are rounded to six decimals in
the output only; lists are joined to text so that results hold plain types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import scoring as sc
from siftwell.functions import text as tx
from siftwell.operators import bounded, compare, context, dense, embed, explain, fusion, lexical, segments, topk
from siftwell.operators import cells as cl
from siftwell.operators.analyze import Analyzer, tokenize
from siftwell.operators.batch import of_category, split_valid
from siftwell.operators.index import doc_lengths, join_postings, look_up_terms
from siftwell.plans import checks, search
from siftwell.sources import documents as src
from workload import tables as tb
from workload.tables import Corpus, corpus

K = 10
MIXES = [0, 25, 50, 75, 100]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    """Register a function of a corpus under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(corpus(spark, sf_dir))
    return fn


def rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def listed(name: str):
    """An array column as comma-separated text."""
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


# -- documents ---------------------------------------------------------------


@query
def corpus_documents(c: Corpus) -> DataFrame:
    return c.plain_documents().select(
        "id", "title", "content", "category", F.col("word_count").cast("long").alias("word_count"), "full_text"
    )


@query
def ordered_texts(c: Corpus) -> DataFrame:
    return src.ordered_texts(c.plain_documents())


@query
def category_filter(c: Corpus) -> DataFrame:
    return c.plain_documents().filter(F.col("category") == "src1").select("id", "title", "category")


@query
def surrogate_keys(c: Corpus) -> DataFrame:
    """Consecutive keys in the order of source and document."""
    rows = c.table("documents").select("source", "doc_id")
    return src.assign_keys(rows, ["source", "doc_id"], key="key_id").select("source", "doc_id", "key_id")


def _as_files(c: Corpus) -> DataFrame:
    """Documents as front-matter files, some of them broken.

    German rows lack the opening marker, Spanish rows the title, French rows
    have a repeated key, rows without a label have no category.
    """
    docs = c.documents().join(
        c.table("labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left"
    )
    opening = F.when(F.col("lang") == "de", "").otherwise("---\n")
    old = F.when(F.col("lang") == "fr", "title: replaced\n").otherwise("")
    title = F.when(F.col("lang") == "es", "author: unknown\n").otherwise(
        F.concat(F.lit("title: no: "), F.col("id").cast("string"), F.lit("\n"))
    )
    category = F.when(F.col("quality").isNull(), "").otherwise(
        F.concat(F.lit("category : quality-"), F.col("quality").cast("string"), F.lit("\n"))
    )
    return docs.select(
        F.concat(F.lit("doc-"), F.col("id").cast("string"), F.lit(".md")).alias("source_file"),
        F.concat(opening, old, title, category, F.lit("---\n\n"), F.col("content"), F.lit("\n")).alias("value"),
    )


@query
def frontmatter_load(c: Corpus) -> DataFrame:
    good, _ = src.split_parsed(src.parse_front_matter(_as_files(c)))
    loaded = src.derive_columns(good)
    return loaded.select(
        "source_file", "title", "category", "content",
        F.col("word_count").cast("long").alias("word_count"),
        F.size("metadata").cast("long").alias("n_keys"),
    )


@query
def frontmatter_rejects(c: Corpus) -> DataFrame:
    _, bad = src.split_parsed(src.parse_front_matter(_as_files(c)))
    return bad


def _loaded_files(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Write the files, load the folder again."""
    def make():
        folder = f"{c.base}/markdown"
        readme = c.table("region").select(F.lit("README.md").alias("source_file"), F.lit("not a document").alias("value")).limit(1)
        other = readme.select(F.lit("notes.txt").alias("source_file"), "value")
        src.write_markdown(_as_files(c).unionByName(readme).unionByName(other), folder, per_folder=500)
        return search.load_corpus(c.spark, folder, packed=True)
    return c._once("markdown", make)


@query
def folder_load(c: Corpus) -> DataFrame:
    """Documents as files in a folder, loaded with keys in the order of their names."""
    docs, _ = _loaded_files(c)
    return docs.select(
        "id", "source_file", "title", "category", "content", F.col("word_count").cast("long").alias("word_count"),
    )


@query
def folder_rejects(c: Corpus) -> DataFrame:
    return _loaded_files(c)[1]


@query
def keyword_like(c: Corpus) -> DataFrame:
    return c.containing_needle().select("id", "category")


@query
def keyword_like_indexed(c: Corpus) -> DataFrame:
    """Two searches, one for a frequent and one for a rare substring, among the documents that the trigrams name."""
    found = lambda needle: c.containing(needle).select("id", "category", F.lit(needle).alias("needle"))
    return found(tb.NEEDLE).unionByName(found(tb.RARE_NEEDLE))


@query
def shortest_matching(c: Corpus) -> DataFrame:
    rows = c.containing_needle().select("id", F.col("word_count").cast("long").alias("word_count"))
    return rows.orderBy("word_count", "id")


@query
def keyword_mass(c: Corpus) -> DataFrame:
    return src.count_words_of(c.plain_documents(), tb.PHRASE)


# -- analysis and index ------------------------------------------------------


@query
def doc_length_table(c: Corpus) -> DataFrame:
    return doc_lengths(c.plain_documents())


@query
def token_positions(c: Corpus) -> DataFrame:
    return tokenize(c.plain_documents(), Analyzer()).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "term"
    )


@query
def compound_tokens(c: Corpus) -> DataFrame:
    """Terms of the analyzer that keeps compounds, counted per document."""
    terms = tokenize(c.plain_documents(), Analyzer(keep_compounds=True))
    return terms.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.count_if(tx.is_compound(F.col("term"))).alias("n_compounds"),
    )


@query
def postings(c: Corpus) -> DataFrame:
    return c.index().postings.select("term", "doc_id", "tf", "doc_len", listed("positions"))


@query
def term_stats(c: Corpus) -> DataFrame:
    return c.index().term_stats.select("term", "doc_freq", *rounded("idf"))


@query
def corpus_stats(c: Corpus) -> DataFrame:
    return c.index().corpus_stats.select("n_docs", "n_tokens", *rounded("avg_len"))


@query
def query_terms(c: Corpus) -> DataFrame:
    return c.keyword_queries().query_terms(Analyzer())


@query
def display_terms(c: Corpus) -> DataFrame:
    batch = c.keyword_queries()
    return batch.queries.select("query_id", tx.display_terms("query").alias("terms")).select(
        "query_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", " ").alias("terms")
    )


@query
def query_workload(c: Corpus) -> DataFrame:
    both = c.keyword_table().unionByName(c.agent_table())
    agent = of_category(both, "agent")
    return agent.select("query_id", "query", "category", *rounded("vector_weight", "keyword_weight"))


@query
def query_rejects(c: Corpus) -> DataFrame:
    """Queries taken from turns; a system turn counts as one without text."""
    turns = c.table("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.when(F.col("role") == "system", "").when(F.col("role") == "user", F.col("text")).alias("query"),
    )
    return split_valid(turns)[1]


# -- lexical -----------------------------------------------------------------


def _scores(c: Corpus) -> DataFrame:
    return lexical.match_scores(c.index(), c.keyword_queries())


@query
def match_and(c: Corpus) -> DataFrame:
    return lexical.match_all(_scores(c)).select("query_id", "doc_id", "n_matched")


@query
def match_or(c: Corpus) -> DataFrame:
    return lexical.match_any(_scores(c)).select("query_id", "doc_id", "n_matched", "n_terms")


@query
def match_counts(c: Corpus) -> DataFrame:
    batch = c.keyword_queries()
    return lexical.match_counts(_scores(c), batch)


@query
def tf_rank_topk(c: Corpus) -> DataFrame:
    return lexical.boolean_topk(_scores(c), K).select("query_id", "doc_id", "rank", *rounded("score"))


@query
def bm25_topk(c: Corpus) -> DataFrame:
    return lexical.bm25_topk(_scores(c), K).select("query_id", "doc_id", "rank", *rounded("score"))


@query
def bm25_bounded_topk(c: Corpus) -> DataFrame:
    """The same list from a part of the postings."""
    best = bounded.bm25_topk_bounded(c.index(), c.bounds(), c.keyword_queries(), K)
    return best.select("query_id", "doc_id", "rank", *rounded("score"))


@query
def bm25_threshold(c: Corpus) -> DataFrame:
    batch = c.keyword_queries(tb.BM25_THRESHOLD)
    best = lexical.bm25_topk_above(lexical.match_scores(c.index(), batch), batch, K)
    return best.select("query_id", "doc_id", "rank", *rounded("score"))


@query
def bm25_content_field(c: Corpus) -> DataFrame:
    """BM25 over the content alone, among documents that contain a substring."""
    among = c.containing_needle().select(F.col("id").alias("doc_id"))
    scores = lexical.match_scores(c.content_index(), c.keyword_queries(), within=among)
    return lexical.bm25_topk(scores, 5).select("query_id", "doc_id", "rank", *rounded("score"))


@query
def bm25_english(c: Corpus) -> DataFrame:
    batch = c.keyword_queries()
    english = batch.with_queries(batch.queries.withColumn("lang", F.lit("en")))
    best = lexical.bm25_topk(lexical.match_scores(c.english_index(), english), K)
    return best.select("query_id", "doc_id", "rank", *rounded("score"))


@query
def english_terms(c: Corpus) -> DataFrame:
    return c.english_index().term_stats.select("term", "doc_freq", *rounded("idf"))


@query
def df_word_boundary(c: Corpus) -> DataFrame:
    stats = explain.display_term_stats(c.index(), c.documents(), c.keyword_queries())
    return stats.select("term", "doc_freq", *rounded("idf"))


@query
def rare_terms(c: Corpus) -> DataFrame:
    stats = explain.display_term_stats(c.index(), c.documents(), c.keyword_queries())
    return explain.rare_term_flags(stats, c.index().n_docs()).select("term", "is_rare", "shown_as")


# -- changes -----------------------------------------------------------------


def _changes(docs: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Two rounds of (new and changed rows, removed ids), together a good tenth of the documents."""
    key = F.col("id")
    row = lambda new_id, title, content: [
        (new_id if c == "id" else title if c == "title" else content if c == "content" else F.col(c)).alias(c)
        for c in ("id", "title", "content", "category", "lang")
    ]
    first = docs.filter(key % 20 == 3).select(*row(key, F.col("title"), F.concat("title", F.lit(" "), F.substring("content", 1, 500))))
    second = docs.filter((key % 40 == 3) & (key % 100 != 23)).select(*row(key, F.col("title"), F.concat(F.lit("second "), "title")))
    added = docs.filter(key % 50 == 1).select(*row(key + 1_000_000, F.concat(F.lit("copy "), "title"), F.col("content")))
    again = docs.filter(key % 100 == 7).select(*row(key, F.col("title"), F.concat(F.lit("again "), F.substring("content", 1, 100))))
    return [
        (src.derive_columns(first), docs.filter(key % 20 == 7).select("id")),
        (src.derive_columns(second.unionByName(added).unionByName(again)), docs.filter(key % 100 == 23).select("id")),
    ]


def _changed(c: Corpus):
    """(documents, index) after both rounds, the second round folded into the first."""
    def make():
        plain = c.documents().select("id", "title", "content", "category", "lang", "word_count")
        home = f"{c.base}/changed"
        docs = segments.write_sharded(plain, f"{home}/documents", c.shards())
        index = segments.SegmentedIndex(c.index(), f"{home}/segments")
        for upserts, deletes in _changes(plain):
            index = index.apply(docs, upserts, deletes)
            docs = segments.update_documents(docs, f"{home}/documents", c.shards(), upserts, deletes)
        return docs, index.fold().merged()
    return c._once("changed", make)


@query
def updated_documents(c: Corpus) -> DataFrame:
    docs, _ = _changed(c)
    return docs.select("id", "title", "content", "category", F.col("word_count").cast("long").alias("word_count"))


@query
def updated_term_stats(c: Corpus) -> DataFrame:
    _, index = _changed(c)
    return index.term_stats.select("term", "doc_freq", *rounded("idf"))


@query
def updated_ranking(c: Corpus) -> DataFrame:
    """BM25 over the base and its segments."""
    _, index = _changed(c)
    best = lexical.bm25_topk(lexical.match_scores(index, c.keyword_queries()), K)
    return best.select("query_id", "doc_id", "rank", *rounded("score"))


# -- vectors -----------------------------------------------------------------


def _nearest(c: Corpus) -> DataFrame:
    return dense.vector_topk(c.vectors(), c.keyword_queries(), K)


@query
def embedding_coverage(c: Corpus) -> DataFrame:
    return embed.coverage(c.documents())


@query
def vector_topk(c: Corpus) -> DataFrame:
    return _nearest(c).select("query_id", "doc_id", "rank", *rounded("distance", "similarity"))


@query
def vector_threshold(c: Corpus) -> DataFrame:
    batch = c.keyword_queries(tb.VECTOR_THRESHOLD)
    near = dense.vector_topk_above(dense.vector_topk(c.vectors(), batch, K), batch)
    return near.select("query_id", "doc_id", "rank", *rounded("distance", "similarity"))


@query
def vector_labels(c: Corpus) -> DataFrame:
    return dense.labelled(_nearest(c)).select("query_id", "doc_id", "rank", "label")


@query
def vector_pruned_topk(c: Corpus) -> DataFrame:
    """Exact, from the cells that can hold a neighbour."""
    near = cl.pruned_search(c.cell_index(), c.keyword_queries(), K).results
    return near.select("query_id", "doc_id", "rank", *rounded("distance", "similarity"))


def _rerank(c: Corpus) -> int:
    return tb.rerank(c.cell_index().n_vectors(), K)


@query
def ann_topk(c: Corpus) -> DataFrame:
    near = cl.approximate_topk(c.cell_index(), c.keyword_queries(), K, rerank=_rerank(c))
    return near.select("query_id", "doc_id", "rank", *rounded("distance", "similarity"))


@query
def ann_all_cells(c: Corpus) -> DataFrame:
    """Probing every cell must give the exact neighbours."""
    cells, model = c.cells()
    near = dense.ann_topk(cells, model, c.keyword_queries(), K, n_probe=tb.N_CELLS)
    return near.select("query_id", "doc_id", "rank", F.round("similarity", 4).alias("similarity"))


@query
def ann_recall(c: Corpus) -> DataFrame:
    """Recall, and the share of the vectors that were ranked by their true distance."""
    index, batch = c.cell_index(), c.keyword_queries()
    near = cl.approximate_topk(index, batch, K, rerank=_rerank(c))
    reads = cl.ranked_counts(index, batch, K, rerank=_rerank(c))
    share = reads.select("query_id", (F.col("n_exact") / F.lit(index.n_vectors())).alias("read_share"))
    return dense.recall(near, _nearest(c)).join(share, "query_id", "left").select("query_id", *rounded("recall", "read_share"))


@query
def embed_documents(c: Corpus) -> DataFrame:
    """Offline hashed embedding of every document."""
    vectors = embed.hashed_embeddings(c.documents(), dims=128)
    return vectors.select("doc_id", F.size("embedding").cast("long").alias("dims"))


# The letters whose shares are a document's vector, what the model refuses for now and for good.
LETTERS, BUSY, REFUSED = "aens", "er", "###"


def _letter_shares(refused: tuple[str, ...]):
    """A model of our own: shares of four letters; it fails on texts with certain parts."""
    def model(texts: list[str]) -> list[list[float]]:
        if any(part in t for t in texts for part in refused):
            raise ValueError("not now")
        return [[t.count(c) / max(len(t), 1) for c in LETTERS] for t in texts]
    return model


@query
def embed_resumed(c: Corpus) -> DataFrame:
    """Two runs of the embedding job: the first model is too busy for many texts, both refuse some."""
    def make() -> str:
        path = f"{c.base}/letter_vectors"
        for refused in ((BUSY, REFUSED), (REFUSED,)):
            embed.resume_embeddings(c.documents(), path, _letter_shares(refused))
        return path
    vectors = embed.stored_embeddings(c.documents(), c._once("letter_vectors", make))
    share = lambda i: F.round(F.col("embedding")[i].cast("double"), 5).alias(f"share_{LETTERS[i]}")
    return vectors.select("doc_id", F.col("run").cast("long").alias("run"), *[share(i) for i in range(len(LETTERS))])


# -- fusion ------------------------------------------------------------------


def _both_lists(c: Corpus) -> tuple[DataFrame, DataFrame]:
    return _nearest(c), lexical.bm25_topk(_scores(c), K)


def _fused(c: Corpus) -> DataFrame:
    vector, keyword = _both_lists(c)
    return fusion.rrf_topk(vector, keyword, c.keyword_queries(), K)


@query
def rrf_topk(c: Corpus) -> DataFrame:
    return _fused(c).select("query_id", "doc_id", "rank", "vector_rank", "keyword_rank", *rounded("score"))


@query
def rrf_threshold(c: Corpus) -> DataFrame:
    kept = fusion.rrf_topk_above(_fused(c), c.keyword_queries(tb.RRF_THRESHOLD))
    return kept.select("query_id", "doc_id", "rank", *rounded("score"))


@query
def rrf_missing_rank(c: Corpus) -> DataFrame:
    vector, keyword = _both_lists(c)
    return fusion.rrf_missing_topk(vector, keyword, K).select("query_id", "doc_id", "rank", *rounded("score"))


@query
def rrf_weight_sweep(c: Corpus) -> DataFrame:
    vector, keyword = _both_lists(c)
    return fusion.rrf_sweep(vector, keyword, MIXES, K).select("query_id", "mix", "doc_id", "rank", *rounded("score"))


@query
def rrf_source_labels(c: Corpus) -> DataFrame:
    rows = explain.explain_hybrid(fusion.source_label(_fused(c)))
    return rows.select("query_id", "doc_id", "found_by", "reason", "why_ranked")


# -- explanations ------------------------------------------------------------


def _counts_text():
    pairs = F.transform(
        F.map_entries("term_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return F.array_join(pairs, " ").alias("term_counts")


def _match_columns() -> list:
    return [
        F.array_join("matched_terms", " ").alias("matched_terms"),
        F.array_join("missing_terms", " ").alias("missing_terms"),
        _counts_text(),
    ]


def _bm25(c: Corpus) -> DataFrame:
    return lexical.bm25_topk(_scores(c), K)


def _explained_bm25(c: Corpus) -> DataFrame:
    stats = explain.display_term_stats(c.index(), c.documents(), c.keyword_queries())
    return search.explained_bm25(_bm25(c), c.documents(), stats, c.keyword_queries(), K)


@query
def match_analysis(c: Corpus) -> DataFrame:
    rows = _explained_bm25(c)
    return rows.select("query_id", "doc_id", "rank", *_match_columns(), "reason", tx.preview("content").alias("preview"))


@query
def boolean_explanation(c: Corpus) -> DataFrame:
    found = lexical.boolean_topk(_scores(c), K)
    rows = search.explained_boolean(found, c.documents(), c.keyword_queries(), K)
    return rows.select("query_id", "doc_id", "rank", *_match_columns(), "reason")


@query
def vector_explanation(c: Corpus) -> DataFrame:
    rows = search.explained_vector(_nearest(c), c.documents(), c.keyword_queries(), K)
    return rows.select("query_id", "doc_id", "rank", *_match_columns(), "reason")


@query
def hybrid_explanation(c: Corpus) -> DataFrame:
    """Terms are matched in the preview that is shown."""
    rows = search.explained_hybrid(_fused(c), c.documents(), c.keyword_queries(), K)
    return rows.select("query_id", "doc_id", "rank", *_match_columns(), "reason")


@query
def term_contributions(c: Corpus) -> DataFrame:
    rows = _explained_bm25(c)
    one = rows.select("query_id", "doc_id", "why_ranked", F.posexplode("contributions").alias("pos", "t"))
    return one.select(
        "query_id", "doc_id", F.col("pos").cast("long").alias("pos"), "t.term",
        F.col("t.count").cast("long").alias("n"), F.round("t.idf", 6).alias("idf"),
        "t.doc_freq", "t.level", "why_ranked",
    )


@query
def length_factor(c: Corpus) -> DataFrame:
    rows = explain.with_documents(_bm25(c), c.documents(), c.keyword_queries(), K)
    return rows.select(
        "query_id", "doc_id", F.col("word_count").cast("long").alias("word_count"),
        sc.length_factor(F.col("word_count"), c.index().avg_len()).alias("length_factor"),
    )


@query
def snippet(c: Corpus) -> DataFrame:
    matched = search.matched_in_full_text(_bm25(c), c.documents(), c.keyword_queries(), K)
    return matched.select("query_id", "doc_id", tx.snippet("content", "matched_terms").alias("snippet"))


@query
def shown_terms(c: Corpus) -> DataFrame:
    few = explain.first_terms(search.matched_in_full_text(_bm25(c), c.documents(), c.keyword_queries(), K))
    return few.select("query_id", "doc_id", listed("shown_matched"), listed("shown_missing"))


@query
def headline(c: Corpus) -> DataFrame:
    rows = search.with_headlines(_bm25(c), c.documents(), c.keyword_queries(), K)
    return rows.select("query_id", "doc_id", "headline")


# -- comparison --------------------------------------------------------------


def _combined(c: Corpus) -> DataFrame:
    return search.side_by_side(c.index(), c.vectors(), c.keyword_queries(), K)


@query
def side_by_side(c: Corpus) -> DataFrame:
    return _combined(c).select("method", "query_id", "doc_id", "rank", *rounded("score"))


@query
def search_results(c: Corpus) -> DataFrame:
    """All methods, explained, in the shape that is written as result rows."""
    batch = c.keyword_queries()
    stats = explain.display_term_stats(c.index(), c.documents(), batch)
    rows = search.search_results(c.index(), c.vectors(), c.documents(), stats, batch, K)
    return rows.select(
        "method", "query_id", "rank", "doc_id", "title", "content", "category", *rounded("score"),
        F.col("word_count").cast("long").alias("word_count"),
        F.size("terms").cast("long").alias("n_terms"),
        F.size("match_analysis.matched_terms").cast("long").alias("n_matched"),
        F.coalesce(F.size("match_analysis.contributions"), F.lit(-1)).cast("long").alias("n_contributions"),
        "match_analysis.vector_rank", "match_analysis.keyword_rank", "match_analysis.reason",
    )


@query
def visible_methods(c: Corpus) -> DataFrame:
    return compare.visible(_combined(c), ["bm25", "hybrid"]).select("method", "query_id", "doc_id", "rank")


@query
def method_overlap(c: Corpus) -> DataFrame:
    return compare.overlap(_combined(c))


@query
def rank_table(c: Corpus) -> DataFrame:
    return compare.rank_table(_combined(c))


@query
def result_pages(c: Corpus) -> DataFrame:
    return topk.page(_bm25(c), 5).select("query_id", "doc_id", "rank", "n_more")


@query
def method_hit_rate(c: Corpus) -> DataFrame:
    rates = compare.hit_rate(_combined(c), c.relevant_ids(), c.keyword_queries(), K)
    return rates.select("method", "n_answered", "n_hit", *rounded("hit_rate"))


@query
def rag_context(c: Corpus) -> DataFrame:
    batch = c.agent_queries()
    fused = search.hybrid_topk(c.index(), c.vectors(), batch, K)
    return context.assemble_context(fused, c.documents(), batch, 5).select(
        "query_id", "n_docs", listed("doc_ids"), "context"
    )


# -- checks ------------------------------------------------------------------


@query
def spam_ratio(c: Corpus) -> DataFrame:
    return checks.spam_ratio(_scores(c), c.spam_ids()).select("query_id", *rounded("tf_ratio", "bm25_ratio"))


@query
def first_spam_and_other(c: Corpus) -> DataFrame:
    """The best labelled-spam row and the best other row of each list."""
    marked = compare.flagged(_bm25(c), c.spam_ids(), c.keyword_queries(), "is_spam", K)
    first = topk.first_of_each(marked, F.col("is_spam"))
    return first.select(
        "query_id", F.col("flagged.doc_id").alias("spam_doc"), F.col("other.doc_id").alias("other_doc")
    )


@query
def short_in_top(c: Corpus) -> DataFrame:
    rows = explain.with_documents(_bm25(c), c.documents(), c.keyword_queries(), K)
    return topk.any_in_top(rows, 3, F.col("word_count") < 100, "has_short")


def _rarest_term_holders(c: Corpus) -> DataFrame:
    """``query_id, doc_id``: documents that hold the rarest indexed term of a query."""
    batch = c.keyword_queries()
    terms = look_up_terms(c.index(), batch.query_terms(Analyzer()), batch)
    rarest = terms.groupBy("query_id").agg(
        F.min_by(F.struct("term_bucket", "term"), F.struct("doc_freq", "term")).alias("t")
    ).select("query_id", "t.term_bucket", "t.term")
    return join_postings(c.index(), rarest, batch).select("query_id", "doc_id")


@query
def validation_checks(c: Corpus) -> DataFrame:
    docs = c.documents().join(
        c.spam_ids().select(F.col("doc_id").alias("id"), F.lit(True).alias("is_spam")), "id", "left"
    )
    scores = _scores(c)
    # Both are short and read by two checks each.
    best = runtime.write_scratch(lexical.bm25_topk(scores, K), "bm25-list")
    facts = runtime.write_scratch(checks.ranking_facts(scores, c.spam_ids()), "ranking-facts")
    return checks.union_checks([
        checks.corpus_checks(docs, tb.PHRASE, tb.NEEDLE, F.col("is_spam"), 10, 20, 5),
        checks.rare_term_check(best, _rarest_term_holders(c)),
        checks.saturation_check(facts),
        checks.short_document_check(best, c.documents(), 50),
        checks.more_matches_check(facts),
        checks.embedding_check(c.documents(), 64),
    ])


@query
def check_summary(c: Corpus) -> DataFrame:
    return checks.summary(validation_checks(c))
