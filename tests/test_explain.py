import re

import pytest
from corpus import CORPUS
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.operators import compare, context, dense, embed, explain, fusion, lexical, topk
from siftwell.operators.analyze import Analyzer
from siftwell.operators.batch import QueryBatch, of_category, split_valid
from siftwell.operators.index import define_index
from siftwell.plans import checks, search


DATABASE_DOCS = sum(bool(re.search(r"\bdatabase\b", f"{t} {c}".lower())) for _, t, c, _ in CORPUS)


@pytest.fixture(scope="module")
def index(docs):
    return define_index(docs)


@pytest.fixture(scope="module")
def vectors(docs):
    return runtime.write_scratch(embed.hashed_embeddings(docs, dims=64), "t-vectors")


@pytest.fixture(scope="module")
def batch(spark, queries):
    """Queries embedded by the same model as the documents."""
    texts = queries.select(F.col("query_id").alias("id"), F.col("query").alias("full_text"))
    own = embed.hashed_embeddings(texts, dims=64).withColumnRenamed("doc_id", "query_id")
    return QueryBatch.measure(runtime.write_scratch(queries.join(own, "query_id", "left"), "t-queries"))


@pytest.fixture(scope="module")
def bm25(index, batch):
    return runtime.write_scratch(lexical.bm25_topk(lexical.match_scores(index, batch)), "t-bm25")


@pytest.fixture(scope="module")
def stats(index, docs, batch):
    return runtime.write_scratch(explain.display_term_stats(index, docs, batch), "t-stats")


def row(df, query_id, doc_id):
    return df.filter((F.col("query_id") == query_id) & (F.col("doc_id") == doc_id)).first()


def test_validation_keeps_white_space_only(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "  ", "b"), (4, "x", "b")], "query_id long, query string, category string")
    good, bad = split_valid(rows)
    assert [r["query_id"] for r in good.orderBy("query_id").collect()] == [3, 4]
    assert {(r["query_id"], r["error"]) for r in bad.collect()} == {(1, "Query is required"), (2, "Query is required")}
    assert of_category(rows, "a").count() == 2
    assert QueryBatch.measure(rows).n_queries == 2


def test_display_statistics_by_whole_word(stats):
    got = {r["term"]: (r["doc_freq"], r["idf"]) for r in stats.collect()}
    assert got["pg-1234"][0] == 1 and got["15.3"][0] == 1
    assert got["c++"] == (0, None) and got["datab"] == (0, None)
    assert got["authentication"][0] == 1 and got["database"][0] == DATABASE_DOCS
    assert got["authentication"][1] > 4 * got["database"][1]


def test_rare_flags(stats, index):
    got = {r["term"]: (r["is_rare"], r["shown_as"]) for r in explain.rare_term_flags(stats, index.n_docs()).collect()}
    assert got["authentication"] == (True, "authentication (1/15)")
    assert got["database"] == (False, f"database ({DATABASE_DOCS}/15)")


def test_bm25_explanation(bm25, docs, stats, batch):
    rows = search.explained_bm25(bm25, docs, stats, batch)
    r = row(rows, 1, 2)
    assert r["matched_terms"] == ["connection", "pooling"] and r["missing_terms"] == ["db"]
    assert r["term_counts"] == {"db": 0, "connection": 2, "pooling": 2}
    assert [(c["term"], c["count"], c["level"]) for c in r["contributions"]] == [("connection", 2, "HIGH"), ("pooling", 2, "HIGH")]
    assert r["reason"] == "Matched 2/3 terms" and r["why_ranked"] == "IDF boost from: connection, pooling"
    assert r["length_factor"] == "boost (shorter than avg)"
    spam = row(rows, 9, 11)
    assert spam["why_ranked"] == "IDF boost from: none" and spam["term_counts"]["database"] == 14


def test_repeated_terms_stay_in_the_lists(bm25, docs, batch):
    r = row(search.matched_in_full_text(bm25, docs, batch), 13, 1)
    assert r["matched_terms"] == ["pool", "pool"] and r["term_counts"] == {"pool": 3}


def test_related_terms_only(docs, batch):
    """A stemmed match may share no literal term with the query."""
    english = define_index(docs, Analyzer("english"))
    found = lexical.bm25_topk(lexical.match_scores(english, batch))
    rows = search.explained_bm25(found, docs, explain.display_term_stats(define_index(docs), docs, batch), batch)
    r = row(rows, 8, 6)
    assert r["matched_terms"] == ["secure", "database"]
    assert rows.filter("size(matched_terms) = 0").filter("reason not like 'No direct%'").count() == 0


def test_boolean_explanation(index, docs, batch):
    found = lexical.boolean_topk(lexical.match_scores(index, batch))
    r = row(search.explained_boolean(found, docs, batch), 3, 2)
    assert r["reason"] == "✓ Contains ALL 3 query terms"


def test_vector_and_hybrid_explanations(vectors, docs, batch, bm25):
    near = dense.vector_topk(vectors, batch)
    r = row(search.explained_vector(near, docs, batch), 4, 5)
    assert r["reason"].startswith(("High", "Moderate", "Low")) and r["reason"].endswith("%)")
    fused = fusion.rrf_topk(near, bm25, batch)
    rows = search.explained_hybrid(fused, docs, batch)
    assert rows.filter(F.length("content") > 200).count() == 0
    both = row(rows, 4, 5)
    assert both["reason"].startswith("Found by BOTH: Vector #") and both["why_ranked"] == "RRF combines ranks: (0.5×vector) + (0.5×keyword)"
    # The guide holds "result" beyond its first 200 characters only.
    cut = search.explained_hybrid(fused.filter("doc_id = 10"), docs, batch.with_queries(
        batch.queries.withColumn("query", F.lit("explain result")))).first()
    assert cut["missing_terms"] == ["result"]


def test_headline_finds_the_densest_window(spark, batch):
    words = ["w"] * 30 + ["pool"] + ["w"] * 70 + ["Pool,", "db", "(pool)"] + ["w"] * 200
    rows = spark.createDataFrame([(1, 7, " ".join(words)), (1, 8, "one two pool"), (1, 9, "nothing " * 60), (1, 10, "")],
                                 "query_id long, doc_id long, content string")
    asked = QueryBatch.measure(spark.createDataFrame([(1, "pool db")], "query_id long, query string"))
    got = {r["doc_id"]: r["headline"] for r in explain.headline(rows, asked).collect()}
    first = got[7].split(" ")
    assert first[:3] == ["<mark>Pool,</mark>", "<mark>db</mark>", "<mark>(pool)</mark>"] and len(first) == 50
    assert got[8] == "one two <mark>pool</mark>"
    assert got[9].split(" ") == ["nothing"] * 20 and got[10] == ""


def test_headline_marks_related_words(spark):
    rows = spark.createDataFrame([(1, 1, "We are securing it securely"), (1, 2, "and the of " * 30 + "secured")],
                                 "query_id long, doc_id long, content string")
    asked = QueryBatch.measure(spark.createDataFrame([(1, "the secure")], "query_id long, query string"))
    got = {r["doc_id"]: r["headline"] for r in explain.headline(rows, asked, Analyzer("english")).collect()}
    assert got[1] == "We are <mark>securing</mark> it <mark>securely</mark>"
    assert got[2].endswith("<mark>secured</mark>") and len(got[2].split(" ")) == 20


def test_pages_and_shown_terms(bm25, docs, batch):
    pages = topk.page(bm25, 5).filter("query_id = 9").collect()
    total = bm25.filter("query_id = 9").count()
    assert len(pages) == 5 and {r["n_more"] for r in pages} == {total - 5}
    few = explain.first_terms(search.matched_in_full_text(bm25, docs, batch), 1, 1)
    r = row(few, 7, 1)
    assert r["shown_matched"] == ["connection"] and r["shown_missing"] == ["fix"]


def test_side_by_side(index, vectors, batch, docs, spark):
    combined = runtime.write_scratch(search.side_by_side(index, vectors, batch), "t-combined")
    assert {r["method"] for r in combined.select("method").distinct().collect()} == set(compare.METHODS)
    assert compare.visible(combined, ["bm25"]).select("method").distinct().count() == 1
    over = row(compare.overlap(combined), 3, 2)
    assert over["methods"] == "bm25,boolean,hybrid,vector" and over["n_methods"] == 4
    assert row(compare.rank_table(combined), 3, 2)["boolean"] is not None
    relevant = spark.createDataFrame([(2,), (2,), (5,)], "doc_id long")
    rates = {r["method"]: (r["n_answered"], r["n_hit"]) for r in compare.hit_rate(combined, relevant, batch).collect()}
    assert rates["boolean"][1] >= 2 and rates["bm25"][1] >= rates["boolean"][1]


def test_result_rows_of_all_methods(index, vectors, docs, stats, batch, tmp_path, spark):
    from siftwell import schema
    from siftwell.sources import documents as src

    limited = batch.with_queries(batch.queries.withColumn("threshold", F.lit(0.5)))
    rows = search.search_results(index, vectors, docs, stats, limited)
    assert [f.name for f in rows.schema["match_analysis"].dataType] == schema.MATCH_ANALYSIS.fieldNames()
    src.write_results(rows, str(tmp_path / "rows"))
    back = spark.read.parquet(str(tmp_path / "rows"))
    r = back.filter("method = 'boolean' and query_id = 3 and doc_id = 2").first()
    assert "<mark>" in r["headline"] and r["query"] == "database connection pooling" and r["threshold"] == 0.5
    assert r["match_analysis"]["contributions"] is None
    h = back.filter("method = 'hybrid' and match_analysis.vector_rank is not null").first()
    assert h["match_analysis"]["vector_distance"] is not None


def test_context_keeps_whole_texts_in_rank_order(bm25, docs, batch):
    got = context.assemble_context(bm25, docs, batch, k=2).filter("query_id = 3").first()
    texts = {r["id"]: r["full_text"] for r in docs.collect()}
    assert got["n_docs"] == 2 and got["context"] == "\n\n".join(texts[d] for d in got["doc_ids"])


def test_flags_from_a_long_table_with_repeats(bm25, batch, spark):
    ids = spark.createDataFrame([(11,), (11,), (2,), (777,)], "doc_id long")
    marked = compare.flagged(bm25, ids, batch, "spam")
    assert marked.count() == bm25.count()
    assert {r["doc_id"] for r in marked.filter("spam").collect()} == {2, 11}


def test_lookup_of_first_rows(bm25):
    spam = topk.first_of_each(bm25, F.col("doc_id") == 11).filter("query_id = 9").first()
    assert spam["flagged"]["doc_id"] == 11 and spam["other"]["doc_id"] != 11
    has = {r["query_id"]: r["x"] for r in topk.any_in_top(bm25, 3, F.col("doc_id") == 11, "x").collect()}
    assert has[9] is True and has[10] is False


def test_checks(index, docs, batch, bm25, spark):
    scores = lexical.match_scores(index, batch)
    spam = spark.createDataFrame([(11,)], "doc_id long")
    facts = checks.ranking_facts(scores, spam)
    all_checks = checks.union_checks([
        checks.corpus_checks(docs, "database", "pool", F.col("category") == "spam", 10, 10, 3),
        checks.saturation_check(facts),
        checks.short_document_check(bm25, docs, 50),
        checks.more_matches_check(facts),
        checks.embedding_check(docs, 64),
    ])
    got = {r["name"]: r["passed"] for r in all_checks.collect()}
    assert got.pop("embeddings loaded") is False
    assert all(got.values()) and len(got) == 6
    total = checks.summary(all_checks).first()
    assert (total["n_passed"], total["n_checks"]) == (6, 7)
