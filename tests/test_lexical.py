"""Boolean and BM25 retrieval against a plain Python model, and its properties."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpus import CORPUS, QUERIES
from siftwell import runtime
from siftwell.operators import lexical
from siftwell.operators.analyze import Analyzer, tokenize
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import define_index, doc_lengths, load_index, prune_common, save_index

WORD = re.compile(r"\w+")
TEXTS = {i: WORD.findall(f"{t} {c}".lower()) for i, t, c, _ in CORPUS}


def model_scores(texts=TEXTS, queries=QUERIES, k1=1.2, b=0.75):
    n = len(texts)
    avg = sum(map(len, texts.values())) / n
    tf = {d: Counter(ts) for d, ts in texts.items()}
    df = Counter(t for ts in tf.values() for t in ts)
    out = {}
    for q, text, *_ in queries:
        terms = set(WORD.findall(text.lower()))
        for d in texts:
            hit = [t for t in terms if tf[d][t]]
            if hit:
                score = sum(
                    math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[d][t] * (k1 + 1)
                    / (tf[d][t] + k1 * (1 - b + b * len(texts[d]) / avg)) for t in hit
                )
                out[q, d] = (len(hit), len(terms), sum(tf[d][t] for t in hit), score)
    return out


def as_dict(scores):
    return {(r["query_id"], r["doc_id"]): (r["n_matched"], r["n_terms"], r["tf_rank"], r["score"]) for r in scores.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][:3] == want[key][:3]
        assert got[key][3] == pytest.approx(want[key][3])


@pytest.fixture(scope="module")
def saved(spark, docs):
    return save_index(docs, runtime.scratch_path(spark, "t-index"), "siftwell_test_index", term_buckets=4, shards=3)


@pytest.fixture(scope="module")
def batch(queries):
    return QueryBatch.measure(queries)


def test_saved_and_lazy_index_agree_with_the_model(docs, saved, batch):
    want = model_scores()
    same(as_dict(lexical.match_scores(saved, batch)), want)
    same(as_dict(lexical.match_scores(define_index(docs), batch)), want)


def test_large_batches_use_the_salted_join_with_equal_results(docs, saved, queries, monkeypatch):
    monkeypatch.setattr("siftwell.operators.index.HOT_FRACTION", 0.002)
    tight = QueryBatch.measure(queries, broadcast_bytes=0)
    plan = lexical.match_scores(saved, tight)
    same(as_dict(plan), model_scores())


def test_result_does_not_depend_on_partitions_or_batch_size(docs, batch, queries):
    want = model_scores()
    same(as_dict(lexical.match_scores(define_index(docs.repartition(7)), batch)), want)
    single = {}
    for q in (3, 7):
        one = QueryBatch.measure(queries.filter(F.col("query_id") == q))
        single |= as_dict(lexical.match_scores(define_index(docs), one))
    same(single, {k: v for k, v in want.items() if k[0] in (3, 7)})


def test_index_opens_again_from_its_files(spark, docs, batch):
    path = runtime.scratch_path(spark, "t-reopen")
    save_index(docs, path, "siftwell_test_first", term_buckets=4, shards=3)
    again = load_index(spark, path, "siftwell_test_again", 3, term_buckets=4)
    same(as_dict(lexical.match_scores(again, batch)), model_scores())


def test_postings_hold_positions(saved):
    row = saved.postings.filter("term = 'database' and doc_id = 11").first()
    assert row["positions"] == [i for i, t in enumerate(TEXTS[11]) if t == "database"]
    assert row["tf"] == len(row["positions"]) and row["doc_len"] == len(TEXTS[11])


def test_statistics(saved, docs):
    stats = saved.corpus_stats.first()
    assert (stats["n_docs"], stats["n_tokens"]) == (15, sum(map(len, TEXTS.values())))
    df = {r["term"]: r["doc_freq"] for r in saved.term_stats.collect()}
    assert df["database"] == sum("database" in t for t in TEXTS.values()) and "db" not in df
    lengths = {r["doc_id"]: r["doc_len"] for r in doc_lengths(docs).collect()}
    assert lengths == {d: len(t) for d, t in TEXTS.items()}


def test_documents_without_terms_count_but_never_match(spark, batch):
    rows = spark.createDataFrame([(1, "database pool"), (2, "..."), (3, "")], "id long, full_text string")
    index = define_index(rows)
    assert index.corpus_stats.first()["n_docs"] == 3
    assert {d for _, d in as_dict(lexical.match_scores(index, batch))} == {1}


def test_and_or_and_counts(saved, batch):
    scores = lexical.match_scores(saved, batch)
    both = {(r["query_id"], r["doc_id"]) for r in lexical.match_all(scores).collect()}
    any_ = {(r["query_id"], r["doc_id"]) for r in lexical.match_any(scores).collect()}
    assert both < any_ and (3, 2) in both and (1, 2) not in both
    counts = {r["query_id"]: (r["and_matches"], r["bm25_matches"]) for r in lexical.match_counts(scores, batch).collect()}
    assert counts[14] == (0, 0) and counts[1][0] == 0 and counts[1][1] > 0
    assert len(counts) == len(QUERIES)


def test_threshold_is_strict_and_off_when_absent_or_not_positive(saved, batch):
    best = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.bm25_topk(lexical.match_scores(saved, batch)).collect()}
    edge = max(s for (q, _), s in best.items() if q == 4)
    limits = F.when(F.col("query_id") == 4, edge).when(F.col("query_id") == 9, 0.0)
    limited = batch.with_queries(batch.queries.withColumn("threshold", limits))
    kept = lexical.bm25_topk_above(lexical.match_scores(saved, limited), limited).collect()
    assert {r["query_id"] for r in kept} == {q for q, _ in best} - {4}
    assert sum(r["query_id"] == 9 for r in kept) == sum(q == 9 for q, _ in best)


def test_ranked_lists_equal_the_single_lists(saved, batch):
    scores = lexical.match_scores(saved, batch)
    lists = lexical.ranked_lists(scores, 5)
    for method, single in (("bm25", lexical.bm25_topk(scores, 5)), ("boolean", lexical.boolean_topk(scores, 5))):
        got = {(r["query_id"], r["doc_id"], r["rank"]) for r in lists.filter(F.col("method") == method).collect()}
        assert got == {(r["query_id"], r["doc_id"], r["rank"]) for r in single.collect()}


def test_within_restricts_documents_but_not_statistics(saved, docs, batch):
    among = docs.filter("category = 'tutorial'").select(F.col("id").alias("doc_id"))
    got = as_dict(lexical.match_scores(saved, batch, within=among.union(among)))
    same(got, {k: v for k, v in model_scores().items() if k[1] in (2, 3, 4)})


def test_common_terms_can_be_pruned(saved, batch):
    pruned = prune_common(saved, 0.5)
    assert not lexical.match_scores(pruned, batch).filter("query_id = 9").count()


def test_english_removes_stop_words_and_keeps_positions(spark):
    rows = spark.createDataFrame([(1, "The secured pools of it", "en"), (2, "The secured", "de")], "id long, full_text string, lang string")
    got = tokenize(rows, Analyzer("english", lang_column="lang")).orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["pos"], r["term"]) for r in got] == [(1, 1, "secur"), (1, 2, "pool"), (2, 0, "the"), (2, 1, "secured")]
    with pytest.raises(ValueError):
        Analyzer("klingon")


def test_one_term_in_every_document_and_copies(spark):
    """A third of the rows are copies of one text; ranks stay exact and ties go by id."""
    texts = {i: (["hot", "copy"] if i % 3 == 0 else ["hot", f"w{i % 7}", "x"]) for i in range(600)}
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, full_text string")
    asked = spark.createDataFrame([(1, "hot copy"), (2, "hot w3")], "query_id long, query string")
    want = model_scores(texts, [(1, "hot copy"), (2, "hot w3")])
    for limit in (runtime.BROADCAST_BYTES, 0):
        b = QueryBatch.measure(asked, broadcast_bytes=limit)
        scores = lexical.match_scores(define_index(rows), b)
        same(as_dict(scores), want)
        top = lexical.bm25_topk(scores, 10).filter("query_id = 1").orderBy("rank").collect()
        assert [r["doc_id"] for r in top] == list(range(0, 30, 3))
