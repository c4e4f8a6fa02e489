"""What a reader expects of the four methods on a small corpus."""

import pytest
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.operators import lexical
from siftwell.operators.analyze import Analyzer
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import define_index
from siftwell.plans import checks


@pytest.fixture(scope="module")
def batch(queries):
    return QueryBatch.measure(queries)


@pytest.fixture(scope="module", params=["simple", "english"])
def scores(request, docs, batch):
    table = lexical.match_scores(define_index(docs, Analyzer(request.param)), batch)
    return request.param, runtime.write_scratch(table, "t-scores")


def ranking(scores, query_id):
    rows = lexical.bm25_topk(scores, 15).filter(F.col("query_id") == query_id).orderBy("rank").collect()
    return [r["doc_id"] for r in rows]


def n_and(scores, query_id):
    return lexical.match_all(scores).filter(F.col("query_id") == query_id).count()


def test_unknown_terms_empty_the_boolean_result_only(scores):
    _, s = scores
    for q in (1, 2):
        assert n_and(s, q) == 0 and set(ranking(s, q)[:3]) & {2, 4}


def test_ranked_retrieval_finds_more_than_and(scores):
    _, s = scores
    assert 0 < n_and(s, 3) < len(ranking(s, 3))


def test_rare_term_decides(scores):
    assert ranking(scores[1], 4)[0] == 5


def test_short_tip_beats_long_guide_by_bm25_but_not_by_frequency(scores):
    _, s = scores
    order = ranking(s, 5)
    assert order.index(8) < order.index(10)
    tf = {r["doc_id"]: r["tf_rank"] for r in s.filter("query_id = 5").collect()}
    assert tf[10] > tf[8]


def test_both_terms_beat_stuffing(scores):
    order = ranking(scores[1], 6)
    assert order[0] in (3, 12) and order.index(11) > order.index(12)


def test_everyday_question_finds_the_troubleshooting_text(scores):
    _, s = scores
    assert n_and(s, 7) == 0 and ranking(s, 7)[0] == 1


def test_stemming_connects_secure_and_security(scores):
    config, s = scores
    assert n_and(s, 8) == 0
    if config == "english":
        assert ranking(s, 8)[0] == 6


def test_saturation_shrinks_the_lead_of_spam(spark, scores):
    spam = spark.createDataFrame([(11,)], "doc_id long")
    r = checks.spam_ratio(scores[1], spam).filter("query_id = 9").first()
    assert r["tf_ratio"] > 3 and r["bm25_ratio"] < r["tf_ratio"] / 2


def test_exact_codes_survive_with_compounds(docs, batch):
    index = define_index(docs, Analyzer(keep_compounds=True))
    s = lexical.match_scores(index, batch)
    assert ranking(s, 10) == [9] and ranking(s, 11) == [9]
