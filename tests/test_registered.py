"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries
from siftwell.operators import dense
from workload.oracle import SQL
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")

# No SQL for these: trained cells, a hash of a feature library.
ROWS_ONLY = {"ann_topk", "ann_recall", "embed_documents"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_query_is_accounted_for():
    assert set(QUERIES) == set(SQL) | ROWS_ONLY
    assert not set(SQL) & ROWS_ONLY
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    columns, rows = compare.rows_of_spark(queries()[name](spark, SF))
    want_columns, want = compare.rows_of_sql(con, oracle_sql()[name])
    assert columns == want_columns
    assert rows == want and rows


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_returns_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_recall_is_useful(spark):
    shares = [r["recall"] for r in queries()["ann_recall"](spark, SF).collect()]
    assert sum(shares) / len(shares) > 0.8


def test_english_index_against_a_plain_model(spark, con):
    """Stop words, stems and language rule, recomputed from the texts."""
    import re
    from collections import Counter

    from siftwell.functions.stemming import porter_stem
    from siftwell.operators.analyze import english_stop_words

    stop = set(english_stop_words())
    rows = con.execute("SELECT text, lang FROM documents").fetchall()
    df = Counter()
    for text, lang in rows:
        title, _, content = text.partition("\n")
        tokens = re.findall(r"\w+", f"{title} {content}".lower())
        if lang == "en":
            tokens = [porter_stem(t) for t in tokens if t not in stop]
        df.update(set(tokens))
    got = {r["term"]: r["doc_freq"] for r in queries()["english_terms"](spark, SF).collect()}
    assert got == dict(df)
