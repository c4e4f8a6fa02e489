"""Substring search by trigrams against a plain search."""

import pytest
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.operators import substring

TEXTS = ["The Quick brown fox", "quick", "qu ick", "", None, "ÄÖÜ straße", "a+b (c)", "aaaa", "aa", "日本語の文章", "tabs\tand\nlines", "fox quick brown"] + [f"filler {i}" for i in range(40)]
NEEDLES = ["quick", "QUICK b", "fox", "a", "", "aa", "aaa", "äöü", "日本語", "b (c", "\tand\n", "nowhere", "filler 1", "k brown fo", "straße"]


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string").withColumn("other", F.lit(1))
    docs = runtime.write_scratch(docs.sort("id"), "substring-docs")
    return docs, substring.save_trigrams(docs, runtime.scratch_path(docs.sparkSession, "substring"))


@pytest.mark.parametrize("pushed", [500, 0])
def test_as_a_plain_search(table, monkeypatch, pushed):
    monkeypatch.setattr(substring, "PUSHED_IDS", pushed)
    docs, index = table
    for needle in NEEDLES:
        got = sorted(r["id"] for r in substring.containing(docs, index, needle).collect())
        assert got == [i for i, t in enumerate(TEXTS) if t is not None and needle.lower() in t.lower()], needle


def test_only_documents_with_all_grams_are_read(table):
    docs, index = table
    assert {r["doc_id"] for r in substring.candidates(index, "quick b").collect()} == {0, 11}  # the second one has all grams, not the needle
    assert substring.candidates(index, "ab") is None
    plan = substring.containing(docs, index, "nowhere")._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan <empty>" in plan
    plan = substring.containing(docs, index, "brown")._jdf.queryExecution().executedPlan().toString()
    assert "In(id, [0,11])" in plan


def test_no_documents(spark):
    docs = spark.createDataFrame([], "id long, content string")
    index = substring.save_trigrams(docs, runtime.scratch_path(spark, "substring-none"))
    assert substring.containing(docs, index, "abc").count() == 0
