import math

import pytest
from pyspark.sql import functions as F

from siftwell.functions import scoring as sc
from siftwell.functions import text as tx
from siftwell.functions.stemming import porter_stem, stem_tokens


def one(spark, expr, **values):
    """Value of ``expr`` over one row with the given columns."""
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("v")).first()["v"]


def test_tokens_split_on_anything_but_word_characters(spark):
    assert one(spark, tx.tokens("t"), t="The c++ max_connections = 100, ÉTÉ!") == ["the", "c", "max_connections", "100", "été"]
    assert one(spark, tx.tokens("t"), t=" --- ") == []


def test_compounds_are_kept_next_to_their_parts(spark):
    got = one(spark, tx.tokens_with_compounds("t"), t="(PG-1234) in 15.3, plain")
    assert got == ["pg-1234", "pg", "1234", "in", "15.3", "15", "3", "plain"]


def test_display_terms_keep_order_and_duplicates(spark):
    assert one(spark, tx.display_terms("q"), q="DB a db C++") == ["db", "db", "c++"]


def test_word_count_counts_white_space_runs(spark):
    assert one(spark, tx.word_count("t"), t="one  two\nthree") == 3


def test_literal_count_takes_terms_literally(spark):
    assert one(spark, tx.literal_count("t", F.lit("a.a")), t="a.a a.a.a axa") == 2
    assert one(spark, tx.literal_count("t", F.lit("")), t="abc") == 0


@pytest.mark.parametrize("term, expected", [
    ("15.3", True), ("15", True), ("5.3", False), ("pg-1234", True), ("c++", False), ("release\\e", False),
])
def test_whole_word_is_literal_and_needs_word_ends(spark, term, expected):
    text = "Release 15.3, error PG-1234 and c++ there"
    assert one(spark, tx.has_whole_word("t", F.lit(term)), t=text) is expected


def test_quoting_survives_the_end_marker(spark):
    assert one(spark, tx.has_whole_word("t", F.lit("a\\Eb")), t="x a\\eb y") is False
    assert one(spark, F.regexp_like(F.col("t"), tx.quoted(F.lit("a\\Eb"))), t="x a\\Eb y") is True


def test_snippet_marks_after_cutting(spark):
    got = one(spark, tx.snippet("c", "m", max_chars=9), c="alpha BETA gamma", m=["beta", "alp"])
    assert got == "<mark>alp</mark>ha BET..."
    assert one(spark, tx.snippet("c", "m"), c="C++ (x)", m=["c++"]) == "<mark>C++</mark> (x)"
    assert one(spark, tx.snippet("c", F.array().cast("array<string>")), c="plain") == "plain"


def test_idf_falls_with_frequency_and_is_null_at_zero(spark):
    values = [one(spark, sc.idf(F.lit(15), F.lit(df))) for df in range(0, 16)]
    assert values[0] is None
    assert all(a > b > 0 for a, b in zip(values[1:], values[2:]))
    assert values[10] == pytest.approx(math.log(5.5 / 10.5 + 1))


def test_bm25_grows_with_tf_and_is_bounded(spark):
    score = lambda tf, length=10.0, b=sc.B: one(
        spark, sc.bm25_term(F.lit(2.0), F.lit(tf), F.lit(length), F.lit(10.0), b=b))
    values = [score(tf) for tf in (1, 2, 5, 50, 5000)]
    assert values == sorted(values) and values[-1] < 2.0 * (sc.K1 + 1)
    assert score(3, 5.0) > score(3, 20.0)
    assert score(3, 5.0, b=0.0) == pytest.approx(score(3, 20.0, b=0.0))


def test_rrf_terms(spark):
    assert one(spark, sc.rrf_term(F.lit(0.5), F.lit(1))) == pytest.approx(0.5 / 61)
    assert one(spark, sc.rrf_term(F.lit(0.5), F.lit(None).cast("int"))) == 0.0
    assert one(spark, sc.rrf_term_missing(F.lit(None).cast("int"))) == pytest.approx(1 / 1060)
    assert one(spark, sc.weight_or_default(F.lit(0.0))) == 0.0
    assert one(spark, sc.weight_or_default(F.lit(None).cast("double"))) == 0.5


def test_mix_gives_both_weights(spark):
    v, k = sc.mix_weights(F.lit(30))
    assert (one(spark, v), one(spark, k)) == (0.3, 0.7)


def test_cosine_distance_ignores_length(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0))
    big = F.transform(b, lambda x: x * 100)
    assert one(spark, sc.cosine_distance(a, b)) == pytest.approx(0.2)
    assert one(spark, sc.cosine_distance(a, big)) == pytest.approx(0.2)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, sc.cosine_distance(a, zero)) is None


def test_vector_text_is_parsed(spark):
    assert one(spark, sc.parse_vector(F.lit("[0.5, 1]"))) == [0.5, 1.0]


def test_labels(spark):
    assert [one(spark, sc.similarity_class(F.lit(s))) for s in (0.41, 0.4, 0.25)] == ["High", "Moderate", "Low"]
    assert [one(spark, sc.rarity_level(F.lit(d))) for d in (3, 7, 8)] == ["HIGH", "MEDIUM", "LOW"]
    got = [one(spark, sc.length_factor(F.lit(n), 40)) for n in (39, 40, 60, 61)]
    assert [g.split()[0] for g in got] == ["boost", "neutral", "neutral", "penalty"]


def test_display_formats(spark):
    assert one(spark, sc.fixed(F.lit(0.0), 4)) == "0.0000"
    assert one(spark, sc.fixed(F.lit(1234.5), 2)) == "1234.50"
    assert one(spark, sc.fixed(F.lit(None).cast("double"), 2)) is None
    assert one(spark, sc.percent(F.lit(0.4567))) == "45.7%"


# Pairs printed in the description of the algorithm.
@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
    ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"),
    ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"),
    ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("cease", "ceas"), ("déjà", "déjà"),
])
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_stemming_keeps_nulls_and_lengths(spark):
    rows = spark.createDataFrame([(1, ["secure", None, "Security"]), (2, None), (3, [])], "i int, t array<string>")
    got = [r["s"] for r in rows.orderBy("i").select(stem_tokens(F.col("t")).alias("s")).collect()]
    assert got == [["secur", None, "Security"], None, []]
