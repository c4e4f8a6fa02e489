"""Schemas of the tables that enter and leave the package."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("word_count", T.IntegerType(), True),
    T.StructField("full_text", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("query", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("vector_weight", T.DoubleType(), True),
    T.StructField("keyword_weight", T.DoubleType(), True),
    T.StructField("threshold", T.DoubleType(), True),
])

NEIGHBOURS = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("distance", T.DoubleType(), False),
])

CONTRIBUTION = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("count", T.IntegerType()),
    T.StructField("idf", T.DoubleType()),
    T.StructField("doc_freq", T.LongType()),
    T.StructField("level", T.StringType()),
])

MATCH_ANALYSIS = T.StructType([
    T.StructField("matched_terms", T.ArrayType(T.StringType())),
    T.StructField("missing_terms", T.ArrayType(T.StringType())),
    T.StructField("term_counts", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("contributions", T.ArrayType(CONTRIBUTION)),
    T.StructField("length_factor", T.StringType()),
    T.StructField("vector_rank", T.LongType()),
    T.StructField("keyword_rank", T.LongType()),
    T.StructField("vector_distance", T.DoubleType()),
    T.StructField("keyword_score", T.DoubleType()),
    T.StructField("similarity", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("why_ranked", T.StringType()),
])
