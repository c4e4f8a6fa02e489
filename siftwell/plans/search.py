"""End-to-end plans: load a corpus, search with every method, explain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import runtime, schema
from siftwell.operators import compare, dense, explain, fusion, lexical
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import LexicalIndex
from siftwell.functions import text as tx
from siftwell.sources import documents as src


def load_corpus(spark: SparkSession, folder: str, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with keys and derived columns, rejected files) of a markdown folder.

    ``packed`` is for very many small files in folders of any depth: tasks list them, and a
    task reads files of a given total size. It needs a store that Arrow can open.
    """
    if packed:
        files = runtime.write_scratch(src.read_packed(src.list_markdown(spark, folder)), "packed-files")
    else:
        files = src.scan_markdown(spark, folder)
    if files.isEmpty():
        raise ValueError(f"no documents in {folder}")
    good, bad = src.split_parsed(src.parse_front_matter(files))
    keyed = src.assign_keys(good.drop("value"), ["source_file"])
    return src.derive_columns(keyed), bad


def hybrid_topk(index: LexicalIndex, vectors: DataFrame, batch: QueryBatch,
                k: int = 10, depth: int = 10) -> DataFrame:
    """Fused top ``k`` of the best ``depth`` rows of both methods."""
    keyword = lexical.bm25_best(index, batch, depth)
    vector = dense.vector_topk(vectors, batch, depth)
    return fusion.rrf_topk(vector, keyword, batch, k)


def all_methods(index: LexicalIndex, vectors: DataFrame, batch: QueryBatch,
                k: int = 10) -> dict[str, DataFrame]:
    """Result lists of the four methods.

    The lexical lists come from one pass over the postings and are written,
    like the vector list, because fusion reads them again; they hold at most
    ``k`` rows per query and method.
    """
    lists = runtime.write_scratch(
        lexical.ranked_lists(lexical.match_scores(index, batch), k), "lexical-lists"
    )
    vector = runtime.write_scratch(dense.vector_topk(vectors, batch, k), "vector-list")
    bm25 = lists.filter(F.col("method") == "bm25")
    return {
        "boolean": lists.filter(F.col("method") == "boolean"),
        "bm25": bm25,
        "vector": vector.withColumn("score", F.col("similarity")),
        "hybrid": fusion.rrf_topk(vector, bm25, batch, k),
    }


def side_by_side(index: LexicalIndex, vectors: DataFrame, batch: QueryBatch, k: int = 10) -> DataFrame:
    return compare.side_by_side(all_methods(index, vectors, batch, k))


# Each function below explains the results of one method. They all attach text
# to the short list first; the hybrid one matches terms in the preview only.


def _with_text(results: DataFrame, docs: DataFrame, batch: QueryBatch, k: int) -> DataFrame:
    texts = explain.spread(explain.with_documents(results, docs, batch, k))
    return explain.with_query_terms(texts, batch)


def matched_in_full_text(results: DataFrame, docs: DataFrame, batch: QueryBatch, k: int = 10) -> DataFrame:
    return explain.match_terms(_with_text(results, docs, batch, k), F.col("full_text"))


def explained_boolean(results: DataFrame, docs: DataFrame, batch: QueryBatch, k: int = 10) -> DataFrame:
    return explain.explain_boolean(matched_in_full_text(results, docs, batch, k))


def explained_bm25(results: DataFrame, docs: DataFrame, stats: DataFrame, batch: QueryBatch,
                   k: int = 10, avg_length: float = 45.0) -> DataFrame:
    matched = matched_in_full_text(results, docs, batch, k)
    return explain.explain_bm25(explain.contributions(matched, stats, batch), avg_length)


def explained_vector(results: DataFrame, docs: DataFrame, batch: QueryBatch, k: int = 10) -> DataFrame:
    return explain.explain_vector(matched_in_full_text(results, docs, batch, k))


def explained_hybrid(results: DataFrame, docs: DataFrame, batch: QueryBatch, k: int = 10) -> DataFrame:
    cut = _with_text(results, docs, batch, k).withColumn("content", tx.preview("content"))
    shown = tx.full_text("title", "content")
    return explain.explain_hybrid(explain.match_terms(cut, shown))


def with_headlines(results: DataFrame, docs: DataFrame, batch: QueryBatch, k: int = 10) -> DataFrame:
    texts = explain.spread(explain.with_documents(results, docs, batch, k))
    return explain.headline(texts, batch)


def result_rows(explained: DataFrame, method: str) -> DataFrame:
    """Explained results in the common shape, ready for the result sink.

    What a method does not know (a keyword rank, a headline) is NULL.
    """
    def known(name: str, dtype) -> Column:
        value = F.col(name) if name in explained.columns else F.lit(None)
        return value.cast(dtype).alias(name)

    analysis = F.struct(*[known(f.name, f.dataType) for f in schema.MATCH_ANALYSIS])
    return explained.select(
        F.lit(method).alias("method"), "query_id", "query", "terms", "threshold", "rank", "doc_id",
        "title", tx.preview("content").alias("content"), "category", "word_count",
        F.col("score").cast("double").alias("score"), known("headline", "string"),
        analysis.alias("match_analysis"),
    )


def search_results(index: LexicalIndex, vectors: DataFrame, docs: DataFrame, stats: DataFrame,
                   batch: QueryBatch, k: int = 10) -> DataFrame:
    """All four methods for all queries, explained, as one table with ``method``."""
    lists = all_methods(index, vectors, batch, k)
    boolean = explain.headline(explained_boolean(lists["boolean"], docs, batch, k), batch, index.analyzer)
    parts = [
        result_rows(boolean, "boolean"),
        result_rows(explained_bm25(lists["bm25"], docs, stats, batch, k), "bm25"),
        result_rows(explained_vector(lists["vector"], docs, batch, k), "vector"),
        result_rows(explained_hybrid(lists["hybrid"], docs, batch, k), "hybrid"),
    ]
    return reduce(DataFrame.unionByName, parts)
