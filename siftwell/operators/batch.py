"""The query side of every operator: a validated, measured table of queries.

A search operator takes a table of queries.  Measuring it once (a single
aggregate over that table alone) tells how many rows anything derived from it
can have, which decides whether that side may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import scoring as sc
from siftwell.functions import text as tx
from siftwell.operators.analyze import Analyzer, distinct_terms

# Fixed value: memory taken by one row of a hashed relation besides its strings.
ROW_OVERHEAD = 100


def split_valid(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable queries, rejected ``query_id, error``); only NULL and '' are rejected."""
    ok = F.col("query").isNotNull() & (F.col("query") != "")
    rejected = queries.filter(~ok).select("query_id", F.lit("Query is required").alias("error"))
    return queries.filter(ok), rejected


def of_category(queries: DataFrame, category: str) -> DataFrame:
    return queries.filter(F.col("category") == category)


@dataclass(frozen=True)
class QueryBatch:
    """A table of queries with its measured size."""

    queries: DataFrame
    n_queries: int
    n_tokens: int
    n_bytes: int
    n_dims: int
    n_compounds: int = 0
    broadcast_bytes: int = runtime.BROADCAST_BYTES

    @classmethod
    def measure(cls, queries: DataFrame,
                broadcast_bytes: int = runtime.BROADCAST_BYTES) -> "QueryBatch":
        """Drop unusable rows, fill in absent optional columns, measure."""
        valid, _ = split_valid(queries)
        optional = {
            "category": "string", "embedding": "array<float>",
            "vector_weight": "double", "keyword_weight": "double", "threshold": "double",
        }
        for name, dtype in optional.items():
            if name not in valid.columns:
                valid = valid.withColumn(name, F.lit(None).cast(dtype))
        per_query = F.greatest(F.size(tx.tokens_with_compounds("query")), tx.word_count("query"))
        compounds = F.filter(tx.display_terms("query"), tx.is_compound)
        row = valid.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(per_query), F.lit(0)).alias("tokens"),
            F.coalesce(F.sum(F.size(compounds)), F.lit(0)).alias("compounds"),
            F.coalesce(F.sum(F.octet_length("query")), F.lit(0)).alias("bytes"),
            F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dims"),
        ).first()
        return cls(valid, row["n"], row["tokens"], row["bytes"],
                   max(row["dims"], 0), row["compounds"], broadcast_bytes)

    def with_queries(self, queries: DataFrame) -> "QueryBatch":
        """Same rows, other columns (a derived threshold, say): sizes still hold."""
        return replace(self, queries=queries)

    # -- size gate ---------------------------------------------------------

    def fits(self, rows: int, payload_bytes: int = 0) -> bool:
        return rows * ROW_OVERHEAD + payload_bytes <= self.broadcast_bytes

    def per_query(self, df: DataFrame, rows_per_query: int = 1,
                  bytes_per_row: int = 0) -> DataFrame:
        """Mark ``df`` for broadcast when at most ``rows_per_query`` rows each fit."""
        rows = self.n_queries * rows_per_query
        return F.broadcast(df) if self.fits(rows, rows * bytes_per_row) else df

    def terms_fit(self) -> bool:
        return self.fits(self.n_tokens, self.n_bytes * 2)

    def text_side(self, df: DataFrame) -> DataFrame:
        """Mark ``df`` (one row per query, carrying its text) for broadcast if it fits."""
        payload = self.n_bytes * 4 + self.n_tokens * ROW_OVERHEAD
        return F.broadcast(df) if self.fits(self.n_queries, payload) else df

    # -- derived tables ----------------------------------------------------

    def query_terms(self, analyzer: Analyzer) -> DataFrame:
        """``query_id, term, n_terms``, one row per distinct term of a query."""
        wanted = ["query_id", "query"] + ([analyzer.lang_column] if analyzer.lang_column else [])
        rows = distinct_terms(self.queries.select(*wanted), analyzer, "query")
        sized = rows.select("query_id", "terms", F.size("terms").cast("long").alias("n_terms"))
        return sized.select(
            "query_id", "n_terms", F.explode_outer("terms").alias("term")
        ).filter(F.col("term").isNotNull())

    def weights(self) -> DataFrame:
        return self.queries.select(
            "query_id",
            sc.weight_or_default(F.col("vector_weight")).alias("vector_weight"),
            sc.weight_or_default(F.col("keyword_weight")).alias("keyword_weight"),
        )

    def thresholds(self) -> DataFrame:
        """Only thresholds that count: numeric and above zero."""
        return self.queries.filter(F.col("threshold") > 0).select("query_id", "threshold")

    def apply_threshold(self, ranked: DataFrame, keep: Column) -> DataFrame:
        """Keep rows of queries without a threshold, and rows where ``keep`` holds.

        ``keep`` may refer to the column ``threshold`` in the query's own unit.
        """
        limits = self.per_query(self.thresholds())
        joined = ranked.join(limits, "query_id", "left")
        return joined.filter(F.col("threshold").isNull() | keep).drop("threshold")
