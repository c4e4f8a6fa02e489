"""Set-up for the registered queries: the given tables in the package's roles.

A corpus is loaded and indexed once per application and then read by every
query, in the shared folder the cluster names. Each table is written when a
query first needs it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import text as tx
from siftwell.operators import bounded, dense, embed, substring
from siftwell.operators import cells as cl
from siftwell.operators.analyze import Analyzer
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import LexicalIndex, save_index
from siftwell.sources import documents as src

TERM_BUCKETS = 8
N_CELLS = 16
# Phrases looked for in the corpus, thresholds of the queries.
NEEDLE = "tion"
RARE_NEEDLE = "NERING"
PHRASE = "the"
BM25_THRESHOLD = 30.0
VECTOR_THRESHOLD = 25.0
RRF_THRESHOLD = 9.0

ENGLISH = Analyzer("english", lang_column="lang")


# Fixed value: vectors that a query may rank exactly, as a share of all.
READ_SHARE = 0.2


def rerank(n_vectors: int, k: int) -> int:
    """Ten vectors for each result, but no more than the share allows."""
    return max(k, min(10 * k, int(n_vectors * READ_SHARE)))


class Corpus:
    """Tables of one data folder, written on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        runtime.ship_package(spark)
        self.base = runtime.scratch_path(spark, "corpus")
        self._made: dict[str, object] = {}

    def _once(self, name: str, make: Callable[[], object]):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _name(self, table: str) -> str:
        return f"siftwell_{self.base[-12:]}_{table}"

    def shards(self) -> int:
        """Shards of the documents and of every index, equal so that joins are local."""
        return self._once("shards", lambda: runtime.default_shards(self.table("documents"), "text"))

    # -- documents ---------------------------------------------------------

    def plain_documents(self) -> DataFrame:
        """The documents table in the canonical columns, lazily."""
        title = F.substring_index("text", "\n", 1)
        rows = self.table("documents").select(
            F.col("doc_id").alias("id"), title.alias("title"),
            F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("content"),
            F.col("source").alias("category"), "lang",
        )
        return src.derive_columns(rows)

    def documents(self) -> DataFrame:
        """Documents with their vector where there is one.

        The full text is put together from title and content when it is read, so that no text is
        shuffled and written twice.
        """
        def make() -> DataFrame:
            vectors = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
            spread = self.plain_documents().drop("full_text").repartition(self.shards(), "id")
            # Dealt out alike, so that the join keeps the shards and no text is shuffled again.
            merged = embed.merge_embeddings(spread, vectors.repartition(self.shards(), "doc_id"))
            table = src.write_documents(merged, f"{self.base}/documents", self._name("documents"), self.shards())
            return table.withColumn("full_text", tx.full_text("title", "content"))
        return self._once("documents", make)

    def vectors(self) -> DataFrame:
        return self.documents().filter(F.col("embedding").isNotNull()).select(
            F.col("id").alias("doc_id"), "embedding"
        )

    # -- indexes -----------------------------------------------------------

    def _index(self, name: str, analyzer: Analyzer, column: str) -> LexicalIndex:
        return self._once(name, lambda: save_index(
            self.documents(), f"{self.base}/{name}", self._name(name), analyzer, column,
            term_buckets=TERM_BUCKETS, shards=self.shards(),
        ))

    def index(self) -> LexicalIndex:
        return self._index("full_text", Analyzer(), "full_text")

    def bounds(self) -> bounded.Bounds:
        """What a term adds at most, by blocks of documents of similar length."""
        return self._once("bounds", lambda: bounded.save_bounds(self.index(), f"{self.base}/full_text"))

    def content_index(self) -> LexicalIndex:
        return self._index("content", Analyzer(), "content")

    def english_index(self) -> LexicalIndex:
        return self._index("english", ENGLISH, "full_text")

    def cells(self):
        """(cell table, model) of the vectors."""
        def make():
            model = dense.train_cells(self.vectors(), N_CELLS)
            return dense.save_cells(dense.assign_cells(self.vectors(), model), f"{self.base}/cells"), model
        return self._once("cells", make)

    def cell_index(self) -> cl.CellIndex:
        """Cells whose number grows with the vectors, with residual codes."""
        return self._once("cell_index", lambda: cl.save_cells(self.vectors(), f"{self.base}/cell_index"))

    # -- queries -----------------------------------------------------------

    def _with_vectors(self, queries: DataFrame) -> DataFrame:
        """Each query takes the vector of the same number, a stand-in for a model.

        The label of that vector sets the weights, from 0 to 0.9 for the vector side.
        """
        vectors = self.table("embeddings").select(
            F.col("vec_id").alias("query_id"), "embedding",
            (F.col("label") / 10.0).alias("vector_weight"),
            ((F.lit(10) - F.col("label")) / 10.0).alias("keyword_weight"),
        )
        return queries.join(vectors, "query_id", "left")

    def keyword_table(self) -> DataFrame:
        return self._with_vectors(self.table("benchmark").select(
            F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("keyword").alias("category")
        ))

    def agent_table(self) -> DataFrame:
        """The first user turn of every conversation."""
        turns = self.table("conversations").filter(F.col("role") == "user")
        first = turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query"))
        return self._with_vectors(first.withColumn("category", F.lit("agent")))

    def _batch(self, name: str, make: Callable[[], DataFrame]) -> QueryBatch:
        return self._once(name, lambda: QueryBatch.measure(runtime.write_scratch(make(), name)))

    def keyword_queries(self, threshold: float | None = None) -> QueryBatch:
        batch = self._batch("keyword-queries", self.keyword_table)
        if threshold is None:
            return batch
        return batch.with_queries(batch.queries.withColumn("threshold", F.lit(threshold)))

    def agent_queries(self) -> QueryBatch:
        return self._batch("agent-queries", self.agent_table)

    # -- labels ------------------------------------------------------------

    def relevant_ids(self) -> DataFrame:
        return self.table("labels").filter(F.col("quality") == 1).select("doc_id")

    def spam_ids(self) -> DataFrame:
        return self.table("labels").filter(F.col("quality") == 0).select("doc_id")

    def trigrams(self) -> substring.TrigramIndex:
        return self._once("trigrams", lambda: substring.save_trigrams(self.documents(), f"{self.base}/content"))

    def containing(self, needle: str) -> DataFrame:
        return substring.containing(self.documents(), self.trigrams(), needle)

    def containing_needle(self) -> DataFrame:
        return self.documents().filter(tx.has_substring("content", NEEDLE))


_OPEN: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Corpus(spark, sf_dir)
    return _OPEN[key]
