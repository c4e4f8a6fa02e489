"""BM25 top-k that leaves out postings which cannot change the list.

Documents are put in blocks of similar length, and the largest part that a term can add to
the score of a document of a block is stored beside the postings. A run first completes
the scores of a few documents that hold a query's rarest terms, so that it knows a score
which the k-th result has at least. In each block a query's terms are then ordered by
their bounds: while the terms from one on could reach that score together, their
postings are read; the postings of the others are only looked up for documents that are
still in reach, in two rounds, the reach shrinking with each.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import scoring as sc
from siftwell.operators import topk
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import LexicalIndex, join_postings, look_up_terms

#: Blocks of documents by length, and the share of a query's postings that is read to find its first documents.
BLOCKS = 8
SEED_SHARE = 0.05
# Fixed value: scores closer than this may be equal when rounded for ranking.
SLACK = 1e-8
#: Bytes of a row of a broadcast relation of numbers.
ROW_BYTES = 100


@dataclass(frozen=True)
class Bounds:
    """``table``: ``term_bucket, term, block, bound, n``; the bound is without the IDF."""

    table: DataFrame
    edges: tuple[int, ...]   # a document is in the block of the number of edges below its length
    k1: float
    b: float

    def block(self, doc_len: Column) -> Column:
        return sum(((doc_len > e).cast("int") for e in self.edges), F.lit(0))


def save_bounds(index: LexicalIndex, path: str, blocks: int = BLOCKS, k1: float = sc.K1, b: float = sc.B) -> Bounds:
    """Find and write the bounds of an index; they hold for its average length and these parameters."""
    spark = index.postings.sparkSession
    cuts = [i / blocks for i in range(1, blocks)]
    found = index.postings.agg(F.percentile_approx("doc_len", cuts)).first()[0] if cuts else []
    edges = tuple(sorted({int(e) for e in found or []}))
    empty = Bounds(index.postings, edges, k1, b)
    part = sc.bm25_term(F.lit(1.0), F.col("tf"), F.col("doc_len"), index.avg_len(), k1, b)
    table = index.postings.groupBy("term_bucket", "term", empty.block(F.col("doc_len")).alias("block")).agg(
        F.max(part).alias("bound"), F.count(F.lit(1)).alias("n")
    )
    (
        table.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term")
        .write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/bounds")
    )
    row = spark.createDataFrame([(list(edges), k1, b)], "edges array<long>, k1 double, b double")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/bound_edges")
    return load_bounds(spark, path)


def load_bounds(spark: SparkSession, path: str) -> Bounds:
    row = spark.read.parquet(f"{path}/bound_edges").first()
    return Bounds(spark.read.parquet(f"{path}/bounds"), tuple(row["edges"]), row["k1"], row["b"])


@dataclass(frozen=True)
class BoundedRun:
    """``results`` as of ``bm25_topk``, and ``reads``: ``query_id, stage, n``, the postings that were scored."""

    results: DataFrame
    reads: DataFrame


class _Run:
    def __init__(self, index: LexicalIndex, bounds: Bounds, batch: QueryBatch, k: int):
        self.index, self.bounds, self.batch, self.k = index, bounds, batch, k
        blocked = index.postings.withColumn("block", bounds.block(F.col("doc_len")))
        self.index_by_block = replace(index, postings=blocked)
        terms = look_up_terms(index, batch.query_terms(index.analyzer), batch)
        self.terms = runtime.write_scratch(terms.select("query_id", "term_bucket", "term", "idf", "doc_freq"), "bounded-terms")
        self.part = sc.bm25_term(F.col("idf"), F.col("tf"), F.col("doc_len"), index.avg_len(), bounds.k1, bounds.b)
        self.reads: list[DataFrame] = []

    def _counted(self, sums: DataFrame, stage: str) -> DataFrame:
        """Write partial scores; note how many postings they took."""
        sums = runtime.write_scratch(sums, f"bounded-{stage}")
        self.reads.append(sums.groupBy("query_id").agg(F.sum("n").alias("n")).select("query_id", F.lit(stage).alias("stage"), "n"))
        return sums

    def _sum(self, hits: DataFrame, *keys: str) -> DataFrame:
        return hits.groupBy(*keys).agg(F.sum(self.part).alias("score"), F.count(F.lit(1)).alias("n"))

    def _at_documents(self, lookups: DataFrame, rows: int) -> DataFrame:
        """Postings of given (doc_id, term), with the columns of ``lookups``.

        Few lookups are broadcast. More are joined where the postings lie, by document; the
        postings of other terms are left out first.
        """
        keys = ["term_bucket", "term", "doc_id"]
        postings = self.index.postings.drop("positions")
        if self.batch.fits(rows, rows * ROW_BYTES):
            return postings.join(F.broadcast(lookups), keys)
        wanted = self.terms.select("term_bucket", "term").distinct()
        if self.batch.terms_fit():
            postings = postings.join(F.broadcast(wanted), ["term_bucket", "term"], "left_semi")
        return postings.join(lookups, keys)

    def _of_documents(self, terms: DataFrame, n_terms: int, wide: QueryBatch, able: DataFrame) -> DataFrame:
        """Postings of planned terms for the (query, document) pairs that are in reach.

        Pairs that fit are broadcast and met by the postings where these lie; more of them become
        lookups, so that no posting meets a query for which its document is out of reach.
        """
        rows = able.count()
        if self.batch.fits(rows, rows * ROW_BYTES):
            hits = join_postings(self.index_by_block, terms, wide).filter(F.col("block") == F.col("_block")).drop("block")
            return hits.join(F.broadcast(able.select("query_id", "doc_id")), ["query_id", "doc_id"])
        side = terms.select("query_id", F.col("_block").alias("block"), "term_bucket", "term", "idf")
        lookups = able.join(F.broadcast(side) if self.batch.fits(n_terms) else side, ["query_id", "block"])
        return self._at_documents(lookups.select("query_id", "doc_id", "term_bucket", "term", "idf"), rows)

    def _reached(self, partial: DataFrame, stage: str, before: DataFrame | None) -> DataFrame:
        """``query_id, least``: the k-th of the full scores of each query's best documents so far."""
        best = topk.top_k(partial.select("query_id", "doc_id", "score"), self.k, "score").select("query_id", "doc_id")
        lookups = best.join(self.terms, "query_id")
        full = self._counted(
            self._sum(self._at_documents(lookups.select("query_id", "doc_id", "term_bucket", "term", "idf"), self.k * self.batch.n_tokens), "query_id", "doc_id"),
            stage,
        )
        least = full.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= self.k, F.min("score")).otherwise(0.0).alias("least"))
        if before is not None:
            both = least.unionByName(before)
            least = both.groupBy("query_id").agg(F.max("least").alias("least"))
        return runtime.write_scratch(least, f"{stage}-least")

    def seeds(self) -> DataFrame:
        """Terms of each query, from the rarest on, that hold a small share of its postings."""
        w = Window.partitionBy("query_id").orderBy("doc_freq", "term")
        summed = self.terms.withColumn("_sum", F.sum("doc_freq").over(w)).withColumn(
            "_all", F.sum("doc_freq").over(Window.partitionBy("query_id"))
        )
        return summed.filter((F.col("_sum") == F.col("doc_freq")) | (F.col("_sum") <= F.col("_all") * SEED_SHARE)).drop("_sum", "_all")

    def plan(self, least: DataFrame) -> DataFrame:
        """``query_id, _block, term_bucket, term, idf, stage, rest_0, rest_1``.

        Terms of stage 0 are read; those of 1 and 2 are looked up. ``rest_s`` is what the
        terms after stage s can add at most.
        """
        table = self.bounds.table
        side = self.terms.select("query_id", "term_bucket", "term", "idf")
        by_block = table.join(F.broadcast(side) if self.batch.terms_fit() else side, ["term_bucket", "term"]).select(
            "query_id", F.col("block").alias("_block"), "term_bucket", "term", "idf", (F.col("idf") * F.col("bound")).alias("ub")
        ).join(self.batch.per_query(least), "query_id", "left")
        group = Window.partitionBy("query_id", "_block")
        onward = group.orderBy(F.col("ub").desc(), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        ranked = by_block.withColumn("rest", F.sum("ub").over(onward))
        read = F.col("rest") >= F.coalesce(F.col("least"), F.lit(0.0)) - SLACK
        staged = ranked.withColumn("_read", read).withColumn("_left", F.sum((~F.col("_read")).cast("int")).over(group))
        nth = F.row_number().over(group.orderBy(F.col("_read").desc(), F.col("ub").desc(), "term")) - F.sum(F.col("_read").cast("int")).over(group)
        stage = F.when(F.col("_read"), 0).when(F.col("_nth") * 2 <= F.col("_left") + 1, 1).otherwise(2)
        staged = staged.withColumn("_nth", nth).withColumn("stage", stage)
        rest = lambda s: F.coalesce(F.max(F.when(F.col("stage") > s, F.col("rest"))).over(group), F.lit(0.0)).alias(f"rest_{s}")
        return runtime.write_scratch(staged.select("query_id", "_block", "term_bucket", "term", "idf", "stage", rest(0), rest(1)), "bounded-plan")

    def run(self) -> BoundedRun:
        first = self._counted(self._sum(join_postings(self.index, self.seeds(), self.batch), "query_id", "doc_id"), "seeds")
        least = self._reached(first, "first-documents", None)
        plan = self.plan(least)
        n_plan = plan.count()
        wide = replace(self.batch, n_tokens=n_plan, n_bytes=self.batch.n_bytes * (len(self.bounds.edges) + 1))
        hits = join_postings(self.index_by_block, plan.filter("stage = 0"), wide).filter(F.col("block") == F.col("_block"))
        partial = self._counted(self._sum(hits, "query_id", "block", "doc_id"), "read")
        least = self._reached(partial, "best-documents", least)
        reach = plan.groupBy("query_id", F.col("_block").alias("block")).agg(F.max("rest_0").alias("rest_0"), F.max("rest_1").alias("rest_1"))
        known = self.batch.per_query(least, 1)
        reach = reach.join(known, "query_id", "left")
        fits = self.batch.fits(self.batch.n_queries * (len(self.bounds.edges) + 1))
        reach = F.broadcast(reach) if fits else reach
        enough = lambda rest: F.col("score") + F.col(rest) >= F.coalesce(F.col("least"), F.lit(0.0)) - SLACK
        able = partial.join(reach, ["query_id", "block"]).filter(enough("rest_0")).select("query_id", "block", "doc_id", "score", "rest_1", "least")
        able = runtime.write_scratch(able, "in-reach-0")
        for stage in (1, 2):
            hits = self._of_documents(plan.filter(F.col("stage") == stage), n_plan, wide, able.select("query_id", "block", "doc_id"))
            more = self._counted(self._sum(hits, "query_id", "doc_id"), f"looked-up-{stage}")
            score = (F.col("score") + F.coalesce(F.col("more"), F.lit(0.0))).alias("score")
            able = able.join(more.select("query_id", "doc_id", F.col("score").alias("more")), ["query_id", "doc_id"], "left")
            able = able.select("query_id", "doc_id", "block", score, "rest_1", "least")
            if stage == 1:
                able = runtime.write_scratch(able.filter(enough("rest_1")), "in-reach-1")
        reads = self.reads[0]
        for more in self.reads[1:]:
            reads = reads.unionByName(more)
        return BoundedRun(topk.top_k(able.select("query_id", "doc_id", "score"), self.k, "score"), reads)


def bounded_run(index: LexicalIndex, bounds: Bounds, batch: QueryBatch, k: int = 10) -> BoundedRun:
    return _Run(index, bounds, batch, k).run()


def bm25_topk_bounded(index: LexicalIndex, bounds: Bounds, batch: QueryBatch, k: int = 10) -> DataFrame:
    """The same rows as ``bm25_topk`` over all matches, from a part of the postings."""
    return bounded_run(index, bounds, batch, k).results
