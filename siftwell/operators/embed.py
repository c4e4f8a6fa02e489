"""Text to vectors as batch stages, and merging vectors into documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.operators.analyze import Analyzer, with_terms

Embedder = Callable[[list[str]], list]


def _safe_vectors(embedder: Embedder, texts: list[str]) -> list:
    """Vectors of one batch; when the batch fails, one text at a time, NULL on failure."""
    try:
        return list(embedder(texts))
    except Exception:  # any failure of the supplied model must leave NULL, not end the job
        out = []
        for t in texts:
            try:
                out.append(embedder([t])[0])
            except Exception:
                out.append(None)
        return out


def embed_documents(docs: DataFrame, embedder: Embedder, text_column: str = "full_text",
                    id_column: str = "id", carry: list[str] | None = None) -> DataFrame:
    """``doc_id, embedding`` from any batch model ``list[str] -> list[vector]``.

    The callable is shipped to the tasks and called once per Arrow batch. The columns
    ``carry`` come along.
    """
    carry = carry or []

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known = f["text"].notna()
            vectors = pd.Series([None] * len(f), index=f.index, dtype=object)
            vectors[known] = pd.Series(
                _safe_vectors(embedder, f.loc[known, "text"].tolist()),
                index=f.index[known], dtype=object,
            )
            yield pd.DataFrame({"doc_id": f["doc_id"], "embedding": vectors, **{c: f[c] for c in carry}})

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), *carry)
    types = dict(rows.dtypes)
    return rows.mapInPandas(stage, ", ".join(["doc_id long", "embedding array<float>", *(f"{c} {types[c]}" for c in carry)]))


# -- a store of vectors that a run continues ------------------------------------


STORE = "doc_id long, text_hash long, run int, embedding array<float>"
#: Documents that are embedded and kept at a time.
SHARE_ROWS = 1_000_000


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that earlier runs have kept; none where there was no run."""
    try:
        return spark.read.schema(STORE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE)


def _keyed(docs: DataFrame, text_column: str, id_column: str) -> DataFrame:
    text = F.col(text_column)
    return docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def resume_embeddings(docs: DataFrame, path: str, embedder: Embedder, text_column: str = "full_text",
                      id_column: str = "id", share_rows: int = SHARE_ROWS) -> dict[str, int]:
    """Embed what the store at ``path`` lacks; returns the counts ``wanted``, ``kept`` and ``failed`` of this run.

    A document is wanted if the store has no vector for its present text. The wanted ones are
    found by keys and text hashes alone, cut by a hash of the key into shares of about
    ``share_rows``, and kept share by share, so that a run that ends early loses one share at
    most. A text whose embedding fails is not kept, so it is tried again in the next run.
    Documents without a text are not wanted.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, text_column, id_column).filter(F.col("text").isNotNull())
    have = open_store(spark, path)
    run = (have.agg(F.max("run")).first()[0] or 0) + 1
    keys = ["doc_id", "text_hash"]
    lacking = rows.select(*keys).join(have.select(*keys), keys, "left_anti")
    lacking = runtime.write_scratch(lacking, "lacking-vectors")
    n = lacking.count()
    shares = -(-n // share_rows)
    for i in range(shares):
        share = lacking if shares == 1 else lacking.filter(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(shares)) == i)
        made = embed_documents(rows.join(share, keys, "left_semi"), embedder, "text", "doc_id", carry=["text_hash"])
        made = made.filter(F.col("embedding").isNotNull()).select("doc_id", "text_hash", F.lit(run).alias("run"), "embedding")
        made.write.mode("append").parquet(path)
    kept = open_store(spark, path).filter(F.col("run") == run).count() if n else 0
    return {"wanted": n, "kept": kept, "failed": n - kept}


def stored_embeddings(docs: DataFrame, path: str, text_column: str = "full_text", id_column: str = "id") -> DataFrame:
    """``doc_id, embedding, run`` of every document: the vector of its present text and the run that made it, or NULL."""
    rows = _keyed(docs, text_column, id_column).select("doc_id", "text_hash")
    # Of the vectors of one text, which a repeated run may have made twice, the first counts.
    have = open_store(docs.sparkSession, path).groupBy("doc_id", "text_hash").agg(F.min_by(F.struct("embedding", "run"), "run").alias("v"))
    return rows.join(have, ["doc_id", "text_hash"], "left").select("doc_id", "v.embedding", "v.run")


def hashed_embeddings(docs: DataFrame, dims: int = 256, analyzer: Analyzer = Analyzer(),
                      text_column: str = "full_text", id_column: str = "id") -> DataFrame:
    """Offline embedding: hashed term frequencies, IDF weights, unit length.

    A text without terms has no direction and gets NULL.
    """
    kept = F.filter("terms", lambda t: t.isNotNull())
    terms = with_terms(docs, text_column, analyzer).select(
        F.col(id_column).alias("doc_id"), kept.alias("terms")
    )
    stages = Pipeline(stages=[
        HashingTF(inputCol="terms", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ])
    vectors = stages.fit(terms).transform(terms)
    values = vector_to_array("_unit", "float32")
    has_direction = F.exists(values, lambda v: v != 0)
    return vectors.select("doc_id", F.when(has_direction, values).alias("embedding"))


def merge_embeddings(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Attach vectors to documents by id; a document without a vector keeps NULL."""
    base = docs.drop("embedding")
    vectors = embeddings.select(F.col("doc_id").alias("id"), "embedding")
    return base.join(vectors, "id", "left")


def coverage(docs: DataFrame) -> DataFrame:
    """How many documents have a vector, and their mean dimension."""
    present = docs.filter(F.col("embedding").isNotNull())
    return present.agg(
        F.count(F.lit(1)).alias("n_embedded"),
        F.avg(F.size("embedding").cast("double")).alias("avg_dims"),
    )
