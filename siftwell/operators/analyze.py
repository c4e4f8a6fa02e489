"""Text analysis: documents and queries to terms, without leaving the row.

An :class:`Analyzer` is a column expression, so analysis costs no join and no
shuffle whatever the size of the vocabulary: stop words are a fixed set tested
in place and stemming is an Arrow function over the token array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.functions.stemming import stem_tokens


def english_stop_words() -> list[str]:
    """The stop list that ships with Spark's feature library."""
    return StopWordsRemover.loadDefaultStopWords("english")


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms.

    ``simple``   lower-cased tokens.
    ``english``  tokens without stop words, stemmed. With ``lang_column`` set,
                 only rows whose language is ``en`` are treated so and all
                 others as ``simple``.
    ``keep_compounds`` also emits ``pg-1234`` next to ``pg`` and ``1234``.
    """

    config: str = "simple"
    keep_compounds: bool = False
    lang_column: str | None = None

    def __post_init__(self) -> None:
        if self.config not in ("simple", "english"):
            raise ValueError(f"unknown analyzer config: {self.config!r}")

    def terms(self, text: Column | str) -> Column:
        """``array<string>`` of terms; a removed stop word leaves a NULL.

        The NULLs keep later terms at their original position.
        """
        split = tx.tokens_with_compounds if self.keep_compounds else tx.tokens
        plain = split(text)
        return plain if self.config == "simple" else self.reduce(plain)

    def reduce(self, plain: Column) -> Column:
        """The terms of given tokens, position by position."""
        if self.config == "simple":
            return plain
        stop = english_stop_words()
        kept = F.transform(plain, lambda t: F.when(~t.isin(stop), t))
        if self.lang_column is None:
            return stem_tokens(kept)
        is_english = F.coalesce(F.col(self.lang_column) == "en", F.lit(False))
        return F.coalesce(stem_tokens(F.when(is_english, kept)), plain)


def with_terms(df: DataFrame, text_column: str, analyzer: Analyzer,
               out: str = "terms") -> DataFrame:
    return df.withColumn(out, analyzer.terms(text_column))


def tokenize(docs: DataFrame, analyzer: Analyzer, text_column: str = "full_text",
             id_column: str = "id") -> DataFrame:
    """One row per term occurrence: ``doc_id, pos, term``."""
    return (
        with_terms(docs, text_column, analyzer)
        .select(F.col(id_column).alias("doc_id"), F.posexplode_outer("terms").alias("pos", "term"))
        .filter(F.col("term").isNotNull())
    )


def entries_in_row(df: DataFrame) -> DataFrame:
    """Turn a ``terms`` array into one row per distinct term of the document.

    Sorting ``(term, position)`` inside the row and cutting the runs gives the
    term frequency and the positions without any shuffle: a document is one
    row, so all its occurrences are already together.  Each step is its own
    projection because a lambda would evaluate an inlined column per element.
    """
    occurrences = F.filter(
        F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))),
        lambda o: o["term"].isNotNull(),
    )
    carried = [c for c in df.columns if c != "terms"]
    ordered = df.select(*carried, F.sort_array(occurrences).alias("_occ"))
    counted = ordered.select(*carried, "_occ", F.size("_occ").alias("_n"))
    is_start = lambda i: (i == 0) | (F.get("_occ", i)["term"] != F.get("_occ", i - 1)["term"])
    runs = counted.select(
        *carried, "_occ", "_n",
        F.when(
            F.col("_n") > 0,
            F.filter(F.sequence(F.lit(0), F.col("_n") - 1), is_start),
        ).alias("_starts"),
    )

    def entry(start: Column, j: Column) -> Column:
        stop = F.coalesce(F.get("_starts", j + 1), F.col("_n"))
        return F.struct(
            F.get("_occ", start)["term"].alias("term"),
            F.transform(F.slice("_occ", start + 1, stop - start), lambda o: o["pos"]).alias("positions"),
        )

    # explode_outer: the inner form would add a filter that analyzes the text twice.
    exploded = runs.select(
        *carried, F.col("_n").cast("long").alias("doc_len"),
        F.explode_outer(F.transform("_starts", entry)).alias("_e"),
    )
    return exploded.filter(F.col("_e.term").isNotNull()).select(
        *carried, "doc_len", "_e.term",
        F.size("_e.positions").cast("long").alias("tf"), "_e.positions",
    )


def distinct_terms(df: DataFrame, analyzer: Analyzer, text_column: str) -> DataFrame:
    """Add ``terms``: the distinct analyzed terms of a row, NULLs dropped."""
    kept = F.filter(F.array_distinct("terms"), lambda t: t.isNotNull())
    return with_terms(df, text_column, analyzer).withColumn("terms", kept)
