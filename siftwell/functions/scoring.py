"""Column arithmetic for ranking: IDF, BM25, cosine, RRF, labels.

Scores are doubles where larger is better; distances are doubles where smaller
is better.  Every ranking orders by the score rounded to nine decimals and then
by document id, so that the order of a float sum cannot change a rank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published ranking parameters.
K1 = 1.2
B = 0.75
RRF_K = 60
MISSING_RANK = 1000
DEFAULT_WEIGHT = 0.5
RANK_DECIMALS = 9

# Display cut-points. They suit a corpus of a few documents and
# are parameters everywhere they are used.
HIGH_DF = 3
MEDIUM_DF = 7
LABEL_AVG_LENGTH = 45.0
LONG_FACTOR = 1.5
HIGH_SIMILARITY = 0.4
MODERATE_SIMILARITY = 0.25

# The texts of the length factor.
SHORT_TEXT = "boost (shorter than avg)"
LONG_TEXT = "penalty (longer than avg)"
NEUTRAL_TEXT = "neutral"


def idf(n_docs: Column, doc_freq: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1); NULL for a term found nowhere."""
    value = F.log((n_docs - doc_freq + 0.5) / (doc_freq + 0.5) + 1.0)
    return F.when(doc_freq > 0, value)


def bm25_term(idf_: Column, tf: Column, doc_len: Column, avg_len: Column,
              k1: float = K1, b: float = B) -> Column:
    """Contribution of one term to one document."""
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * doc_len / avg_len)
    return idf_ * tf * F.lit(k1 + 1.0) / (tf + norm)


def rank_key(score: Column | str) -> Column:
    return F.round(score, RANK_DECIMALS)


def rrf_term(weight: Column, rank: Column, k: int = RRF_K) -> Column:
    """Weighted reciprocal rank; a side without the document adds nothing."""
    return weight * F.coalesce(F.lit(1.0) / (rank + k).cast("double"), F.lit(0.0))


def rrf_term_missing(rank: Column, k: int = RRF_K, missing: int = MISSING_RANK) -> Column:
    """Unweighted reciprocal rank where an absent document has a very low rank."""
    return F.lit(1.0) / (F.coalesce(rank, F.lit(missing)) + k).cast("double")


def weight_or_default(weight: Column) -> Column:
    """Zero is a weight; only a missing one falls back."""
    return F.coalesce(weight, F.lit(DEFAULT_WEIGHT))


def mix_weights(mix: Column) -> tuple[Column, Column]:
    """(vector, keyword) weights for a mix from 0 (keyword) to 100 (vector)."""
    return mix / F.lit(100.0), (F.lit(100.0) - mix) / F.lit(100.0)


def cosine_distance(left: Column, right: Column) -> Column:
    """Cosine distance of two arrays, for single rows and small inputs.

    Array lambdas run outside generated code; bulk ranking uses
    :func:`siftwell.operators.dense.vector_topk`.
    """
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(norms > 0, F.lit(1.0) - dot(left, right) / norms)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def parse_vector(text: Column) -> Column:
    """``'[0.1,0.2]'`` to ``array<float>``; NULL when the text is not a vector."""
    return F.from_json(text, "array<float>")


def similarity_class(sim: Column, high: float = HIGH_SIMILARITY,
                     moderate: float = MODERATE_SIMILARITY) -> Column:
    return (F.when(sim > high, "High").when(sim > moderate, "Moderate").otherwise("Low"))


def rarity_level(doc_freq: Column, high: int = HIGH_DF, medium: int = MEDIUM_DF) -> Column:
    return F.when(doc_freq <= high, "HIGH").when(doc_freq <= medium, "MEDIUM").otherwise("LOW")


def length_factor(words: Column, avg_length: Column | float = LABEL_AVG_LENGTH,
                  long_factor: float = LONG_FACTOR) -> Column:
    avg = F.lit(avg_length) if isinstance(avg_length, (int, float)) else avg_length
    return (
        F.when(words < avg, SHORT_TEXT)
        .when(words > avg * long_factor, LONG_TEXT)
        .otherwise(NEUTRAL_TEXT)
    )


def fixed(value: Column, decimals: int) -> Column:
    """Number as text with a fixed count of decimals; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value.cast("double")))


def percent(share: Column, decimals: int = 1) -> Column:
    return F.concat(fixed(share * 100, decimals), F.lit("%"))
