"""Quality by compression: which of two dictionaries describes a text more briefly.

Two zstandard dictionaries are built from good and from bad labelled text. A text
is compressed with each in pieces of a fixed size, so that the dictionary and not
the text's own past decides, over its whole length. The difference of the two
sizes, divided by their sum, is turned into a probability by logistic regression,
together with the compressed size per byte, which tells texts that repeat
themselves and that both dictionaries therefore describe equally well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siftwell import runtime
from siftwell.llm import arrays as ar
from siftwell.llm import training

# Bytes of a piece and of a dictionary, compression level.
PIECE, DICTIONARY, LEVEL = 512, 1 << 16, 3


@dataclass
class QualityModel:
    """Two dictionaries and the weights of the calibration; small enough to travel with a task."""

    good: bytes
    bad: bytes
    weights: np.ndarray

    def compressors(self) -> list:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def scores(self, texts: list[bytes], compressors: list | None = None) -> np.ndarray:
        x = features(texts, compressors or self.compressors())
        return training.logistic(x, self.weights)


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def features(texts: list[bytes], compressors: list) -> np.ndarray:
    """(normalised size difference in percent, log of compressed bytes per byte) of each text; an empty text has (0, -0.7)."""
    good, bad = compressors
    out = np.zeros((len(texts), 2))
    for i, raw in enumerate(texts):
        a = b = 0
        for piece in _pieces(raw):
            a += len(good.compress(piece))
            b += len(bad.compress(piece))
        out[i] = (100 * (b - a) / (a + b), np.log(min(a, b) / len(raw))) if raw else (0.0, -0.7)
    return out


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the plain text where there is too little to train on."""
    pieces = [p for raw in samples for p in _pieces(raw)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY:] or b"\n" * 8


def fit_quality(sample: list[tuple[bytes, int]]) -> QualityModel:
    """Dictionaries from one half of the sample, calibration on the other.

    With one class only, or none, the score is that of the share of good rows.
    """
    halves = sample[0::2], sample[1::2]
    model = QualityModel(*(_dictionary([t for t, y in halves[0] if (y == 1) == good]) for good in (True, False)), np.zeros(3))
    rest = halves[1] or [(b"", 1)]
    y = np.array([int(v == 1) for _, v in rest], float)
    x = features([t for t, _ in rest], model.compressors())
    model.weights = training.fit_logistic(x, y)
    return model


def score_quality(docs: DataFrame, model: QualityModel, into: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and one named by ``into`` (0 to 1); null counts as an empty text. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    @ar.tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tools = shared.value.compressors()
        for texts in batches:
            raw = [t.encode() if t else b"" for t in texts.to_pylist()]
            yield pa.array(shared.value.scores(raw, tools), pa.float64())

    return docs.withColumn(into, score(F.col("text")))


def quality_model(docs: DataFrame, labels: DataFrame, rows: int = training.SAMPLE_ROWS) -> QualityModel:
    """A model fitted on the whole texts of at most ``rows`` labelled documents whose crc32(doc_id) mod 3 is not 1."""
    runtime.ship_package(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").alias("label"))
    return fit_quality(training.labelled_sample(docs, known, ~training.held_out("doc_id", 3, 1), rows))
