"""English stemming (Porter 1980) as an Arrow function over token arrays.

One Arrow batch arrives as a list column.  Its values are dictionary-encoded,
only the distinct tokens of the batch are stemmed, and the result is put back
under the same offsets; no token is handled twice and no row leaves its task.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of the published algorithm, (suffix, replacement).
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

_ASCII_WORD = re.compile(r"^[a-z]+$")


def _shape(word: str) -> str:
    """'c' and 'v' per letter; y is a vowel after a consonant."""
    shape = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and shape[i - 1] == "c")
        shape.append("v" if vowel else "c")
    return "".join(shape)


def _measure(stem: str) -> int:
    """Number of vowel-to-consonant changes, the m of the published rules."""
    return _shape(stem).count("vc")


def _ends_cvc(stem: str) -> bool:
    return len(stem) >= 3 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" \
                    and stem[-1] not in "lsz":
                return stem[:-1]
            if _measure(stem) == 1 and _ends_cvc(stem):
                return stem + "e"
            return stem
    return word


def _replace_suffix(word: str, rules: list[tuple[str, str]]) -> str:
    table = dict(rules)
    suffix = _longest(word, table)
    if suffix and _measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + table[suffix]
    return word


def _drop_suffix(word: str) -> str:
    suffix = _longest(word, STEP4)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
        return stem
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 18)
def porter_stem(word: str) -> str:
    """Stem of one lower-case word; words of other alphabets come back unchanged."""
    if len(word) <= 2 or not _ASCII_WORD.match(word):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_suffix(word, STEP2)
    word = _replace_suffix(word, STEP3)
    return _tidy(_drop_suffix(word))


def _stem_lists(lists: pa.Array) -> pa.Array:
    flat = lists.flatten()
    encoded = pc.dictionary_encode(flat)
    stems = pa.array([porter_stem(w) for w in encoded.dictionary.to_pylist()], pa.string())
    values = stems.take(encoded.indices)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0] + lengths.cumsum().tolist(), pa.int32())
    mask = pc.is_null(lists)
    return pa.ListArray.from_arrays(offsets, values, mask=mask)


def stem_tokens(tokens: Column) -> Column:
    """Stem every token of an ``array<string>``; NULL tokens and arrays stay NULL."""

    def run(batch: pa.Array) -> pa.Array:
        return _stem_lists(batch)

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(tokens)
