"""Column expressions over text: tokens, counts, boundaries, snippets, headlines.

Everything here is a built-in expression, so it stays in the JVM and can be
used in any select or filter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token is, what separates two tokens, what separates two words.
WORD = r"[\p{L}\p{N}_]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
NON_WORD_CHAR = r"[^\p{L}\p{N}_]"
SPACES = r"\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside an array lambda an outer column may be inlined and evaluated again
    for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores, in text order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def tokens_with_compounds(text: Column | str) -> Column:
    """Like :func:`tokens`, but ``PG-1234`` also yields ``pg-1234`` itself."""

    def expand(word: Column) -> Column:
        bare = F.regexp_replace(word, rf"^{NON_WORD}|{NON_WORD}$", "")
        whole = F.when(F.size(tokens(word)) > 1, F.array(bare)).otherwise(F.array().cast("array<string>"))
        return F.concat(whole, tokens(word))

    return F.flatten(F.transform(F.split(F.lower(_col(text)), SPACES), expand))


def display_terms(query: Column | str) -> Column:
    """Terms shown to the reader: whitespace words of two or more characters.

    Order and duplicates are kept; this is not the analyzer used for ranking.
    """
    return F.filter(F.split(F.lower(_col(query)), SPACES), lambda t: F.length(t) >= 2)


def word_count(text: Column | str) -> Column:
    return F.size(F.split(_col(text), SPACES))


def full_text(title: Column | str, content: Column | str) -> Column:
    """Title, one space, content; NULL when either side is NULL."""
    return F.concat(_col(title), F.lit(" "), _col(content))


def literal_count(text: Column | str, term: Column) -> Column:
    """Non-overlapping occurrences of ``term``, taken literally, in ``text``.

    ``text`` must already have the letter case of ``term``.
    """
    text = _col(text)
    removed = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (removed / F.length(term)).cast("int")).otherwise(0)


def quoted(term: Column) -> Column:
    """``term`` as a regular expression that matches it literally."""
    inner = F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), inner, F.lit("\\E"))


def starts_and_ends_in_word(term: Column) -> Column:
    """A word boundary can only hold at both ends of such a term."""
    return term.rlike(rf"^[\p{{L}}\p{{N}}_](.*[\p{{L}}\p{{N}}_])?$")


def is_single_word(term: Column) -> Column:
    return term.rlike(r"^[\p{L}\p{N}_]+$")


def is_compound(term: Column) -> Column:
    """Starts and ends in a word but has something else inside, like ``pg-1234``."""
    return starts_and_ends_in_word(term) & ~is_single_word(term)


def has_whole_word(text: Column | str, term: Column) -> Column:
    """True when ``term`` stands between word boundaries in the lower-cased text."""
    pattern = F.concat(
        F.lit(f"(^|{NON_WORD_CHAR})"), quoted(term), F.lit(f"({NON_WORD_CHAR}|$)")
    )
    return starts_and_ends_in_word(term) & F.regexp_like(F.lower(_col(text)), pattern)


def has_substring(text: Column | str, needle: Column | str) -> Column:
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(_col(text)), needle)


def preview(text: Column | str, chars: int = 200) -> Column:
    return F.substring(_col(text), 1, chars)


def snippet(content: Column | str, matched: Column | str, max_chars: int = 120,
            start: str = "<mark>", stop: str = "</mark>") -> Column:
    """Short display text with the matched terms marked.

    The text is cut first and marked second, so a term cut in two stays plain.
    """
    content, matched = _col(content), _col(matched)
    cut = F.when(
        F.length(content) > max_chars,
        F.concat(F.substring(content, 1, max_chars), F.lit("...")),
    ).otherwise(content)
    any_term = F.concat(
        F.lit("(?iu)("), F.array_join(F.transform(matched, quoted), "|"), F.lit(")")
    )
    marked = F.regexp_replace(cut, any_term, F.lit(f"{start}$1{stop}"))
    return F.when(F.size(matched) > 0, marked).otherwise(cut)


def hit_positions(words: Column | str, surface_terms: Column | str) -> Column:
    """Zero-based positions of the words that contain one of the given tokens."""
    words = _col(words)

    def positions(surface: Column) -> Column:
        hit = lambda w, i: F.when(F.arrays_overlap(tokens(w), surface), i)
        return F.filter(F.transform(words, hit), lambda p: p.isNotNull())

    return let(_col(surface_terms), positions)


def best_window_start(hits: Column | str, n_words: Column | str,
                      max_words: int, min_words: int) -> Column:
    """Start of the window of ``max_words`` words holding most hits; earliest wins.

    Only windows that begin on a hit can be best, and a window can hold at most
    ``max_words`` hits, so the work is bounded by hits times ``max_words``.
    A window too close to the end is moved back until it has ``min_words`` words.
    """
    hits, n_words = _col(hits), _col(n_words)
    scored = F.transform(
        hits,
        lambda p, i: F.struct(
            F.size(F.filter(F.slice(hits, i + 1, F.lit(max_words)),
                            lambda q: q < p + max_words)).alias("n"),
            (-p).alias("neg_start"),
        ),
    )
    start = F.coalesce(-F.array_max(scored)["neg_start"], F.lit(0))
    return F.greatest(F.least(start, n_words - min_words), F.lit(0))


def mark_window(words: Column | str, hits: Column | str, window_start: Column | str,
                length: Column | str, start: str = "<mark>", stop: str = "</mark>") -> Column:
    """The words of the window joined by spaces, with the hits marked."""
    words, hits = _col(words), _col(hits)

    def mark(window: Column) -> Column:
        first, n = window["start"], window["n"]
        near = F.filter(hits, lambda p: (p >= first) & (p < first + n))
        wrap = lambda near_hits: F.transform(
            F.slice(words, first + 1, n),
            lambda w, i: F.when(
                F.array_contains(near_hits, i + first), F.concat(F.lit(start), w, F.lit(stop))
            ).otherwise(w),
        )
        return F.array_join(let(near, wrap), " ")

    return let(F.struct(_col(window_start).alias("start"), _col(length).alias("n")), mark)
