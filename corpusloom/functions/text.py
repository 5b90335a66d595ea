"""Text functions as column expressions: they stay in the JVM and inside code generation wherever Spark allows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed value: what Python's split() takes for white space, as a class that Java and RE2 read alike.
SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Openings by which an answer is counted as a refusal or a preamble; only the first 200 characters are read.
REFUSAL_OPENINGS = (
    r"^I (?:can'?t|cannot|am unable|won'?t)",
    r"^I'?m sorry,? (?:but )?I",
    r"^I apologi[sz]e,? (?:but )?I",
    r"^Sorry,? (?:but )?I",
    r"^As an AI",
    r"^As a language model",
    r"^Here'?s? (?:the|your|a) rewrit",
    r"^Sure,? here'?s",
    r"^Of course[,!]?\s+Here",
    r"^Certainly[,!]?\s+Here",
    r"^Rewrite:?\s",
    r"^Rewritten text:?\s",
    r"^\*\*Rewrite",
    r"^\(?Note:",
)
REFUSAL = "(?i)" + "|".join(REFUSAL_OPENINGS)
#: A character of a word in any script, as a class that Java and RE2 read alike.
WORD = r"\p{L}\p{N}_"
#: Added before rounding, so that halves round alike in any engine.
NUDGE = 1e-9


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def n_words(c: Column | str) -> Column:
    """Words between white space, as len(text.split()); 0 for null."""
    return F.regexp_count(text_of(c), F.lit(f"[^{SPACE}]+"))


def tokens(c: Column | str) -> Column:
    """The words between white space; an empty array for null and blank."""
    return F.regexp_extract_all(text_of(c), F.lit(f"([^{SPACE}]+)"), F.lit(1))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text_of(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_refusal(c: Column | str) -> Column:
    return F.substring(text_of(c), 1, 200).rlike(REFUSAL)


def edits(a: str, b: str) -> int:
    """Levenshtein distance over all characters: a column of the table at a time, a bit for each character (Hyyrö 2003)."""
    if a == b:
        return 0
    n, first = min(len(a), len(b)), 0
    while first < n and a[first] == b[first]:
        first += 1
    n, last = n - first, 0
    while last < n and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    up, down = every, 0  # rows where the column rises or falls by one
    for c in b:
        x = places.get(c, 0) | down
        same = ((((x & up) + up) ^ up) | x) & every
        right, left = down | (every ^ (up | same)), up & same
        x = (right << 1 | 1) & every
        up, down = (left << 1 & every) | (every ^ (x | same)), x & same
    return len(b) + up.bit_count() - down.bit_count()


def _edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


#: Of two text columns, in Arrow batches: Spark's levenshtein is too slow on whole texts. Null where one is null.
edit_distance = F.pandas_udf(_edit_distance, LongType())


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - levenshtein / longer length over the whole texts; 0 where both are empty."""
    a, b = text_of(a), text_of(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(1 - edit_distance(a, b) / longer)


def ngrams(words: Column, n: int) -> Column:
    """The distinct runs of n items of an array, joined by blanks."""
    if n == 1:
        return F.array_distinct(words)
    starts = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, n)])))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: 1 where both are empty, 0 where one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def n_sentences(t: Column) -> Column:
    """Pieces between runs of . ! ? before white space or the end that aren't blank; at least 1."""
    return F.greatest(F.size(F.filter(F.split(t, f"[.!?]+(?:[{SPACE}]+|$)"), lambda s: s.rlike(f"[^{SPACE}]"))), F.lit(1))


def surface(c: Column | str) -> dict[str, Column]:
    """Word, character, sentence and punctuation statistics; rates are 0 where there are no words."""
    t = text_of(c)
    words = F.regexp_extract_all(t, F.lit(f"([{WORD}]+)"), F.lit(1))
    n, sents = F.size(words), n_sentences(t)
    rate = lambda x: F.when(n > 0, F.round(x / n + NUDGE, 6)).otherwise(0.0)
    return {
        "n_words": n,
        "n_chars": F.length(t),
        "n_sents": sents,
        "avg_word_len": rate(F.length(F.array_join(words, ""))),
        "avg_sent_len": F.round(n / sents, 6),
        "type_token_ratio": rate(F.size(F.array_distinct(F.transform(words, F.lower)))),
        "punct_rate": rate(F.regexp_count(t, F.lit(r"[\.,;:!?\-\"'()\[\]]"))),
    }


def readability(c: Column | str) -> dict[str, Column]:
    """Coleman-Liau, LIX, ARI and shares of stop words, capitals and marks, from counts alone; 0 for wordless texts."""
    t = text_of(c)
    words = F.regexp_extract_all(t, F.lit(r"(\p{L}+)"), F.lit(1))
    n, sents = F.size(words), n_sentences(t)
    letters = F.length(F.array_join(words, ""))
    long_words = F.size(F.filter(words, lambda w: F.length(w) > 6))
    stop = F.size(F.filter(words, lambda w: F.lower(w).isin("the", "a", "an", "of", "to", "in", "and", "is", "it", "that", "for", "on", "with", "as", "was")))
    some = lambda x: F.when(n > 0, F.round(x + NUDGE, 6)).otherwise(0.0)
    return {
        "coleman_liau": some(5.88 * letters / n - 29.6 * sents / n - 15.8),
        "lix": some(n / sents + 100.0 * long_words / n),
        "ari": some(4.71 * letters / n + 0.5 * n / sents - 21.43),
        "stop_rate": some(stop / n),
        "caps_rate": some(F.size(F.filter(words, lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))) / n),
        "exclaim_rate": some(F.regexp_count(t, F.lit("!")) / n),
        "quote_rate": some(F.regexp_count(t, F.lit('"')) / n),
    }


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def clean(a: Column) -> Column:
    """NaN and infinities as 0."""
    return F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))


def fit_width(a: Column, width: int) -> Column:
    """Zeros on the right up to the width, cut off beyond it."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), width)), 1, width)
