"""Column functions on text: blanks, words, shingles, n-grams."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.fixed_values import BLANK, BLANK_CHARS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column expression used twice is planned twice, and one used inside a lambda runs once
    per element; a bound lambda variable does neither.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever is done with them later.

    Catalyst moves a filter on a plain column below it and repeats the expression there. A
    generated column stays where it is: the filter runs above it, on the value.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)


def strip_blanks(text: Column) -> Column:
    """Remove leading and trailing Unicode blanks in linear time."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def blank_words(text: Column) -> Column:
    """Words between runs of Unicode blanks; an empty text has no words."""
    return F.array_remove(F.split(text, BLANK + "+"), "")


def normalize_text(text: Column, unicode: bool = False) -> Column:
    """Lower-case and drop what is neither a word character nor a blank.

    The default keeps ASCII word characters only (``für`` becomes ``fr``);
    ``unicode=True`` keeps letters and digits of every script.
    """
    pattern = r"[^\p{L}\p{N}_\s]" if unicode else r"[^\w\s]"
    return F.regexp_replace(F.lower(text), pattern, "")


def shingle_words(text: Column, unicode: bool = False) -> Column:
    """Distinct words of the normalised text.

    An empty text keeps the single shingle ``''``, so it is never filtered out
    and all empty texts are copies of each other.
    """
    return F.array_distinct(F.split(normalize_text(text, unicode), r"\s+"))


def word_ngrams(words: Column, n: int) -> Column:
    """Set of word n-grams; words hold no blanks, so the joined form is unique."""
    if n == 1:
        return F.array_distinct(words)

    def grams(bound: Column) -> Column:
        joined = F.transform(
            F.sequence(F.lit(1), F.size(bound) - F.lit(n - 1)),
            lambda i: F.array_join(F.slice(bound, i, n), " "),
        )
        return F.when(F.size(bound) >= n, F.array_distinct(joined)).otherwise(
            F.array().cast("array<string>")
        )

    return let(words, grams)


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two arrays of distinct values; null when both are empty."""
    return let(a, lambda x: let(b, lambda y: let(
        F.size(F.array_intersect(x, y)),
        lambda shared: F.try_divide(shared, F.size(x) + F.size(y) - shared),
    )))


def count_substring(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    without = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.length(text) - without) / F.lit(len(needle))).cast("int")
